"""Hard negatives by a secondary sort.

For every anchor, rows of its label with the highest scores are its positives, and rows of other labels that score
within a band below a positive are that positive's hard negatives. Scores are packed into keys (anchor, descending
score, kind, id); ``repartitionAndSortWithinPartitions`` brings an anchor's pairs together in order, and one streaming
pass opens a window at each positive and emits negatives while they fall into it. A window holds two numbers and a
count, so no anchor's pairs are ever held together.

Rows and anchors meet in blocks of bounded size, and a block sends on only what can be part of a result: per anchor
the first few rows of its label, then, with the positives known, the first few rows of other labels in each of its
windows. The shuffled pairs grow with the number of anchors and blocks and not with anchors times rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.llm.common import partitions, written

#: Vector components of a block of rows and of a block of anchors, and scores computed at a time.
ROW_CELLS, ANCHOR_CELLS, TILE = 1_000_000, 1_000_000, 4_000_000

#: Scores are held between the ends of a long.
TOP = 2**63 - 1

PAIR = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def usable(label: str, vector: str) -> Column:
    """A label, and a vector without null or non-finite components."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite, F.lit(False))


def _vectors(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
    return v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1 if t.num_rows and len(v.flatten()) else 0)


def scores(a: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of floor(scale * component): exact in doubles while all sums stay below 2^53, else in integers."""
    with np.errstate(over="ignore"):
        p, q = np.floor(a * scale), np.floor(x * scale)
    if max(1.0, np.abs(p).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53:
        return (p @ q.T).astype(np.int64)
    whole = lambda m: [[int(c) * scale if abs(c) >= 2**53 else math.floor(c * scale) for c in r] for r in m.tolist()]
    left, right = whole(a), whole(x)
    out = [[max(-TOP, min(TOP, sum(map(int.__mul__, u, v)))) for v in right] for u in left]
    return np.array(out, np.int64).reshape(len(a), len(x))


def first(score: np.ndarray, may: np.ndarray, n: int):
    """(line, row) positions of each line's n highest scores among those that may; ties to the first row."""
    left = np.where(may, score, -TOP - 1)
    line = np.arange(len(left))
    for _ in range(min(n, left.shape[1])):
        best = left.argmax(1)
        good = left[line, best] > -TOP - 1
        if not good.any():
            return
        yield line[good], best[good]
        left[line, best] = -TOP - 1


def _meet(rows: DataFrame, anchors: DataFrame, by: list[str], pick, scale: int) -> DataFrame:
    """Distinct anchor, id, score of all blocks: ``pick(score, row ids, row labels, anchors, from, to)`` gives positions."""
    anchors = anchors.toDF(*anchors.columns)  # columns of their own: anchors come from the rows
    cells = [d.agg(F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(1))), F.lit(1))).first()[0] for d in (rows, anchors)]
    n_rows, n_anchors = -(-cells[0] // ROW_CELLS), -(-cells[1] // ANCHOR_CELLS)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.size("v").alias("dim"), block(n_rows).alias("rb")).select("*", every(n_anchors).alias("ab"))
    right = anchors.select("*", F.size("v").alias("dim"), block(n_anchors).alias("ab")).select("*", every(n_rows).alias("rb"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple] = [(np.empty(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("id"), right.sort_by("id")
            x, a = _vectors(left), _vectors(right)
            ids, labels, own = (c.to_numpy() for c in (left.column("id"), left.column("label"), right.column("id")))
            step = max(1, TILE // len(ids))
            for at in range(0, len(own), step):
                s = scores(a[at : at + step], x, scale)
                for line, row in pick(s, ids, labels, right.slice(at, step)):
                    parts.append((own[at + line], ids[row], s[line, row]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=PAIR)

    keys = ["dim", "rb", "ab", *by]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "anchor long, id long, score long")
    return met.distinct()


def mine(
    rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    key: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of components taken as floor(scale x); higher scores come first, ties go to smaller
    ids. ``anchors`` is an SQL condition on ``id``. Per anchor the first ``positives`` other rows of its label are
    its positives, and per positive the first ``negatives`` rows of other labels with low p <= 100 n <= high p are
    returned (p, n: their scores; none if p is negative).

    Rows without id or label and vectors that are null or hold null or non-finite components take no part; an empty
    vector is a vector. Of rows with one id the one with the smallest label, then vector, takes part, so repeated
    rows count once. Only vectors of one length meet. Scores beyond a long are held at its ends. Where there are
    fewer rows, fewer are returned; an empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    r = rows.where(usable(label, vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    r = r.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    r = written(r, "vectors")
    a = r.where(anchors)

    def same_label(s, ids, labels, block):
        return first(s, block.column("id").to_numpy()[:, None] != ids, positives)

    def in_windows(s, ids, labels, block):
        other = block.column("label").to_numpy()[:, None] != labels
        listed = block.column("opened").to_pylist()
        for j in range(positives):
            ends = [(-(-low * p[j] // 100), min(TOP, high * p[j] // 100)) if len(p) > j else (1, 0) for p in listed]
            least, most = (np.array(e, np.int64)[:, None] for e in zip(*ends))
            yield from first(s, other & (s >= least) & (s <= most), negatives)

    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id")
    opened = _meet(r, a, ["label"], same_label, scale).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    opened = written(opened.drop("n"), "positives")
    windows = opened.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("opened"))
    below = _meet(r, a.join(windows, "id"), [], in_windows, scale)

    pairs = opened.withColumn("kind", F.lit(0)).unionByName(below.withColumn("kind", F.lit(1)))
    keyed = pairs.rdd.map(lambda p: ((p["anchor"], -p["score"], p["kind"], p["id"]), None))

    def stream(part):
        anchor, windows = None, []
        for (at, less, kind, row), _ in part:
            if at != anchor:
                anchor, windows = at, []
            if kind == 0:
                windows.append([row, -less, 0])
                continue
            for w in windows:
                if w[2] < negatives and low * w[1] <= -100 * less <= high * w[1]:
                    w[2] += 1
                    yield at, w[0], w[2], row, w[1], -less

    mixed = lambda k: (k[0] * 0x9E3779B97F4A7C15 % 2**64) >> 33
    ordered = keyed.repartitionAndSortWithinPartitions(partitions(spark), mixed).mapPartitions(stream)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(ordered, out, verifySchema=False)
