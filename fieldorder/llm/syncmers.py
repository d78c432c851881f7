"""Document fingerprints of closed syncmers.

Of all stretches of K code points a text's anchors are those whose least stretch of S code points (by hash) lies at
one of their ends. Whether a stretch is an anchor depends on nothing outside it, so a passage has the same anchors
wherever it stands, and any K - S consecutive stretches hold one: anchors are never further apart. A fingerprint lists
the anchors' hashes and the steps between them; two fingerprints are compared by the anchors they share at places
that agree.

A document is also compared with the document after it and with a text made of both, so the corpus is cut into
ranges of ids, each streamed in order by one task that holds two documents; the first document of a range is sent to
the range before it, too.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldorder.llm.common import hold, partitions, small_batches

#: Code points of an anchor and of the inner stretches that decide on it.
K, S = 40, 8

#: Code points that are hashed at a time.
SEGMENT = 1 << 18

#: One anchor of a fingerprint: a hash, and the step from the anchor before it (from the text's start: plus one).
ANCHOR = np.dtype([("hash", "<u4"), ("step", "u1")])

_MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: Powers of an odd number and of its inverse, modulo 2^64: sums of prefixes give the hash of any stretch.
_UP, _DOWN = _powers(_MULTIPLIER), _powers(pow(_MULTIPLIER, -1, 2**64))


def _selected(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors of at most SEGMENT code points."""
    n = len(points)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    inner = _mixed((sums[s:] - sums[:-s]) * _DOWN[: n - s + 1])
    wide = k - s + 1  # inner stretches of an anchor
    least, done = inner, 1
    while done < wide:
        step = min(done, wide - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    at = np.flatnonzero((inner[: n - k + 1] == least) | (inner[k - s :] == least))
    return at, (_mixed((sums[at + k] - sums[at]) * _DOWN[at]) >> np.uint64(32)).astype(np.uint32)


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of every text's anchors, ascending; a text too short to have one is an anchor, an empty one none.

    Short texts are hashed together and long ones in stretches that overlap by k - 1: the anchors are the same.
    """
    out: list = [(np.empty(0, np.int64), np.empty(0, np.uint32))] * len(texts)
    held: list[tuple[int, np.ndarray]] = []

    def run():
        at, hashes = _selected(np.concatenate([x for _, x in held]), k, s)
        begin = 0
        for i, x in held:
            a, b = np.searchsorted(at, [begin, begin + len(x) - k + 1])
            out[i] = (at[a:b] - begin, hashes[a:b])
            begin += len(x)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        if len(text) < k:
            continue
        if len(text) > SEGMENT // 2:
            parts = []
            for begin in range(0, len(text) - k + 1, SEGMENT - k + 1):
                at, hashes = _selected(_points(text[begin : begin + SEGMENT]), k, s)
                parts.append((at + begin, hashes))
            out[i] = tuple(map(np.concatenate, zip(*parts)))
        else:
            if size + len(text) > SEGMENT:
                run()
                size = 0
            held.append((i, _points(text)))
            size += len(text)
    if held:
        run()
    for i, text in enumerate(texts):
        if text and not len(out[i][0]):
            raw = text.encode("utf-8", "surrogatepass")
            out[i] = (np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(raw)], np.uint32))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprint(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Anchors as base64 text, five bytes each; anchors are at most K - S apart, so a step fits in a byte."""
    out = np.empty(len(found[0]), ANCHOR)
    out["hash"], out["step"] = found[1], np.diff(found[0], prepend=-1)
    return base64.b64encode(out.tobytes()).decode()


def read_fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(base64.b64decode(text), ANCHOR)
    return np.cumsum(found["step"].astype(np.int64)) - 1, found["hash"]


def _keys(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number among equal hashes, packed and sorted, with the places."""
    at, hashes = found
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    number = np.arange(len(h))
    first = np.concatenate([[True], h[1:] != h[:-1]])
    return (h.astype(np.uint64) << np.uint64(32)) | (number - np.maximum.accumulate(np.where(first, number, 0))).astype(np.uint64), at[order]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of anchors (of both, 0 to 1) that match at agreeing places.

    Equal hashes are matched first with first, second with second; a match counts if another one is shifted by the
    same number of code points, or if one side has a single anchor. Two empty fingerprints are alike (1).
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (x, p), (y, q) = _keys(a), _keys(b)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = y[at] == x
    matched = int(same.sum())
    if matched and min(len(x), len(y)) > 1:
        votes = np.unique(p[same] - q[at[same]], return_counts=True)[1]
        matched = int(votes[votes > 1].sum())
    return 2 * matched / (len(x) + len(y))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many first code points of the next document, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def edited_anchors(text: str, own: tuple, after: str, later: tuple, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of ``edited(text, after)`` from those of both texts: only stretches across the seam are hashed."""
    half = len(text) // 2
    keep, taken = len(text) - half, min(half, len(after))
    if min(keep + taken, len(text), len(after)) < 2 * k:  # one of them may be too short to have anchors
        return anchors([edited(text, after)], k, s)[0]
    begin = max(0, keep - k + 1)
    seam = text[begin:keep] + after[: min(taken, k - 1)]
    at, hashes = _selected(_points(seam), k, s)
    left, right = np.searchsorted(own[0], keep - k, "right"), np.searchsorted(later[0], taken - k, "right")
    return np.concatenate([own[0][:left], at + begin, later[0][:right] + keep]), np.concatenate([own[1][:left], hashes, later[1][:right]])


def _place() -> list[Column]:
    """Order of rows: id (null last), then hash of the text, then a salt that spreads repeated rows."""
    return [
        F.col("doc_id").isNull().cast("long").alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64("text").alias("_hash"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    ]


KEY = ["_none", "_id", "_hash", "_salt"]
OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row per row.

    ``docs`` (doc_id, a whole number, and text; other columns are not read) is read twice and must give the same
    rows both times, as a written table does. Documents follow each other by id, null last; rows of one id go by a
    hash of their text; repeated rows follow each other in any order, with the same results. The last document is
    followed by the first, and a single one by itself. Null text is empty; an empty text has an empty fingerprint.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    keys = docs.select(*_place()).repartitionByRange(n, *KEY)
    first = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    first = sorted(map(tuple, first.collect()))  # one row per range
    bounds = spark.sparkContext.broadcast(first)

    @F.pandas_udf("array<int>")
    def ranges(none: pd.Series, ids: pd.Series, hashes: pd.Series, salt: pd.Series) -> pd.Series:
        """The row's range; the first row of a range also goes to the range before it, as the one that follows."""
        from bisect import bisect_right

        out = []
        for key in zip(none.tolist(), ids.tolist(), hashes.tolist(), salt.tolist()):
            at = bisect_right(bounds.value, key) - 1
            out.append([at, (at - 1) % len(bounds.value)] if bounds.value[at] == key else [at])
        return pd.Series(out)

    d = docs.select("*", *_place()).withColumn("_to", ranges(*KEY))
    d = d.select("*", F.posexplode("_to").alias("_ends", "_range")).drop("_to")
    d = d.repartitionById(max(1, len(first)), F.col("_range")).sortWithinPartitions("_ends", *KEY).select("doc_id", "text", "_ends")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(OUT)])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        hold(None)
        last = None  # the document whose successor is still to come, with its anchors
        ended = True

        def chunks():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()))

        for rows in chunks():
            out = []
            for row, found in zip(rows, anchors([t for _, t, _ in rows], k, s)):
                if last is not None:
                    (i, text, _), own = last
                    changed = edited_anchors(text, own, row[1], found, k, s)
                    digest = hashlib.sha256(edited(text, row[1]).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((i, len(text), digest, fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, found)))
                ended = row[2] == 1
                last = None if ended else (row, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
        if not ended:
            raise RuntimeError("the documents differ between two reads; write them to a table first")

    return d.mapInArrow(run, schema)
