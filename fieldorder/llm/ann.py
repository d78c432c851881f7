"""Approximate nearest neighbours with a forest of hash prefixes.

Every vector has, per tree, a long string of sign bits of random projections; a tree is the sorted array of these
strings. A query descends to its longest common prefixes, then all trees ascend together, one bit at a time, and
what comes to share the shorter prefix is compared exactly. The ascent of a query ends when a neighbour at the
angle of its k-th best would have been missed by all trees with probability 1 - ``recall`` at most, so easy queries
stop early and hard ones look at more; no number of candidates is fixed.

Rows are indexed in blocks of bounded size, each with its own forest; queries, in blocks too, visit all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trees, bits of a string, rows and queries of a block.
TREES, BITS, ROWS, QUERIES = 96, 32, 32_768, 4_096


def usable(v: str) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    x = F.col(v)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0), F.lit(False))


class Forest:
    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int = 7):
        self.x, self.trees, self.bits = x, trees, bits
        self.mean = x.mean(0)
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
        self.unit = self.directions(x)
        strings = self.strings(x)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def directions(self, x: np.ndarray) -> np.ndarray:
        y = x - self.mean
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """One unsigned number of ``bits`` bits per row and tree."""
        out = np.empty((len(x), self.trees), np.uint64)
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for at in range(0, len(x), 2048):
            sign = (x[at : at + 2048] - self.mean) @ self.planes > 0
            out[at : at + 2048] = (sign.reshape(-1, self.trees, self.bits) * weight).sum(2, dtype=np.uint64)
        return out

    def search(self, q: np.ndarray, own: list[np.ndarray], k: int, recall: float):
        """Per query the rows found, nearest first, with their distances; ``own`` are row numbers to leave out."""
        strings = self.strings(q)
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for depth in range(self.bits, -1, -1):
            low = (strings >> np.uint64(self.bits - depth)) << np.uint64(self.bits - depth)
            high = low | np.uint64((1 << (self.bits - depth)) - 1)
            a = np.empty(low.shape, np.int64)
            b = np.empty(low.shape, np.int64)
            for t in range(self.trees):
                a[:, t] = np.searchsorted(self.sorted[:, t], low[:, t], "left")
                b[:, t] = np.searchsorted(self.sorted[:, t], high[:, t], "right")
            ends[depth] = (a, b)
        directions = self.directions(q)
        for i in range(len(q)):
            seen = np.zeros(len(self.x), bool)
            seen[own[i]] = True
            found, dist = np.empty(0, np.int64), np.empty(0)
            a1 = b1 = None
            for depth in range(self.bits, -1, -1):
                a, b = ends[depth][0][i], ends[depth][1][i]
                if depth == 0:
                    new = np.flatnonzero(~seen)
                else:
                    if a1 is None:
                        runs = [self.order[u:v, t] for t, (u, v) in enumerate(zip(a, b)) if v > u]
                    else:
                        runs = [self.order[u:w, t] for t, (u, w) in enumerate(zip(a, a1)) if w > u]
                        runs += [self.order[w:v, t] for t, (w, v) in enumerate(zip(b1, b)) if v > w]
                    a1, b1 = a, b
                    new = np.unique(np.concatenate(runs)) if runs else np.empty(0, np.int64)
                    new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    d = np.sqrt(((self.x[new] - q[i]) ** 2).sum(1))
                    found, dist = np.concatenate([found, new]), np.concatenate([dist, d])
                    if len(found) > 4 * k:  # only ties with the k-th and better can matter
                        keep = dist <= np.partition(dist, k - 1)[k - 1]
                        found, dist = found[keep], dist[keep]
                if len(found) >= k and depth:
                    best = found[np.argpartition(dist, k - 1)[:k]]
                    angle = np.arccos(np.clip((self.unit[best] @ directions[i]).min(), -1.0, 1.0))
                    if (1 - (1 - angle / np.pi) ** depth) ** self.trees <= 1 - recall:
                        break
            yield found, dist


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.96, key: str = "vec_id", vector: str = "embedding",
    trees: int = TREES, bits: int = BITS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found by Euclidean distance, ties to smaller ids.

    Rows with the query's own id are left out; rows without an id and unusable vectors (see ``usable``) take no part,
    on either side. Only vectors of one dimension meet. Repeated rows count once. With fewer than k others, all are returned; no usable
    rows give an empty result. Distances are in double precision on the vectors as given.
    """
    known = usable(vector) & F.col(key).isNotNull()
    r = rows.where(known).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(known).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n_rows, n_queries = max(1, -(-r.count() // ROWS)), max(1, -(-q.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = r.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n_rows)).cast("int").alias("rb"), "id", "v")
    r = r.select("*", every(n_queries).alias("qb"))
    q = q.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int").alias("qb"), "id", "v")
    q = q.select("*", every(n_rows).alias("rb"))
    keys = ["dim", "rb", "qb"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def arrays(t: pa.Table):
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks()
        v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        table = np.column_stack([ids.view(np.float64), x]) if len(ids) else np.empty((0, 1))
        once = np.unique(np.ascontiguousarray(table).view(np.void(table.shape[1] * 8).dtype).ravel(), return_index=True)[1] if len(ids) else []
        return ids[once], x[once]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            (ids, x), (qids, qx) = arrays(left), arrays(right)
            # components whose squares leave double precision are scaled by a power of two, which changes no digit
            largest = max(np.abs(x).max(), np.abs(qx).max())
            scale = 2.0 ** np.frexp(largest)[1] if largest > 1e150 else 1.0
            x, qx = x / scale, qx / scale
            forest = Forest(x, trees, bits)
            own = [np.flatnonzero(ids == i) for i in qids]
            for qid, (found, dist) in zip(qids, forest.search(qx, own, k, recall)):
                best = np.lexsort((ids[found], dist))
                seen: set[int] = set()
                for j in best:
                    if len(seen) == k:
                        break
                    if (i := int(ids[found[j]])) not in seen:
                        seen.add(i)
                        for c, value in zip(out, (int(qid), i, float(dist[j] * scale))):
                            c.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    near = r.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return near.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
