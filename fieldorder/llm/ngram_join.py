"""Set-similarity join of documents on word n-grams, with rare-first prefixes.

A document's set is its distinct n-grams. Ordered rare first, two sets of the needed similarity share an n-gram
within their prefixes; the length filter and the positional filter hold or drop a pair where it is found, the
suffix filter before it is verified, and each pair is verified once by the size of its intersection.

* Equal sets are one row from the start; copies follow their set.
* An n-gram that only one set has can be in no intersection and comes first in every order. So what is passed on are
  the others, found by bringing equal hashes together in buckets; a set whose prefix has none of them is done.
* The most frequent n-grams (counted first, in bounded summaries) never travel: they are last in the order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.llm.common import Digests, digest64, digest128, map_rows, partitions, written
from fieldorder.llm.components import components, link_members

#: Counters of the summary of frequent n-grams; n-grams of one bucket; n-grams of one batch of documents.
COUNTERS, BUCKET, CHUNK = 65_536, 2_000_000, 1_000_000

#: A set's digest as numpy sorts it.
DIGEST = np.dtype([("a", "<u8"), ("b", "<u8")])

_MEMO = Digests(digest64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text, A-Z lower-cased; fewer words are one gram."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.frombuffer(_MEMO.of(words), "<u8").astype(np.uint64)
    k = min(n, len(words))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def prefix(n: int, percent: int) -> int:
    """Length of the prefix in which similar sets of this size share a member."""
    return n - -(-percent * n // 100) + 1


# ---- frequent n-grams


def reduced(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) <= k:
        return keys, counts
    left = counts - np.partition(counts, len(counts) - k - 1)[len(counts) - k - 1]
    return keys[left > 0], left[left > 0]


def added(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)
    return reduced(keys, counts, k)


def frequent(docs: DataFrame, n: int, k: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts, each low by one k-th of all at most, of n-grams above that share.

    Tasks keep k counters each (Misra and Gries), summaries are merged in a tree: at most 1 MB moves per task.
    """
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def count(batches):
        total, held = none, []
        seen = size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    held.append(grams(text, n))
                    size += len(held[-1])
                    if size >= CHUNK:
                        total = added(total, np.unique(np.concatenate(held), return_counts=True), k)
                        seen, size, held = seen + size, 0, []
        if held:
            total = added(total, np.unique(np.concatenate(held), return_counts=True), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([total[0].astype("<u8").tobytes()]), pa.array([total[1].astype("<i8").tobytes()]), pa.array([seen + size])],
            names=["keys", "counts", "seen"],
        )

    def merge(a, b):
        return (*added(a[:2], b[:2], k), a[2] + b[2])

    parts = docs.select("text").mapInArrow(count, "keys binary, counts binary, seen long")
    keys, counts, seen = parts.rdd.map(
        lambda r: (np.frombuffer(bytes(r[0]), "<u8"), np.frombuffer(bytes(r[1]), "<i8"), r[2])
    ).treeAggregate((*none, 0), merge, merge, depth=3)
    often = counts > max(1, seen // k)
    return keys[often], counts[often]


def ordered(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Order keys, rare first: the bits of the count's logarithm over 58 bits of the hash."""
    level = np.minimum(np.log2(np.maximum(times, 1)), 30).astype(np.uint64)
    return ((level << np.uint64(58)) | (h >> np.uint64(6))).astype(np.int64)


# ---- sets


def documents_sets(docs: DataFrame, n: int, hot) -> DataFrame:
    """doc_id, set (digest), n_shingles, frequent (order keys): one row per row of ``docs``."""

    def rows(part):
        keys, counts = hot.value
        for i, (text,) in enumerate(part):
            g = grams(text, n)
            at = np.searchsorted(keys, g)
            known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == g) if len(keys) else np.zeros(len(g), bool)
            yield i, digest128(g.tobytes()), len(g), ordered(g[known], counts[at[known]]).tobytes()

    return map_rows(docs, rows, ["text"], ["doc_id"], "set binary, n_shingles long, frequent binary")


def bucketed(docs: DataFrame, n: int, hot, buckets: int) -> DataFrame:
    """bucket, sets, sizes, grams: per batch of documents and bucket, the hashes of each set that fall into it."""

    def batch_rows(held: dict[bytes, np.ndarray], keys: np.ndarray):
        names = list(held)
        lengths = np.array([len(held[s]) for s in names])
        h, owner = np.concatenate([held[s] for s in names]), np.repeat(np.arange(len(names)), lengths)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            h, owner = h[keys[at] != h], owner[keys[at] != h]
        where = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(where, kind="stable")  # owners stay together within a bucket
        h, owner, where = h[order], owner[order], where[order]
        digests = np.frombuffer(b"".join(names), DIGEST)
        cuts = np.flatnonzero(np.diff(where)) + 1
        for hs, os_, b in zip(np.split(h, cuts), np.split(owner, cuts), where[np.concatenate([[0], cuts])] if len(h) else []):
            new = np.flatnonzero(np.concatenate([[True], np.diff(os_) != 0]))
            sizes = np.diff(np.concatenate([new, [len(os_)]])).astype("<u4")
            yield int(b), digests[os_[new]].tobytes(), sizes.tobytes(), hs.astype("<u8").tobytes()

    def run(batches):
        keys, held, size = hot.value[0], {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    g = grams(text, n)
                    if len(g):
                        held[digest128(g.tobytes())] = g
                        size += len(g)
                    if size >= CHUNK:
                        yield from out(batch_rows(held, keys))
                        held, size = {}, 0
        if held:
            yield from out(batch_rows(held, keys))

    def out(rows):
        for b, s, z, g in rows:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([s]), pa.array([z]), pa.array([g])], names=["bucket", "sets", "sizes", "grams"])

    return docs.select("text").mapInArrow(run, "bucket int, sets binary, sizes binary, grams binary")


def shared(bucket_rows: DataFrame, parts: int) -> DataFrame:
    """part, sets, sizes, keys: per bucket and part of the sets, the order keys of n-grams that two sets or more have."""

    def run(t: pa.Table) -> pa.Table:
        digests, sizes, h = unpacked(t, "grams", "<u8")
        names, at = np.unique(digests, return_inverse=True)
        owner = np.repeat(at, sizes)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        once = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(owner) != 0)])  # a set may come from several batches
        h, owner = h[once], owner[once]
        first = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0]))
        lengths = np.diff(np.concatenate([first, [len(h)]]))
        times = np.repeat(lengths, lengths)
        again = times > 1
        key, owner = ordered(h[again], times[again]), owner[again]
        by = np.argsort(owner, kind="stable")
        key, owner = key[by], owner[by]
        new = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0])) if len(owner) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate([new, [len(owner)]]))
        sets = names[owner[new]]  # sorted, so the sets of a part stand together
        part = part_of(sets["a"], parts)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = [
            (int(part[u]), sets[u:v].tobytes(), sizes[u:v].astype("<u4").tobytes(), key[ends[u] : ends[v]].astype("<i8").tobytes())
            for u, v in zip(cuts[:-1], cuts[1:])
        ]
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "sets", "sizes", "keys"])

    return bucket_rows.groupBy("bucket").applyInArrow(run, "part int, sets binary, sizes binary, keys binary")


def unpacked(t: pa.Table, values: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, how many values each has, and all values, of packed rows."""
    read = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k)
    return read("sets", DIGEST), read("sizes", "<u4"), read(values, kind)


def part_of(high: np.ndarray, parts: int) -> np.ndarray:
    """The part of sets by the first half of their digests, rising with it."""
    return (((high >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def ranked_sets(sets: DataFrame, some: DataFrame, percent: int, parts: int) -> DataFrame:
    """set, size, alone, keys, head of sets whose prefix holds an n-gram that others have, too.

    ``alone``: n-grams that no other set has, first in the order; ``keys``: the others, rare first; ``head``: those of
    them within the prefix.
    """

    def pack(rows):
        for i, (name, frequent) in enumerate(rows):
            part = part_of(np.frombuffer(name, DIGEST)["a"], parts)[0]
            yield i, int(part), name, np.array([len(frequent) // 8], "<u4").tobytes(), frequent

    own = map_rows(sets, pack, ["set", "frequent"], ["n"], "part int, sets binary, sizes binary, keys binary")
    both = own.unionByName(some.withColumn("n", F.lit(None).cast("long")))
    out = pa.schema([("set", pa.binary()), ("size", pa.int64()), ("alone", pa.int64()), ("keys", pa.binary()), ("head", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        digests, sizes, keys = unpacked(t, "keys", "<i8")
        names, at = np.unique(digests, return_inverse=True)
        known = t.filter(t.column("n").is_valid())
        size = np.zeros(len(names), np.int64)
        mine = np.frombuffer(b"".join(known.column("sets").to_pylist()), DIGEST)
        size[np.searchsorted(names, mine)] = known.column("n").to_numpy()
        owner = np.repeat(at, sizes)
        order = np.lexsort((keys, owner))
        keys, ends = keys[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))])
        rows = []
        for i in range(len(names)):
            k, n = keys[ends[i] : ends[i + 1]], int(size[i])
            head = k[: max(0, prefix(n, percent) - (n - len(k)))]
            if len(head):
                rows.append((names[i].tobytes(), n, n - len(k), k.tobytes(), head.tolist()))
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return both.groupBy("part").applyInArrow(run, "set binary, size long, alone long, keys binary, head array<long>")


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """At most this many common members: split both at the middle of y, and the parts again."""
    if not len(x) or not len(y) or depth == 0:
        return min(len(x), len(y))
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    same = at < len(x) and x[at] == y[mid]
    return suffix_bound(x[:at], y[:mid], depth - 1) + int(same) + suffix_bound(x[at + same :], y[mid + 1 :], depth - 1)


def verifier(sets: DataFrame, percent: int) -> Callable[[DataFrame], DataFrame]:
    """Pairs (a, b) to those whose sets are similar: suffix filter first, then the intersection itself."""

    def rows(part):
        for i, (na, nb, ka, kb) in enumerate(part):
            x, y = np.frombuffer(ka, "<i8"), np.frombuffer(kb, "<i8")
            need = -(-percent * (na + nb) // (100 + percent))
            if suffix_bound(x, y) >= need:
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (na + nb - common):
                    yield i, True

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
        b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
        full = pairs.join(a, "a").join(b, "b")
        return map_rows(full, rows, ["na", "nb", "ka", "kb"], ["a", "b"], "_ok boolean").drop("_ok")

    return verify


def fits(percent: int) -> Callable[[str, str], Column]:
    """Length filter, and positional filter for the first shared n-gram (n: size, at: place in the order)."""

    def condition(a: str, b: str) -> Column:
        na, nb, i, j = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}at"), F.col(f"{b}at")
        length = (100 * na >= percent * nb) & (100 * nb >= percent * na)
        most = 1 + F.least(na - i, nb - j) - 1
        return length & ((100 + percent) * most >= percent * (na + nb))

    return condition


def linked_sets(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """The table of documents_sets, and (set, label) of the sets that are linked with others (None: no set is)."""
    sc = docs.sparkSession.sparkContext
    hot = sc.broadcast(frequent(docs, n))  # at most COUNTERS numbers
    rows = written(documents_sets(docs, n, hot), "sets")
    sets = rows.where("n_shingles > 0").groupBy("set").agg(F.first("n_shingles").alias("n"), F.first("frequent").alias("frequent"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // BUCKET))
    some = shared(bucketed(docs, n, hot, buckets), buckets)
    ranked = ranked_sets(sets, some, percent, buckets)
    ranked = ranked.withColumnsRenamed({"size": "n"}).withColumn("id", F.monotonically_increasing_id())
    ranked = written(ranked, "ranked")
    members = ranked.select("id", "n", "alone", F.posexplode("head").alias("p", "key"))
    members = members.select("key", "id", "n", (F.col("alone") + F.col("p")).alias("at"))
    members = written(first_keys(members), "prefixes")
    # the text that others are copies of has the fewest n-grams of its own
    links = link_members(members, ["n", "at"], fits(percent), verifier(ranked, percent), central="at")
    if links is None:
        return rows, None
    names = ranked.select(F.col("id").alias("_i"), "set")
    return rows, written(components(links).join(names, F.col("id") == F.col("_i")).select("set", "label"), "components")


def first_keys(members: DataFrame) -> DataFrame:
    """Only the first of the keys that the same sets share.

    Every pair that meets in one of them meets in all, first in the smallest, where the positional filter is widest.
    Runs of n-grams that are copied together so count once. Member lists are compared by size and two 64-bit xors.
    """
    by = [F.bit_xor(F.xxhash64("id", F.lit(i))) for i in range(2)]
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), by[0].alias("x"), by[1].alias("y")).where("c > 1")
    kept = lists.groupBy("c", "x", "y").agg(F.min("key").alias("_k"))
    return members.join(kept.select("_k"), F.col("key") == F.col("_k")).drop("_k")


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links); one row per row of ``docs``.

    Two documents link when 100 x intersection >= percent x union of their n-gram sets. Null, empty or blank texts
    have an empty set and stay alone. Repeated rows and copies share a set and so a component. A null doc_id counts
    as larger than any other and is a component's id only if all are null. An empty table gives an empty result.
    """
    rows, labels = linked_sets(docs, n, percent)
    d = rows.select("doc_id", "set", "n_shingles")
    alone = d.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    d = d.where("n_shingles > 0")
    if labels is not None:
        labels = labels.select(F.col("set").alias("_s"), "label")
        d = d.join(labels, F.col("set") == F.col("_s"), "left")
    else:
        d = d.withColumn("label", F.lit(None).cast("long"))
    # a set without links is known by its digest, a component by its label
    d = d.select("doc_id", "n_shingles", F.struct("label", F.when(F.col("label").isNull(), F.col("set")).alias("s")).alias("c"))
    d = written(d, "labelled")
    least = d.groupBy("c").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("c", "_c")
    d = d.join(least, F.col("c").eqNullSafe(F.col("_c"))).select("doc_id", "n_shingles", "component_id")
    return d.unionByName(alone)
