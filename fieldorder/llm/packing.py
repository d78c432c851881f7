"""Best-fit packing of token sequences with large-item matching.

Only lengths matter, and pieces of one length may change places. So the plan is made on the histogram of lengths,
at most ``capacity`` rows whatever the input, and every piece finds its place by its number among those of its
length. Pieces above a third of the capacity go first: at most two fit together, and the largest is matched with
the largest that still fits. Shorter pieces, longest first, go to the sequence with the least room that holds them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.llm.common import map_rows, partitions, written
from fieldorder.llm.tokens import ids_of, tokenizer_file


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many, first sequence, offset): piece first + i lies in sequence first + i."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    sizes: list[int] = []
    sequences = 0

    def put(length: int, many: int, first: int, offset: int) -> None:
        out.append((length, used[length], many, first, offset))
        used[length] += many
        left[length] -= many

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            many = left[a]
            put(a, many, sequences, 0)
            leave(capacity - a, sequences, many)
        else:
            b = large[at]
            many = min(left[a], left[b]) if a != b else left[a] // 2
            if not many:  # one of this length is left: match it with the next smaller one, if any
                at -= 1
                while at >= 0 and not left[large[at]]:
                    large.pop(at)
                    at -= 1
                b, many = (large[at], 1) if at >= 0 else (0, 1)
            put(a, many, sequences, 0)
            if b:
                put(b, many, sequences, a)
            leave(capacity - a - b, sequences, many)
        sequences += many

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # new sequences, each filled with as many as it holds
                fit = capacity // n
                many = max(1, left[n] // fit)
                for j in range(min(fit, left[n]) if many == 1 else fit):
                    put(n, many, sequences, j * n)
                    room = capacity - (j + 1) * n
                leave(room, sequences, many)
                sequences += many
                continue
            room = sizes[at]
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                sizes.pop(at)
            fit = room // n  # the least room stays the least until it is too small
            whole = min(many, left[n] // fit)
            if whole:
                for j in range(fit):
                    put(n, whole, first, capacity - room + j * n)
                leave(room - fit * n, first, whole)
            elif left[n]:
                some = left[n]
                for j in range(some):
                    put(n, 1, first, capacity - room + j * n)
                leave(room - some * n, first, 1)
                whole = 1
            leave(room, first + whole, many - whole)
    return out


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows with ``length`` (1 to capacity), all other columns kept.

    ``pieces`` should be a written table: it is read twice. Pieces of one length are numbered in shards, so that a
    length which most rows share is spread over all tasks; shards' counts, not rows, are added up across them.
    Repeated rows take a place each. An empty table stays empty.
    """
    spark = pieces.sparkSession
    lengths = dict(pieces.groupBy("length").count().collect())  # at most ``capacity`` rows
    shards = max(partitions(spark), sum(lengths.values()) // 1_000_000)
    ordered = sorted(lengths, reverse=True)
    base = dict(zip(ordered, np.cumsum([0, *[lengths[n] for n in ordered]]).tolist()))
    steps = sorted((base[n] + at, many, first, offset) for n, at, many, first, offset in plan(lengths, capacity))
    start, first, offset = (np.array([s[i] for s in steps], np.int64) for i in (0, 2, 3))
    where = spark.sparkContext.broadcast((start, first, offset, base))

    rest = [c for c in pieces.columns if c != "length"]
    shard = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in rest]), F.lit(shards)) if rest else F.lit(0)
    p = pieces.withColumn("_shard", shard)
    inside = Window.partitionBy("length", "_shard").orderBy(*rest)
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    skip = p.groupBy("length", "_shard").count().select(
        F.col("length").alias("_l"), F.col("_shard").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_skip")
    )
    p = p.withColumn("_in", F.row_number().over(inside) - 1)
    p = p.join(skip, (F.col("length") == F.col("_l")) & (F.col("_shard") == F.col("_s"))).withColumn("_at", F.col("_skip") + F.col("_in"))

    def rows(part):
        start, first, offset, base = where.value
        at = np.array([base[n] + k for n, k in part], np.int64)
        step = np.searchsorted(start, at, "right") - 1
        return zip(range(len(at)), (first[step] + at - start[step]).tolist(), offset[step].tolist())

    return map_rows(p, rows, ["length", "_at"], pieces.columns, "sequence_id long, offset long")


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: each document's ids with the end mark, cut only above the capacity.

    A null or empty text is the end mark alone. One call of Python per task: ids never pass through another, and stay
    in it unless ``ids`` asks for them.
    """
    file = tokenizer_file(docs.sparkSession, path)

    def rows(part):
        step = 4 * capacity
        for i, x in ids_of(file, part, end):
            for k, at in enumerate(range(0, len(x), step)):
                piece = x[at : at + step]
                yield i, k, at // 4, len(piece) // 4, crc32(piece), *([piece] if ids else [])

    out = "piece int, start long, length long, ids_crc32 long"
    return map_rows(docs, rows, ["text"], ["doc_id"], f"{out}, ids binary" if ids else out)


def packed(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """Pack whole documents: token_pieces (with ids, if asked for), sequence_id and offset."""
    return pack(written(token_pieces(docs, path, capacity, end, ids), "pieces"), capacity)
