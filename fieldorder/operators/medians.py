"""Exact medians of many columns at once, without sorting and without one task that holds a column.

A double is read as a whole number of the same order, and the middle rows are found digit by digit: a pass counts, for
all columns together, how many rows fall into each value of the next bits among those that share the bits known so far. A task keeps the counts of at most two prefixes a column; sums of fixed size reach the driver. A prefix whose
smallest and largest row agree is done, so columns of few values end after a pass or two, and five are enough for any.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldorder.operators.grouping import checkpointed

#: What runs in tasks travels to Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits left to find after each pass: sign and exponent go first.
SHIFTS = (52, 39, 26, 13, 0)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles; -0.0 counts as 0.0, NaN as larger than all."""
    b = (x + 0.0).view(np.int64)
    return b ^ ((b >> 63) & np.int64(2**63 - 1))


def from_bits(b: int) -> float:
    a = np.array([b], np.int64)
    return float((a ^ ((a >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def _counts(data: DataFrame, shift: int, above: int | None, wanted: list[list[int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per column the (bucket, rows, least, largest) of rows whose bits from ``above`` on are wanted (None: of all)."""
    wanted = data.sparkSession.sparkContext.broadcast([np.array(w, np.int64) for w in wanted])

    def run(batches):
        held: list[list[tuple]] = [[] for _ in wanted.value]

        def folded(parts):
            bucket, n, low, high = map(np.concatenate, zip(*parts))
            names, at = np.unique(bucket, return_inverse=True)
            total, least, most = np.zeros(len(names), np.int64), np.full(len(names), 2**63 - 1), np.full(len(names), -(2**63))
            np.add.at(total, at, n)
            np.minimum.at(least, at, low)
            np.maximum.at(most, at, high)
            return names, total, least, most

        for batch in batches:
            for i, prefixes in enumerate(wanted.value):
                if above is not None and not len(prefixes):
                    continue
                x = ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False).astype(float))
                if above is not None:
                    x = x[np.isin(x >> above, prefixes)]
                if not len(x):
                    continue
                x.sort()
                bucket = x >> shift
                start = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
                end = np.append(start[1:], len(x))
                held[i].append((bucket[start], end - start, x[start], x[end - 1]))
                if len(held[i]) >= 64:
                    held[i] = [folded(held[i])]
        for i, parts in enumerate(held):
            if parts:
                names, total, least, most = folded(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), i)), pa.array(names), pa.array(total), pa.array(least), pa.array(most)],
                    names=["c", "bucket", "n", "least", "most"],
                )

    d = data.mapInArrow(run, "c long, bucket long, n long, least long, most long")
    d = d.groupBy("c", "bucket").agg(F.sum("n"), F.min("least"), F.max("most"))
    out: dict[int, list[tuple[int, int, int, int]]] = {i: [] for i in range(len(wanted.value))}
    for c, *row in d.collect():  # at most two prefixes of 2^13 buckets a column
        out[c].append(tuple(row))
    return {i: sorted(rows) for i, rows in out.items()}


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The median of each column's values that are not null (the mean of the middle two); None for an empty column."""
    data = checkpointed(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[int, int]] = {}  # (column, which of the two) -> (prefix, rank among its rows)
    for above, shift in zip((None, *SHIFTS), SHIFTS):
        wanted = [sorted({p for (c, _), (p, _) in open_.items() if c == i}) for i in range(len(columns))]
        counts = _counts(data, shift, above, wanted)
        if above is None:
            totals = {i: sum(r[1] for r in rows) for i, rows in counts.items()}
            open_ = {(i, side): (0, (n - 1 + side) // 2) for i, n in totals.items() if n for side in (0, 1)}
        for (i, side), (prefix, rank) in list(open_.items()):
            for bucket, n, least, most in counts[i]:
                if above is not None and bucket >> (above - shift) != prefix:
                    continue
                if rank < n:
                    open_[i, side] = (bucket, rank)
                    if least == most:
                        found[i, side] = from_bits(least)
                        del open_[i, side]
                    break
                rank -= n
        if not open_:
            break
    return {c: 0.5 * found[i, 0] + 0.5 * found[i, 1] if (i, 0) in found else None for i, c in enumerate(columns)}
