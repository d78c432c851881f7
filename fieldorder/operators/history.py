"""Features over an entrant's or a group's earlier contests.

Every value uses strictly earlier rows of the same key. Rolling frames count rows (a null takes
a slot), ``min_periods`` counts non-null values. A long history (``hot``) is cut into chunks that
carry over the last rows of the chunk before, so one key never has to fit one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from fieldorder.operators.grouping import (
    is_hot,
    join_groups,
    with_index,
    with_prefix,
)

#: Rows of one key handled together when a long history is split.
CHUNK_ROWS = 4096
#: Least rows per block of the exponentially weighted mean, and the weight (as a logarithm) below double precision.
BLOCK, FAINT = 256, 37.0


def _lookback(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int, hot: bool
) -> tuple[DataFrame, WindowSpec, Callable[[DataFrame], DataFrame]]:
    """A frame in which a window may look back up to ``reach`` rows."""
    if not hot:
        return df, Window.partitionBy(*keys).orderBy(*order), lambda d: d
    size = max(CHUNK_ROWS, 4 * reach)
    d = with_index(df, keys, order, "_i", hot=True)
    own = F.floor((F.col("_i") - 1) / size)
    late = (F.col("_i") - 1) % size >= size - reach
    d = d.withColumn("_own", own)
    d = d.withColumn("_chunk", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_i")
    return d, w, lambda r: r.where(F.col("_own") == F.col("_chunk")).drop("_i", "_own", "_chunk")


def with_rolling_means(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, tuple[Column, int, int]],
    hot: bool | None = None,
) -> DataFrame:
    """Add lagged rolling means. ``specs``: name -> (value, rows back, min non-null values)."""
    reach = max(n for _, n, _ in specs.values())
    d, w, close = _lookback(df, keys, order, reach, is_hot(df, keys, hot))
    cols = []
    for name, (x, n, least) in specs.items():
        f = w.rowsBetween(-n, -1)
        cols.append(F.when(F.count(x).over(f) >= least, F.avg(x).over(f)).alias(name))
    return close(d.select("*", *cols))


def with_expanding_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: Column,
    out: str,
    min_periods: int = 1,
    hot: bool | None = None,
) -> DataFrame:
    """Mean over all earlier rows of the key."""
    some = F.when(x.isNotNull(), 1).otherwise(0)
    d = with_prefix(df, keys, order, {"_s": x.cast("double"), "_c": some}, hot=hot)
    mean = F.when(F.col("_c") >= min_periods, F.try_divide(F.col("_s"), F.col("_c")))
    return d.withColumn(out, mean).drop("_s", "_c")


def with_ewm(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: Column,
    span: float,
    out: str,
    min_periods: int = 1,
    ignore_na: bool = False,
    hot: bool | None = None,
) -> DataFrame:
    """Exponentially weighted mean of the earlier rows, weights r**k with r = 1 - 2/(span+1).

    ``k`` counts rows back, or non-null rows back with ``ignore_na``. Rows are grouped into
    blocks: inside a block a running sum of x * r**-offset gives the recent part, and the sum of
    the block before gives the rest. Blocks are as long as the span needs for anything older to be below double
    precision.
    """
    if span <= 1:
        raise ValueError("span must be above 1")
    hot = is_hot(df, keys, hot)
    r = 1.0 - 2.0 / (span + 1.0)
    block = max(BLOCK, math.ceil(FAINT / -math.log(r)))
    some = F.when(F.col("_x").isNotNull(), 1).otherwise(0)
    d = df.withColumn("_x", x.cast("double"))
    d = with_prefix(d, keys, order, {"_n": some, "_all": F.lit(1)}, hot=hot)
    at = F.coalesce(F.col("_n" if ignore_na else "_all"), F.lit(0))
    d = d.withColumn("_b", F.floor(at / block)).withColumn("_o", at % block)
    up = F.pow(F.lit(1.0 / r), F.col("_o"))
    down = F.pow(F.lit(r), (block - 1) - F.col("_o"))
    seen = F.col("_x").isNotNull()
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_pn", F.coalesce(F.sum(F.col("_x") * up).over(inside), F.lit(0.0)))
    d = d.withColumn("_pd", F.coalesce(F.sum(F.when(seen, up)).over(inside), F.lit(0.0)))
    tail_n, tail_d = F.sum(F.col("_x") * down), F.sum(F.when(seen, down))
    if hot:
        prev = d.groupBy(*keys, "_b").agg(tail_n.alias("_cn"), tail_d.alias("_cd"))
        d = join_groups(d, prev.withColumn("_b", F.col("_b") + 1), [*keys, "_b"])
    else:
        before = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
        d = d.withColumn("_cn", tail_n.over(before)).withColumn("_cd", tail_d.over(before))
    near = F.pow(F.lit(r), F.col("_o") - 1)
    far = F.pow(F.lit(r), F.col("_o"))
    num = near * F.col("_pn") + far * F.coalesce(F.col("_cn"), F.lit(0.0))
    den = near * F.col("_pd") + far * F.coalesce(F.col("_cd"), F.lit(0.0))
    value = F.when(F.coalesce(F.col("_n"), F.lit(0)) >= min_periods, F.try_divide(num, den))
    return d.withColumn(out, value).drop("_x", "_n", "_all", "_b", "_o", "_pn", "_pd", "_cn", "_cd")


def with_last_seen(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: Column,
    out: str,
    hot: bool | None = None,
) -> DataFrame:
    """Latest non-null earlier value of the key."""
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(x, ignorenulls=True).over(w))
    d = df.withColumn("_x", x)
    some = F.when(F.col("_x").isNotNull(), 1).otherwise(0)
    d = with_prefix(d, keys, order, {"_n": some}, hot=True)
    held = d.where(F.col("_x").isNotNull()).select(
        *keys, (F.coalesce(F.col("_n"), F.lit(0)) + 1).alias("_n"), F.col("_x").alias(out)
    )
    return join_groups(d, held, [*keys, "_n"]).drop("_x", "_n")


def with_recent_years(
    df: DataFrame,
    keys: Sequence[str],
    year: str,
    order: Sequence[str],
    years_back: int,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Sums over rows of the last ``years_back`` years plus the earlier rows of the same year.

    Yearly totals come from a map-side combined aggregate, so only one year of a key is ever
    sorted together.
    """
    yearly = df.groupBy(*keys, year).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(year).rangeBetween(-years_back, -1)
    yearly = yearly.select(*keys, year, *[F.sum(n).over(w).alias(f"_y_{n}") for n in sums])
    d = with_prefix(df, [*keys, year], order, {f"_s_{n}": c for n, c in sums.items()}, hot=False)
    d = join_groups(d, yearly, [*keys, year])
    zero = F.lit(0)
    for n in sums:
        total = F.coalesce(F.col(f"_y_{n}"), zero) + F.coalesce(F.col(f"_s_{n}"), zero)
        d = d.withColumn(n, total)
    return d.drop(*[f"_{p}_{n}" for p in "ys" for n in sums])


def prior_group_means(
    df: DataFrame,
    keys: Sequence[str],
    contest: Sequence[str],
    x: Column,
    out: str,
    hot: bool | None = False,
) -> DataFrame:
    """Per (keys, contest): mean of x over earlier contests of the key.

    Rows are combined per contest first, so rows of one contest never see each other.
    """
    per = df.groupBy(*keys, *contest).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    per = with_prefix(per, keys, list(contest), {"_ps": F.col("_s"), "_pc": F.col("_c")}, hot=hot)
    mean = F.when(F.col("_pc") > 0, F.col("_ps") / F.col("_pc")).alias(out)
    return per.select(*keys, *contest, mean)
