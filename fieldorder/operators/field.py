"""Analytics inside one contest or season: picks, overlaps, standings, imputation, pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.operators.features import CONTEST, Sizes, classified, rank_correlation
from fieldorder.operators.grouping import (
    join_groups,
    quantiles,
    with_index,
    with_rank,
    with_totals,
)
from fieldorder.operators.medians import column_medians


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, hot: bool | None) -> DataFrame:
    """The first k rows per group, numbered in ``place``.

    Spark turns the row_number limit into a per-partition group limit before the shuffle.
    """
    return with_index(df, keys, order, "place", hot).where(F.col("place") <= k)


def best(value: Column, score: Column, tie: Column, lowest: bool = False) -> Column:
    """value at the highest (lowest) score; ties go to the smaller ``tie`` key."""
    if lowest:
        return F.min_by(value, F.struct(score, tie))
    return F.max_by(value, F.struct(score, -tie))


def _without(ranked: Column, who: str, pick: str) -> Column:
    return F.filter(ranked, lambda x: x[who] != F.col(pick))


def sequential_picks(
    df: DataFrame, keys: Sequence[str], scores: Sequence[str], who: str, hot: bool | None
) -> DataFrame:
    """Pick 1 by the first score, pick 2 by the second among the rest, and so on.

    Pick j is among the j best rows of score j, so only that many rows per group are collected.
    """
    sides = []
    for j, s in enumerate(scores, start=1):
        top = top_k(df.select(*keys, who, s), keys, [F.col(s).desc_nulls_last(), who], j, hot)
        ranked = F.array_sort(F.collect_list(F.struct("place", who)))
        sides.append(top.groupBy(*keys).agg(ranked.alias(f"_t{j}")))
    g = sides[0]
    for side in sides[1:]:
        g = g.join(side, list(keys))
    picks: list[str] = []
    for j in range(1, len(scores) + 1):
        free = F.col(f"_t{j}")
        for p in picks:
            free = _without(free, who, p)
        picks.append(f"pick_{j}")
        g = g.withColumn(f"pick_{j}", F.try_element_at(free, F.lit(1))[who])
    return g.select(*keys, *picks)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def standings(race: DataFrame, sprint: DataFrame, who: str, through: int) -> DataFrame:
    """Race plus sprint points per year through a round. Both: year, round, <who>, points."""
    both = race.select("year", "round", who, "points").unionByName(
        sprint.select("year", "round", who, "points")
    )
    return both.where(F.col("round") <= through).groupBy("year", who).agg(F.sum("points").alias("points"))


def session_gaps(df: DataFrame, s: Sizes) -> DataFrame:
    """Log gap (%) to the best time, usable sessions only, scaled to the season's spread.

    A session needs 10 timed rows and an order that follows the times (rank correlation 0.9).
    """
    pos, t = F.col("quali_position"), F.col("best_time_ms")
    d = df.where(t.isNotNull() & pos.isNotNull() & (t > 0))
    rho = rank_correlation(d, CONTEST, pos, t, "_rho", 10, s.contest)
    d = with_totals(d, CONTEST, {"_n": F.count(F.lit(1)), "_best": F.min(t)}, s.contest)
    d = join_groups(d, rho, CONTEST).where(F.col("_rho") >= 0.9)
    gap = 100 * F.log(t / F.col("_best"))
    cut = 10 + F.floor((F.col("_n") - 10) / 2)
    stage = F.when(pos <= 10, 3).when(pos <= cut, 2).otherwise(1)
    d = d.withColumn("y", gap).withColumn("stage", stage).where(F.col("y") <= 7.0)
    med = quantiles(d, CONTEST, F.col("y"), {"_med": 0.5}, s.contest)
    season = med.groupBy("year").agg(F.median("_med").alias("_season"))
    d = join_groups(d, med.join(season, "year"), CONTEST)
    return d.withColumn("y", F.try_divide(F.col("y") * F.col("_season"), F.col("_med"))).drop(
        "_n", "_best", "_rho", "_med", "_season"
    )


def fill_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Medians of all columns in one row (0 where a column is empty)."""
    found = column_medians(df, columns)
    return df.sparkSession.createDataFrame([tuple(found[c] or 0.0 for c in columns)], ", ".join(f"`{c}` double" for c in columns))


def with_fill(df: DataFrame, columns: Sequence[str], saved: DataFrame | None = None) -> DataFrame:
    """Replace missing values by medians (or saved ones), except where missing is meant."""
    todo = [c for c in columns if c not in fv.MISSING_ALLOWED]
    values = (saved or fill_values(df, todo)).select(*[F.col(c).alias(f"_fill_{c}") for c in todo])
    d = df.crossJoin(F.broadcast(values))  # exactly one row
    filled = {c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in todo}
    return d.withColumns(filled).drop(*[f"_fill_{c}" for c in todo])


def attach_weather(df: DataFrame, weather: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Left join on the contest; missing numbers get the median over rows, missing wet is 0."""
    d = df.join(weather, CONTEST, "left")
    med = column_medians(d, numeric)
    d = d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c]).cast("double")) for c in numeric})
    return d.withColumn("is_wet", F.coalesce("is_wet", F.lit(0)))


def pivot(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, aggs: Mapping[str, Column]) -> DataFrame:
    """Long to wide with stated column values (no job to discover them)."""
    return df.groupBy(*keys).pivot(name, list(values)).agg(*[a.alias(n) for n, a in aggs.items()])


def elo_rank_gap(df: DataFrame, rating: Column, s: Sizes) -> DataFrame:
    d = with_rank(df, CONTEST, rating, "_r", "average", descending=True, hot=s.contest)
    return d.withColumn("elo_rank_gap", F.col("grid_position") - F.col("_r")).drop("_r")


def group_filter(df: DataFrame, keys: Sequence[str], least: int, hot: bool | None) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    d = with_totals(df, keys, {"_n": F.count(F.lit(1))}, hot)
    return d.where(F.col("_n") >= least).drop("_n")


def finishers(df: DataFrame) -> DataFrame:
    return df.where(classified())
