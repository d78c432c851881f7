"""Contest features: form, standings, venue history, grid, qualifying and team context.

Each function takes the result rows (one per entrant and contest) and returns them with added
columns. ``Sizes`` says which groups may be too large for one window task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.functions import fixed_values as fv
from fieldorder.functions.lookups import grid_bin
from fieldorder.operators.grouping import (
    join_groups,
    quantiles,
    with_prefix,
    with_rank,
    with_totals,
)
from fieldorder.operators.history import (
    prior_group_means,
    with_ewm,
    with_expanding_mean,
    with_recent_years,
    with_rolling_means,
)

CONTEST = ["year", "round"]
TIME = ["year", "round"]
TEAM_CONTEST = ["year", "round", "team"]


@dataclass(frozen=True)
class Sizes:
    """Known bounds: False = small groups, True = split them, None = measure."""

    contest: bool | None = None
    history: bool | None = None
    league: bool | None = None


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range; a missing value stays missing."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def classified() -> Column:
    return (F.col("dnf") == 0) & F.col("finish_position").isNotNull()


# --- entrant history ------------------------------------------------------------------


def driver_form(df: DataFrame, s: Sizes, windows: Sequence[int] = (5, 10)) -> DataFrame:
    x = F.col("finish_position")
    specs = {f"driver_form_{n}": (x, n, 1) for n in windows}
    return with_rolling_means(df, ["entrant"], TIME, specs, s.history)


def driver_form_ewm(df: DataFrame, s: Sizes) -> DataFrame:
    return with_ewm(df, ["entrant"], TIME, F.col("finish_position"), 5, "driver_form_ewm", hot=s.history)


def points_before(df: DataFrame, s: Sizes) -> DataFrame:
    d = with_prefix(df, ["year", "entrant"], ["round"], {"_p": F.col("points")}, s.history)
    return d.withColumn("cum_points_before", F.coalesce("_p", F.lit(0)).cast("bigint")).drop("_p")


def championship_position(df: DataFrame, s: Sizes) -> DataFrame:
    return with_rank(
        df, CONTEST, F.col("cum_points_before"), "championship_position", descending=True, hot=s.contest
    )


def season_lengths(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Rounds per year; the latest year uses the calendar (year, n_rounds) when it is longer."""
    lengths = df.groupBy("year").agg(F.max("round").alias("last_round"))
    if calendar is None:
        return lengths
    newest = lengths.agg(F.max("year").alias("_newest"))
    planned = calendar.select("year", F.col("n_rounds").alias("_planned"))
    return (
        lengths.join(planned, "year", "left")
        .crossJoin(newest)
        .select(
            "year",
            F.when(
                F.col("year") == F.col("_newest"),
                F.greatest("last_round", "_planned"),
            )
            .otherwise(F.col("last_round"))
            .alias("last_round"),
        )
    )


def championship_pressure(df: DataFrame, s: Sizes, calendar: DataFrame | None = None) -> DataFrame:
    d = with_totals(df, CONTEST, {"_lead": F.max("cum_points_before")}, s.contest)
    d = join_groups(d, season_lengths(df, calendar), ["year"])
    left = F.greatest(25 * F.greatest(F.col("last_round") - F.col("round"), F.lit(0)), F.lit(1))
    gap = F.col("_lead") - F.col("cum_points_before")
    return d.withColumn("championship_pressure", clip(gap / left, 0.0, 1.0)).drop("_lead", "last_round")


def dnf_rate(df: DataFrame, s: Sizes) -> DataFrame:
    return with_rolling_means(df, ["entrant"], TIME, {"dnf_rate": (F.col("dnf"), 10, 3)}, s.history)


def venue_history(df: DataFrame, years_back: int = 5) -> DataFrame:
    """Average finish, podiums and starts of the entrant at this venue in the last years."""
    fin = F.col("finish_position")
    sums = {
        "_f": fin,
        "_n": F.when(fin.isNotNull(), 1).otherwise(0),
        "circuit_podiums": F.coalesce("podium", F.lit(0)),
        "circuit_appearances": F.lit(1),
    }
    d = with_recent_years(df, ["venue", "entrant"], "year", ["round"], years_back, sums)
    return d.withColumn("circuit_avg_finish", F.try_divide("_f", "_n")).drop("_f", "_n")


def wet_form(df: DataFrame, s: Sizes) -> DataFrame:
    """Needs is_wet_race."""
    wet = F.when(F.col("is_wet_race") == 1, F.col("finish_position"))
    return with_expanding_mean(df, ["entrant"], TIME, wet, "driver_wet_avg_finish", 3, s.history)


def experience(df: DataFrame, s: Sizes, veteran: int = 100) -> DataFrame:
    d = with_prefix(df, ["entrant"], TIME, {"_n": F.lit(1)}, s.history)
    starts = F.coalesce("_n", F.lit(0)) / F.lit(float(veteran))
    return d.withColumn("driver_experience_norm", F.least(starts, F.lit(1.0))).drop("_n")


# --- team history ---------------------------------------------------------------------


def team_points(df: DataFrame, s: Sizes) -> DataFrame:
    """One row per team and contest: points of earlier contests of the year, and the rank."""
    per = df.groupBy(*TEAM_CONTEST).agg(F.sum("points").alias("_p"))
    per = with_prefix(per, ["year", "team"], ["round"], {"_c": F.col("_p")}, s.history)
    per = per.withColumn("team_cum_points", F.coalesce("_c", F.lit(0)).cast("bigint"))
    per = with_rank(
        per, CONTEST, F.col("team_cum_points"), "constructor_standing", descending=True, hot=s.contest
    )
    return per.select(*TEAM_CONTEST, "team_cum_points", "constructor_standing")


def team_reliability(df: DataFrame, s: Sizes, window: int = 10) -> DataFrame:
    per = df.groupBy(*TEAM_CONTEST).agg(F.avg("dnf").alias("_r"))
    per = with_rolling_means(per, ["team"], TIME, {"_m": (F.col("_r"), window, 3)}, s.history)
    return per.select(*TEAM_CONTEST, (1.0 - F.col("_m")).alias("team_reliability_rate"))


def team_form(df: DataFrame, s: Sizes, window: int = 5) -> DataFrame:
    per = df.groupBy(*TEAM_CONTEST).agg(F.min("finish_position").alias("_b"))
    name = f"team_form_{window}"
    per = with_rolling_means(per, ["team"], TIME, {name: (F.col("_b"), window, 1)}, s.history)
    return per.select(*TEAM_CONTEST, name)


# --- venue ----------------------------------------------------------------------------


def grid_conversion(df: DataFrame, s: Sizes) -> DataFrame:
    """Mean finish from this grid bin in earlier contests, here or (fallback) anywhere."""
    d = df.withColumn("_bin", grid_bin(F.col("grid_position")))
    fin = F.col("finish_position")
    here = prior_group_means(d, ["venue", "_bin"], CONTEST, fin, "_here", s.history)
    anywhere = prior_group_means(d, ["_bin"], CONTEST, fin, "_any", s.history)
    d = join_groups(d, here, ["venue", "_bin", *CONTEST])
    d = join_groups(d, anywhere, ["_bin", *CONTEST])
    return d.withColumn("circuit_grid_conversion", F.coalesce("_here", "_any")).drop("_bin", "_here", "_any")


def rank_correlation(
    df: DataFrame, keys: Sequence[str], a: Column, b: Column, out: str, least: int, hot: bool | None
) -> DataFrame:
    """Spearman: Pearson correlation of average ranks over rows with both values.

    Every group of df gives a row; the value is null below ``least`` rows and where a side is constant.
    """
    both = a.isNotNull() & b.isNotNull()
    d = df.select(*keys, F.when(both, a).alias("_a"), F.when(both, b).alias("_b"))
    d = with_rank(d, keys, F.col("_a"), "_ra", "average", hot=hot)
    d = with_rank(d, keys, F.col("_b"), "_rb", "average", hot=hot)
    spread = F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))  # one value alone has no correlation
    g = d.groupBy(*keys).agg((F.covar_pop("_ra", "_rb") / spread).alias("_c"), F.count("_a").alias("_n"))
    return g.select(*keys, F.when((F.col("_n") >= least) & ~F.isnan("_c"), F.col("_c")).alias(out))


def contest_rank_correlation(df: DataFrame, s: Sizes) -> DataFrame:
    """Grid against finish per contest, classified rows with a grid slot only."""
    ok = (F.col("grid_position") > 0) & classified()
    grid = F.when(ok, F.col("grid_position"))
    return rank_correlation(df, ["venue", *CONTEST], grid, F.col("finish_position"), "rho", 5, s.contest)


def overtaking_index(df: DataFrame, s: Sizes, window: int = 8) -> DataFrame:
    """Per contest: 1 - mean rank correlation of the venue's last contests before it."""
    races = contest_rank_correlation(df, s)
    races = with_rolling_means(races, ["venue"], TIME, {"_here": (F.col("rho"), window, 1)}, s.history)
    some = F.when(F.col("rho").isNotNull(), 1).otherwise(0)
    years = races.groupBy("year").agg(F.sum("rho").alias("_ys"), F.sum(some).alias("_yc"))
    years = years.select(
        "year",
        *[
            F.sum(c).over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)).alias(c)
            for c in ("_ys", "_yc")
        ],
    )
    races = with_prefix(races, ["year"], ["round", "venue"], {"_s": F.col("rho"), "_c": some}, s.history)
    races = join_groups(races, years, ["year"])
    zero = F.lit(0)
    total = F.coalesce("_s", zero) + F.coalesce("_ys", zero)
    count = F.coalesce("_c", zero) + F.coalesce("_yc", zero)
    overall = F.when(count > 0, total / count)
    value = 1 - F.coalesce("_here", overall, F.lit(0.75))
    return races.select("venue", *CONTEST, value.alias("circuit_overtaking"))


# --- qualifying and grid --------------------------------------------------------------


def pit_lane_to_back(df: DataFrame, s: Sizes) -> DataFrame:
    """A start from the pit lane (grid 0) counts as one place behind the last slot."""
    g = F.col("grid_position")
    d = with_totals(df, CONTEST, {"_last": F.max(F.when(g > 0, g))}, s.contest)
    return d.withColumn("grid_position", F.when(g == 0, F.col("_last") + 1).otherwise(g)).drop("_last")


def quali_gap(df: DataFrame, s: Sizes, limit: float = 5.0) -> DataFrame:
    """Seconds behind the fastest of the contest, at most ``limit``."""
    d = with_totals(df, CONTEST, {"_best": F.min("best_time_ms")}, s.contest)
    gap = (F.col("best_time_ms") - F.col("_best")) / 1000.0
    return d.withColumn("quali_gap_s", clip(gap, high=limit)).drop("_best")


def teammate_quali_delta(df: DataFrame, s: Sizes) -> DataFrame:
    """Own gap minus the mean gap of the other team members; null when alone."""
    g = F.col("quali_gap_s")
    d = with_totals(df, TEAM_CONTEST, {"_s": F.sum(g), "_n": F.count(g)}, s.contest)
    others = F.try_divide(F.col("_s") - g, F.col("_n") - 1)
    return d.withColumn("teammate_quali_delta", g - others).drop("_s", "_n")


def car_pace_delta(df: DataFrame, s: Sizes) -> DataFrame:
    """Per team and contest: median gap relative to the best team's median, 0..3 %."""
    per = quantiles(df, TEAM_CONTEST, F.col("quali_gap_s"), {"_m": 0.5}, s.contest)
    per = with_totals(per, CONTEST, {"_f": F.min("_m")}, s.contest)
    pct = (F.col("_m") - F.col("_f")) / F.greatest(F.col("_f"), F.lit(0.01)) * 100
    return per.select(*TEAM_CONTEST, F.coalesce(clip(pct, 0.0, 3.0), F.lit(0.0)).alias("car_pace_delta_pct"))


def quali_gap_relative(df: DataFrame, s: Sizes) -> DataFrame:
    d = with_totals(df, CONTEST, {"_x": F.max("quali_gap_s")}, s.contest)
    share = F.when(F.col("_x") >= 0.01, F.col("quali_gap_s") / F.col("_x"))
    return d.withColumn("quali_gap_relative", share).drop("_x")


def grid_relative(df: DataFrame, s: Sizes) -> DataFrame:
    d = with_totals(df, CONTEST, {"_x": F.max("grid_position")}, s.contest)
    rel = F.when(F.col("_x") >= 1, F.try_divide(F.col("grid_position") - 1, F.col("_x") - 1))
    return d.withColumn("grid_position_rel", rel).drop("_x")


def round_fraction(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    d = join_groups(df, season_lengths(df, calendar), ["year"])
    part = (F.col("round") - 1) / F.greatest(F.col("last_round") - 1, F.lit(1))
    return d.withColumn("round_fraction", part).drop("last_round")


def grid_penalty(df: DataFrame) -> DataFrame:
    lost = F.greatest(F.col("grid_position") - F.col("quali_position"), F.lit(0))
    known = F.col("grid_position").isNotNull() & F.col("quali_position").isNotNull()
    return df.withColumn("grid_penalty_places", F.when(known, lost).otherwise(0).cast("double"))


def sprint_relative(position: Column, starters: Column) -> Column:
    """Sprint place over the field (20 when unknown); 0.5 without a sprint."""
    return F.coalesce(position / F.coalesce(starters, F.lit(20)), F.lit(0.5))


def quali_vs_prior(df: DataFrame, s: Sizes) -> DataFrame:
    """Relative qualifying place against the entrant's (else the team's, else 0.5) recent mean."""
    d = df.where(F.col("quali_position").isNotNull())
    d = with_totals(d, CONTEST, {"_x": F.max("quali_position")}, s.contest)
    rel = (F.col("quali_position") - 1) / F.greatest(F.col("_x") - 1, F.lit(1))
    d = d.withColumn("_rel", rel)
    d = with_ewm(d, ["entrant"], TIME, F.col("_rel"), 5, "_own", 2, hot=s.history)
    team = d.groupBy(*TEAM_CONTEST).agg(F.avg("_rel").alias("_t"))
    team = with_ewm(team, ["team"], TIME, F.col("_t"), 5, "_team", hot=s.history)
    d = join_groups(d, team.select(*TEAM_CONTEST, "_team"), TEAM_CONTEST)
    prior = F.coalesce("_own", "_team", F.lit(0.5))
    return d.withColumn("quali_vs_prior", F.col("_rel") - prior).drop("_x", "_rel", "_own", "_team")


def quali_stats(df: DataFrame, s: Sizes) -> DataFrame:
    """Per contest: spread of P2..P10 against P1 (%), and order against time."""
    pos, t = F.col("quali_position"), F.col("best_time_ms")
    d = df.where(pos.isNotNull())
    d = with_totals(d, CONTEST, {"_p1": F.min(pos)}, s.contest)
    top = d.where((pos <= 10) & t.isNotNull())
    first = Window.partitionBy(*CONTEST).orderBy("quali_position")
    top = top.withColumn("_k", F.row_number().over(first))  # at most ten places per contest
    g = d.groupBy(*CONTEST).agg(F.max(F.when(pos == F.col("_p1"), t)).alias("_t1"))
    m = top.groupBy(*CONTEST).agg(
        F.count(F.lit(1)).alias("_n"), F.median(F.when(F.col("_k") > 1, t)).alias("_rest")
    )
    order = rank_correlation(d, CONTEST, pos, t, "quali_segment_order", 10, s.contest)
    spread = (F.col("_rest") / F.col("_t1") - 1.0) * 100.0
    return (
        g.join(m, CONTEST, "left")
        .join(order, CONTEST, "left")
        .select(
            *CONTEST,
            clip(F.when((F.col("_n") >= 5) & (F.col("_t1") > 0), spread), 0.0, 10.0).alias("quali_spread_pct"),
            "quali_segment_order",
        )
    )


# --- domain context -------------------------------------------------------------------


def slot_gain(df: DataFrame, enough: int = 500) -> DataFrame:
    """Places gained minus the usual gain from that slot (earlier years, or the same year)."""
    d = df.withColumn(
        "_raw", F.when(classified(), F.col("grid_position") - F.col("finish_position"))
    ).withColumn("_slot", F.least(F.col("grid_position"), F.lit(22)))
    per = d.groupBy("year", "_slot").agg(F.sum("_raw").alias("_s"), F.count("_raw").alias("_c"))
    sizes = d.groupBy("year").agg(F.count(F.lit(1)).alias("_rows"))
    past = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row per year
    sizes = sizes.select("year", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_past"))
    slots = per.select("_slot").distinct()
    w = Window.partitionBy("_slot").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    curve = (
        slots.crossJoin(sizes)  # at most 23 slots x years
        .join(per, ["year", "_slot"], "left")
        .select(
            "year",
            "_slot",
            F.when(
                F.col("_past") >= enough, F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w))
            )
            .otherwise(F.try_divide("_s", "_c"))
            .alias("_usual"),
        )
    )
    d = join_groups(d, curve, ["year", "_slot"])
    return d.withColumn("slot_gain", F.col("_raw") - F.col("_usual")).drop("_raw", "_slot", "_usual")


def gain_ewm(df: DataFrame, s: Sizes) -> DataFrame:
    """Needs slot_gain."""
    return with_ewm(
        df, ["entrant"], TIME, F.col("slot_gain"), 8, "driver_gain_ewm", 3, ignore_na=True, hot=s.history
    )


def team_gain_ewm(df: DataFrame, s: Sizes) -> DataFrame:
    per = df.groupBy(*TEAM_CONTEST).agg(F.avg("slot_gain").alias("_g"))
    per = with_ewm(per, ["team"], TIME, F.col("_g"), 8, "team_gain_ewm", 3, ignore_na=True, hot=s.history)
    return per.select(*TEAM_CONTEST, "team_gain_ewm")


def teammate_finish_ewm(df: DataFrame, s: Sizes) -> DataFrame:
    """Finish against the one classified teammate, weighted over earlier contests."""
    fc = F.when(classified(), F.col("finish_position"))
    d = with_totals(df, TEAM_CONTEST, {"_s": F.sum(fc), "_n": F.count(fc)}, s.contest)
    delta = F.when((F.col("_n") == 2) & fc.isNotNull(), fc - (F.col("_s") - fc))
    d = d.withColumn("_delta", delta).drop("_s", "_n")
    x, name = F.col("_delta"), "teammate_finish_delta_ewm"
    return with_ewm(d, ["entrant"], TIME, x, 10, name, 3, ignore_na=True, hot=s.history).drop("_delta")


def teammate_quali_ewm(df: DataFrame, s: Sizes) -> DataFrame:
    """Needs teammate_quali_delta."""
    x = F.col("teammate_quali_delta")
    return with_ewm(
        df, ["entrant"], TIME, x, 10, "teammate_quali_delta_ewm", 3, ignore_na=True, hot=s.history
    )


def venue_type_form(df: DataFrame, s: Sizes) -> DataFrame:
    """Team's mean best finish at this kind of venue minus its overall one. Needs venue_type."""
    fc = F.when(classified(), F.col("finish_position"))
    per = df.groupBy(*TEAM_CONTEST, "venue_type").agg(F.min(fc).alias("_b"))
    per = with_rolling_means(per, ["team"], TIME, {"_all": (F.col("_b"), 6, 3)}, s.history)
    per = with_rolling_means(per, ["team", "venue_type"], TIME, {"_kind": (F.col("_b"), 6, 2)}, s.history)
    return per.select(*TEAM_CONTEST, (F.col("_kind") - F.col("_all")).alias("team_type_form_delta"))


def car_pace_trend(per_team: DataFrame, s: Sizes) -> DataFrame:
    """This contest's pace delta minus the recent weighted mean. One row per team and contest."""
    x = F.col("car_pace_delta_pct")
    d = with_ewm(per_team, ["team"], TIME, x, 5, "_prev", hot=s.history)
    return d.select(*TEAM_CONTEST, (x - F.col("_prev")).alias("car_pace_trend"))


def era_progress(df: DataFrame, resets: Sequence[int] = tuple(fv.REGULATION_RESETS)) -> DataFrame:
    """Contests since the last regulation reset over 44, at most 1."""
    era = F.lit(None).cast("int")
    for r in sorted(resets):
        era = F.when(F.col("year") >= r, F.lit(r)).otherwise(era)
    years = df.groupBy("year").agg(F.max("round").alias("_n"))
    years = years.withColumn("_era", F.coalesce(era, F.col("year")))
    w = Window.partitionBy("_era").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("year", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    d = join_groups(df, years, ["year"])
    done = (F.col("_start") + F.col("round") - 1) / 44.0
    return d.withColumn("reg_era_progress", F.least(done, F.lit(1.0))).drop("_start")


def pit_delta(df: DataFrame, x: Column, s: Sizes) -> DataFrame:
    """Team median minus field median of x."""
    team = quantiles(df, TEAM_CONTEST, x, {"_t": 0.5}, s.contest)
    field = quantiles(df, CONTEST, x, {"_f": 0.5}, s.contest)
    d = join_groups(join_groups(df, team, TEAM_CONTEST), field, CONTEST)
    return d.withColumn("team_pit_delta_s", F.col("_t") - F.col("_f")).drop("_t", "_f")
