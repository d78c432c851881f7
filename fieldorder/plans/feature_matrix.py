"""The feature matrix: one plan for training and for contests still to come.

Future contests are appended as rows with empty outcomes; every feature looks back only, so the
same plan serves both and there is no second code path to keep in step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.functions.lookups import is_street, safety_car_rate, venue_type
from fieldorder.operators import features as ft
from fieldorder.operators import field as fd
from fieldorder.operators import joins as jn
from fieldorder.operators import ratings as rt
from fieldorder.operators.grouping import checkpointed, join_groups
from fieldorder.plans.models import target_position

KEY = ["year", "round", "entrant"]


@dataclass(frozen=True)
class Inputs:
    """Source tables. Optional ones may be absent; their features take the neutral value.

    results: year, round, venue_key, entrant, team, league, quali_position, grid_position,
    finish_position, dnf, points, podium, best_time_ms. weather: year, round, precip_mm_total,
    temp_c_mean, windspeed_ms_mean, humidity_pct_mean, is_wet. sprint: year, round, entrant,
    sprint_position, n_starters. practice: year, round, entrant, fp_longrun_gap_pct,
    team_longrun_gap_pct. calendar: year, n_rounds.
    """

    results: DataFrame
    weather: DataFrame | None = None
    sprint: DataFrame | None = None
    practice: DataFrame | None = None
    calendar: DataFrame | None = None


def feature_matrix(
    x: Inputs, s: ft.Sizes, saved_fill: DataFrame | None = None, domain: bool = True, cut: bool = True
) -> DataFrame:
    """All feature columns, targets and ids. ``cut`` checkpoints between the stages of the plan."""

    def stage(d: DataFrame) -> DataFrame:
        return checkpointed(d) if cut else d

    d = x.results.withColumn("venue", F.col("venue_key"))
    d = stage(ft.pit_lane_to_back(d, s))
    base = d
    # order-dependent ratings
    elo = rt.elo_ratings(base, hot=s.league).drop("league")
    d = d.join(elo, KEY, "left")
    # entrant history: all on one partitioning by entrant
    d = ft.driver_form_ewm(ft.dnf_rate(ft.driver_form(d, s), s), s)
    d = ft.experience(d, s)
    d = stage(ft.venue_history(d))
    # contest: standings, grid, qualifying
    d = ft.championship_position(ft.points_before(d, s), s)
    d = ft.championship_pressure(d, s, x.calendar)
    d = ft.teammate_quali_delta(ft.quali_gap(d, s), s)
    d = ft.grid_penalty(ft.grid_relative(ft.quali_gap_relative(d, s), s))
    d = stage(ft.round_fraction(d, x.calendar))
    # teams and venues: small tables joined back
    pace = ft.car_pace_delta(d, s)
    for per in (ft.team_points(base, s), ft.team_reliability(base, s), ft.team_form(base, s), pace):
        d = join_groups(d, per, ft.TEAM_CONTEST)
    d = d.join(_side(ft.grid_conversion(base, s), "circuit_grid_conversion"), KEY, "left")
    d = join_groups(d, ft.overtaking_index(base, s), ["venue", "year", "round"])
    d = stage(d)
    # weather, sprint, practice
    if x.weather is not None:
        d = fd.attach_weather(d, x.weather, ["temp_c_mean", "precip_mm_total", "windspeed_ms_mean", "humidity_pct_mean"])
        d = d.withColumnRenamed("is_wet", "is_wet_race")
    else:
        none = F.lit(None).cast("double")
        d = d.withColumns({c: none for c in ("temp_c_mean", "precip_mm_total", "windspeed_ms_mean", "humidity_pct_mean")})
        d = d.withColumn("is_wet_race", F.lit(0))
    d = ft.wet_form(d, s)
    if x.sprint is not None:
        d = d.join(x.sprint.select(*KEY, "sprint_position", "n_starters"), KEY, "left")
        d = d.withColumn("sprint_position_rel", ft.sprint_relative(F.col("sprint_position"), F.col("n_starters")))
        d = d.drop("sprint_position", "n_starters")
    else:
        d = d.withColumn("sprint_position_rel", F.lit(0.5))
    if x.practice is not None:
        d = d.join(x.practice.select(*KEY, "fp_longrun_gap_pct", "team_longrun_gap_pct"), KEY, "left")
    d = d.withColumn("is_street_circuit", is_street(F.col("venue_key")))
    d = d.withColumn("circuit_safety_car_rate", safety_car_rate(F.col("venue_key")))
    if domain:
        d = stage(d)
        d = with_domain(d, s)
    for c in fv.FEATURE_COLUMNS:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("double"))
    d = stage(d)
    d = fd.with_fill(d, fv.FEATURE_COLUMNS, saved_fill)
    d = target_position(d, s.contest)
    for c in ("entrant", "team", "venue_key"):
        d = jn.category_codes(d, base, c, f"{c}_idx")
    return d


def _side(d: DataFrame, *columns: str) -> DataFrame:
    return d.select(*KEY, *columns)


def with_domain(c: DataFrame, s: ft.Sizes) -> DataFrame:
    """Context features beyond the base list.

    Every block is computed from the same (materialised) frame and joined back by key, so the plan
    grows with the number of blocks and not with their nesting.
    """
    gain = ft.slot_gain(c)
    per_pace = c.groupBy(*ft.TEAM_CONTEST).agg(F.avg("car_pace_delta_pct").alias("car_pace_delta_pct"))
    typed = c.withColumn("venue_type", venue_type(F.col("venue_key")))
    by_entrant = [
        _side(ft.gain_ewm(gain, s), "driver_gain_ewm"),
        _side(ft.teammate_quali_ewm(ft.teammate_finish_ewm(c, s), s), "teammate_finish_delta_ewm", "teammate_quali_delta_ewm"),
        _side(jn.traffic(c, F.col("driver_elo"), "entrant", s), "stronger_behind_n", "weaker_ahead_n"),
        _side(ft.quali_vs_prior(c, s), "quali_vs_prior"),
    ]
    by_team = [ft.team_gain_ewm(gain, s), ft.venue_type_form(typed, s), ft.car_pace_trend(per_pace, s)]
    d = ft.era_progress(fd.elo_rank_gap(typed, F.col("driver_elo"), s))
    for side in by_entrant:
        d = d.join(side, KEY, "left")
    for side in by_team:
        d = d.join(side, ft.TEAM_CONTEST, "left")
    return d.join(ft.quali_stats(c, s), ["year", "round"], "left")


def with_future(results: DataFrame, remaining: DataFrame) -> DataFrame:
    """Results plus empty rows for contests to come (year, round, venue_key)."""
    cols = [c for c in results.columns if c not in ("year", "round", "venue", "venue_key", "entrant", "team", "league")]
    lineup = results.select("entrant", "league").distinct()
    f = jn.future_rows(results, remaining.withColumnRenamed("venue_key", "venue"), cols)
    f = f.withColumnRenamed("venue", "venue_key").join(lineup, "entrant").withColumn("dnf", F.coalesce("dnf", F.lit(0)))
    return results.unionByName(f, allowMissingColumns=True)
