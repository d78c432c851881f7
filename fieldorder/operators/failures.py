"""Conditions of a contest before and after it, for asking which of them go with bad predictions (H36)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.functions.fixed_values import REGULATION_RESETS
from fieldorder.operators.grouping import with_index, with_totals

RACE = ["year", "round"]

#: Known before the start, and known after the finish.
BEFORE = [
    "wet", "precip_mm", "street", "sc_rate", "sprint_weekend", "reg_reset_year", "season_opener_3", "new_circuit",
    "quali_shuffle", "quali_spread", "fav_not_on_pole", "fav_grid", "fav_margin", "fav_p_finish",
    "top5_rating_out_of_top6", "front_row_teammates", "top2_team_gap_pct", "teams_within_0_3pct", "temp_c", "wind_ms",
    "title_pressure",
]
AFTER = ["fav_dnf", "n_dnf", "top5_rating_dnf", "winner_grid", "winner_model_rank", "pole_dnf"]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _count(c: Column) -> Column:
    return F.sum(_flag(c))


def team_pace(df: DataFrame, hot: bool | None) -> DataFrame:
    """How far the second team is behind the first, and the teams within 0.3 of the first; teams without a pace are out."""
    teams = df.where("car_pace_delta_pct IS NOT NULL").groupBy(*RACE, "team").agg(F.max("car_pace_delta_pct").alias("_pace"))
    d = with_totals(teams, RACE, {"_best": F.min("_pace")}, hot)
    ahead = F.col("_pace") == F.col("_best")
    behind = F.min(F.when(~ahead, F.col("_pace") - F.col("_best")))
    gap = F.when(_count(ahead) > 1, F.lit(0.0)).otherwise(behind)
    close = _count(F.col("_pace") - F.col("_best") <= 0.3)
    return d.groupBy(*RACE).agg(gap.alias("top2_team_gap_pct"), close.alias("teams_within_0_3pct"))


def contest_conditions(df: DataFrame, hot: bool | None = None) -> DataFrame:
    """year, round and the conditions BEFORE and AFTER, as doubles; one row per contest.

    ``df`` has a row per entrant: year, round, entrant, team, pred (lower is stronger), p_finish, rating, grid_position,
    finish_position, dnf, car_pace_delta_pct, sprint_position_rel, circuit_appearances, championship_pressure, and the
    contest's own is_wet, precip_mm, is_street_circuit, circuit_safety_car_rate, quali_shuffle, quali_spread_pct, temp_c
    and wind_ms, equal in its rows. The favourite is the entrant with the lowest ``pred``, ties by entrant, nulls last;
    ties among the five highest ratings go to the lower ``pred``, and entrants without a rating are not among them.
    Flags are 0 where what they ask for is unknown, but a favourite without a place did not start from pole. Measures
    that are unknown are null. A contest with several winners counts the one with the lowest ``pred``.

    Everything is one aggregate of flags over two numberings, so a contest of any size is combined map-side.
    """
    d = with_index(df, RACE, [F.col("pred").asc_nulls_last(), "entrant"], "_k", hot)
    order = [F.col("rating").desc_nulls_last(), F.col("pred").asc_nulls_last(), "entrant"]
    d = with_index(d, RACE, order, "_r", hot)
    fav, top = F.col("_k") == 1, (F.col("_r") <= 5) & F.col("rating").isNotNull()
    grid, out, won = F.col("grid_position"), F.col("dnf") == 1, F.col("finish_position") == 1
    row = F.when(grid <= 2, F.col("team"))
    of_fav = lambda c: F.max(F.when(fav, F.col(c)))
    facts = {
        "wet": F.max(_flag(F.col("is_wet") == 1)),
        "precip_mm": F.max("precip_mm"),
        "street": F.max(_flag(F.col("is_street_circuit") == 1)),
        "sc_rate": F.max("circuit_safety_car_rate"),
        "sprint_weekend": F.max(_flag(F.col("sprint_position_rel") != 0.5)),
        "reg_reset_year": F.max(_flag(F.col("year").isin(REGULATION_RESETS))),
        "season_opener_3": F.max(_flag(F.col("round") <= 3)),
        "new_circuit": _flag(F.max("circuit_appearances") <= 1),
        "quali_shuffle": F.max("quali_shuffle"),
        "quali_spread": F.max("quali_spread_pct"),
        "fav_not_on_pole": F.lit(1.0) - F.max(_flag(fav & (grid == 1))),
        "fav_grid": of_fav("grid_position"),
        "fav_margin": F.max(F.when(F.col("_k") == 2, F.col("pred"))) - of_fav("pred"),
        "fav_p_finish": of_fav("p_finish"),
        "top5_rating_out_of_top6": _count(top & (grid > 6)),
        "front_row_teammates": _flag(F.min(row) == F.max(row)),
        "temp_c": F.max("temp_c"),
        "wind_ms": F.max("wind_ms"),
        "title_pressure": F.min("championship_pressure"),
        "fav_dnf": F.max(_flag(fav & out)),
        "n_dnf": _count(out),
        "top5_rating_dnf": _count(top & out),
        "winner_grid": F.min_by(F.when(won, grid), F.when(won, F.col("_k"))),
        "winner_model_rank": F.min(F.when(won, F.col("_k"))),
        "pole_dnf": F.max(_flag((grid == 1) & out)),
    }
    g = d.groupBy(*RACE).agg(*[v.cast("double").alias(k) for k, v in facts.items()])
    g = g.join(team_pace(df, hot), RACE, "left").withColumn("teams_within_0_3pct", F.coalesce("teams_within_0_3pct", F.lit(0.0)))
    return g.select(*RACE, *BEFORE, *AFTER)
