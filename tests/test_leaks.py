"""Features of a contest must not depend on its own or later outcomes."""

from pyspark.sql import functions as F

from fieldorder.functions.fixed_values import FEATURE_COLUMNS
from fieldorder.operators import features as ft
from fieldorder.plans.feature_matrix import Inputs, feature_matrix, with_future
from fieldorder.plans.venues import venue_name
from fieldorder.sources.tables import Tables

S = ft.Sizes(contest=False, history=False)
LATE = ["driver_form_5", "driver_form_ewm", "cum_points_before", "championship_position", "dnf_rate", "circuit_avg_finish",
        "circuit_grid_conversion", "driver_elo", "team_form_5", "team_reliability_rate", "team_cum_points", "championship_pressure"]


def test_outcomes_do_not_leak_and_future_rows_work(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    r = t.results.where("year <= 1996").withColumn("venue_key", venue_name(F.col("venue"))).cache()
    hit = (F.col("year") == 1996) & (F.col("round") >= 6)
    changed = r.withColumn("finish_position", F.when(hit, 30 - F.col("entrant")).otherwise(F.col("finish_position")).cast("int"))
    changed = changed.withColumn("points", F.when(hit, 0).otherwise(F.col("points"))).withColumn("dnf", F.when(hit, 0).otherwise(F.col("dnf")))
    fill = spark.createDataFrame([tuple([-1.0] * len(FEATURE_COLUMNS))], ", ".join(f"{c} double" for c in FEATURE_COLUMNS))
    remaining = spark.createDataFrame([(1997, 1, "monza")], "year int, round int, venue_key string")
    a = feature_matrix(Inputs(with_future(r, remaining)), S, fill, domain=False)
    b = feature_matrix(Inputs(changed), S, fill, domain=False)
    upto = "year < 1996 or (year = 1996 and round <= 6)"
    keys = ["year", "round", "entrant"]
    rows = lambda d: {tuple(x[:3]): [round(float(v), 9) for v in x[3:]] for x in d.where(upto).select(*keys, *LATE).collect()}
    left, right = rows(a), rows(b)
    assert left and left == right
    nxt = a.where("year = 1997").select("driver_form_5", "driver_elo", "target_position").collect()
    assert nxt and all(x["driver_form_5"] > 0 and x["driver_elo"] > 0 for x in nxt)
