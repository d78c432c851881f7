"""The whole feature matrix and stream twins run on the given tables."""

from pyspark.sql import functions as F

from fieldorder.plans.feature_matrix import Inputs, feature_matrix
from fieldorder.plans.queries.field import sprint_rows
from fieldorder.plans.queries.history import KEY, sizes
from fieldorder.plans.registry import query
from fieldorder.plans.venues import venue_name


def inputs(t) -> Inputs:
    t.settle_results()
    r = t.results.withColumn("venue_key", venue_name(F.col("venue")))
    w = t.weather.select(
        "year", "round", (F.col("precip_tenths_mm") / 10.0).alias("precip_mm_total"), F.col("temp_c").cast("double").alias("temp_c_mean"),
        F.lit(None).cast("double").alias("windspeed_ms_mean"), F.lit(None).cast("double").alias("humidity_pct_mean"), "is_wet",
    )
    return Inputs(results=r, weather=w, sprint=sprint_rows(t))


@query("M01_feature_matrix")
def matrix(t):
    from fieldorder.functions import fixed_values as fv

    d = feature_matrix(inputs(t), sizes(t))
    return d.select(*KEY, "team", "target_position", "entrant_idx", "team_idx", "venue_key_idx",
                    *[F.round(F.col(c).cast("double"), 6).alias(c) for c in fv.FEATURE_COLUMNS])
