"""Bootstrap intervals with draws fixed by hashes, so a rerun gives the same interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.operators.grouping import checkpointed, with_index
from fieldorder.operators.probability import hash_uniform


def resampled(
    units: DataFrame, order: Sequence[str], replicates: int, hot: bool | None = None
) -> DataFrame:
    """(replicate, unit columns): every replicate draws as many units as there are, with replacement.

    Units are numbered once; draw i of replicate b is unit floor(u(b, i) * n) + 1. Units should be
    materialised: they are read for the count, the draws and the values.
    """
    n = units.agg(F.count(F.lit(1)).alias("_n"))
    numbered = with_index(units.withColumn("_all", F.lit(0)), ["_all"], order, "_i", hot).drop("_all")
    draws = (
        numbered.select("_i")
        .crossJoin(F.broadcast(n))  # one row
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    )
    u = hash_uniform(F.col("replicate"), F.col("_i"))
    draws = draws.select("replicate", (F.floor(u * F.col("_n")) + 1).cast("int").alias("_i"))
    return draws.join(numbered, "_i").drop("_i")


def interval(draws: DataFrame, statistic: Column, point: DataFrame) -> DataFrame:
    """2.5 and 97.5 percentiles of the statistic over replicates, beside the point estimate."""
    per = draws.groupBy("replicate").agg(statistic.alias("_v"))
    ends = per.agg(
        F.percentile("_v", F.lit(0.025)).alias("low"), F.percentile("_v", F.lit(0.975)).alias("high")
    )
    return point.crossJoin(F.broadcast(ends))


def paired(df: DataFrame, a: str, b: str, order: Sequence[str], replicates: int = 2000, hot=None) -> DataFrame:
    """Mean of a - b over rows where both are known, with its 95 % interval."""
    d = checkpointed(df.select(*order, (F.col(a) - F.col(b)).alias("_d")).where(F.col("_d").isNotNull()))
    point = d.agg(F.avg("_d").alias("mean"))
    return interval(resampled(d, order, replicates, hot), F.avg("_d"), point)


def clustered(
    df: DataFrame, cluster: Sequence[str], x: Column, replicates: int = 2000, hot=None
) -> DataFrame:
    """Mean of x over rows when whole clusters are resampled (one total per cluster is enough)."""
    per = checkpointed(df.groupBy(*cluster).agg(F.sum(x).alias("_s"), F.count(x).alias("_c")))
    point = per.agg((F.sum("_s") / F.sum("_c")).alias("mean"))
    return interval(resampled(per, cluster, replicates, hot), F.sum("_s") / F.sum("_c"), point)
