"""Contest-level calibration of strengths: temperature, slopes and a disrupted-contest mixture."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.operators.probability import top_nll

RACE = ["year", "round"]


@dataclass(frozen=True)
class Parameters:
    temperature: float = 1.0
    rating_weight: float = 0.0
    overtaking_slope: float = 0.0
    quali_shuffle_slope: float = 0.0
    quali_spread_slope: float = 0.0
    sprint_slope: float = 0.0
    sc_scale: float = 0.0
    sc_flatten: float = 0.5
    lambda_2: float = 1.0
    lambda_3: float = 1.0

    @property
    def powers(self) -> tuple[float, float, float]:
        return (1.0, self.lambda_2, self.lambda_3)


def _value(p: Parameters, name: str, swept: str | None) -> Column:
    return F.col("value") if name == swept else F.lit(float(getattr(p, name)))


def strength(p: Parameters, swept: str | None = None) -> Column:
    """(raw + weight * rating) / (T * exp(sum of slope * standardised condition))."""
    bend = _value(p, "sprint_slope", swept) * F.col("sprint")
    for name, (mean, scale) in fv.CALIBRATION_REFERENCE.items():
        bend = bend + _value(p, f"{name}_slope", swept) * (F.col(name) - mean) / scale
    top = F.col("raw") + _value(p, "rating_weight", swept) * F.col("rating")
    return top / (_value(p, "temperature", swept) * F.exp(bend))


def mixture_nll(
    df: DataFrame, p: Parameters, hot: bool | None, swept: str | None = None
) -> DataFrame:
    """Top-3 log loss when a share of contests runs with flattened strengths."""
    keys = [*RACE, *(["value"] if swept else [])]
    d = df.withColumn("_strength", strength(p, swept))
    s, place = F.col("_strength"), F.col("finish_position")
    calm = top_nll(d, keys, s, place, 3, hot, p.powers, out="_a")
    wild = top_nll(d, keys, s * _value(p, "sc_flatten", swept), place, 3, hot, p.powers, out="_b")
    share = F.least(_value(p, "sc_scale", swept) * F.max("sc_rate"), F.lit(0.9)).alias("_p")
    if swept == "sc_scale":
        share = F.least(F.max("value") * F.max("sc_rate"), F.lit(0.9)).alias("_p")
    shares = d.groupBy(*keys).agg(share)
    mixed = -F.log((1 - F.col("_p")) * F.exp(-F.col("_a")) + F.col("_p") * F.exp(-F.col("_b")))
    nll = F.when(F.col("_p") <= 0, F.col("_a")).otherwise(mixed)
    return calm.join(wild, keys).join(shares, keys).select(*keys, nll.alias("nll"))


def sweep(df: DataFrame, p: Parameters, name: str, grid: Sequence[float], hot: bool | None) -> DataFrame:
    """Mean loss for every value of one parameter (the grid rides along as a projection)."""
    if name in ("lambda_2", "lambda_3"):  # the place powers are part of the plan, not of the rows
        parts = [
            mixture_nll(df, replace(p, **{name: float(v)}), hot)
            .agg(F.avg("nll").alias("loss"))
            .select(F.lit(float(v)).alias("value"), "loss")
            for v in grid
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    d = df.withColumn("value", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    return mixture_nll(d, p, hot, swept=name).groupBy("value").agg(F.avg("nll").alias("loss"))


def fit(
    df: DataFrame, names: Sequence[str], hot: bool | None, start: Parameters | None = None, rounds: int = 2
) -> Parameters:
    """Coordinate descent over the fixed grids; temperature first. One small result per sweep."""
    p = start or Parameters()
    order = ["temperature", *[n for n in names if n != "temperature"]]
    best = mixture_nll(df, p, hot).agg(F.avg("nll")).first()[0]
    for _ in range(rounds):
        for name in order:
            rows = sweep(df, p, name, fv.CALIBRATION_GRIDS[name], hot).orderBy("loss", "value").limit(1)
            row = rows.first()
            if row["loss"] < best - 1e-9:
                p, best = replace(p, **{name: float(row["value"])}), row["loss"]
    return p
