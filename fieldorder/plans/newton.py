"""Convex fits by Newton steps: one distributed pass a step returns loss, gradient and second moments.

Rows only ever meet in sums; the driver holds the coefficients and one small matrix. Near the optimum the error is
squared with every step, so a fit takes a handful of passes whatever its condition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest |score| of a row: beyond it exponentials may leave double precision, and a step is halved.
LARGEST = 500.0

Moments = tuple[float, np.ndarray, np.ndarray]


def _sum(terms) -> Column:
    return reduce(Column.__add__, terms, F.lit(0.0))


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(columns, 2))


def _scored(df: DataFrame, columns: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """Add the linear score. Coefficients come as a row and not as literals, so all passes share one compiled plan."""
    row = df.sparkSession.createDataFrame([tuple(map(float, beta))], ", ".join(f"_b{i} double" for i in range(len(columns))))
    z = _sum(F.col(c) * F.col(f"_b{i}") for i, c in enumerate(columns))
    return df.crossJoin(F.broadcast(row)).withColumn("_z", z)  # one row


def _moments(row, columns: Sequence[str], ridge: np.ndarray, beta: np.ndarray) -> Moments | None:
    """Loss, gradient and second derivatives with the penalty; None if a score left the safe range."""
    if row["far"] is None or row["far"] > LARGEST:
        return None
    h = np.zeros((len(columns), len(columns)))
    for (c, d), (i, j) in zip(_pairs(columns), _pairs(range(len(columns)))):
        h[i, j] = h[j, i] = row[f"h_{c}_{d}"]
    g = np.array([row[f"g_{c}"] for c in columns])
    return row["loss"] + 0.5 * float(ridge @ beta**2), g + ridge * beta, h + np.diag(ridge)


def order_moments(df: DataFrame, columns: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """Mean top-3 loss of the linear order model, its gradient and second derivatives, in one row.

    Stage j draws from the rows not yet placed. The rows behind the second place are summed once per contest; the
    placed rows are added to them stage by stage, so nothing is subtracted. Contests without three places are left
    out; a place is held by one row.
    """
    d = _scored(df, columns, beta).select("year", "round", "_z", F.col("finish_position").alias("_p"), *columns)
    e = F.when(F.col("_p").isNull() | (F.col("_p") >= 3), F.exp("_z")).otherwise(0.0)
    d = d.withColumn("_e", e)
    aggs = [F.sum("_e").alias("_s"), F.max(F.abs("_z")).alias("_far")]
    aggs += [F.sum(F.col("_e") * F.col(c)).alias(f"_s_{c}") for c in columns]
    aggs += [F.sum(F.col("_e") * F.col(a) * F.col(b)).alias(f"_s_{a}_{b}") for a, b in _pairs(columns)]
    for j in (1, 2, 3):
        aggs += [F.max(F.when(F.col("_p") == j, F.col(x))).alias(f"_{j}{x}") for x in ("_z", *columns)]
    g = d.groupBy("year", "round").agg(*aggs).where("_1_z IS NOT NULL AND _2_z IS NOT NULL AND _3_z IS NOT NULL")
    g = g.withColumns({f"_e{j}": F.exp(f"_{j}_z") for j in (1, 2)})

    def stage(j: int, name: str, of: Callable[[int], Column]) -> Column:
        return _sum([F.col(name), *[F.col(f"_e{k}") * of(k) for k in (2, 1) if k >= j]])

    one = lambda k: F.lit(1.0)
    at = lambda c: lambda k: F.col(f"_{k}{c}")
    total = {j: stage(j, "_s", one) for j in (1, 2, 3)}
    g = g.withColumns({f"_t{j}": total[j] for j in total})
    g = g.withColumns({f"_m{j}_{c}": stage(j, f"_s_{c}", at(c)) / F.col(f"_t{j}") for j in total for c in columns})
    loss = _sum(F.log(f"_t{j}") - F.col(f"_{j}_z") for j in total)
    slope = {c: _sum(F.col(f"_m{j}_{c}") - F.col(f"_{j}{c}") for j in total) for c in columns}
    curve = {
        (a, b): _sum(
            stage(j, f"_s_{a}_{b}", lambda k: F.col(f"_{k}{a}") * F.col(f"_{k}{b}")) / F.col(f"_t{j}")
            - F.col(f"_m{j}_{a}") * F.col(f"_m{j}_{b}")
            for j in total
        )
        for a, b in _pairs(columns)
    }
    return g.agg(
        F.avg(loss).alias("loss"), F.max("_far").alias("far"), F.count(F.lit(1)).alias("n"),
        *[F.avg(v).alias(f"g_{c}") for c, v in slope.items()],
        *[F.avg(v).alias(f"h_{a}_{b}") for (a, b), v in curve.items()],
    )


def logistic_moments(df: DataFrame, columns: Sequence[str], beta: Sequence[float], label: str, weight: str | None = None) -> DataFrame:
    """Weighted mean logistic loss, its gradient and second derivatives, in one row; an intercept is a column of ones."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = _scored(df, columns, beta).select("_z", w.alias("_w"), F.col(label).cast("double").alias("_y"), *columns)
    d = d.withColumn("_q", 1 / (1 + F.exp(-F.col("_z"))))
    d = d.withColumn("_r", F.col("_w") * (F.col("_q") - F.col("_y"))).withColumn("_v", F.col("_w") * F.col("_q") * (1 - F.col("_q")))
    # log(1 + exp(z)) - y z, with the larger exponent taken out
    loss = F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("_y") * F.col("_z")
    sums = d.agg(
        F.sum("_w").alias("n"), F.max(F.abs("_z")).alias("far"), F.sum(F.col("_w") * loss).alias("loss"),
        *[F.sum(F.col("_r") * F.col(c)).alias(f"g_{c}") for c in columns],
        *[F.sum(F.col("_v") * F.col(a) * F.col(b)).alias(f"h_{a}_{b}") for a, b in _pairs(columns)],
    )
    keep = [c for c in sums.columns if c not in ("n", "far")]
    return sums.select("n", "far", *[(F.col(c) / F.col("n")).alias(c) for c in keep])


def newton(
    one_pass: Callable[[Sequence[float]], DataFrame], columns: Sequence[str], ridge: Sequence[float], tolerance: float = 1e-9,
) -> tuple[list[float], int]:
    """Coefficients where the penalised loss is least, and the passes it took.

    A step that does not lower the loss is halved; the fit ends when the gradient is below ``tolerance`` or no step
    lowers the loss in double precision. Without rows all coefficients are 0.
    """
    ridge = np.array(ridge, float)
    beta = np.zeros(len(columns))
    now = _moments(one_pass(beta.tolist()).first(), columns, ridge, beta)
    passes, size = 1, 1.0
    while now is not None and np.abs(now[1]).max(initial=0) >= tolerance and size > 1e-9:
        step = np.linalg.lstsq(now[2], now[1], rcond=None)[0]
        trial = beta - size * step
        new = _moments(one_pass(trial.tolist()).first(), columns, ridge, trial)
        passes += 1
        if new is not None and new[0] < now[0]:
            beta, now, size = trial, new, 1.0
        elif new is not None and np.abs(new[1]).max() < np.abs(now[1]).max():
            return trial.tolist(), passes  # the loss is flat to the last bit, the gradient still fell
        else:
            size /= 2
    return beta.tolist(), passes


def equations(row: DataFrame, columns: Sequence[str], ridge: Sequence[float], beta: Sequence[float]) -> DataFrame:
    """column_name, n, equation: each penalised score equation at ``beta`` (0 at the fitted point)."""
    named = [F.struct(F.lit(c).alias("c"), F.abs(F.col(f"g_{c}") + float(r) * float(b)).alias("e")) for c, r, b in zip(columns, ridge, beta)]
    d = row.select("n", F.explode(F.array(*named)).alias("s"))
    return d.select(F.col("s.c").alias("column_name"), "n", F.col("s.e").alias("equation"))
