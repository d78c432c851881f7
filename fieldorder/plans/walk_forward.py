"""Walk-forward predictions: every season by a model fitted on the seasons before it.

A ``Predictor`` takes training and test rows and returns the test rows with a prediction. Any of them can be walked
season by season (``by_season``). Where a fit needs only sums over its rows, sums are taken once per season and added
up season after season (``LeastSquares``), so one pass over the rows fits all folds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predictor = Callable[[DataFrame, DataFrame], DataFrame]


def seasons(rows: DataFrame) -> list[int]:
    return sorted(r["year"] for r in rows.select("year").distinct().where("year IS NOT NULL").collect())


def by_season(rows: DataFrame, predictor: Predictor, first: int | None = None) -> DataFrame:
    """The test rows of every season from ``first`` (the second one) on, each predicted from all earlier seasons."""
    years = seasons(rows)
    tested = [y for y in years[1:] if first is None or y >= first]
    parts = [predictor(rows.where(F.col("year") < y), rows.where(F.col("year") == y)) for y in tested]
    return reduce(DataFrame.unionByName, parts) if parts else predictor(rows.where("false"), rows.where("false"))


class LeastSquares:
    """Linear least squares with an intercept; ``half_life`` (years) weighs a season by its age.

    Rows without a target or an input are left out of the fit and get no prediction. A season's rows become one row of
    sums; a fold adds up the sums of the seasons before it, weighed by their age, and solves one small system. Inputs
    that say the same share their coefficient (the smallest solution).
    """

    def __init__(self, columns: Sequence[str], target: str, half_life: float | None = None, ridge: float = 0.0):
        self.columns, self.target, self.half_life, self.ridge = list(columns), target, half_life, ridge

    def season_sums(self, rows: DataFrame) -> dict[int, np.ndarray]:
        """Per season the products of (1, inputs, target), summed: one row a season reaches the driver."""
        names = ["one", *[f"x{i}" for i in range(len(self.columns))], "y"]
        values = [F.lit(1.0), *[F.col(c).cast("double") for c in self.columns], F.col(self.target).cast("double")]
        d = rows.select("year", *[v.alias(n) for n, v in zip(names, values)]).dropna()
        pairs = list(combinations_with_replacement(names, 2))
        got = d.groupBy("year").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).collect()
        out = {}
        for r in got:
            m = np.zeros((len(names), len(names)))
            for (a, b), (i, j) in zip(pairs, combinations_with_replacement(range(len(names)), 2)):
                m[i, j] = m[j, i] = r[f"{a}_{b}"]
            out[r["year"]] = m
        return out

    def solved(self, sums: dict[int, np.ndarray], before: int) -> np.ndarray | None:
        """Intercept and coefficients from the seasons before ``before``; None without any."""
        past = [(y, m) for y, m in sums.items() if y < before]
        if not past:
            return None
        last = max(y for y, _ in past)
        total = sum(m * (0.5 ** ((last - y) / self.half_life) if self.half_life else 1.0) for y, m in past)
        # around the means, so that large means cost no digits of the slopes
        mean = total[0] / total[0, 0]
        around = total - total[0, 0] * np.outer(mean, mean)
        k = len(self.columns)
        a = around[1 : k + 1, 1 : k + 1] + self.ridge * total[0, 0] * np.eye(k)
        slope = np.linalg.lstsq(a, around[1 : k + 1, k + 1], rcond=1e-12)[0]
        return np.concatenate([[mean[k + 1] - mean[1 : k + 1] @ slope], slope])

    def _with(self, rows: DataFrame, folds: list[tuple], out: str) -> DataFrame:
        names = [f"_k{i}" for i in range(len(self.columns) + 1)]
        table = rows.sparkSession.createDataFrame(folds, "year int, " + ", ".join(f"{n} double" for n in names))
        z = reduce(lambda p, q: p + q, [F.col(n) * F.col(c).cast("double") for n, c in zip(names[1:], self.columns)], F.col(names[0]))
        return rows.join(F.broadcast(table), "year").withColumn(out, z).drop(*names)  # one row per season

    def walk(self, rows: DataFrame, out: str = "predicted") -> DataFrame:
        """All seasons but the first, each predicted from the seasons before it: one pass for every fold."""
        sums = self.season_sums(rows)
        folds = [(y, self.solved(sums, y)) for y in seasons(rows)]
        return self._with(rows, [(y, *map(float, b)) for y, b in folds if b is not None], out)

    def __call__(self, train: DataFrame, test: DataFrame, out: str = "predicted") -> DataFrame:
        """As a Predictor: one fit on all training rows."""
        years = seasons(test)
        sums = self.season_sums(train)
        b = self.solved(sums, max(sums) + 1) if sums else None
        return self._with(test, [(y, *map(float, b)) for y in years] if b is not None else [], out)
