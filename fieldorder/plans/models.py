"""Models on feature tables with pyspark.ml, and a listwise linear model fitted by Spark sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.operators.grouping import checkpointed, with_index, with_totals
from fieldorder.operators.market import logit
from fieldorder.plans.newton import equations, logistic_moments, newton, order_moments

RACE = ["year", "round"]


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v_{c}") for c in columns])
    inputs = [f"_v_{c}" for c in columns]
    return VectorAssembler(inputCols=inputs, outputCol="_raw").transform(filled).drop(*inputs)


def _scaled(df: DataFrame, columns: Sequence[str], stats: dict[str, float]) -> DataFrame:
    """(x - mean) / deviation of the training rows, missing values as 0 before; a constant column is only shifted."""
    x = {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns({f"_x_{c}": v for c, v in x.items()}).withColumn("_x_1", F.lit(1.0))


class FinishFit:
    """Weighted logistic regression of finishing on standardised columns, unit ridge on all but the intercept."""

    def __init__(self, train: DataFrame, columns: Sequence[str], weight: str | None = None):
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
        parts = [f(x).alias(f"{n}_{c}") for c, x in zip(columns, filled) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        total = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
        self.stats = train.agg(*parts, total.cast("double").alias("total")).first().asDict()
        self.columns, self.weight = list(columns), weight
        self.inputs = ["_x_1", *[f"_x_{c}" for c in columns]]
        d = _scaled(train, columns, self.stats).withColumn("_y", F.coalesce((F.col("dnf") == 0).cast("double"), F.lit(1.0)))
        self.data = checkpointed(d.select("_y", *[F.col(weight).alias("_weight")] if weight else [], *self.inputs))
        # a penalty of |b|^2 / 2 on the summed loss is 1 / total on the mean loss
        self.ridge = [0.0, *[1.0 / (self.stats["total"] or 1.0)] * len(columns)]
        self.beta, self.passes = newton(self.moments, self.inputs, self.ridge)

    def moments(self, beta: Sequence[float]) -> DataFrame:
        return logistic_moments(self.data, self.inputs, beta, "_y", "_weight" if self.weight else None)

    def predict(self, test: DataFrame, out: str) -> DataFrame:
        z = sum((F.col(c) * float(b) for c, b in zip(self.inputs, self.beta)), F.lit(0.0))
        return _scaled(test, self.columns, self.stats).withColumn(out, 1 / (1 + F.exp(-z))).drop(*self.inputs)

    def equations(self) -> DataFrame:
        return equations(self.moments(self.beta), self.inputs, self.ridge, self.beta)


def finish_model(
    train: DataFrame, test: DataFrame, columns: Sequence[str], weight: str | None = None, out: str = "p_finish"
) -> DataFrame:
    """P(finish) of the test rows by a FinishFit on the training rows."""
    return FinishFit(train, columns, weight).predict(test, out)


def top_pairs(df: DataFrame, columns: Sequence[str], top: int, hot: bool | None, weight: str | None = None) -> DataFrame:
    """Feature differences of each of the ``top`` finishers with every finisher behind it.

    A row meets at most ``top`` others, so the pairs grow linearly with the rows.
    """
    d = df.where((F.col("dnf") == 0) & F.col("finish_position").isNotNull())
    d = with_index(d, RACE, ["finish_position", "entrant"], "_k", hot)
    w = F.col(weight) if weight else F.lit(1.0)
    d = d.select(*RACE, "entrant", "_k", w.alias("_w"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    first = d.where(F.col("_k") <= top)
    contest_weight = F.max(F.when(F.col("_k") == 1, F.col("_w"))).alias("_cw")
    heads = first.groupBy(*RACE).agg(
        F.collect_list(F.struct("_k", *columns)).alias("_heads"), contest_weight  # at most ``top`` rows
    )
    p = d.join(heads, RACE).withColumn("_h", F.explode("_heads")).where(F.col("_h._k") < F.col("_k"))
    sign = F.when(F.pmod(F.col("_k") + F.col("_h._k"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return p.select(
        *RACE,
        F.col("_cw").alias("weight"),
        F.when(sign > 0, 1.0).otherwise(0.0).alias("label"),
        *[((F.col(f"_h.{c}") - F.col(c)) * sign).alias(c) for c in columns],
    )


class RankerFit:
    """Linear ranker: logistic regression on feature differences of ``top_pairs``, no intercept, ridge on the mean loss."""

    def __init__(
        self, train: DataFrame, columns: Sequence[str], hot: bool | None, weight: str | None = None, top: int = 5, ridge: float = 1e-3
    ):
        self.pairs = checkpointed(top_pairs(train, columns, top, hot, weight))
        self.columns, self.ridge = list(columns), [ridge] * len(columns)
        self.beta, self.passes = newton(self.moments, self.columns, self.ridge)

    def moments(self, beta: Sequence[float]) -> DataFrame:
        return logistic_moments(self.pairs, self.columns, beta, "label", "weight")

    def predict(self, test: DataFrame, out: str) -> DataFrame:
        parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(b) for c, b in zip(self.columns, self.beta)]
        return test.withColumn(out, sum(parts, F.lit(0.0)))

    def equations(self) -> DataFrame:
        return equations(self.moments(self.beta), self.columns, self.ridge, self.beta)


def ranker(
    train: DataFrame, test: DataFrame, columns: Sequence[str], hot: bool | None, weight: str | None = None,
    top: int = 5, out: str = "score", ridge: float = 1e-3,
) -> tuple[DataFrame, list[float]]:
    """Scores of the test rows by a RankerFit on the training rows, and its coefficients."""
    fit = RankerFit(train, columns, hot, weight, top, ridge)
    return fit.predict(test, out), fit.beta


def position_regressor(
    train: DataFrame, test: DataFrame, columns: Sequence[str], weight: str | None = None, out: str = "predicted",
    trees: int = 20, depth: int = 4,
) -> DataFrame:
    """Boosted trees on target_position with absolute loss."""
    fit = GBTRegressor(featuresCol="_raw", labelCol="target_position", lossType="absolute", maxIter=trees, maxDepth=depth, seed=0)
    if weight:
        fit = fit.setWeightCol(weight)
    model = fit.fit(_assembled(train, columns))
    return model.transform(_assembled(test, columns)).withColumnRenamed("prediction", out).drop("_raw")


def target_position(df: DataFrame, hot: bool | None) -> DataFrame:
    """Finish, or starters + 1 without one."""
    d = with_totals(df, RACE, {"_n": F.count(F.lit(1))}, hot)
    return d.withColumn("target_position", F.coalesce(F.col("finish_position"), F.col("_n") + 1).cast("double")).drop("_n")


def order_loss_gradient(
    df: DataFrame, columns: Sequence[str], beta: Sequence[float], hot: bool | None, ridge: float = 0.0
) -> DataFrame:
    """Mean top-3 loss of the linear order model and its gradient, in one row.

    Stage j draws from the rows not yet placed; its gradient is the mean feature of what remains
    under the stage's softmax minus the feature of the placed row. All of it are group sums.
    """
    z = sum((F.col(c) * float(b) for c, b in zip(columns, beta)), F.lit(0.0))
    d = df.select(*RACE, z.alias("_z"), F.col("finish_position").alias("_p"), *columns)
    d = with_totals(d, RACE, {"_m": F.max("_z")}, hot)
    e = F.exp(F.col("_z") - F.col("_m"))
    aggs = [F.count_distinct(F.when(F.col("_p").between(1, 3), F.col("_p"))).alias("_n")]
    for j in (1, 2, 3):
        left = F.col("_p").isNull() | (F.col("_p") >= j)
        here = F.col("_p") == j
        aggs.append(F.sum(F.when(left, e)).alias(f"_e{j}"))
        aggs.append(F.max(F.when(here, F.col("_z") - F.col("_m"))).alias(f"_s{j}"))
        for c in columns:
            aggs.append(F.sum(F.when(left, e * F.col(c))).alias(f"_e{j}_{c}"))
            aggs.append(F.max(F.when(here, F.col(c))).alias(f"_x{j}_{c}"))
    g = d.groupBy(*RACE).agg(*aggs).where(F.col("_n") == 3)
    loss = sum((F.log(f"_e{j}") - F.col(f"_s{j}") for j in (1, 2, 3)), F.lit(0.0))
    slopes = {
        c: sum((F.col(f"_e{j}_{c}") / F.col(f"_e{j}") - F.col(f"_x{j}_{c}") for j in (1, 2, 3)), F.lit(0.0)) for c in columns
    }
    out = g.agg(F.avg(loss).alias("loss"), *[F.avg(v).alias(f"d_{c}") for c, v in slopes.items()])
    penalty = 0.5 * ridge * sum(float(b) ** 2 for b in beta)
    return out.select(
        (F.col("loss") + penalty).alias("loss"),
        *[(F.col(f"d_{c}") + ridge * float(b)).alias(f"d_{c}") for c, b in zip(columns, beta)],
    )


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation; missing values count as the mean."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    d = df.crossJoin(F.broadcast(stats))  # one row
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}
    return d.withColumns(z).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


class OrderFit:
    """Linear order model: Newton steps on the exact mean top-3 loss of standardised columns with a ridge."""

    def __init__(self, train: DataFrame, columns: Sequence[str], ridge: float = 0.01, tolerance: float = 1e-9):
        self.data = checkpointed(standardised(train, columns).select(*RACE, "finish_position", *columns))
        self.columns, self.ridge = list(columns), [ridge] * len(columns)
        self.beta, self.passes = newton(self.moments, self.columns, self.ridge, tolerance)

    def moments(self, beta: Sequence[float]) -> DataFrame:
        return order_moments(self.data, self.columns, beta)

    def equations(self) -> DataFrame:
        return equations(self.moments(self.beta), self.columns, self.ridge, self.beta)


def order_model(
    train: DataFrame, columns: Sequence[str], hot: bool | None = None, ridge: float = 0.01, tolerance: float = 1e-9
) -> list[float]:
    """Coefficients of an OrderFit. Contests are aggregated map-side, so their size (``hot``) does not matter."""
    return OrderFit(train, columns, ridge, tolerance).beta


def calibration_slope(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """Logistic fit y ~ a + b * logit(p); a and b near 0 and 1 mean calibrated."""
    d = df.select(logit(p).alias("slope"), F.lit(1.0).alias("one"), y.cast("double").alias("label"))
    d = checkpointed(d.where("slope is not null and label is not null"))
    (a, b), _ = newton(lambda beta: logistic_moments(d, ["one", "slope"], beta, "label"), ["one", "slope"], [0.0, 0.0])
    return df.sparkSession.createDataFrame([(a, b)], "cal_intercept double, cal_slope double")


def mean_scores(frames: Sequence[DataFrame], keys: Sequence[str], score: str) -> DataFrame:
    """Average of several models' scores per row: a union and one aggregate, no chain of joins."""
    both = frames[0].select(*keys, score)
    for f in frames[1:]:
        both = both.unionByName(f.select(*keys, score))
    return both.groupBy(*keys).agg(F.avg(score).alias(score))


def forward_folds(df: DataFrame, group: Column, folds: int) -> DataFrame:
    """(fold, group, part): the last ``folds`` groups are tested, each trained on all groups before it."""
    groups = df.select(group.alias("g")).distinct()
    tests = groups.orderBy(F.desc("g")).limit(folds).withColumnRenamed("g", "fold")
    pairs = groups.join(F.broadcast(tests), F.col("g") <= F.col("fold"))  # ``folds`` rows
    return pairs.select("fold", F.col("g").alias("group"), F.when(F.col("g") == F.col("fold"), "test").otherwise("train").alias("part"))
