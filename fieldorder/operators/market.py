"""Market prices as probabilities, blending with a model, and scores of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.operators.grouping import with_totals

RACE = ["year", "round"]
FLOOR = 0.002
BLEND = [round(0.1 * i, 1) for i in range(17)]


def quote_price(bid: Column, ask: Column, last: Column, unit: float = 1.0, spread: float = 0.15) -> Column:
    """Mid of a usable book, else the last trade, else null. ``unit`` is one price point's size."""
    width = (ask - bid) * unit
    return (
        F.when((bid >= 0) & (width > 0) & (width <= spread), (bid + ask) / 2.0 * unit)
        .when(last > 0, last * unit)
        .otherwise(F.lit(None).cast("double"))
    )


def devig(prices: DataFrame, price: str, total: float, out: str, hot: bool | None) -> DataFrame:
    """Scale one market's prices to sum to ``total``; contests with too thin a book drop out."""
    d = prices.where(F.col(price).isNotNull() & F.col("entrant").isNotNull())
    d = d.withColumn("_p", F.greatest(F.col(price), F.lit(0.001)))
    d = with_totals(d, RACE, {"_s": F.sum("_p")}, hot).where(F.col("_s") >= 0.5 * total)
    return d.select(*RACE, "entrant", (F.col("_p") * total / F.col("_s")).alias(out))


def both_markets(win: DataFrame, podium: DataFrame) -> DataFrame:
    return win.join(podium, [*RACE, "entrant"], "full_outer")


def with_floor(df: DataFrame, p: str, floor: float, total: float, hot: bool | None) -> DataFrame:
    """Entrants without a listed price get the floor; then the contest sums to ``total`` again."""
    d = df.withColumn(p, F.coalesce(F.col(p), F.lit(floor)))
    d = with_totals(d, RACE, {"_s": F.sum(p)}, hot)
    return d.withColumn(p, F.col(p) * total / F.col("_s")).drop("_s")


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def blend_win(df: DataFrame, keys: Sequence[str], model: str, market: str, a: Column, b: Column, out: str, hot) -> DataFrame:
    """Softmax of a ln(model) + b ln(market) per group."""
    z = a * F.log(F.greatest(F.col(model), F.lit(1e-4))) + b * F.log(F.greatest(F.col(market), F.lit(1e-4)))
    d = with_totals(df.withColumn("_z", z), keys, {"_m": F.max("_z")}, hot)
    d = d.withColumn("_w", F.exp(F.col("_z") - F.col("_m")))
    d = with_totals(d, keys, {"_s": F.sum("_w")}, hot)
    return d.withColumn(out, F.col("_w") / F.col("_s")).drop("_z", "_m", "_w", "_s")


def blend_podium(df: DataFrame, keys: Sequence[str], model: str, market: str, a: Column, b: Column, out: str, hot) -> DataFrame:
    """Logit blend rescaled to three podium places, then clipped."""
    d = df.withColumn("_q", sigmoid(a * logit(F.col(model)) + b * logit(F.col(market))))
    d = with_totals(d, keys, {"_s": F.sum("_q")}, hot)
    p = F.col("_q") * 3.0 / F.col("_s")
    return d.withColumn(out, F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))).drop("_q", "_s")


def contest_scores(df: DataFrame, keys: Sequence[str], p_win: str, p_podium: str) -> DataFrame:
    """ll_winner, mean binary ll_podium, win Brier and winner hit per contest."""
    pw = F.least(F.greatest(F.col(p_win), F.lit(1e-6)), F.lit(1.0))
    pp = F.least(F.greatest(F.col(p_podium), F.lit(1e-4)), F.lit(1 - 1e-4))
    won, pod = F.col("won") == 1, F.col("podium") == 1
    return df.groupBy(*keys).agg(
        F.sum(F.when(won, -F.log(pw))).alias("ll_winner"),
        F.avg(F.when(pod, -F.log(pp)).otherwise(-F.log(1 - pp))).alias("ll_podium"),
        F.avg(F.pow(pw - F.col("won"), 2)).alias("brier_win"),
        F.max_by(won, F.struct(pw, -F.col("entrant"))).alias("winner_hit"),
    )


def blend_grid() -> list[tuple[float, float]]:
    return [(a, b) for a in BLEND for b in BLEND if a or b]


def blend_losses(df: DataFrame, model: str, market: str, hot: bool | None) -> DataFrame:
    """Winner log loss of every contest at every blend weight pair."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in blend_grid()])
    lm = F.log(F.greatest(F.col(model), F.lit(1e-4)))
    lk = F.log(F.greatest(F.col(market), F.lit(1e-4)))
    d = df.select(*RACE, lm.alias("_lm"), lk.alias("_lk"), "won")
    # logs are at most 0 and at least ln 1e-4, so exp(a lm + b lk) needs no shift: > 1e-13
    d = d.withColumn("_ab", F.explode(pairs)).select("*", "_ab.a", "_ab.b")
    w = F.exp(F.col("a") * F.col("_lm") + F.col("b") * F.col("_lk"))
    g = d.groupBy(*RACE, "a", "b").agg(F.sum(w).alias("_s"), F.max(F.when(F.col("won") == 1, w)).alias("_w"))
    p = F.least(F.greatest(F.col("_w") / F.col("_s"), F.lit(1e-6)), F.lit(1.0))
    return g.select(*RACE, "a", "b", (-F.log(p)).alias("ll_winner"))


def crossfit_weights(losses: DataFrame) -> DataFrame:
    """Per season: the weight pair with the lowest mean loss over all other seasons."""
    season = losses.groupBy("year", "a", "b").agg(F.sum("ll_winner").alias("_s"), F.count("ll_winner").alias("_c"))
    total = losses.groupBy("a", "b").agg(F.sum("ll_winner").alias("_ts"), F.count("ll_winner").alias("_tc"))
    d = season.join(total, ["a", "b"])
    loss = F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tc") - F.col("_c"))
    best = F.min(F.struct(loss.alias("loss"), F.col("a"), F.col("b"))).alias("m")
    return d.groupBy("year").agg(best).select("year", "m.a", "m.b", "m.loss")
