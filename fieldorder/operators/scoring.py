"""Scores of predictions: per contest, per season, calibration tables and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.operators.grouping import checkpointed, with_index, with_totals

RACE = ["year", "round"]


def grid_score(df: DataFrame, grid: str, out: str, hot: bool | None) -> DataFrame:
    """The grid as predicted position; pit-lane starts and unknown ones go last."""
    g = F.col(grid)
    d = with_totals(df, RACE, {"_last": F.max(F.when(g > 0, g)), "_n": F.count(F.lit(1))}, hot)
    back = F.coalesce(F.col("_last") + 1, F.col("_n"))
    return d.withColumn(out, F.when(g > 0, g).otherwise(back)).drop("_last", "_n")


def fit_temperature(nll: DataFrame) -> DataFrame:
    """The temperature with the lowest mean loss (the smallest on ties)."""
    mean = nll.groupBy("temperature").agg(F.avg("ll_top3").alias("loss"))
    return mean.agg(F.min(F.struct("loss", "temperature")).alias("b")).select("b.temperature", "b.loss")


def leave_one_out(nll: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per contest: the temperature fitted on all other contests and the loss at it."""
    total = nll.groupBy("temperature").agg(F.sum("ll_top3").alias("_s"))
    other = F.col("_s") - F.col("ll_top3")
    pick = F.min_by(F.struct("temperature", "ll_top3"), F.struct(other, F.col("temperature")))
    return nll.join(total, "temperature").groupBy(*keys).agg(pick.alias("b")).select(*keys, "b.*")


def score_contests(df: DataFrame, pred: Column, who: str, nll: DataFrame, hot: bool | None) -> DataFrame:
    """Winner hit and podium overlap of the ranking by ``pred`` joined to the losses ``nll``.

    Only the three best predicted and three best finished rows of a contest are kept.
    """
    d = with_index(df.withColumn("_pred", pred), RACE, ["_pred", who], "_k", hot)
    fin = F.col("finish_position")
    d = d.where((F.col("_k") <= 3) | fin.between(1, 3))
    hits = d.groupBy(*RACE).agg(
        (F.count_if((F.col("_k") == 1) & (fin == 1)) > 0).alias("winner_hit"),
        F.count_if((F.col("_k") <= 3) & fin.between(1, 3)).alias("podium_overlap"),
    )
    return nll.join(hits, RACE)


def ece_edges(bins: int = 10) -> list[float]:
    return [i * (1.0 / bins) if bins != 10 else i * 0.1 for i in range(bins + 1)]


def bin_of(p: Column, edges: Sequence[float]) -> Column:
    """Index of the right-open bin; p at the last edge falls outside (index = bins)."""
    b = F.lit(-1)
    for i, e in enumerate(edges):
        b = F.when(p >= F.lit(float(e)), F.lit(i)).otherwise(b)
    return b


def calibration_error(
    df: DataFrame, keys: Sequence[str], p: Column, y: Column, out: str, bins: int = 10
) -> DataFrame:
    """Expected calibration error: sum over bins of n_bin / n * |mean y - mean p|.

    p = 1 lies outside the last bin; it counts in n only.
    """
    d = df.select(*keys, p.alias("_p"), y.cast("double").alias("_y"))
    d = d.withColumn("_b", bin_of(F.col("_p"), ece_edges(bins)))
    g = d.groupBy(*keys, "_b").agg(
        F.avg("_p").alias("_mp"), F.avg("_y").alias("_my"), F.count(F.lit(1)).alias("_n")
    )
    gap = F.when(F.col("_b") < bins, F.abs(F.col("_my") - F.col("_mp")) * F.col("_n")).otherwise(0.0)
    return g.groupBy(*keys).agg((F.sum(gap) / F.sum("_n")).alias(out))


def calibration_curve(df: DataFrame, p: Column, y: Column) -> DataFrame:
    d = df.select(p.alias("_p"), y.cast("double").alias("_y"))
    d = d.withColumn("bin", bin_of(F.col("_p"), ece_edges())).where("bin between 0 and 9")
    return d.groupBy("bin").agg(
        (F.col("bin") * 0.1 + 0.05).alias("prob_bin_mid"),
        F.avg("_p").alias("mean_predicted"),
        F.avg("_y").alias("mean_actual"),
        F.count(F.lit(1)).alias("n"),
    )


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share k / n; null when n is 0."""
    n = F.when(n > 0, n)
    p = k / n
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half))
    return low, F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))


def reliability_table(df: DataFrame, p: Column, y: Column, edges: Sequence[float]) -> DataFrame:
    """Per bin of the edges (the last bin includes its upper edge): predicted against observed."""
    inner = list(edges[1:-1])
    b = F.lit(0)
    for i, e in enumerate(inner):
        b = F.when(p >= F.lit(float(e)), F.lit(i + 1)).otherwise(b)
    g = (
        df.select(b.alias("bin"), p.alias("_p"), y.cast("bigint").alias("_y"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_pos"), F.avg("_p").alias("mean_pred"))
    )
    low, high = wilson(F.col("n_pos"), F.col("n"))
    seen = F.col("n_pos") / F.col("n")
    return g.select(
        "bin", "n", "n_pos", "mean_pred", seen.alias("observed"), low.alias("low"), high.alias("high"),
        (seen - F.col("mean_pred")).alias("obs_minus_pred"),
    )


def brier_parts(df: DataFrame, p: Column, y: Column, edges: Sequence[float]) -> DataFrame:
    """Brier score, its reliability / resolution / uncertainty, calibration error and log loss."""
    d = df.select(p.alias("_p"), y.cast("bigint").alias("_y"))
    table = reliability_table(d, F.col("_p"), F.col("_y"), edges)
    pc = F.least(F.greatest(F.col("_p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    whole = d.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg("_y").alias("base_rate"),
        F.avg(F.pow(F.col("_p") - F.col("_y"), 2)).alias("brier"),
        F.avg(-(F.col("_y") * F.log(pc) + (1 - F.col("_y")) * F.log(1 - pc))).alias("log_loss"),
    )
    n = F.col("n")
    parts = table.crossJoin(F.broadcast(whole)).groupBy("total", "base_rate", "brier", "log_loss").agg(
        (F.sum(n * F.pow(F.col("mean_pred") - F.col("observed"), 2)) / F.sum(n)).alias("reliability"),
        (F.sum(n * F.pow(F.col("observed") - F.col("base_rate"), 2)) / F.sum(n)).alias("resolution"),
        (F.sum(n * F.abs(F.col("observed") - F.col("mean_pred"))) / F.sum(n)).alias("ece"),
    )
    return parts.select(
        F.col("total").alias("n"), "base_rate", "brier", "reliability", "resolution",
        (F.col("base_rate") * (1 - F.col("base_rate"))).alias("uncertainty"), "ece", "log_loss",
    )


def by_favourite(df: DataFrame, p: str, who: str, targets: Sequence[tuple[str, str]], ranks: int, hot) -> DataFrame:
    """Predicted and observed by the rank of p in the contest. targets: (probability, outcome)."""
    d = with_index(df, RACE, [F.desc(p), who], "favourite_rank", hot).where(F.col("favourite_rank") <= ranks)
    aggs = [F.count(F.lit(1)).alias("n")]
    for prob, outcome in targets:
        aggs.append(F.avg(prob).alias(f"mean_{prob}"))
        aggs.append(F.avg(F.col(outcome).cast("double")).alias(f"observed_{outcome}"))
    return d.groupBy("favourite_rank").agg(*aggs)


def walk_forward(nll: DataFrame, previous_only: bool = False) -> DataFrame:
    """Contest losses at a temperature fitted on earlier years only.

    ``previous_only``: on the season tested last, whether or not it was the year before; the first one is scored at
    temperature 1, which the table must hold. One (contest x temperature) loss table serves every season: yearly sums are accumulated, the
    best temperature per season is picked, and that season's losses are looked up.
    """
    per = nll.groupBy("year", "temperature").agg(F.sum("ll_top3").alias("_s"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("temperature").orderBy("year")
    w = w.rowsBetween(-1 if previous_only else Window.unboundedPreceding, -1)
    per = per.select("year", "temperature", (F.sum("_s").over(w) / F.sum("_c").over(w)).alias("_loss"))
    if previous_only:
        first = F.col("_loss").isNull()  # temperature 1 is for the first season alone
        per = per.withColumn("_loss", F.when(F.col("temperature") != 1.0, F.col("_loss")).when(first, 0.0))
    best = per.where(F.col("_loss").isNotNull()).groupBy("year").agg(
        F.min(F.struct("_loss", "temperature")).alias("b")
    )
    best = best.select("year", F.col("b.temperature").alias("temperature"))
    return nll.join(best, ["year", "temperature"])


def rolling_temperature(nll: DataFrame, window: int = 22, start: float = 1.0) -> DataFrame:
    """Contest losses at the temperature fitted on the ``window`` contests before; first at ``start``."""
    w = Window.partitionBy("temperature").orderBy(*RACE).rowsBetween(-window, -1)
    d = nll.withColumn("_loss", F.avg("ll_top3").over(w))
    first = F.col("_loss").isNull()
    usable = d.where(~first | (F.col("temperature") == start))
    pick = F.min_by(
        F.struct("temperature", "ll_winner", "ll_top3"), F.struct(F.coalesce("_loss", F.lit(0.0)), F.col("temperature"))
    )
    return usable.groupBy(*RACE).agg(pick.alias("b")).select(*RACE, "b.*")


def recency_weights(df: DataFrame, half_life: float | None = None, low: float = 0.65, high: float = 1.35) -> DataFrame:
    """Per year: linear weights low..high by season, or halving every ``half_life`` years; mean 1."""
    years = df.groupBy("year").agg(F.count(F.lit(1)).alias("_n"))
    if half_life is None:
        span = years.agg(F.count(F.lit(1)).alias("_k"))
        years = years.withColumn("_r", F.row_number().over(Window.orderBy("year")))  # one row per year
        part = F.try_divide(F.col("_r") - 1, F.col("_k") - 1)
        raw = F.when(F.col("_k") > 1, low + part * (high - low)).otherwise(1.0)
    else:
        span = years.agg(F.max("year").alias("_k"))
        raw = F.pow(F.lit(0.5), (F.col("_k") - F.col("year")) / F.lit(half_life))
    d = years.crossJoin(F.broadcast(span)).withColumn("_w", raw)
    mean = d.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    return d.crossJoin(F.broadcast(mean)).select("year", (F.col("_w") / F.col("_mean")).alias("weight"))


def season_split(df: DataFrame) -> DataFrame:
    """train / calibration / holdout per year: 2 + 1 last years from 8 seasons, 1 + 1 from 5, 0 + 1 from 3."""
    years = df.select("year").distinct()
    count = years.agg(F.count(F.lit(1)).alias("_k"))
    d = years.crossJoin(F.broadcast(count)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("year"))))
    k, r = F.col("_k"), F.col("_r")
    held = F.when(k >= 8, 2).when(k >= 5, 1).otherwise(0)
    cal = F.when(k >= 3, 1).otherwise(0)
    part = F.when(r <= held, "holdout").when(r <= held + cal, "calibration").otherwise("train")
    return d.select("year", part.alias("part"))


def gate(current: Column, grid: Column, n: Column) -> Column:
    """promote / keep from structs (mean, low) of candidate - current and candidate - grid."""
    worse = (current["mean"] > 0.05) & (current["low"] > 0)
    below = (grid["mean"] > 0.0) & (grid["low"] > 0)
    return F.when(n < 5, "promote").when(worse | below, "keep").otherwise("promote")


def promotion(df: DataFrame, candidate: str, current: str, grid: str, order: Sequence[str], replicates: int) -> DataFrame:
    """Promote unless the candidate is clearly worse than the current model or the grid.

    df has one row per contest with the three losses; one set of draws serves both comparisons.
    """
    from fieldorder.operators.resample import resampled

    d = checkpointed(
        df.select(*order, (F.col(candidate) - F.col(current)).alias("_c"), (F.col(candidate) - F.col(grid)).alias("_g"))
    )
    point = d.agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("mc"), F.avg("_g").alias("mg"))
    per = resampled(d, order, replicates).groupBy("replicate").agg(F.avg("_c").alias("vc"), F.avg("_g").alias("vg"))
    ends = per.agg(F.percentile("vc", F.lit(0.025)).alias("lc"), F.percentile("vg", F.lit(0.025)).alias("lg"))
    out = point.crossJoin(F.broadcast(ends))
    cur = F.struct(F.col("mc").alias("mean"), F.col("lc").alias("low"))
    base = F.struct(F.col("mg").alias("mean"), F.col("lg").alias("low"))
    return out.select(
        "n",
        F.round("mc", 6).alias("minus_current"), F.round("lc", 6).alias("minus_current_low"),
        F.round("mg", 6).alias("minus_grid"), F.round("lg", 6).alias("minus_grid_low"),
        gate(cur, base, F.col("n")).alias("decision"),
    )


def contributions(df: DataFrame, coefficients: dict[str, float]) -> dict[str, Column]:
    return {c: F.lit(w) * F.col(c) for c, w in coefficients.items()}


def attribution(
    df: DataFrame, keys: Sequence[str], coefficients: dict[str, float], groups: dict[str, list[str]],
    temperature: float, hot: bool | None,
) -> DataFrame:
    """Per row and feature group: contributions minus their contest mean, over the temperature."""
    parts = contributions(df, coefficients)
    d = df.select(*keys, *[v.alias(f"_x_{c}") for c, v in parts.items()])
    d = with_totals(d, RACE, {f"_m_{c}": F.avg(f"_x_{c}") for c in parts}, hot)
    sums = {
        g: sum(((F.col(f"_x_{c}") - F.col(f"_m_{c}")) / temperature for c in cols), F.lit(0.0))
        for g, cols in groups.items()
    }
    wide = d.select(*keys, *[v.alias(g) for g, v in sums.items()])
    return wide.unpivot(list(keys), list(groups), "feature_group", "effect")


def attribution_share(df: DataFrame, coefficients: dict[str, float], groups: dict[str, list[str]]) -> DataFrame:
    """Share of the mean absolute contribution by feature group."""
    parts = contributions(df, coefficients)
    one = df.agg(*[F.avg(F.abs(v)).alias(c) for c, v in parts.items()])
    sums = {g: sum((F.col(c) for c in cols), F.lit(0.0)) for g, cols in groups.items()}
    total = sum(sums.values(), F.lit(0.0))
    wide = one.select(*[(v / total).alias(g) for g, v in sums.items()])
    return wide.unpivot([], list(groups), "feature_group", "share")


def worst_quarter(df: DataFrame, loss: str) -> DataFrame:
    cut = df.agg(F.percentile(loss, F.lit(0.75)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("fail", F.col(loss) >= F.col("_cut")).drop("_cut")


def failure_conditions(df: DataFrame, loss: str, names: Sequence[str]) -> DataFrame:
    """Mean of each condition in the worst quarter and the rest, and its rank correlation with loss."""
    from fieldorder.operators.features import rank_correlation

    d = worst_quarter(df, loss).select(loss, "fail", *[F.col(c).cast("double").alias(c) for c in names])
    long = d.unpivot([loss, "fail"], list(names), "condition", "x").where(F.col("x").isNotNull())
    rho = rank_correlation(long, ["condition"], F.col("x"), F.col(loss), "rho", 2, hot=False)
    g = long.groupBy("condition").agg(
        F.avg(F.when(F.col("fail"), F.col("x"))).alias("worst_mean"),
        F.avg(F.when(~F.col("fail"), F.col("x"))).alias("rest_mean"),
    )
    return g.join(rho, "condition", "left")


def chaos_share(df: DataFrame, loss: str, chaos: Column) -> DataFrame:
    d = worst_quarter(df.withColumn("_chaos", F.coalesce(chaos, F.lit(False)).cast("double")), loss)
    return d.agg(F.avg("_chaos").alias("share_all"), F.avg(F.when(F.col("fail"), F.col("_chaos"))).alias("share_worst"))


def unreliable(contests: DataFrame) -> DataFrame:
    """Flag contests in the top fifth of shuffle, with a wide spread or an order unlike the times."""
    cut = contests.agg(F.percentile("shuffle", F.lit(0.8)).alias("_cut"))
    flag = (F.col("shuffle") >= F.col("_cut")) | (F.col("spread") >= 2.0) | (F.col("order") < 0.9)
    d = contests.crossJoin(F.broadcast(cut))
    return d.select(*RACE, F.coalesce(flag, F.lit(False)).alias("unreliable"))


def champion_log_loss(df: DataFrame, hot_contest: bool | None, hot_history: bool | None) -> DataFrame:
    """Loss on the eventual champion after every contest: points share against equal chances."""
    from fieldorder.operators.grouping import with_prefix

    total = df.groupBy("year", "entrant").agg(F.sum("points").alias("_s"))
    champ = total.groupBy("year").agg(F.max_by("entrant", F.struct(F.col("_s"), -F.col("entrant"))).alias("entrant"))
    last = df.groupBy("year").agg(F.max("round").alias("_n"))
    d = with_prefix(df, ["year", "entrant"], ["round"], {"_cum": F.col("points")}, hot_history, inclusive=True)
    d = with_totals(d, RACE, {"_t": F.sum(F.col("_cum") + 1), "_f": F.count(F.lit(1))}, hot_contest)
    d = d.join(champ, ["year", "entrant"]).join(last, "year")
    share, equal = (F.col("_cum") + 1) / F.col("_t"), 1.0 / F.col("_f")
    d = d.select(
        (F.col("_n") - F.col("round")).alias("contests_left"),
        (-F.log(F.greatest(share, F.lit(0.001)))).alias("_a"), (-F.log(F.greatest(equal, F.lit(0.001)))).alias("_b"),
    )
    return d.groupBy("contests_left").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("_a"), 6).alias("ll_share"), F.round(F.avg("_b"), 6).alias("ll_equal"),
        F.round(F.avg(F.col("_a") - F.col("_b")), 6).alias("diff"),
    )


def season_accuracy(df: DataFrame, hot: bool | None) -> DataFrame:
    """Winner hits, podium overlap and Brier per season. Needs _s (strength), p_win, won, podium."""
    k = with_index(df, RACE, [F.desc("_s"), "entrant"], "_k", hot)
    c = k.groupBy(*RACE).agg(
        F.max(F.when(F.col("_k") == 1, F.col("won"))).alias("hit"),
        F.count_if((F.col("_k") <= 3) & (F.col("podium") == 1)).alias("o"),
        F.sum(F.pow(F.col("p_win") - F.col("won"), 2)).alias("b"),
        F.count(F.lit(1)).alias("n"),
    )
    return c.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_contests"), F.sum("hit").alias("winner_hits"),
        F.round(F.avg("hit"), 6).alias("winner_accuracy"), F.round(F.avg("o"), 6).alias("mean_overlap"),
        F.round(F.sum("b") / F.sum("n"), 6).alias("brier_p1"),
    )


def feature_skew(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], example: str) -> DataFrame:
    """Features that differ by more than 1e-6 between two builds of the same rows."""
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in columns])
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in columns])
    d = left.join(right, list(keys)).select(*keys, *[F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in columns])
    long = d.unpivot(list(keys), list(columns), "feature", "diff")
    off = F.col("diff") > 1e-6
    g = long.groupBy("feature").agg(
        F.max("diff").alias("max_diff"), F.count_if(off).alias("n_diff"), F.min(F.when(off, F.col(example))).alias("example")
    )
    return g.where(F.col("max_diff") > 1e-6)
