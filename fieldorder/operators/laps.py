"""Lap and run analytics: long runs, wear, pace per entrant and team, session summaries.

``hot`` speaks of the groups inside one entrant's laps (runs, own sessions), ``hot_session`` of whole sessions: those
are large long before an entrant's laps are, and runs need no split plan for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.operators.features import clip
from fieldorder.operators.grouping import (
    checkpointed,
    is_hot,
    join_groups,
    quantiles,
    with_prefix,
    with_quantiles,
    with_totals,
)

MIN_LAPS = 5
#: Fixed value: laps of a run that count as long in a live session.
LIVE_LONG_RUN = 5
#: Prior compound offsets in % against MEDIUM, and their weight in runs.
COMPOUND_PRIOR = {"SOFT": -0.3, "HARD": 0.2}
PRIOR_WEIGHT = 3.0


def laps_with_stints(laps: DataFrame, keys: Sequence[str], order: Sequence[str], hot: bool | None) -> DataFrame:
    """Number runs per key: a pit-out lap starts a new one."""
    out = F.col("is_pit_out_lap").cast("int")
    d = with_prefix(laps, keys, order, {"_outs": out}, hot, inclusive=True)
    return d.withColumn("stint_number", (F.col("_outs") + 1).cast("int")).drop("_outs")


def long_run_laps(
    laps: DataFrame, run: Sequence[str], session: Sequence[str], hot: bool | None, clean: bool = False
) -> DataFrame:
    """Laps of long runs: timed, no out lap, not the run's first remaining lap, near the median.

    The filters apply in this order and medians are taken on what is left. ``clean`` also asks for
    steady runs (spread up to 3 %) that are not far (12 %) off the session's best lap.
    """
    d = laps.where(F.col("lap_s").isNotNull() & F.col("stint_number").isNotNull() & ~F.col("is_pit_out_lap"))
    d = with_totals(d, run, {"_first": F.min("lap_number")}, hot).where(F.col("lap_number") > F.col("_first"))
    d = with_quantiles(d.drop("_first"), run, F.col("lap_s"), {"_med": 0.5}, hot)
    d = d.where(F.col("lap_s") <= F.col("_med") * 1.07).drop("_med")
    d = with_totals(d, run, {"_n": F.count(F.lit(1))}, hot).where(F.col("_n") >= MIN_LAPS).drop("_n")
    if clean:
        d = with_quantiles(d, run, F.col("lap_s"), {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, hot)
        best = laps.groupBy(*session).agg(F.min("lap_s").alias("_best"))
        d = join_groups(d, best, session)
        steady = (F.col("_q3") - F.col("_q1")) / F.col("_q2") * 100 <= 3.0
        slow = (F.col("_q2") / F.col("_best") - 1) * 100 > 12.0
        d = d.where(steady & ~slow).drop("_q1", "_q2", "_q3", "_best")
    return d


def with_age(df: DataFrame, run: Sequence[str], hot: bool | None, given: str | None = None) -> DataFrame:
    """Tyre age: given, else laps into the run."""
    d = with_totals(df, run, {"_first": F.min("lap_number")}, hot)
    into = (F.col("lap_number") - F.col("_first")).cast("double")
    age = F.coalesce(F.col(given).cast("double"), into) if given else into
    return d.withColumn("age", age).drop("_first")


def slopes(df: DataFrame, run: Sequence[str], session: Sequence[str], hot: bool | None) -> tuple[DataFrame, DataFrame]:
    """Seconds per lap within runs, and pooled per session and compound.

    Centred sums come from one aggregate per run: sum(xy) - sum(x) sum(y) / n.
    """
    d = with_totals(df, run, {"_my": F.avg("lap_s"), "_mx": F.avg("age")}, hot)
    x, y = F.col("age") - F.col("_mx"), F.col("lap_s") - F.col("_my")
    comp = F.coalesce("compound", F.lit("UNKNOWN")).alias("compound")
    st = d.groupBy(*run, comp).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    per = st.groupBy(*session, "compound").agg(
        F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.count(F.lit(1)).alias("n")
    )
    whole = st.groupBy(*session).agg(F.sum("xy").alias("_sxy"), F.sum("xx").alias("_sxx"))

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0)))

    per = join_groups(per, whole, session).select(
        *session, "compound", F.when(F.col("n") >= 3, ratio("xy", "xx")).otherwise(ratio("_sxy", "_sxx")).alias("comp_slope")
    )
    return st.select(*run, ratio("xy", "xx").alias("slope")), per


def age_adjusted(df: DataFrame, per: DataFrame, run: Sequence[str], session: Sequence[str], hot: bool | None) -> DataFrame:
    """Lap times with wear removed: slope between 0 and 0.4 % of the run's median per lap of age."""
    d = df.withColumn("compound", F.coalesce("compound", F.lit("UNKNOWN")))
    d = join_groups(d, per, [*session, "compound"])
    d = with_quantiles(d, run, F.col("lap_s"), {"_med": 0.5}, hot)
    wear = F.least(F.greatest(F.coalesce("comp_slope", F.lit(0.0)), F.lit(0.0)), F.col("_med") * 0.004)
    return d.withColumn("lap_s", F.col("lap_s") - wear * F.col("age")).drop("comp_slope", "_med")


def run_paces(
    df: DataFrame, run: Sequence[str], session: Sequence[str], hot: bool | None, adjust_age: bool = False
) -> DataFrame:
    """One row per long run: median pace, laps, compound, wear against its compound (%/lap)."""
    d = df.withColumn("compound", F.coalesce("compound", F.lit("UNKNOWN")))
    own, per = slopes(d, run, session, hot)
    if adjust_age:
        d = age_adjusted(d, per, run, session, hot)
    med = quantiles(d, run, F.col("lap_s"), {"pace_s": 0.5}, hot)
    g = d.groupBy(*run).agg(F.count(F.lit(1)).alias("n_laps"), F.min_by("compound", "lap_number").alias("compound"))
    g = g.join(med, list(run)).join(own, list(run), "left")
    g = join_groups(g, per, [*session, "compound"])
    deg = (F.col("slope") - F.col("comp_slope")) / F.col("pace_s") * 100
    return g.select(*run, "pace_s", "n_laps", "compound", deg.alias("deg_pct"))


def compound_offsets(paces: DataFrame, session: Sequence[str]) -> DataFrame:
    """Per session: % offset of SOFT and HARD against MEDIUM, by ridge least squares with priors.

    Model: 100 ln pace = a + b car + s soft + h hard, with prior pseudo-runs on s and h. The normal
    equations are sums over runs; eliminating a and b (one division each) leaves a 2 x 2 system,
    solved in closed form. paces: best pace per entrant and compound, with car_pace_delta_pct.
    """
    d = paces.where(F.col("compound").isin("SOFT", "MEDIUM", "HARD"))
    mean = d.groupBy(*session).agg(F.coalesce(F.avg("car_pace_delta_pct"), F.lit(0.0)).alias("_mc"))
    d = join_groups(d, mean, session)
    d = d.select(
        *session,
        (F.log("pace_s") * 100).alias("y"),
        F.coalesce("car_pace_delta_pct", "_mc").cast("double").alias("c"),
        (F.col("compound") == "SOFT").cast("double").alias("s"),
        (F.col("compound") == "HARD").cast("double").alias("h"),
    )
    m = d.groupBy(*session).agg(*[F.avg(x).alias(f"_m{x}") for x in "ycsh"], F.count(F.lit(1)).alias("_n"))
    d = join_groups(d, m, session)
    z = {x: F.col(x) - F.col(f"_m{x}") for x in "ycsh"}
    pairs = ["cc", "cs", "ch", "cy", "ss", "sh", "hh", "sy", "hy"]
    g = d.groupBy(*session).agg(*[F.sum(z[p[0]] * z[p[1]]).alias(p) for p in pairs])

    def without_car(p: str) -> Column:
        a, b = sorted(("c" + p[0], "c" + p[1]))
        return F.col(p) - F.when(F.col("cc") > 1e-12, F.col(a) * F.col(b) / F.col("cc")).otherwise(0.0)

    k = PRIOR_WEIGHT
    a11, a12, a22 = without_car("ss") + k, without_car("sh"), without_car("hh") + k
    b1 = without_car("sy") + k * COMPOUND_PRIOR["SOFT"]
    b2 = without_car("hy") + k * COMPOUND_PRIOR["HARD"]
    det = a11 * a22 - a12 * a12
    return g.select(
        *session, ((b1 * a22 - b2 * a12) / det).alias("soft_pct"), ((a11 * b2 - a12 * b1) / det).alias("hard_pct")
    )


def best_runs(paces: DataFrame, session: Sequence[str], hot_session: bool | None, least: int = 6) -> DataFrame:
    """Per session and entrant: best pace, its gap to the field's median (+-5 %), laps, wear.

    Sessions with fewer than ``least`` entrants on long runs drop out. Where sessions are measured or split, their rows
    are made once.
    """
    n = F.when(F.col("deg_pct").isNotNull(), F.col("n_laps"))
    b = paces.groupBy(*session, "entrant").agg(
        F.min("pace_s").alias("pace_s"), F.sum("n_laps").alias("n_laps"),
        F.try_divide(F.sum(F.col("deg_pct") * F.col("n_laps")), F.sum(n)).alias("deg"),
    )
    if hot_session is not False:
        b = checkpointed(b)
        hot_session = is_hot(b, session, hot_session)
    b = with_quantiles(b, session, F.col("pace_s"), {"_field": 0.5}, hot_session)
    b = with_totals(b, session, {"_runs": F.count(F.lit(1))}, hot_session).where(F.col("_runs") >= least)
    gap = clip((F.col("pace_s") / F.col("_field") - 1) * 100, -5.0, 5.0)
    return b.withColumn("gap", gap).withColumn("deg", clip(F.col("deg"), -0.5, 0.5)).drop("_field", "_runs")


def session_mean(x: Column, weights: dict[str, float] | None) -> Column:
    """Mean over sessions, weighted by session name where weights are given (1 for others)."""
    if not weights:
        return F.avg(x)
    w = F.lit(1.0)
    for name, v in weights.items():
        w = F.when(F.col("session") == name, F.lit(v)).otherwise(w)
    return F.try_divide(F.sum(x * w), F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0)))


def weekend_pace(best: DataFrame, weekend: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    return best.groupBy(*weekend, "entrant").agg(
        session_mean(F.col("gap"), weights).alias("fp_longrun_gap_pct"),
        F.sum("n_laps").alias("fp_longrun_laps"),
        session_mean(F.col("deg"), weights).alias("fp_longrun_deg_pct"),
    )


def team_pace(best: DataFrame, weekend: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """The team's best gap per session, then the mean over sessions. Needs team."""
    per = best.groupBy(*weekend, "session", "team").agg(F.min("gap").alias("gap"))
    return per.groupBy(*weekend, "team").agg(session_mean(F.col("gap"), weights).alias("team_longrun_gap_pct"))


def practice_pace(
    laps: DataFrame, lineup: DataFrame, weekend: Sequence[str], hot: bool | None, clean: bool = False,
    adjust_age: bool = False, weights: dict[str, float] | None = None, hot_session: bool | None = None,
) -> DataFrame:
    """Long-run features per entrant and weekend; rows without any value drop out.

    lineup: weekend keys, entrant, team.
    """
    session, run = [*weekend, "session"], [*weekend, "session", "entrant", "stint_number"]
    d = with_age(long_run_laps(laps, run, session, hot, clean), run, hot)
    best = best_runs(run_paces(d, run, session, hot, adjust_age), session, hot_session)
    best = best.join(lineup.select(*weekend, "entrant", "team"), [*weekend, "entrant"], "left")
    out = lineup.select(*weekend, "entrant", "team").join(weekend_pace(best, weekend, weights), [*weekend, "entrant"], "left")
    out = out.join(team_pace(best, weekend, weights), [*weekend, "team"], "left")
    some = F.col("fp_longrun_gap_pct").isNotNull() | F.col("team_longrun_gap_pct").isNotNull()
    return out.where(some)


def session_metrics(laps: DataFrame, session: Sequence[str], hot: bool | None, hot_session: bool | None = None) -> DataFrame:
    """Per entrant: best-lap gap, long-run delta and laps of a live session.

    Laps of 50-150 s within 12 s of the entrant's median count. The long-run delta is the mean lap
    of the entrant's runs with at least LIVE_LONG_RUN laps minus the session's median lap.
    """
    own = [*session, "entrant"]
    d = laps.where(F.col("lap_s").between(50.0, 150.0))
    d = with_quantiles(d, own, F.col("lap_s"), {"_med": 0.5}, hot)
    d = d.where(F.abs(F.col("lap_s") - F.col("_med")) <= 12.0).drop("_med")
    whole = d.groupBy(*session).agg(F.min("lap_s").alias("_best"))
    whole = whole.join(quantiles(d, session, F.col("lap_s"), {"_mid": 0.5}, hot_session), list(session))
    runs = d.groupBy(*own, "stint_number").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("lap_s").alias("_s"), F.min("lap_s").alias("_b")
    )
    long = (F.col("_n") >= LIVE_LONG_RUN) & F.col("stint_number").isNotNull()
    g = runs.groupBy(*own).agg(
        F.min("_b").alias("_own"), F.sum("_n").alias("n_laps"),
        F.sum(F.when(long, F.col("_s"))).alias("_ls"), F.sum(F.when(long, F.col("_n"))).alias("_ln"),
    )
    g = join_groups(g, whole, session)
    return g.select(
        *own, "n_laps", (F.col("_own") - F.col("_best")).alias("best_gap_s"),
        (F.try_divide("_ls", "_ln") - F.col("_mid")).alias("long_run_delta_s"),
    )


def merge_sessions(metrics: dict[str, DataFrame], keys: Sequence[str], columns: Sequence[str], when: str) -> DataFrame:
    """Sessions side by side: one row per key; undated facts come from the latest session.

    One union and aggregate instead of a chain of full outer joins.
    """
    parts = [m.withColumn("_s", F.lit(name)) for name, m in metrics.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    wide = [F.max(F.when(F.col("_s") == name, F.col(c))).alias(f"{name}_{c}") for name in metrics for c in columns]
    return u.groupBy(*keys).agg(*wide, F.max_by("_s", F.struct(when, "_s")).alias("last_session"))


def sprint_pace(laps: DataFrame, session: Sequence[str], hot: bool | None, hot_session: bool | None = None) -> DataFrame:
    """Best gap (0..10 s) and mid-race pace against the session's (-5..10 s).

    The middle leaves out the first lap and the last two of the session; an entrant (or session)
    without middle laps uses all of its laps.
    """
    own = [*session, "entrant"]
    d = laps.where(F.col("lap_s").between(40.0, 200.0))
    d = with_totals(d, session, {"_last": F.max("lap_number"), "_best": F.min("lap_s")}, hot_session)
    middle = (F.col("lap_number") > 1) & (F.col("lap_number") < F.col("_last") - 1)
    d = d.withColumn("_mid", F.when(middle, F.col("lap_s")))

    def pace(keys: Sequence[str], out: str, hot: bool | None) -> DataFrame:
        a = quantiles(d, keys, F.col("_mid"), {"_m": 0.5}, hot).join(
            quantiles(d, keys, F.col("lap_s"), {"_a": 0.5}, hot), list(keys)
        )
        return a.select(*keys, F.coalesce("_m", "_a").alias(out))

    g = d.groupBy(*own).agg(F.min("lap_s").alias("_own"), F.max("_best").alias("_best"))
    g = join_groups(g.join(pace(own, "_pace", hot), own), pace(session, "_field", hot_session), session)
    return g.select(
        *own, clip(F.col("_own") - F.col("_best"), 0.0, 10.0).alias("sprint_best_gap_s"),
        clip(F.col("_pace") - F.col("_field"), -5.0, 10.0).alias("sprint_pace_delta_s"),
    )


def start_compound(stints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compound of the first run, upper case; MEDIUM when unknown."""
    d = stints.where(F.col("stint_number") == 1)
    return d.groupBy(*keys).agg(F.coalesce(F.upper(F.max("compound")), F.lit("MEDIUM")).alias("start_compound"))


def grid_changes(stored: DataFrame, published: DataFrame, keys: Sequence[str], hot: bool | None) -> DataFrame:
    """Entrants whose stored grid differs from the published one; off the list means pit lane.

    A contest without any published slot changes nothing.
    """
    last = published.groupBy(*keys).agg((F.max("grid_position") + 1).alias("_back"))
    new = published.select(*keys, "entrant", F.col("grid_position").alias("new_grid"))
    d = stored.select(*keys, "entrant", F.col("grid_position").alias("old_grid")).join(last, list(keys))
    d = d.join(new, [*keys, "entrant"], "left").withColumn("new_grid", F.coalesce("new_grid", "_back"))
    return d.where(~F.col("old_grid").eqNullSafe(F.col("new_grid"))).drop("_back")
