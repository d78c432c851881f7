"""Scoring, calibration, bootstrap and market operators (H13-H41, D22)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.functions import fixed_values as fv
from fieldorder.operators import failures as fl
from fieldorder.operators import features as ft
from fieldorder.operators import joins as jn
from fieldorder.operators import market as mk
from fieldorder.operators import probability as pr
from fieldorder.operators import resample as rs
from fieldorder.operators import scoring as sc
from fieldorder.operators.grouping import with_index
from fieldorder.plans.models import target_position
from fieldorder.plans.queries import field, scalars  # noqa: F401  (their queries give the conditions of H36)
from fieldorder.plans.queries.history import BACK, KEY, rounded, sizes
from fieldorder.plans.queries.probability import GRID, MODEL, T_LIST, TGRID, contexts, nll_sql, nll_table, scored
from fieldorder.plans.registry import QUERIES, query
from fieldorder.plans.walk_forward import LeastSquares

RACE = ["year", "round"]

PROBS = f"""{GRID}, {MODEL}, pw AS (SELECT *, exp(-(mpred - mn) / 6.0) / sum(exp(-(mpred - mn) / 6.0)) OVER (PARTITION BY year, round) AS p_win,
  least(3 * exp(-(mpred - mn) / 9.0) / sum(exp(-(mpred - mn) / 9.0)) OVER (PARTITION BY year, round), 1.0) AS p_podium,
  CASE WHEN finish_position = 1 THEN 1 ELSE 0 END AS won
  FROM (SELECT *, min(mpred) OVER (PARTITION BY year, round) AS mn FROM md))"""


def probs(t):
    d = pr.win_probability(scored(t), RACE, F.col("mpred"), 6.0, "p_win", t.hot_contest)
    d = pr.win_probability(d, RACE, F.col("mpred"), 9.0, "_p3", t.hot_contest)
    d = d.withColumn("p_podium", F.least(3 * F.col("_p3"), F.lit(1.0))).drop("_p3")
    return d.withColumn("won", F.coalesce((F.col("finish_position") == 1).cast("int"), F.lit(0)))


HITS = """hit AS (SELECT year, round, count(*) FILTER (k = 1 AND finish_position = 1) > 0 AS winner_hit,
  count(*) FILTER (k <= 3 AND finish_position <= 3) AS podium_overlap
  FROM (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY mpred, entrant) AS k FROM md) GROUP BY 1, 2)"""


@query("H13_contest_scores", "results",
       sql=f"""{GRID}, {MODEL}, sx AS (SELECT *, -mpred / 4.0 AS s FROM md), {nll_sql('sx', 's')}, {HITS}
SELECT year, round, round(ll_winner, 6) AS ll_winner, round(ll_top3, 6) AS ll_top3, winner_hit, podium_overlap FROM nl JOIN hit USING (year, round)""")
def contest_scores(t):
    d = scored(t)
    nll = pr.nll_by_temperature(d, RACE, F.col("mpred"), F.col("finish_position"), [4.0], t.hot_contest)
    out = sc.score_contests(d, F.col("mpred"), "entrant", nll, t.hot_contest)
    return out.select(*RACE, F.round("ll_winner", 6).alias("ll_winner"), F.round("ll_top3", 6).alias("ll_top3"),
                      "winner_hit", "podium_overlap")


@query("H14_evaluation_summary", "results",
       sql=f"""{PROBS}, rk AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY p_win DESC, entrant) AS k,
  row_number() OVER (PARTITION BY year, round ORDER BY p_podium DESC, entrant) AS k3,
  row_number() OVER (PARTITION BY year, round ORDER BY CASE WHEN grid_position > 0 THEN grid_position END NULLS LAST, entrant) AS g FROM pw),
sp AS (SELECT year, round, corr(a, b) AS rho FROM (SELECT year, round,
   rank() OVER (PARTITION BY year, round ORDER BY mpred) + (count(*) OVER (PARTITION BY year, round, mpred) - 1) / 2.0 AS a,
   rank() OVER (PARTITION BY year, round ORDER BY finish_position) AS b FROM pw WHERE finish_position IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 3),
ep AS (SELECT a.year, a.round, a.entrant, 1 + sum(1 / (1 + exp((b.mpred - a.mpred) / 6.0))) AS e FROM pw a JOIN pw b
   ON a.year = b.year AND a.round = b.round AND a.entrant <> b.entrant GROUP BY 1, 2, 3),
ma AS (SELECT year, round, avg(abs(e - finish_position)) AS mae FROM ep JOIN pw USING (year, round, entrant) WHERE finish_position IS NOT NULL GROUP BY 1, 2),
c AS (SELECT year, round, max(CASE WHEN k = 1 THEN won END) AS hit, count(*) FILTER (k3 <= 3 AND podium = 1) AS o,
  max(CASE WHEN g = 1 THEN won END) AS ghit, count(*) FILTER (g <= 3 AND podium = 1) AS go, max(CASE WHEN won = 1 THEN -ln(greatest(p_win, 1e-6)) END) AS ll FROM rk GROUP BY 1, 2)
SELECT round(avg(hit), 6) AS winner_accuracy, round(avg(o) / 3, 6) AS podium_accuracy, round((SELECT avg((p_win - won) ** 2) FROM pw), 6) AS brier_p1,
  round(avg(rho), 6) AS mean_spearman, round(avg(mae), 6) AS mean_mae, round(avg(ll), 6) AS mean_log_loss,
  round(avg(ghit), 6) AS pole_accuracy, round(avg(go) / 3, 6) AS grid_podium_accuracy, avg(hit) > avg(ghit) AND avg(o) > avg(go) AS beats_baselines, count(*) AS n_contests
FROM c LEFT JOIN sp USING (year, round) LEFT JOIN ma USING (year, round)""")
def summary(t):
    t.settle_results()
    d = probs(t)
    s = sizes(t)
    hot = t.hot_contest
    k = with_index(d, RACE, [F.desc("p_win"), "entrant"], "k", hot)
    k = with_index(k, RACE, [F.desc("p_podium"), "entrant"], "k3", hot)
    grid = F.when(F.col("grid_position") > 0, F.col("grid_position"))
    k = with_index(k, RACE, [grid.asc_nulls_last(), "entrant"], "g", hot)
    pod = F.col("podium") == 1
    c = k.groupBy(*RACE).agg(
        F.max(F.when(F.col("k") == 1, F.col("won"))).alias("hit"), F.count_if((F.col("k3") <= 3) & pod).alias("o"),
        F.max(F.when(F.col("g") == 1, F.col("won"))).alias("ghit"), F.count_if((F.col("g") <= 3) & pod).alias("go"),
        F.max(F.when(F.col("won") == 1, -F.log(F.greatest("p_win", F.lit(1e-6))))).alias("ll"),
        F.sum(F.pow(F.col("p_win") - F.col("won"), 2)).alias("b"), F.count(F.lit(1)).alias("n"),
    )
    rho = ft.rank_correlation(d, RACE, F.col("mpred"), F.col("finish_position"), "rho", 3, hot)
    e = pr.expected_position(d, RACE, -F.col("mpred") / 6.0, "e")
    mae = e.groupBy(*RACE).agg(F.avg(F.abs(F.col("e") - F.col("finish_position"))).alias("mae"))
    c = c.join(rho, RACE, "left").join(mae, RACE, "left")
    r = lambda x, n: F.round(x, 6).alias(n)
    return c.agg(
        r(F.avg("hit"), "winner_accuracy"), r(F.avg("o") / 3, "podium_accuracy"), r(F.sum("b") / F.sum("n"), "brier_p1"),
        r(F.avg("rho"), "mean_spearman"), r(F.avg("mae"), "mean_mae"), r(F.avg("ll"), "mean_log_loss"),
        r(F.avg("ghit"), "pole_accuracy"), r(F.avg("go") / 3, "grid_podium_accuracy"),
        ((F.avg("hit") > F.avg("ghit")) & (F.avg("o") > F.avg("go"))).alias("beats_baselines"),
        F.count(F.lit(1)).alias("n_contests"),
    )


@query("H15_grid_baseline", "results",
       sql="""g AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY CASE WHEN grid_position > 0 THEN grid_position END NULLS LAST, entrant) AS g FROM results)
SELECT year, round, count(*) FILTER (g = 1 AND finish_position = 1) > 0 AS pole_won, count(*) FILTER (g <= 3 AND podium = 1) AS grid_overlap FROM g GROUP BY 1, 2""")
def grid_baseline(t):
    grid = F.when(F.col("grid_position") > 0, F.col("grid_position"))
    d = with_index(t.results, RACE, [grid.asc_nulls_last(), "entrant"], "g", t.hot_contest)
    return d.groupBy(*RACE).agg(
        (F.count_if((F.col("g") == 1) & (F.col("finish_position") == 1)) > 0).alias("pole_won"),
        F.count_if((F.col("g") <= 3) & (F.col("podium") == 1)).alias("grid_overlap"),
    )


#: Probabilities on a coarse scale so that bins fill up, including p = 1.
COARSE = """co AS (SELECT year, round, entrant, podium, (entrant * 7 + round) % 101 / 100.0::DOUBLE AS p FROM results)"""


def coarse(t):
    p = ((F.col("entrant") * 7 + F.col("round")) % 101) / 100.0
    return t.results.select(*KEY, "podium", p.alias("p"))


def bin_sql(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {p} >= {e!r}::DOUBLE THEN {i}" for i, e in reversed(list(enumerate(sc.ece_edges())))) + " END"


ECE = f"""{COARSE}, bn AS (SELECT year, round, {bin_sql('p')} AS b, avg(p) AS mp, avg(podium) AS my, count(*) AS n FROM co GROUP BY 1, 2, 3),
ec AS (SELECT year, round, sum(CASE WHEN b < 10 THEN abs(my - mp) * n ELSE 0 END) / sum(n) AS ece FROM bn GROUP BY 1, 2)"""


@query("H16_calibration_error", "results", sql=f"{ECE} SELECT year, round, round(ece, 6) AS ece FROM ec")
def ece(t):
    return rounded(sc.calibration_error(coarse(t), RACE, F.col("p"), F.col("podium"), "ece"), RACE, "ece")


@query("D22_running_calibration", "results",
       sql=f"{ECE} SELECT year, round, round(avg(ece) OVER (PARTITION BY year ORDER BY round), 6) AS ece_running FROM ec")
def running_ece(t):
    d = sc.calibration_error(coarse(t), RACE, F.col("p"), F.col("podium"), "ece")
    w = Window.partitionBy("year").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(d.withColumn("ece_running", F.avg("ece").over(w)), RACE, "ece_running")


@query("H17_calibration_curve", "results",
       sql=f"""{COARSE} SELECT b AS bin, round(b * 0.1 + 0.05, 6) AS prob_bin_mid, round(avg(p), 6) AS mean_predicted, round(avg(podium), 6) AS mean_actual,
  count(*) AS n FROM (SELECT *, {bin_sql('p')} AS b FROM co) WHERE b < 10 GROUP BY b""")
def curve(t):
    d = sc.calibration_curve(coarse(t), F.col("p"), F.col("podium"))
    return d.select("bin", *[F.round(c, 6).alias(c) for c in ("prob_bin_mid", "mean_predicted", "mean_actual")], "n")


EDGES = [0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0]
EDGE_BIN = "CASE " + " ".join(f"WHEN p >= {e}::DOUBLE THEN {i}" for i, e in reversed(list(enumerate(EDGES[:-1])))) + " END"
RELIABILITY = f"""{COARSE}, rt AS (SELECT {EDGE_BIN} AS bin, count(*) AS n, CAST(sum(podium) AS BIGINT) AS n_pos, avg(p) AS mean_pred, avg(podium) AS observed FROM co GROUP BY 1)"""
WILSON = """round(greatest(0, (observed + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(observed * (1 - observed) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (observed + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(observed * (1 - observed) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high"""


@query("H18_reliability_table", "results",
       sql=f"""{RELIABILITY} SELECT bin, n, n_pos, round(mean_pred, 6) AS mean_pred, round(observed, 6) AS observed, {WILSON},
  round(observed - mean_pred, 6) AS obs_minus_pred FROM rt""")
def reliability(t):
    d = sc.reliability_table(coarse(t), F.col("p"), F.col("podium"), EDGES)
    return rounded(d, ["bin", "n", "n_pos"], "mean_pred", "observed", "low", "high", "obs_minus_pred")


@query("H19_brier_parts", "results",
       sql=f"""{RELIABILITY}, wh AS (SELECT count(*) AS total, avg(podium) AS base_rate, avg((p - podium) ** 2) AS brier,
  avg(-(podium * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - podium) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))) AS log_loss FROM co)
SELECT max(total) AS n, round(max(base_rate), 6) AS base_rate, round(max(brier), 6) AS brier, round(sum(n * (mean_pred - observed) ** 2) / sum(n), 6) AS reliability,
  round(sum(n * (observed - base_rate) ** 2) / sum(n), 6) AS resolution, round(max(base_rate) * (1 - max(base_rate)), 6) AS uncertainty,
  round(sum(n * abs(observed - mean_pred)) / sum(n), 6) AS ece, round(max(log_loss), 6) AS log_loss FROM rt, wh""")
def brier(t):
    d = sc.brier_parts(coarse(t), F.col("p"), F.col("podium"), EDGES)
    return rounded(d, ["n"], "base_rate", "brier", "reliability", "resolution", "uncertainty", "ece", "log_loss")


@query("H21_by_favourite_rank", "results",
       sql=f"""{PROBS} SELECT CAST(k AS INT) AS favourite_rank, count(*) AS n, round(avg(p_win), 6) AS mean_p_win, round(avg(won), 6) AS observed_won,
  round(avg(p_podium), 6) AS mean_p_podium, round(avg(podium), 6) AS observed_podium
FROM (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY mpred, entrant) AS k FROM pw) WHERE k <= 6 GROUP BY 1""")
def by_favourite(t):
    d = probs(t).withColumn("strength", -F.col("mpred"))
    g = sc.by_favourite(d, "strength", "entrant", [("p_win", "won"), ("p_podium", "podium")], 6, t.hot_contest)
    return rounded(g, ["favourite_rank", "n"], "mean_p_win", "observed_won", "mean_p_podium", "observed_podium")


N_BOOT = 2000
#: Per contest: loss of the model and of the grid.
LOSSES = f"""{GRID}, {MODEL}, sa AS (SELECT *, -mpred / 4.0 AS s FROM md), sb AS (SELECT *, -pred / 4.0 AS s2 FROM md),
{nll_sql('sa', 's', 'la')}, {nll_sql('sb', 's2', 'lb')},
ls AS (SELECT year, round, la.ll_top3 AS a, lb.ll_top3 AS b FROM la JOIN lb USING (year, round))"""


def draws_sql(src: str) -> str:
    return f"""num AS (SELECT *, row_number() OVER (ORDER BY year, round) AS i FROM {src}),
dr AS (SELECT b.b AS rep, floor(('0x' || substr(md5(concat_ws('|', b.b, num.i)), 1, 8))::BIGINT / 4294967296.0 * (SELECT count(*) FROM num)) + 1 AS i
  FROM num, (SELECT unnest(range(1, {N_BOOT + 1})) AS b) b)"""


def losses(t):
    d = scored(t)
    place = F.col("finish_position")
    a = pr.top_nll(d, RACE, -F.col("mpred") / 4.0, place, 3, t.hot_contest, out="a")
    return a.join(pr.top_nll(d, RACE, -F.col("pred") / 4.0, place, 3, t.hot_contest, out="b"), RACE)


@query("H22_paired_bootstrap", "results",
       sql=f"""{LOSSES}, df AS (SELECT year, round, a - b AS d FROM ls), {draws_sql('df')},
m AS (SELECT rep, avg(d) AS v FROM dr JOIN num USING (i) GROUP BY rep)
SELECT round((SELECT avg(d) FROM df), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM m""")
def paired(t):
    return rounded(rs.paired(losses(t), "a", "b", RACE, N_BOOT), [], "mean", "low", "high")


@query("H23_cluster_bootstrap", "results",
       sql=f"""{COARSE}, cl AS (SELECT year, round, sum((p - podium) ** 2) AS s, count(*) AS c FROM co GROUP BY 1, 2), {draws_sql('cl')},
m AS (SELECT rep, sum(s) / sum(c) AS v FROM dr JOIN num USING (i) GROUP BY rep)
SELECT round((SELECT sum(s) / sum(c) FROM cl), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM m""")
def clustered(t):
    x = F.pow(F.col("p") - F.col("podium"), 2)
    return rounded(rs.clustered(coarse(t), RACE, x, N_BOOT), [], "mean", "low", "high")


#: Listed prices derived from the results: some entrants unlisted, some contests thin.
BOOK = """bk AS (SELECT year, round, entrant, CASE WHEN entrant % 13 = 0 THEN NULL WHEN (year + round) % 5 = 0 THEN 0.0005
    ELSE 1.0 / (1 + quali_position) + (entrant * 7 + round) % 5 / 100.0 END AS win_price,
  CASE WHEN entrant % 17 = 0 THEN NULL ELSE least(0.95, 3.0 / (2 + quali_position) + (entrant * 3 + round) % 7 / 100.0) END AS podium_price FROM results),
wm AS (SELECT year, round, entrant, p / s AS p_win_market FROM (SELECT *, sum(p) OVER (PARTITION BY year, round) AS s FROM
  (SELECT *, greatest(win_price, 0.001) AS p FROM bk WHERE win_price IS NOT NULL)) WHERE s >= 0.5),
pm AS (SELECT year, round, entrant, p * 3 / s AS p_podium_market FROM (SELECT *, sum(p) OVER (PARTITION BY year, round) AS s FROM
  (SELECT *, greatest(podium_price, 0.001) AS p FROM bk WHERE podium_price IS NOT NULL)) WHERE s >= 1.5)"""


def book(t):
    q, e, r = F.col("quali_position"), F.col("entrant"), F.col("round")
    thin = (F.col("year") + r) % 5 == 0
    win = F.when(thin, 0.0005).otherwise(1.0 / (1 + q) + (e * 7 + r) % 5 / 100.0)
    pod = F.least(F.lit(0.95), 3.0 / (2 + q) + (e * 3 + r) % 7 / 100.0)
    return t.results.select(
        *KEY, F.when(e % 13 != 0, win).alias("win_price"), F.when(e % 17 != 0, pod).alias("podium_price")
    )


def markets(t):
    b = book(t)
    w = mk.devig(b, "win_price", 1.0, "p_win_market", t.hot_contest)
    p = mk.devig(b, "podium_price", 3.0, "p_podium_market", t.hot_contest)
    return mk.both_markets(w, p)


@query("H24_devig", "results", sql=BOOK + """ SELECT year, round, entrant, round(p_win_market, 6) AS p_win_market,
  round(p_podium_market, 6) AS p_podium_market FROM wm FULL JOIN pm USING (year, round, entrant)""")
def devig(t):
    return rounded(markets(t), KEY, "p_win_market", "p_podium_market")


JOINED = f"""{PROBS}, {BOOK}, jm AS (SELECT pw.*, coalesce(p_win_market, 0.002) AS q1, coalesce(p_podium_market, 0.006) AS q3
  FROM pw LEFT JOIN wm USING (year, round, entrant) LEFT JOIN pm USING (year, round, entrant)
  WHERE (year, round) IN (SELECT (year, round) FROM wm)),
jn AS (SELECT * EXCLUDE (q1), q1 / sum(q1) OVER (PARTITION BY year, round) AS p_win_market, q3 AS p_podium_market FROM jm)"""


def joined(t):
    m = markets(t)
    listed = m.where(F.col("p_win_market").isNotNull()).select(*RACE)
    d = probs(t).join(listed, RACE, "left_semi").join(m, KEY, "left")
    d = mk.with_floor(d, "p_win_market", mk.FLOOR, 1.0, t.hot_contest)
    return d.withColumn("p_podium_market", F.coalesce("p_podium_market", F.lit(mk.FLOOR * 3)))


@query("H25_market_floor", "results", sql=JOINED + " SELECT year, round, entrant, round(p_win_market, 6) AS p_win_market, round(p_podium_market, 6) AS p_podium_market FROM jn")
def market_floor(t):
    return rounded(joined(t), KEY, "p_win_market", "p_podium_market")


@query("H26_blend_win", "results",
       sql=JOINED + """, z AS (SELECT *, 0.6 * ln(greatest(p_win, 1e-4)) + 0.8 * ln(greatest(p_win_market, 1e-4)) AS z FROM jn)
SELECT year, round, entrant, round(exp(z) / sum(exp(z)) OVER (PARTITION BY year, round), 6) AS p_win_blend FROM z""")
def blend_win(t):
    d = mk.blend_win(joined(t), RACE, "p_win", "p_win_market", F.lit(0.6), F.lit(0.8), "p_win_blend", t.hot_contest)
    return rounded(d, KEY, "p_win_blend")


LOGIT = "ln(least(greatest({0}, 1e-4), 1 - 1e-4) / (1 - least(greatest({0}, 1e-4), 1 - 1e-4)))"


@query("H27_blend_podium", "results",
       sql=JOINED + f""", z AS (SELECT *, 1 / (1 + exp(-(0.6 * {LOGIT.format('p_podium')} + 0.5 * {LOGIT.format('p_podium_market')}))) AS q FROM jn)
SELECT year, round, entrant, round(least(greatest(q * 3 / sum(q) OVER (PARTITION BY year, round), 1e-4), 1 - 1e-4), 6) AS p_podium_blend FROM z""")
def blend_podium(t):
    d = mk.blend_podium(joined(t), RACE, "p_podium", "p_podium_market", F.lit(0.6), F.lit(0.5), "p_podium_blend", t.hot_contest)
    return rounded(d, KEY, "p_podium_blend")


@query("H28_crossfit_blend", "results",
       sql=JOINED + """, ab AS (SELECT a / 10.0 AS a, b / 10.0 AS b FROM (SELECT unnest(range(0, 17)) AS a), (SELECT unnest(range(0, 17)) AS b) WHERE a + b > 0),
l AS (SELECT year, round, a, b, -ln(greatest(max(CASE WHEN won = 1 THEN exp(a * ln(greatest(p_win, 1e-4)) + b * ln(greatest(p_win_market, 1e-4))) END)
   / sum(exp(a * ln(greatest(p_win, 1e-4)) + b * ln(greatest(p_win_market, 1e-4)))), 1e-6)) AS ll FROM jn, ab GROUP BY 1, 2, 3, 4),
y AS (SELECT year, a, b, sum(ll) AS s, count(ll) AS c FROM l GROUP BY 1, 2, 3),
x AS (SELECT year, a, b, (sum(s) OVER (PARTITION BY a, b) - s) / (sum(c) OVER (PARTITION BY a, b) - c) AS loss FROM y)
SELECT year, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, round(loss, 6) AS loss FROM x QUALIFY row_number() OVER (PARTITION BY year ORDER BY loss, a, b) = 1""")
def crossfit(t):
    d = mk.crossfit_weights(mk.blend_losses(joined(t), "p_win", "p_win_market", t.hot_contest))
    return rounded(d, ["year", "a", "b"], "loss")


@query("H29_market_scores", "results",
       sql=JOINED + """ SELECT year, round, round(sum(CASE WHEN won = 1 THEN -ln(greatest(p_win_market, 1e-6)) END), 6) AS ll_winner,
  round(avg(CASE WHEN podium = 1 THEN -ln(least(greatest(p_podium_market, 1e-4), 1 - 1e-4)) ELSE -ln(1 - least(greatest(p_podium_market, 1e-4), 1 - 1e-4)) END), 6) AS ll_podium,
  round(avg((greatest(p_win_market, 1e-6) - won) ** 2), 6) AS brier_win, arg_max(won = 1, round(p_win_market, 12) * 1e12 - entrant / 1e6) AS winner_hit FROM jn GROUP BY 1, 2""")
def market_scores(t):
    d = mk.contest_scores(joined(t), RACE, "p_win_market", "p_podium_market")
    return d.select(*RACE, *[F.round(c, 6).alias(c) for c in ("ll_winner", "ll_podium", "brier_win")], "winner_hit")


@query("H30_walk_forward", "results",
       sql=TGRID + """, y AS (SELECT year, temperature, sum(ll_top3) AS s, count(*) AS c FROM nt GROUP BY 1, 2),
p AS (SELECT year, temperature, sum(s) OVER w / sum(c) OVER w AS loss FROM y WINDOW w AS (PARTITION BY temperature ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT year, temperature FROM p WHERE loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year ORDER BY loss, temperature) = 1)
SELECT year, round, temperature, round(ll_winner, 6) AS ll_winner, round(ll_top3, 6) AS ll_top3 FROM nt JOIN b USING (year, temperature)""")
def walk_forward(t):
    return rounded(sc.walk_forward(nll_table(t)), [*RACE, "temperature"], "ll_winner", "ll_top3")


@query("H30_walk_forward_previous_year", "results",
       sql=TGRID.replace(T_LIST, T_LIST[:-1] + ", 1.0::DOUBLE]") + """, s AS (SELECT year, lag(year) OVER (ORDER BY year) AS before FROM (SELECT DISTINCT year FROM nt)),
f AS (SELECT year AS before, temperature, sum(ll_top3) / count(*) AS loss FROM nt WHERE temperature <> 1.0 GROUP BY 1, 2),
y AS (SELECT year, temperature, loss FROM s JOIN f USING (before) UNION ALL SELECT year, 1.0, 0.0 FROM s WHERE before IS NULL),
b AS (SELECT year, temperature FROM y QUALIFY row_number() OVER (PARTITION BY year ORDER BY loss, temperature) = 1)
SELECT year, round, temperature, round(ll_winner, 6) AS ll_winner, round(ll_top3, 6) AS ll_top3 FROM nt JOIN b USING (year, temperature)""")
def walk_forward_previous(t):
    return rounded(sc.walk_forward(nll_table(t, extra=(1.0,)), previous_only=True), [*RACE, "temperature"], "ll_winner", "ll_top3")


FITTED = """tp AS (SELECT *, CAST(coalesce(finish_position, count(*) OVER (PARTITION BY year, round) + 1) AS DOUBLE) AS y, CAST(pred AS DOUBLE) AS a, CAST(entrant % 11 AS DOUBLE) AS b FROM gs),
fs AS (SELECT s.year, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby
  FROM (SELECT DISTINCT year FROM results) s JOIN tp ON tp.year < s.year GROUP BY 1),
co AS (SELECT *, (cay * vb - cby * cab) / (va * vb - cab * cab) AS ka, (cby * va - cay * cab) / (va * vb - cab * cab) AS kb FROM fs),
md AS (SELECT tp.*, my + ka * (a - ma) + kb * (b - mb) AS mpred FROM tp JOIN co USING (year))"""


def fitted(t):
    """Expected finishes of all seasons but the first, by least squares on the grid and a column of the entrant."""
    d = sc.grid_score(t.results, "grid_position", "pred", t.hot_contest).withColumn("b", F.col("entrant") % 11)
    return LeastSquares(["pred", "b"], "target_position").walk(target_position(d, t.hot_contest), "mpred")


@query("H30_fitted_predictions", "results", sql=f"{GRID}, {FITTED} SELECT year, round, entrant, round(mpred, 6) AS predicted FROM md")
def fitted_predictions(t):
    return fitted(t).select(*KEY, F.round("mpred", 6).alias("predicted"))


@query("H30_walk_forward_fitted", "results",
       sql=TGRID.replace(MODEL, FITTED) + """, y AS (SELECT year, temperature, sum(ll_top3) AS s, count(*) AS c FROM nt GROUP BY 1, 2),
p AS (SELECT year, temperature, sum(s) OVER w / sum(c) OVER w AS loss FROM y WINDOW w AS (PARTITION BY temperature ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT year, temperature FROM p WHERE loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY year ORDER BY loss, temperature) = 1)
SELECT year, round, temperature, round(ll_winner, 6) AS ll_winner, round(ll_top3, 6) AS ll_top3 FROM nt JOIN z USING (year, temperature)""")
def walk_forward_fitted(t):
    """Model and temperature both from earlier seasons: predictions of a season never seen by its fit."""
    nll = pr.nll_by_temperature(fitted(t), RACE, F.col("mpred"), F.col("finish_position"), fv.TEMPERATURES, t.hot_contest)
    return rounded(sc.walk_forward(nll), [*RACE, "temperature"], "ll_winner", "ll_top3")


@query("H31_rolling_temperature", "results",
       sql=TGRID.replace(T_LIST, T_LIST[:-1] + ", 1.0::DOUBLE]") + """, a AS (SELECT *, avg(ll_top3) OVER (PARTITION BY temperature ORDER BY year, round ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING) AS loss FROM nt)
SELECT year, round, temperature, round(ll_winner, 6) AS ll_winner, round(ll_top3, 6) AS ll_top3 FROM a WHERE loss IS NOT NULL OR temperature = 1.0
QUALIFY row_number() OVER (PARTITION BY year, round ORDER BY loss, temperature) = 1""")
def rolling(t):
    return rounded(sc.rolling_temperature(nll_table(t, extra=(1.0,))), [*RACE, "temperature"], "ll_winner", "ll_top3")


@query("H32_recency_weights", "results",
       sql="""y AS (SELECT year, count(*) AS n, row_number() OVER (ORDER BY year) AS r, count(*) OVER () AS k, max(year) OVER () AS m FROM results GROUP BY year),
w AS (SELECT *, 0.65 + (r - 1) / (k - 1.0) * 0.7 AS a, 0.5 ** ((m - year) / 3.0) AS b FROM y)
SELECT year, round(a / (SELECT sum(a * n) / sum(n) FROM w), 6) AS linear_weight, round(b / (SELECT sum(b * n) / sum(n) FROM w), 6) AS half_life_weight FROM w""")
def weights(t):
    a = sc.recency_weights(t.results).withColumnRenamed("weight", "linear_weight")
    b = sc.recency_weights(t.results, half_life=3.0).withColumnRenamed("weight", "half_life_weight")
    return rounded(a.join(b, "year"), ["year"], "linear_weight", "half_life_weight")


#: Predictors of the promotion gate: the candidate, the current model, and the grid.
GATE = {"a": "mpred", "c": "quali_position", "b": "pred"}


def loo_sql(name: str, pred: str) -> str:
    """l_<name>: every contest's loss at the temperature that is best on all other contests."""
    return f"""x_{name} AS (SELECT md.year, md.round, md.finish_position, temperature, -{pred} / temperature AS s FROM md, tg),
{nll_sql(f'x_{name}', 's', f'n_{name}', extra='temperature')}, t_{name} AS (SELECT temperature, sum(ll_top3) AS s FROM n_{name} GROUP BY 1),
l_{name} AS (SELECT year, round, ll_top3 AS {name} FROM n_{name} JOIN t_{name} USING (temperature) QUALIFY row_number() OVER (PARTITION BY year, round ORDER BY s - ll_top3, temperature) = 1)"""


@query("H33_promotion_gate", "results",
       sql=f"""{GRID}, {MODEL}, tg AS (SELECT unnest({T_LIST}) AS temperature), {", ".join(loo_sql(n, c) for n, c in GATE.items())},
df AS (SELECT year, round, a - b AS d, a - c AS e FROM l_a JOIN l_b USING (year, round) JOIN l_c USING (year, round) WHERE a IS NOT NULL), {draws_sql('df')},
m AS (SELECT rep, avg(d) AS v, avg(e) AS u FROM dr JOIN num USING (i) GROUP BY rep),
q AS (SELECT quantile_cont(v, 0.025) AS lo_grid, quantile_cont(u, 0.025) AS lo_cur FROM m),
z AS (SELECT avg(d) AS mean_grid, avg(e) AS mean_cur, count(*) AS n FROM df)
SELECT n, round(mean_cur, 6) AS minus_current, round(lo_cur, 6) AS minus_current_low, round(mean_grid, 6) AS minus_grid, round(lo_grid, 6) AS minus_grid_low,
  CASE WHEN n < 5 THEN 'promote' WHEN mean_cur > 0.05 AND lo_cur > 0 THEN 'keep' WHEN mean_grid > 0 AND lo_grid > 0 THEN 'keep' ELSE 'promote' END AS decision FROM z, q""")
def promotion(t):
    """Candidate, current model and grid, each at temperatures fitted without the contest that is scored."""
    parts = [sc.leave_one_out(nll_table(t, c), RACE).select(*RACE, F.col("ll_top3").alias(n)) for n, c in GATE.items()]
    d = parts[0].join(parts[1], RACE).join(parts[2], RACE).where("a IS NOT NULL")
    return sc.promotion(d, "a", "c", "b", RACE, N_BOOT)


@query("H34_season_split", "results",
       sql="""y AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT year FROM results))
SELECT year, CASE WHEN k >= 8 AND r <= 2 THEN 'holdout' WHEN k >= 8 AND r = 3 THEN 'calibration' WHEN k < 8 AND k >= 5 AND r = 1 THEN 'holdout'
  WHEN k < 8 AND k >= 5 AND r = 2 THEN 'calibration' WHEN k < 5 AND k >= 3 AND r = 1 THEN 'calibration' ELSE 'train' END AS part FROM y""")
def split(t):
    return sc.season_split(t.results)


ATTR = {"grid": ["grid_position", "quali_position"], "score": ["points", "podium"]}
COEF = {"grid_position": -0.2, "quali_position": -0.1, "points": 0.05, "podium": 0.3}


@query("H35_attribution", "results",
       sql="""c AS (SELECT year, round, entrant, -0.2 * grid_position AS c1, -0.1 * quali_position AS c2, 0.05 * points AS c3, 0.3 * podium AS c4 FROM results),
d AS (SELECT year, round, entrant, (c1 - avg(c1) OVER w) / 2.0 + (c2 - avg(c2) OVER w) / 2.0 AS g, (c3 - avg(c3) OVER w) / 2.0 + (c4 - avg(c4) OVER w) / 2.0 AS s
  FROM c WINDOW w AS (PARTITION BY year, round))
SELECT year, round, entrant, 'grid' AS feature_group, round(g, 6) AS effect FROM d UNION ALL SELECT year, round, entrant, 'score', round(s, 6) FROM d""")
def attribution(t):
    d = sc.attribution(t.results, KEY, COEF, ATTR, 2.0, t.hot_contest)
    return rounded(d, [*KEY, "feature_group"], "effect")


@query("H35_attribution_share", "results",
       sql="""c AS (SELECT year, round, -0.2 * grid_position AS c1, -0.1 * quali_position AS c2, 0.05 * points AS c3, 0.3 * podium AS c4 FROM results),
a AS (SELECT avg(abs(c1)) + avg(abs(c2)) AS g, avg(abs(c3)) + avg(abs(c4)) AS s FROM c)
SELECT 'grid' AS feature_group, round(g / (g + s), 6) AS share FROM a UNION ALL SELECT 'score', round(s / (g + s), 6) FROM a""")
def attribution_share(t):
    return rounded(sc.attribution_share(t.results, COEF, ATTR), ["feature_group"], "share")


COND = f"""{LOSSES}, cd AS (SELECT r.year, r.round, max(CASE WHEN w.is_wet = 1 THEN 1 ELSE 0 END) AS wet, sum(dnf) AS n_dnf,
  max(CASE WHEN quali_position = 1 THEN dnf END) AS pole_dnf, max(CASE WHEN finish_position = 1 THEN grid_position END) AS winner_grid
  FROM results r LEFT JOIN weather w USING (year, round) GROUP BY 1, 2),
fa AS (SELECT cd.*, a, a >= (SELECT quantile_cont(a, 0.75) FROM ls) AS fail, pole_dnf = 1 OR winner_grid > 5 AS chaos FROM cd JOIN ls USING (year, round)),
un AS (UNPIVOT (SELECT year, round, a, fail, CAST(wet AS DOUBLE) AS wet, CAST(n_dnf AS DOUBLE) AS n_dnf, CAST(pole_dnf AS DOUBLE) AS pole_dnf, CAST(winner_grid AS DOUBLE) AS winner_grid FROM fa)
  ON wet, n_dnf, pole_dnf, winner_grid INTO NAME condition VALUE x)"""


def conditions(t):
    d = t.results.join(t.weather.select(*RACE, "is_wet"), RACE, "left")
    per = d.groupBy(*RACE).agg(
        F.max(F.when(F.col("is_wet") == 1, 1).otherwise(0)).alias("wet"), F.sum("dnf").alias("n_dnf"),
        F.max(F.when(F.col("quali_position") == 1, F.col("dnf"))).alias("pole_dnf"),
        F.max(F.when(F.col("finish_position") == 1, F.col("grid_position"))).alias("winner_grid"),
    )
    return per.join(losses(t).select(*RACE, "a"), RACE)


@query("H36_failure_conditions", "results", "weather",
       sql=COND + """, rk AS (SELECT condition, fail, x, rank() OVER (PARTITION BY condition ORDER BY x) + (count(*) OVER (PARTITION BY condition, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY condition ORDER BY a) + (count(*) OVER (PARTITION BY condition, a) - 1) / 2.0 AS ra FROM un)
SELECT condition, round(avg(x) FILTER (fail), 6) AS worst_mean, round(avg(x) FILTER (NOT fail), 6) AS rest_mean,
  CASE WHEN isfinite(corr(rx, ra)) THEN round(corr(rx, ra), 6) END AS rho FROM rk GROUP BY 1""")
def failure(t):
    d = sc.failure_conditions(conditions(t), "a", ["wet", "n_dnf", "pole_dnf", "winner_grid"])
    return rounded(d, ["condition"], "worst_mean", "rest_mean", "rho")


@query("H36_chaos_share", "results", "weather",
       sql=COND + """ SELECT round(avg(CASE WHEN chaos THEN 1.0 ELSE 0.0 END), 6) AS share_all, round(avg(CASE WHEN chaos THEN 1.0 ELSE 0.0 END) FILTER (fail), 6) AS share_worst FROM fa""")
def chaos(t):
    d = conditions(t).withColumn("chaos", (F.col("pole_dnf") == 1) | (F.col("winner_grid") > 5))
    return rounded(sc.chaos_share(d, "a", F.col("chaos")), [], "share_all", "share_worst")


#: Feature queries by entrant, by team and by contest.
CONDITION_FEATURES = ["D04_dnf_rate", "D03_points_before", "E08_penalty_and_sprint", "D05_venue_history", "E02_championship_pressure", "B16_street_and_rate",
                      "E04_car_pace_delta", "E10_quali_spread_and_order", "E11_quali_shuffle"]
KNOWN = [c for c in (*fl.BEFORE, *fl.AFTER) if c != "wind_ms"]
#: The entrants' rows that the conditions are asked of: what the feature queries give, the points so far as the rating.
CONDITION_ROWS = f"""{LOSSES}, {BACK}, {", ".join(f"x{i} AS ({QUERIES[n].sql})" for i, n in enumerate(CONDITION_FEATURES))},
f AS (SELECT year, round, entrant, rb.team, mpred AS pred, 1 - dnf_rate AS p_finish, cum_points_before AS rating, rb.grid_position, rb.finish_position, rb.dnf,
  car_pace_delta_pct, sprint_position_rel, circuit_appearances, championship_pressure, is_wet, precip_tenths_mm / 10.0 AS precip_mm, is_street_circuit,
  circuit_safety_car_rate, quali_shuffle, quali_spread_pct, temp_c
  FROM rb JOIN (SELECT year, round, entrant, mpred FROM md) m USING (year, round, entrant) LEFT JOIN x0 USING (year, round, entrant) LEFT JOIN x1 USING (year, round, entrant)
  LEFT JOIN x2 USING (year, round, entrant) LEFT JOIN x3 USING (year, round, entrant) LEFT JOIN x4 USING (year, round, entrant) LEFT JOIN x5 USING (year, round, entrant)
  LEFT JOIN (SELECT year, round, team, car_pace_delta_pct FROM x6) e USING (year, round, team) LEFT JOIN x7 USING (year, round) LEFT JOIN x8 USING (year, round)
  LEFT JOIN weather w USING (year, round)),
n AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY pred NULLS LAST, entrant) AS k,
  row_number() OVER (PARTITION BY year, round ORDER BY rating DESC NULLS LAST, pred NULLS LAST, entrant) AS r FROM f),
tp2 AS (SELECT year, round, team, max(car_pace_delta_pct) AS p FROM f WHERE car_pace_delta_pct IS NOT NULL GROUP BY 1, 2, 3),
tk AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY p, team) AS i, min(p) OVER (PARTITION BY year, round) AS p1 FROM tp2),
tg AS (SELECT year, round, max(CASE WHEN i = 2 THEN p - p1 END) AS top2_team_gap_pct, count(*) FILTER (p - p1 <= 0.3) AS teams_within_0_3pct FROM tk GROUP BY 1, 2),
c0 AS (SELECT year, round, coalesce(max(is_wet), 0) AS wet, max(precip_mm) AS precip_mm, max(is_street_circuit) AS street, max(circuit_safety_car_rate) AS sc_rate,
  bool_or(sprint_position_rel <> 0.5) AS sprint_weekend, year IN (2014, 2017, 2022, 2026) AS reg_reset_year, round <= 3 AS season_opener_3,
  max(circuit_appearances) <= 1 AS new_circuit, max(quali_shuffle) AS quali_shuffle, max(quali_spread_pct) AS quali_spread,
  NOT coalesce(bool_or(k = 1 AND grid_position = 1), false) AS fav_not_on_pole, max(grid_position) FILTER (k = 1) AS fav_grid,
  max(pred) FILTER (k = 2) - max(pred) FILTER (k = 1) AS fav_margin, max(p_finish) FILTER (k = 1) AS fav_p_finish,
  count(*) FILTER (r <= 5 AND rating IS NOT NULL AND grid_position > 6) AS top5_rating_out_of_top6, count(DISTINCT team) FILTER (grid_position <= 2) = 1 AS front_row_teammates,
  max(temp_c) AS temp_c, min(championship_pressure) AS title_pressure, coalesce(bool_or(k = 1 AND dnf = 1), false) AS fav_dnf, count(*) FILTER (dnf = 1) AS n_dnf,
  count(*) FILTER (r <= 5 AND rating IS NOT NULL AND dnf = 1) AS top5_rating_dnf, arg_min(grid_position, k) FILTER (finish_position = 1) AS winner_grid,
  min(k) FILTER (finish_position = 1) AS winner_model_rank, coalesce(bool_or(grid_position = 1 AND dnf = 1), false) AS pole_dnf FROM n GROUP BY 1, 2),
cx AS (SELECT a, a >= (SELECT quantile_cont(a, 0.75) FROM ls) AS fail, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in KNOWN)}
  FROM c0 JOIN tg USING (year, round) JOIN ls USING (year, round)),
un AS (UNPIVOT (SELECT * FROM cx) ON {", ".join(KNOWN)} INTO NAME condition VALUE x)"""


def condition_rows(t):
    """Wind is not among the given weather, so that condition has no values."""
    d = ft.pit_lane_to_back(t.results, sizes(t)).select(*KEY, "team", "grid_position", "finish_position", "dnf")
    d = d.join(scored(t).select(*KEY, F.col("mpred").alias("pred")), KEY)
    for name in CONDITION_FEATURES:
        x = QUERIES[name].build(t)
        d = d.join(x, [c for c in (*KEY, "team") if c in x.columns], "left")
    w = t.weather.select(*RACE, "is_wet", (F.col("precip_tenths_mm") / 10.0).alias("precip_mm"), "temp_c", F.lit(None).cast("double").alias("wind_ms"))
    return d.join(w, RACE, "left").withColumn("p_finish", 1 - F.col("dnf_rate")).withColumnRenamed("cum_points_before", "rating")


@query("H36_all_conditions", "results", "weather",
       sql=CONDITION_ROWS + """, rk AS (SELECT condition, fail, x, rank() OVER (PARTITION BY condition ORDER BY x) + (count(*) OVER (PARTITION BY condition, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY condition ORDER BY a) + (count(*) OVER (PARTITION BY condition, a) - 1) / 2.0 AS ra FROM un)
SELECT condition, round(avg(x) FILTER (fail), 4) AS worst_mean, round(avg(x) FILTER (NOT fail), 4) AS rest_mean,
  CASE WHEN isfinite(corr(rx, ra)) THEN round(corr(rx, ra), 4) END AS rho FROM rk GROUP BY 1""")
def all_conditions(t):
    t.settle_results()
    d = fl.contest_conditions(condition_rows(t), t.hot_contest).join(losses(t).select(*RACE, "a"), RACE)
    d = sc.failure_conditions(d, "a", [*fl.BEFORE, *fl.AFTER])
    # means of features that have six places meet halves at six places, where the order of a sum would decide
    return d.select("condition", *[F.round(c, 4).alias(c) for c in ("worst_mean", "rest_mean", "rho")])


@query("H37_unreliable_contests", "results",
       sql=f"""{LOSSES}, g AS (SELECT year, round, avg(abs(quali_position - finish_position)) AS shuffle, stddev_samp(best_time_ms) / 1000.0 AS spread,
  corr(quali_position, best_time_ms) AS ord FROM results GROUP BY 1, 2),
u AS (SELECT * FROM g WHERE shuffle >= (SELECT quantile_cont(shuffle, 0.8) FROM g) OR spread >= 2.0 OR ord < 0.9)
SELECT round(avg(a), 6) AS loss_all, round(avg(a) FILTER ((year, round) IN (SELECT (year, round) FROM u)), 6) AS loss_unreliable, (SELECT count(*) FROM u) AS n_unreliable FROM ls""")
def unreliable(t):
    g = t.results.groupBy(*RACE).agg(
        F.avg(F.abs(F.col("quali_position") - F.col("finish_position"))).alias("shuffle"),
        (F.stddev_samp("best_time_ms") / 1000.0).alias("spread"), F.corr("quali_position", "best_time_ms").alias("order"),
    )
    d = sc.unreliable(g)
    out = losses(t).join(d, RACE)
    u = F.col("unreliable")
    return out.agg(F.round(F.avg("a"), 6).alias("loss_all"), F.round(F.avg(F.when(u, F.col("a"))), 6).alias("loss_unreliable"),
                   F.count_if(u).alias("n_unreliable"))


CHAMP = """p AS (SELECT year, round, entrant, sum(points) OVER (PARTITION BY year, entrant ORDER BY round) AS cum FROM results),
ch AS (SELECT year, arg_max(entrant, s * 1000000 - entrant) AS champion, max(n) AS n FROM (SELECT year, entrant, sum(points) AS s, max(max(round)) OVER (PARTITION BY year) AS n FROM results GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT year, round, entrant, cum, (cum + 1) / sum(cum + 1) OVER (PARTITION BY year, round) AS share, 1.0 / count(*) OVER (PARTITION BY year, round) AS equal FROM p),
cl AS (SELECT v.year, v.round, n - v.round AS contests_left, -ln(greatest(share, 0.001)) AS ll_share, -ln(greatest(equal, 0.001)) AS ll_equal FROM v JOIN ch ON v.year = ch.year AND v.entrant = ch.champion)"""


@query("H38_champion_log_loss", "results",
       sql=CHAMP + " SELECT CAST(contests_left AS INT) AS contests_left, count(*) AS n, round(avg(ll_share), 6) AS ll_share, round(avg(ll_equal), 6) AS ll_equal, round(avg(ll_share - ll_equal), 6) AS diff FROM cl GROUP BY 1")
def champion(t):
    return sc.champion_log_loss(t.results, t.hot_contest, t.hot_history)


@query("H39_season_accuracy", "results",
       sql=f"""{PROBS}, k AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY mpred, entrant) AS k FROM pw),
c AS (SELECT year, round, max(CASE WHEN k = 1 THEN won END) AS hit, count(*) FILTER (k <= 3 AND podium = 1) AS o, sum((p_win - won) ** 2) AS b, count(*) AS n FROM k GROUP BY 1, 2)
SELECT year, count(*) AS n_contests, CAST(sum(hit) AS BIGINT) AS winner_hits, round(avg(hit), 6) AS winner_accuracy, round(avg(o), 6) AS mean_overlap, round(sum(b) / sum(n), 6) AS brier_p1 FROM c GROUP BY 1""")
def season_accuracy(t):
    return sc.season_accuracy(probs(t).withColumn("_s", -F.col("mpred")), t.hot_contest)


WEIGHTS = [k / 10 for k in range(11)]
SCALES = [0.02 * 1.4**k for k in range(12)]


def doubles(values):
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


@query("H40_two_score_combination", "results",
       sql=f"""{GRID}, {MODEL}, ww AS (SELECT unnest({doubles(WEIGHTS)}) AS value), cc AS (SELECT unnest({doubles(SCALES)}) AS scale),
x AS (SELECT value, scale, year, round, finish_position, -(value * pred + (1 - value) * mpred) * scale AS s FROM md, ww, cc WHERE finish_position IS NOT NULL),
m AS (SELECT *, max(s) OVER (PARTITION BY value, scale, year, round) AS mx FROM x),
l AS (SELECT value, scale, year, round, s - mx - ln(sum(exp(s - mx)) OVER (PARTITION BY value, scale, year, round ORDER BY finish_position DESC ROWS UNBOUNDED PRECEDING)) AS ll FROM m),
c AS (SELECT value, scale, year, round, sum(ll) AS ll FROM l GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT value, scale, avg(ll) AS ll FROM c GROUP BY ALL)
SELECT value, round(scale, 6) AS scale, round(ll, 6) AS order_ll FROM g QUALIFY row_number() OVER (PARTITION BY value ORDER BY ll DESC, scale) = 1""")
def combination(t):
    """Per weight of two scores the scale at which the whole finishing order is likeliest, and its mean log-likelihood."""
    per = pr.order_ll_by_blend(
        scored(t), RACE, (F.col("pred"), F.col("mpred")), WEIGHTS, SCALES, F.col("finish_position"), t.hot_contest
    ).where("n >= 2")
    mean = per.groupBy("value", "scale").agg(F.avg("ll").alias("ll"))
    best = mean.groupBy("value").agg(F.min(F.struct((-F.col("ll")).alias("loss"), "scale")).alias("b"))
    return best.select("value", F.round("b.scale", 6).alias("scale"), F.round(-F.col("b.loss"), 6).alias("order_ll"))


@query("H41_feature_skew", "results",
       sql="""b AS (SELECT year, round, entrant, CASE WHEN entrant % 50 = 0 THEN points + 1 ELSE points END AS points, grid_position FROM results),
d AS (SELECT 'points' AS feature, abs(a.points - b.points) AS diff, a.entrant FROM results a JOIN b USING (year, round, entrant)
  UNION ALL SELECT 'grid_position', abs(a.grid_position - b.grid_position), a.entrant FROM results a JOIN b USING (year, round, entrant))
SELECT feature, CAST(max(diff) AS DOUBLE) AS max_diff, count(*) FILTER (diff > 1e-6) AS n_diff, min(entrant) FILTER (diff > 1e-6) AS example FROM d GROUP BY 1 HAVING max(diff) > 1e-6""")
def skew(t):
    served = t.results.withColumn("points", F.when(F.col("entrant") % 50 == 0, F.col("points") + 1).otherwise(F.col("points")))
    return sc.feature_skew(t.results, served, KEY, ["points", "grid_position"], "entrant")


@query("H20_calibration_slope", "results",
       sql=f"""{PROBS}, d AS MATERIALIZED (SELECT ln(c / (1 - c)) AS x, CAST(podium AS DOUBLE) AS y FROM (SELECT least(greatest(p_podium, 1e-4), 1 - 1e-4) AS c, podium FROM pw)),
nw AS (WITH RECURSIVE f AS (SELECT 0 AS k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL SELECT k + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (SELECT k, a, b, sum(y - q) AS g1, sum((y - q) * x) AS g2, sum(q * (1 - q)) AS h11, sum(q * (1 - q) * x) AS h12, sum(q * (1 - q) * x * x) AS h22
    FROM (SELECT f.*, x, y, 1 / (1 + exp(-(f.a + f.b * x))) AS q FROM f, d WHERE f.k < 30) GROUP BY k, a, b)) SELECT * FROM f)
SELECT round(a, 6) AS cal_intercept, round(b, 6) AS cal_slope FROM nw ORDER BY k DESC LIMIT 1""")
def slope(t):
    from fieldorder.plans.models import calibration_slope

    return rounded(calibration_slope(probs(t), F.col("p_podium"), F.col("podium")), [], "cal_intercept", "cal_slope")
