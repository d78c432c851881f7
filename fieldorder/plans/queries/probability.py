"""Probability operators (H1-H12, G4)."""

from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.operators import calibration as cal
from fieldorder.operators import features as ft
from fieldorder.operators import probability as pr
from fieldorder.operators import scoring as sc
from fieldorder.plans.queries.history import KEY, rounded, sizes
from fieldorder.plans.registry import query

RACE = ["year", "round"]

#: The grid as predicted position: pit lane and unknown go behind the last slot.
GRID = """gs AS (SELECT *, CASE WHEN grid_position > 0 THEN grid_position ELSE coalesce(max(CASE WHEN grid_position > 0
  THEN grid_position END) OVER (PARTITION BY year, round) + 1, count(*) OVER (PARTITION BY year, round)) END AS pred FROM results)"""
#: A second, finer predictor: qualifying place with a small team-free adjustment.
MODEL = """md AS (SELECT *, (quali_position * 8 + (entrant % 11) * 6) / 10.0 AS mpred FROM gs)"""


def scored(t):
    d = sc.grid_score(t.results, "grid_position", "pred", t.hot_contest)
    return d.withColumn("mpred", (F.col("quali_position") * 8 + (F.col("entrant") % 11) * 6) / 10.0)


def nll_sql(src: str, s: str, name: str = "nl", powers=(1.0, 1.0, 1.0), extra: str = "") -> str:
    """Order likelihood of the top 3, stage by stage, as plain aggregates over what remains."""
    e = (extra + ", ") if extra else ""
    stages = []
    for j, p in enumerate(powers):
        keep = f"(finish_position IS NULL OR finish_position > {j})"
        stages.append(
            f"ln(sum(exp({p} * ({s} - m{j}))) FILTER ({keep})) - max({p} * ({s} - m{j})) FILTER (finish_position = {j + 1}) AS l{j}"
        )
    maxes = ", ".join(
        f"max({s}) FILTER (finish_position IS NULL OR finish_position > {j}) OVER (PARTITION BY {e}year, round) AS m{j}"
        for j in range(3)
    )
    return f"""{name}_m AS (SELECT *, {maxes} FROM {src}),
{name} AS (SELECT {e}year, round, l0 AS ll_winner, l0 + l1 + l2 AS ll_top3 FROM (SELECT {e}year, round, {", ".join(stages)} FROM {name}_m GROUP BY {e}year, round))"""


@query("H01_win_probability", "results",
       sql=f"""{GRID} SELECT year, round, entrant, round(exp(-pred / 4.0 - max(-pred / 4.0) OVER w) /
  sum(exp(-pred / 4.0 + mn / 4.0)) OVER w, 6) AS p_win FROM (SELECT *, min(pred) OVER (PARTITION BY year, round) AS mn FROM gs)
  WINDOW w AS (PARTITION BY year, round)""")
def win_probability(t):
    d = pr.win_probability(scored(t), RACE, F.col("pred"), 4.0, "p_win", t.hot_contest)
    return rounded(d, KEY, "p_win")


@query("H02_top3_nll", "results",
       sql=f"{GRID}, {nll_sql('gs', '(-pred / 4.0)')} SELECT year, round, round(ll_winner, 6) AS ll_winner, round(ll_top3, 6) AS ll_top3 FROM nl")
def top3(t):
    d = scored(t)
    s, place = -F.col("pred") / 4.0, F.col("finish_position")
    a = pr.top_nll(d, RACE, s, place, 1, t.hot_contest, out="ll_winner", complete=3)
    b = pr.top_nll(d, RACE, s, place, 3, t.hot_contest, out="ll_top3")
    return rounded(a.join(b, RACE), RACE, "ll_winner", "ll_top3")


def place_sql(powers) -> str:
    l1, l2, l3 = powers
    return f"""{GRID}, x AS (SELECT *, -pred / 9.0 AS s, max(-pred / 9.0) OVER (PARTITION BY year, round) AS m FROM gs),
w AS (SELECT year, round, entrant, exp({l1} * (s - m)) AS a, exp({l2} * (s - m)) AS b, exp({l3} * (s - m)) AS c FROM x),
sh AS (SELECT year, round, entrant, a / sum(a) OVER g AS p, b / sum(b) OVER g AS v, c / sum(c) OVER g AS u FROM w WINDOW g AS (PARTITION BY year, round)),
pairs AS (SELECT i.year, i.round, i.entrant, sum(j.p * i.v / (1 - j.v)) AS p2,
    sum((i.p / (1 - i.v) * j.v + j.p / (1 - j.v) * i.v) / (1 - i.u - j.u)) AS r
  FROM sh i JOIN sh j ON i.year = j.year AND i.round = j.round AND i.entrant <> j.entrant GROUP BY 1, 2, 3),
al AS (SELECT sh.*, p2, u * (sum(r) OVER (PARTITION BY year, round) / 2 - r) AS p3 FROM sh JOIN pairs USING (year, round, entrant))
SELECT year, round, entrant, round(p, 6) AS p_win, round(p2, 6) AS p_p2, round(p3, 6) AS p_p3, round(least(p + p2 + p3, 1), 6) AS p_podium FROM al"""


@query("H03_place_probabilities", "results", sql=place_sql((1, 1, 1)))
def places(t):
    d = pr.place_probabilities(scored(t), RACE, "entrant", -F.col("pred") / 9.0, t.hot_contest)
    return rounded(d, KEY, "p_win", "p_p2", "p_p3", "p_podium")


@query("H04_place_powers", "results", sql=place_sql((1, 0.85, 0.7)))
def place_powers(t):
    d = pr.place_probabilities(scored(t), RACE, "entrant", -F.col("pred") / 9.0, t.hot_contest, (1.0, 0.85, 0.7))
    return rounded(d, KEY, "p_win", "p_p2", "p_p3", "p_podium")


@query("H04_nll_powers", "results",
       sql=f"{GRID}, {nll_sql('gs', '(-pred / 4.0)', powers=(1.0, 0.85, 0.7))} SELECT year, round, round(ll_top3, 6) AS nll FROM nl")
def nll_powers(t):
    d = pr.top_nll(scored(t), RACE, -F.col("pred") / 4.0, F.col("finish_position"), 3, t.hot_contest, (1.0, 0.85, 0.7))
    return rounded(d, RACE, "nll")


@query("H05_subset_nll", "results",
       sql=f"""{GRID}, d AS (SELECT year, round, entrant, -pred / 9.0 AS s, 0.75 + (entrant % 5) * 0.05 AS q,
    CASE WHEN finish_position BETWEEN 1 AND 3 THEN finish_position END AS p FROM gs),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY year, round)) AS w FROM d),
top AS (SELECT year, round, sum(ln(q)) AS lq, sum(w) AS c1, sum(w) FILTER (p >= 2) AS c2, sum(w) FILTER (p >= 3) AS c3,
  max(w) FILTER (p = 1) AS o1, max(w) FILTER (p = 2) AS o2, max(w) FILTER (p = 3) AS o3 FROM e WHERE p IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 3),
dr AS (SELECT year, round, b, sum(CASE WHEN p IS NULL AND ('0x' || substr(md5(concat_ws('|', year, round, entrant, b)), 1, 8))::BIGINT / 4294967296.0 < q
  THEN w ELSE 0 END) AS ws FROM e, (SELECT unnest(range(1, 2001)) AS b) GROUP BY 1, 2, 3)
SELECT year, round, round(-(max(lq) + ln(avg(o1 / (ws + c1) * o2 / (ws + c2) * o3 / (ws + c3)))), 6) AS nll FROM dr JOIN top USING (year, round) GROUP BY 1, 2""")
def subset(t):
    q = 0.75 + (F.col("entrant") % 5) * 0.05
    d = pr.subset_nll(scored(t), RACE, "entrant", -F.col("pred") / 9.0, q, F.col("finish_position"), 2000, t.hot_contest)
    return rounded(d, RACE, "nll")


POSITIONS = """pos AS (SELECT team, finish_position AS position, count(*) / sum(count(*)) OVER (PARTITION BY team) AS p
  FROM results WHERE dnf = 0 AND finish_position IS NOT NULL GROUP BY team, finish_position)"""


def team_positions(t):
    n = t.results.where(ft.classified()).groupBy("team", F.col("finish_position").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("team").agg(F.sum("n").alias("total"))
    return n.join(total, "team").select("team", "position", (F.col("n") / F.col("total")).alias("p"))


@query("H06_from_position_table", "results",
       sql=POSITIONS + """ SELECT team, round(coalesce(sum(p) FILTER (position = 1), 0), 6) AS p_win, round(coalesce(sum(p) FILTER (position = 2), 0), 6) AS p_p2,
  round(coalesce(sum(p) FILTER (position = 3), 0), 6) AS p_p3, round(coalesce(sum(p) FILTER (position <= 3), 0), 6) AS p_podium,
  round(coalesce(sum(p) FILTER (position <= 6), 0), 6) AS p_top6, round(coalesce(sum(p) FILTER (position <= 10), 0), 6) AS p_top10 FROM pos GROUP BY team""")
def from_positions(t):
    d = pr.from_positions(team_positions(t), ["team"], "position", "p")
    return rounded(d, ["team"], "p_win", "p_p2", "p_p3", "p_podium", "p_top6", "p_top10")


@query("H07_expected_from_table", "results",
       sql=POSITIONS + " SELECT team, round(sum(position * p), 6) AS expected_position FROM pos GROUP BY team")
def expected_from_table(t):
    return rounded(pr.from_positions(team_positions(t), ["team"], "position", "p"), ["team"], "expected_position")


@query("H07_expected_position", "results",
       sql=f"""{GRID} SELECT a.year, a.round, a.entrant, round(1 + sum(1 / (1 + exp((b.pred - a.pred) / 9.0))), 6) AS expected_position
FROM gs a JOIN gs b ON a.year = b.year AND a.round = b.round AND a.entrant <> b.entrant GROUP BY 1, 2, 3""")
def expected(t):
    t.settle_results()
    return rounded(pr.expected_position(scored(t), RACE, -F.col("pred") / 9.0, "expected_position"), KEY, "expected_position")


T_LIST = "[" + ", ".join(f"{v}::DOUBLE" for v in fv.TEMPERATURES) + "]"
TGRID = f"""{GRID}, {MODEL}, tg AS (SELECT unnest({T_LIST}) AS temperature),
xt AS (SELECT md.year, md.round, md.finish_position, temperature, -mpred / temperature AS s FROM md, tg),
{nll_sql('xt', 's', 'nt', extra='temperature')}"""


def nll_table(t, pred: str = "mpred", extra=()):
    grid = [*fv.TEMPERATURES, *extra]
    return pr.nll_by_temperature(scored(t), RACE, F.col(pred), F.col("finish_position"), grid, t.hot_contest)


@query("H08_fit_temperature", "results",
       sql=TGRID + """, av AS (SELECT temperature, avg(ll_top3) AS loss FROM nt GROUP BY 1)
SELECT temperature, round(loss, 6) AS loss FROM av ORDER BY av.loss, temperature LIMIT 1""")
def fit_temperature(t):
    return rounded(sc.fit_temperature(nll_table(t)), ["temperature"], "loss")


@query("H09_leave_one_out", "results",
       sql=TGRID + """, tot AS (SELECT temperature, sum(ll_top3) AS s FROM nt GROUP BY 1),
b AS (SELECT year, round, temperature, ll_top3, row_number() OVER (PARTITION BY year, round ORDER BY s - ll_top3, temperature) AS k FROM nt JOIN tot USING (temperature))
SELECT year, round, temperature, round(ll_top3, 6) AS ll_top3 FROM b WHERE k = 1""")
def leave_one_out(t):
    return rounded(sc.leave_one_out(nll_table(t), RACE), [*RACE, "temperature"], "ll_top3")


CONTEXT = f"""{GRID}, {MODEL}, cx AS (SELECT year, round, entrant, finish_position, -mpred AS raw, (entrant % 9) / 4.0 AS rating,
  0.15 + (venue % 3) * 0.05 AS ovt, 0.1 + (round % 4) * 0.02 AS qsh, 0.08 + venue * 0.03 AS sc FROM md),
cs AS (SELECT *, (raw + 0.5 * rating) / (3.0 * exp(0.1 * (ovt - 0.2) / 0.05 + 0.05 * (qsh - 0.146) / 0.041)) AS s FROM cx)"""


def contexts(t):
    return scored(t).select(
        *KEY, "finish_position", (-F.col("mpred")).alias("raw"), ((F.col("entrant") % 9) / 4.0).alias("rating"),
        (0.15 + (F.col("venue") % 3) * 0.05).alias("overtaking"),
        (0.1 + (F.col("round") % 4) * 0.02).alias("quali_shuffle"),
        F.lit(1.16).alias("quali_spread"), F.lit(0.0).alias("sprint"),
        (0.08 + F.col("venue") * 0.03).alias("sc_rate"),
    )


PARAMS = cal.Parameters(temperature=3.0, rating_weight=0.5, overtaking_slope=0.1, quali_shuffle_slope=0.05, sc_scale=2.0)


@query("H10_calibrated_strength", "results", sql=CONTEXT + " SELECT year, round, entrant, round(s, 6) AS strength FROM cs")
def calibrated(t):
    return rounded(contexts(t).withColumn("strength", cal.strength(PARAMS)), KEY, "strength")


@query("H11_mixture_nll", "results",
       sql=f"""{CONTEXT}, fl AS (SELECT *, s * 0.5 AS s2 FROM cs), {nll_sql('cs', 's', 'na')}, {nll_sql('fl', 's2', 'nb')},
p AS (SELECT year, round, least(2.0 * max(sc), 0.9) AS p FROM cs GROUP BY 1, 2)
SELECT year, round, round(-ln((1 - p) * exp(-na.ll_top3) + p * exp(-nb.ll_top3)), 6) AS nll FROM na JOIN nb USING (year, round) JOIN p USING (year, round)""")
def mixture(t):
    return rounded(cal.mixture_nll(contexts(t), PARAMS, t.hot_contest), RACE, "nll")


@query("H12_parameter_sweep", "results",
       sql=f"""{GRID}, {MODEL}, v AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]) AS value),
cs AS (SELECT value, year, round, finish_position, (-mpred + value * (entrant % 9) / 4.0) / (3.0 * exp(0.1 * (0.15 + (venue % 3) * 0.05 - 0.2) / 0.05
  + 0.05 * (0.1 + (round % 4) * 0.02 - 0.146) / 0.041)) AS s, 0.08 + venue * 0.03 AS sc FROM md, v),
fl AS (SELECT *, s * 0.5 AS s2 FROM cs), {nll_sql('cs', 's', 'na', extra='value')}, {nll_sql('fl', 's2', 'nb', extra='value')},
p AS (SELECT value, year, round, least(2.0 * max(sc), 0.9) AS p FROM cs GROUP BY 1, 2, 3)
SELECT value, round(avg(-ln((1 - p) * exp(-na.ll_top3) + p * exp(-nb.ll_top3))), 6) AS loss
FROM na JOIN nb USING (value, year, round) JOIN p USING (value, year, round) GROUP BY 1""")
def sweep(t):
    return rounded(cal.sweep(contexts(t), PARAMS, "rating_weight", fv.CALIBRATION_GRIDS["rating_weight"], t.hot_contest), ["value"], "loss")


@query("G04_order_gradient", "results",
       sql=f"""{GRID}, f AS (SELECT *, -pred / 9.0 AS s FROM gs WHERE dnf = 0 AND finish_position IS NOT NULL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY year, round)) AS w, s - max(s) OVER (PARTITION BY year, round) AS z,
  max(finish_position) OVER (PARTITION BY year, round) AS l FROM f),
r AS (SELECT *, sum(w) OVER (PARTITION BY year, round ORDER BY finish_position DESC) AS rem FROM e)
SELECT year, round, entrant, round(CASE WHEN finish_position < l THEN 1 ELSE 0 END - w * coalesce(sum(CASE WHEN finish_position < l THEN 1 / rem END)
  OVER (PARTITION BY year, round ORDER BY finish_position), 0), 6) AS gradient,
  round(CASE WHEN finish_position < l THEN z - ln(rem) ELSE 0 END, 6) AS order_ll FROM r""")
def gradient(t):
    place = F.when(ft.classified(), F.col("finish_position"))
    d = pr.order_gradient(scored(t), RACE, -F.col("pred") / 9.0, place, t.hot_contest)
    return rounded(d, KEY, "gradient", "order_ll")
