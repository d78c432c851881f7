"""Ratings (G) and models (I)."""

from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.functions.lookups import is_street, safety_car_rate
from fieldorder.operators import features as ft
from fieldorder.operators import field as fd
from fieldorder.operators import ratings as rt
from fieldorder.operators.grouping import join_groups, kept
from fieldorder.operators.scoring import recency_weights
from fieldorder.plans import models as md
from fieldorder.plans.queries.field import GAPS
from fieldorder.plans.queries.history import KEY, rounded, sizes
from fieldorder.plans.queries.ingest import FUTURE, remaining
from fieldorder.plans.queries.probability import GRID, MODEL, nll_sql, scored
from fieldorder.plans.registry import query
from fieldorder.plans.venues import venue_name

RACE = ["year", "round"]
LEAGUE = ["league", "year", "round"]


ELO = """y AS (SELECT year, round, row_number() OVER (ORDER BY year, round) AS t, year > lag(year) OVER (ORDER BY year, round) AS fresh FROM (SELECT DISTINCT year, round FROM results)),
rs AS (SELECT t, league, entrant, finish_position AS p FROM results JOIN y USING (year, round) WHERE dnf = 0 AND finish_position IS NOT NULL),
el AS (WITH RECURSIVE f AS (SELECT CAST(0 AS BIGINT) AS t, league, entrant, 1500.0::DOUBLE AS pre, 1500.0::DOUBLE AS post FROM (SELECT DISTINCT league, entrant FROM results)
  UNION ALL (WITH p AS (SELECT y.t, f.league, f.entrant, CASE WHEN y.fresh THEN f.post * 0.85::DOUBLE + 225.0::DOUBLE ELSE f.post END AS pre FROM f JOIN y ON y.t = f.t + 1),
    c AS (SELECT p.*, rs.p AS place FROM p LEFT JOIN rs ON rs.t = p.t AND rs.league = p.league AND rs.entrant = p.entrant)
    SELECT a.t, a.league, a.entrant, a.pre, a.pre + coalesce(32.0::DOUBLE / nullif(count(b.entrant), 0) * sum(CASE WHEN a.place < b.place THEN 1.0::DOUBLE WHEN a.place = b.place THEN 0.5 ELSE 0 END
      - 1 / (1 + power(10.0::DOUBLE, (b.pre - a.pre) / 400))), 0) AS post FROM c a LEFT JOIN c b ON a.league = b.league AND a.place IS NOT NULL AND b.place IS NOT NULL AND a.entrant <> b.entrant
    GROUP BY a.t, a.league, a.entrant, a.pre)) SELECT * FROM f)"""


@query("G01_elo", "results",
       sql=ELO + " SELECT league, year, round, entrant, round(pre, 6) AS driver_elo FROM results JOIN y USING (year, round) JOIN el USING (t, league, entrant)")
def elo(t):
    t.settle_results()
    return rounded(rt.elo_ratings(t.results, hot=t.hot_league), [*LEAGUE, "entrant"], "driver_elo")


@query("G02_elo_contest_step", "results",
       sql="""r AS (SELECT *, 1500 + points * 8 - quali_position * 3.0 AS rating FROM results WHERE dnf = 0 AND finish_position IS NOT NULL),
p AS (SELECT a.year, a.round, a.entrant, count(*) AS m, sum(CASE WHEN a.finish_position < b.finish_position THEN 1.0 WHEN a.finish_position = b.finish_position THEN 0.5 ELSE 0 END
  - 1 / (1 + power(10.0, (b.rating - a.rating) / 400))) AS d FROM r a JOIN r b ON a.year = b.year AND a.round = b.round AND a.entrant <> b.entrant GROUP BY 1, 2, 3)
SELECT year, round, entrant, round(32.0 / m * d, 6) AS change FROM p""")
def elo_step(t):
    d = t.results.withColumn("rating", (1500 + F.col("points") * 8 - F.col("quali_position") * 3.0).cast("double"))
    return rounded(rt.elo_step(d, "rating", 32.0, RACE, t.hot_contest), KEY, "change")


def strength_sql(points):
    """Every contest's strengths before it, for each point (point, ld, lt, dc, tc, rk): a recursion over the time steps."""
    return f"""y AS (SELECT year, round, row_number() OVER (ORDER BY year, round) AS t, year > lag(year) OVER (ORDER BY year, round) AS fresh FROM (SELECT DISTINCT year, round FROM results)),
pt AS ({points}), rs AS (SELECT t, league, entrant, finish_position AS p, dnf FROM results JOIN y USING (year, round)),
st AS (WITH RECURSIVE f AS (
  SELECT CAST(0 AS BIGINT) AS t, point, league, entrant, team, NULL::DOUBLE AS dr, 0.0::DOUBLE AS tr, NULL::DOUBLE AS dn, 0.0::DOUBLE AS tn, false AS here, NULL::DOUBLE AS ll, CAST(0 AS BIGINT) AS m
  FROM (SELECT DISTINCT league, entrant, team FROM results), pt
  UNION ALL (WITH a AS (SELECT y.t, f.point, ld, lt, rk, f.league, f.entrant, f.team, CASE WHEN y.fresh THEN f.dn * dc ELSE f.dn END AS d0, CASE WHEN y.fresh THEN f.tn * tc ELSE f.tn END AS tr
      FROM f JOIN y ON y.t = f.t + 1 JOIN pt USING (point)),
    b AS (SELECT a.*, rs.entrant IS NOT NULL AS here, CASE WHEN rs.dnf = 0 THEN rs.p END AS place, CASE WHEN rs.entrant IS NOT NULL THEN coalesce(d0, rk) ELSE d0 END AS dr
      FROM a LEFT JOIN rs ON rs.t = a.t AND rs.league = a.league AND rs.entrant = a.entrant),
    c AS (SELECT *, dr + tr AS s, count(place) OVER (PARTITION BY point, league) AS m, row_number() OVER (PARTITION BY point, league ORDER BY place NULLS LAST) AS k,
      sum(CASE WHEN place IS NOT NULL THEN exp(dr + tr) END) OVER (PARTITION BY point, league ORDER BY place DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS behind FROM b),
    g AS (SELECT *, CASE WHEN k < m THEN s - ln(behind) END AS l, CASE WHEN place IS NOT NULL AND m >= 2 THEN CASE WHEN k < m THEN 1 ELSE 0 END
      - exp(s) * sum(CASE WHEN k < m THEN 1 / behind END) OVER (PARTITION BY point, league ORDER BY place NULLS LAST ROWS UNBOUNDED PRECEDING) ELSE 0 END AS g FROM c)
    SELECT t, point, league, entrant, team, dr, tr, dr + ld * g, tr + lt * sum(g) OVER (PARTITION BY point, league, team), here, sum(l) OVER (PARTITION BY point, league), m FROM g)) SELECT * FROM f)"""


ONE = " , ".join(f"{fv.STRENGTH[k]}::DOUBLE AS {n}" for k, n in (("lr_driver", "ld"), ("lr_team", "lt"), ("driver_carry", "dc"), ("team_carry", "tc"), ("rookie", "rk")))
EVERY = "SELECT CAST(row_number() OVER () - 1 AS INT) AS point, * EXCLUDE (x) FROM (SELECT * FROM (SELECT unnest({lr_driver}::DOUBLE[]) AS ld), (SELECT unnest({lr_team}::DOUBLE[]) AS lt), (SELECT unnest({driver_carry}::DOUBLE[]) AS dc), (SELECT unnest({team_carry}::DOUBLE[]) AS tc), (SELECT unnest({reset_carry}::DOUBLE[]) AS x), (SELECT unnest({rookie}::DOUBLE[]) AS rk) ORDER BY ld, lt, dc, tc, x, rk)".format(**fv.STRENGTH_GRID)


@query("G03_strength", "results",
       sql=strength_sql(f"SELECT 0 AS point, {ONE}") + """ SELECT league, year, round, entrant, round(dr, 6) AS driver_rating, round(tr, 6) AS team_rating, round(dr + tr, 6) AS car_rating
FROM st JOIN y USING (t) WHERE here""")
def strength(t):
    t.settle_results()
    return rounded(rt.strength_ratings(t.results, hot=t.hot_league), [*LEAGUE, "entrant"], "driver_rating", "team_rating", "car_rating")


@query("G05_rating_grid", "results",
       sql=strength_sql(EVERY) + """, c AS (SELECT DISTINCT point, league, t, ll, m FROM st WHERE m >= 2)
SELECT point, round(sum(ll) / sum(m), 6) AS score FROM c JOIN y USING (t) WHERE year > (SELECT min(year) FROM y) GROUP BY point""")
def rating_grid(t):
    t.settle_results()
    return rounded(rt.score_parameters(t.results, None, t.hot_league), ["point"], "score")


@query("G06_level_tracker", "results",
       sql=GAPS + """, ob AS (SELECT entrant, year, round, y, row_number() OVER (PARTITION BY entrant ORDER BY year, round) AS i FROM sg)
SELECT entrant, year, round, round(mean, 6) AS mean, round(sd, 6) AS sd FROM (WITH RECURSIVE f AS (
  SELECT entrant, i, year, round, 0.0::DOUBLE AS mean, sqrt(1 + 0.0064) AS sd, (1.0064 / (1.0064 + 0.0625)) * y AS m, (1 - 1.0064 / (1.0064 + 0.0625)) * 1.0064 AS v FROM ob WHERE i = 1
  UNION ALL SELECT o.entrant, o.i, o.year, o.round, f.m, sqrt(p.w), f.m + p.w / (p.w + 0.0625) * (o.y - f.m), (1 - p.w / (p.w + 0.0625)) * p.w FROM f JOIN ob o ON o.entrant = f.entrant AND o.i = f.i + 1,
    LATERAL (SELECT f.v + 0.0064 + CASE WHEN o.year > f.year THEN 0.16 ELSE 0 END AS w) p) SELECT * FROM f)""")
def tracker(t):
    d = fd.session_gaps(t.results, sizes(t))
    return rounded(rt.level_tracker(d, ["entrant"], F.col("y")), ["entrant", *RACE], "mean", "sd")


@query("G07_rating_as_of", "results",
       sql=ELO + " SELECT league, year, round, entrant, finish_position, round(pre, 6) AS driver_elo FROM results JOIN y USING (year, round) JOIN el USING (t, league, entrant)")
def rating_as_of(t):
    """Ratings before a contest, for every entry, whether or not it has a result."""
    t.settle_results()
    pre = rt.elo_ratings(t.results, hot=t.hot_league)
    d = t.results.select(*LEAGUE, "entrant", "finish_position").join(pre, [*LEAGUE, "entrant"], "left")
    return rounded(d, [*LEAGUE, "entrant", "finish_position"], "driver_elo")


def split_rows(t):
    """Rows before 2000 (with recency weights of their seasons) and from 2000 on, with all columns of the finish model."""
    t.settle_results()
    s = sizes(t)
    d = ft.grid_relative(ft.pit_lane_to_back(t.results, s), s)
    d = ft.dnf_rate(ft.experience(d, s), s)
    d = join_groups(d, ft.team_reliability(t.results, s), ft.TEAM_CONTEST)
    wet = t.weather.select(*RACE, (F.col("precip_tenths_mm") / 10.0).alias("precip_mm_total"), F.col("is_wet").alias("is_wet_race"))
    d = d.join(wet, RACE, "left").withColumn("_venue", venue_name(F.col("venue")))
    d = d.withColumn("is_street_circuit", is_street(F.col("_venue"))).withColumn("circuit_safety_car_rate", safety_car_rate(F.col("_venue")))
    d = d.drop("_venue")
    if t.hot_lines:  # made once, as a fit reads its rows several times
        d = kept(d)
    train, test = d.where("year < 2000"), d.where("year >= 2000")
    return train.join(recency_weights(t.results.where("year < 2000")), "year"), test


COLUMNS = fv.FINISH_COLUMNS


def score_sql(names, n):
    return f"SELECT column_name, n, CAST(0 AS DOUBLE) AS equation FROM (SELECT unnest({names}) AS column_name), ({n})"


def score_rows(d):
    return d.select("column_name", "n", (F.round("equation", 6) + 0.0).alias("equation"))


@query("I01_finish_model")
def finish_model(t):
    train, test = split_rows(t)
    return rounded(md.finish_model(train, test, COLUMNS, "weight"), KEY, "p_finish")


@query("I01_score_equations", "results",
       sql=score_sql(["_x_1", *[f"_x_{c}" for c in COLUMNS]], "SELECT CAST(count(*) AS BIGINT) AS n FROM results WHERE year < 2000"))
def finish_equations(t):
    """The weighted score equations of the fitted finish model, and the sum of its weights (mean 1)."""
    d = md.FinishFit(split_rows(t)[0], COLUMNS, "weight").equations()
    return score_rows(d.withColumn("n", F.round("n").cast("long")))


@query("I02_ranker")
def ranker(t):
    train, test = split_rows(t)
    scores, _ = md.ranker(train, test, COLUMNS, t.hot_contest, "weight")
    return rounded(scores, KEY, "score")


@query("I02_score_equations", "results",
       sql=f"""f AS (SELECT year, round, row_number() OVER (PARTITION BY year, round ORDER BY finish_position, entrant) AS k FROM results
  WHERE year < 2000 AND dnf = 0 AND finish_position IS NOT NULL),
y AS (SELECT year, count(*) AS c, 0.65 + 0.7 * (row_number() OVER (ORDER BY year) - 1) / (count(*) OVER () - 1) AS a FROM results WHERE year < 2000 GROUP BY year),
w AS (SELECT year, a / (SELECT sum(a * c) / sum(c) FROM y) AS w FROM y),
p AS (SELECT round(sum(w * least(k - 1, 5)), 6) AS n FROM f JOIN w USING (year)) {score_sql(COLUMNS, "SELECT n FROM p")}""")
def ranker_equations(t):
    """The score equations of the fitted ranker, and the weight of all its pairs."""
    d = md.RankerFit(split_rows(t)[0], COLUMNS, t.hot_contest, "weight").equations()
    return score_rows(d.withColumn("n", F.round("n", 6)))


@query("I03_position_regressor")
def regressor(t):
    train, test = split_rows(t)
    train = md.target_position(train, t.hot_contest)
    return rounded(md.position_regressor(train, test, COLUMNS, "weight"), KEY, "predicted")


@query("I04_order_loss_gradient", "results",
       sql="""s AS (SELECT year, round, finish_position AS p, quali_position / 10.0 AS q, points / 10.0 AS w, -0.4 * quali_position / 10.0 + 0.3 * points / 10.0 AS z FROM results),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY year, round)) AS e, z - max(z) OVER (PARTITION BY year, round) AS d FROM s),
st AS (SELECT unnest([1, 2, 3]) AS j), g AS (SELECT year, round, j, sum(e) FILTER (p IS NULL OR p >= j) AS se, sum(e * q) FILTER (p IS NULL OR p >= j) AS sq, sum(e * w) FILTER (p IS NULL OR p >= j) AS sw,
  max(d) FILTER (p = j) AS dj, max(q) FILTER (p = j) AS qj, max(w) FILTER (p = j) AS wj FROM e, st GROUP BY 1, 2, 3),
c AS (SELECT year, round, sum(ln(se) - dj) AS l, sum(sq / se - qj) AS dq, sum(sw / se - wj) AS dw FROM g GROUP BY 1, 2 HAVING count(dj) = 3)
SELECT round(avg(l), 6) AS loss, round(avg(dq), 6) AS d_q, round(avg(dw), 6) AS d_w FROM c""")
def order_gradient(t):
    d = t.results.select("*", (F.col("quali_position") / 10.0).alias("q"), (F.col("points") / 10.0).alias("w"))
    return rounded(md.order_loss_gradient(d, ["q", "w"], [-0.4, 0.3], t.hot_contest), [], "loss", "d_q", "d_w")


@query("I04_order_model")
def order_model(t):
    train, test = split_rows(t)
    beta = md.order_model(train, COLUMNS)
    z = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * b for c, b in zip(COLUMNS, beta)), F.lit(0.0))
    return rounded(test.withColumn("score", z), KEY, "score")


@query("I04_score_equations", "results",
       sql=score_sql(COLUMNS, """SELECT count(*) AS n FROM (SELECT year, round FROM results WHERE year < 2000 GROUP BY 1, 2
  HAVING count(DISTINCT finish_position) FILTER (finish_position BETWEEN 1 AND 3) = 3)"""))
def order_equations(t):
    """The score equations of the fitted order model, and its contests."""
    return score_rows(md.OrderFit(split_rows(t)[0], COLUMNS).equations())


@query("I05_mean_scores", "results",
       sql="SELECT year, round, entrant, round((quali_position * 0.5 + points + coalesce(grid_position, 0) * 2.0) / 3, 6) AS score FROM results")
def mean_scores(t):
    r = t.results
    parts = [r.select(*KEY, x.alias("score")) for x in (F.col("quali_position") * 0.5, F.col("points") * 1.0, F.col("grid_position") * 2.0)]
    return rounded(md.mean_scores(parts, KEY, "score"), KEY, "score")


@query("I07_forward_folds", "results",
       sql="""g AS (SELECT DISTINCT year * 100 + round AS g FROM results), f AS (SELECT g AS fold FROM g ORDER BY g DESC LIMIT 5)
SELECT fold, g AS "group", CASE WHEN g = fold THEN 'test' ELSE 'train' END AS part FROM g JOIN f ON g <= fold""")
def folds(t):
    return md.forward_folds(t.results, F.col("year") * 100 + F.col("round"), 5)


@query("I08_future_state", "results",
       sql=FUTURE + """, k AS (SELECT *, row_number() OVER (PARTITION BY entrant ORDER BY year DESC, round DESC) AS k FROM results),
st AS (SELECT entrant, avg(finish_position) FILTER (k <= 5) AS form, CASE WHEN count(dnf) FILTER (k <= 10) >= 3 THEN avg(dnf) FILTER (k <= 10) END AS dnf_rate, least(count(*) / 100.0, 1) AS experience FROM k GROUP BY 1),
vn AS (SELECT fu.year, fu.round, fu.entrant, avg(b.finish_position) AS v FROM fu LEFT JOIN results b ON b.venue = fu.venue AND b.entrant = fu.entrant AND b.year >= fu.year - 5 GROUP BY 1, 2, 3)
SELECT year, round, entrant, round(form, 6) AS driver_form_5, round(dnf_rate, 6) AS dnf_rate, round(CAST(experience AS DOUBLE), 6) AS driver_experience_norm, round(v, 6) AS circuit_avg_finish FROM vn LEFT JOIN st USING (entrant)""")
def future_state(t):
    """The entrant's columns as they stand at the first contest to come, for all of them; the circuit's column of each."""
    from fieldorder.operators.joins import future_rows

    s, state = sizes(t), ["driver_form_5", "dnf_rate", "driver_experience_norm"]
    f = future_rows(t.results, remaining(t), [c for c in t.results.columns if c not in (*KEY, "venue", "team")])
    d = t.results.unionByName(f.withColumn("_to_come", F.lit(True)), allowMissingColumns=True)
    first = f.agg(F.min(F.struct("year", "round")).alias("m")).select("m.year", "m.round")
    now = ft.experience(ft.dnf_rate(ft.driver_form(d, s), s), s).where("_to_come").join(F.broadcast(first), RACE, "left_semi")  # one row
    circuit = ft.venue_history(d).where("_to_come").select(*KEY, "circuit_avg_finish")
    return rounded(circuit.join(now.select("entrant", *state), "entrant", "left"), KEY, *state, "circuit_avg_finish")


SHARES = [k / 20 for k in range(9)]
SHARE_LIST = "[" + ", ".join(f"{v}::DOUBLE" for v in SHARES) + "]"


@query("I06_component_weights", "results",
       sql=f"""{GRID}, {MODEL}, ww AS (SELECT x, y FROM (SELECT unnest({SHARE_LIST}) AS x), (SELECT unnest({SHARE_LIST}) AS y) WHERE x + y > 0),
sx AS (SELECT x, y, year, round, finish_position, -(x * pred + y * mpred) AS s FROM md, ww),
{nll_sql('sx', 's', extra='x, y')}, av AS (SELECT x, y, avg(ll_top3) AS loss FROM nl GROUP BY 1, 2) SELECT x AS first_weight, y AS second_weight, round(loss, 6) AS loss FROM av ORDER BY av.loss, x, y LIMIT 1""")
def component_weights(t):
    from fieldorder.operators.probability import top_nll_by_weights

    pairs = [(x, y) for x in SHARES for y in SHARES if x + y > 0]
    d = scored(t).select(*RACE, "finish_position", "pred", "mpred")
    n = top_nll_by_weights(d, RACE, lambda w: -(w[0] * F.col("pred") + w[1] * F.col("mpred")), pairs, F.col("finish_position"))
    loss = n.groupBy(F.col("weights")[0].alias("x"), F.col("weights")[1].alias("y")).agg(F.avg("nll").alias("loss"))
    best = loss.agg(F.min(F.struct("loss", "x", "y")).alias("b"))
    return best.select(F.col("b.x").alias("first_weight"), F.col("b.y").alias("second_weight"), F.round("b.loss", 6).alias("loss"))


@query("I06_score_equations", "results",
       sql=score_sql(["first", "second"], "SELECT count(*) AS n FROM (SELECT year, round FROM results GROUP BY 1, 2 HAVING count(DISTINCT finish_position) FILTER (finish_position BETWEEN 1 AND 3) = 3)"))
def weight_equations(t):
    """The likeliest weights of two components without a grid: their score equations hold."""
    from fieldorder.operators.grouping import checkpointed
    from fieldorder.plans.newton import equations, newton, order_moments

    d = scored(t).select(*RACE, "finish_position", (-F.col("pred")).cast("double").alias("first"), (-F.col("mpred")).cast("double").alias("second"))
    d, names = checkpointed(d), ["first", "second"]
    beta, _ = newton(lambda b: order_moments(d, names, b), names, [0.0, 0.0])
    return score_rows(equations(order_moments(d, names, beta), names, [0.0, 0.0], beta))
