"""Joins (C)."""

from pyspark.sql import functions as F

from fieldorder.operators import features as ft
from fieldorder.operators import joins as jn
from fieldorder.operators import ledger as lg
from fieldorder.plans.queries.field import BEFORE
from fieldorder.plans.queries.history import CAR_PACE, KEY, MATE, QUALI, rounded, sizes
from fieldorder.plans.queries.ingest import FUTURE, remaining
from fieldorder.plans.queries.scoring import BOOK, PROBS, markets, probs
from fieldorder.plans.registry import query

RACE = ["year", "round"]


@query("C01_left_join_entrant", "results",
       sql=f"{QUALI}, {MATE} SELECT r.year, r.round, r.entrant, r.points, round(mate, 6) AS teammate_quali_delta FROM results r LEFT JOIN (SELECT * FROM md WHERE gap IS NOT NULL) m ON r.year = m.year AND r.round = m.round AND r.entrant = m.entrant")
def left_join(t):
    s = sizes(t)
    q = ft.quali_gap(t.results, s).where(F.col("quali_gap_s").isNotNull())
    right = ft.teammate_quali_delta(q, s).select(*KEY, "teammate_quali_delta")
    d = t.results.join(right, KEY, "left")
    return d.select(*KEY, "points", F.round("teammate_quali_delta", 6).alias("teammate_quali_delta"))


@query("C02_left_join_contest", "results", "weather",
       sql="SELECT r.year, r.round, entrant, is_wet, temp_c FROM results r LEFT JOIN weather w ON r.year = w.year AND r.round = w.round")
def join_contest(t):
    return t.results.join(t.weather, RACE, "left").select(*KEY, "is_wet", "temp_c")


@query("C03_join_team", "results",
       sql=f"{QUALI}, {CAR_PACE} SELECT r.year, r.round, entrant, round(car_pace_delta_pct, 6) AS car_pace_delta_pct FROM results r LEFT JOIN cp USING (year, round, team)")
def join_team(t):
    s = sizes(t)
    per = ft.car_pace_delta(ft.quali_gap(t.results, s), s)
    return rounded(t.results.join(per, ft.TEAM_CONTEST, "left"), KEY, "car_pace_delta_pct")


@query("C04_full_outer", "results",
       sql=BOOK + " SELECT year, round, entrant, p_win_market IS NOT NULL AS in_win, p_podium_market IS NOT NULL AS in_podium FROM wm FULL JOIN pm USING (year, round, entrant)")
def full_outer(t):
    d = markets(t)
    return d.select(*KEY, F.col("p_win_market").isNotNull().alias("in_win"), F.col("p_podium_market").isNotNull().alias("in_podium"))


@query("C05_multi_join", "results", "weather",
       sql=f"{PROBS}, {BOOK} SELECT pw.year, pw.round, pw.entrant, round(p_win, 6) AS p_win, round(p_win_market, 6) AS p_win_market, is_wet FROM pw JOIN weather USING (year, round) LEFT JOIN wm USING (year, round, entrant)")
def multi_join(t):
    m = markets(t).select(*KEY, "p_win_market")
    d = probs(t).join(t.weather.select(*RACE, "is_wet"), RACE).join(m, KEY, "left")
    return d.select(*KEY, F.round("p_win", 6).alias("p_win"), F.round("p_win_market", 6).alias("p_win_market"), "is_wet")


@query("C06_semi_join", "results", sql=BOOK + " SELECT year, round, entrant FROM results WHERE (year, round) IN (SELECT (year, round) FROM wm)")
def semi(t):
    listed = markets(t).where(F.col("p_win_market").isNotNull()).select(*RACE)
    return t.results.join(listed, RACE, "left_semi").select(*KEY)


@query("C07_anti_join", "results", "weather", sql="SELECT year, round, entrant FROM results WHERE (year, round) NOT IN (SELECT (year, round) FROM weather)")
def anti(t):
    return t.results.join(t.weather, RACE, "left_anti").select(*KEY)


@query("C08_range_join",
       sql="""s AS (SELECT o_orderkey, o_custkey % 500 AS k, o_orderdate::DATE - DATE '1990-01-01' AS d0, o_orderdate::DATE - DATE '1990-01-01' + o_orderkey % 20 AS d1, o_orderkey % 5 AS age0 FROM orders),
p AS (SELECT l_orderkey, l_linenumber, max(l_partkey) % 500 AS k, max(l_shipdate)::DATE - DATE '1990-01-01' AS d FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, o_orderkey AS span, CAST(age0 + d - d0 AS BIGINT) AS age FROM p LEFT JOIN s ON p.k = s.k AND d BETWEEN d0 AND d1
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY d0 DESC NULLS LAST, o_orderkey DESC) = 1""")
def range_join(t):
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    spans = t.read("orders").select(
        "o_orderkey", (F.col("o_custkey") % 500).alias("k"), day("o_orderdate").alias("d0"),
        (day("o_orderdate") + F.col("o_orderkey") % 20).alias("d1"), (F.col("o_orderkey") % 5).alias("age0"),
    )
    points = t.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        (F.max("l_partkey") % 500).alias("k"), F.max(day("l_shipdate")).alias("d")
    )
    d = jn.covering_span(points, spans, ["k"], "d", "d0", "d1", ["o_orderkey", "age0"], "o_orderkey")
    return d.select("l_orderkey", "l_linenumber", F.col("o_orderkey").alias("span"), (F.col("age0") + F.col("d") - F.col("d0")).cast("bigint").alias("age"))


def race_times(t):
    """Contest starts on the event clock: one per four days."""
    e = t.read("events").select(F.dayofmonth("ts").alias("day"), "ts")
    g = e.where("day % 4 = 0").groupBy("day").agg(F.min("ts").alias("first"))
    return g.select((F.col("day") / 4).cast("int").alias("round"), (F.floor(F.unix_micros(F.col("first").cast("timestamp")) / 3_600_000_000) + 14).alias("race_h"))


RACES = "rt AS (SELECT CAST(day(ts) // 4 AS INT) AS round, epoch_us(min(ts)) // 3600000000 + 14 AS race_h FROM events WHERE day(ts) % 4 = 0 GROUP BY day(ts))"


def event_hours(t):
    return t.read("events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("h"))


@query("C09_first_within_four_days",
       sql=RACES + """, e AS (SELECT event_id, epoch_us(ts) // 3600000000 AS h FROM events)
SELECT e.event_id, arg_min(rt.round, race_h) FILTER (rt.round IS NOT NULL) AS round FROM e LEFT JOIN rt ON race_h - h BETWEEN 0 AND 96 GROUP BY 1""")
def first_after(t):
    d = jn.first_after(event_hours(t), race_times(t), "h", "race_h", "round", 96, t.forced)
    return d.select("event_id", "round")


@query("C10_nearest_within_36h",
       sql=RACES + """, e AS (SELECT event_id, epoch_us(ts) // 3600000000 AS h FROM events),
j AS (SELECT e.event_id, rt.round, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(race_h - h), rt.round) AS k FROM e LEFT JOIN rt ON abs(race_h - h) <= 36)
SELECT event_id, round FROM j WHERE k = 1""")
def nearest(t):
    d = jn.nearest(event_hours(t), race_times(t), "h", "race_h", "round", 36, t.forced)
    return d.select("event_id", "round")


@query("C11_quote_as_of", "quotes", "tickets",
       sql="""c AS (SELECT ticker, epoch_us(ts) AS e, event_id, bid_millis, last_millis FROM quotes), k AS (SELECT ticket_id, bettor AS ticker, epoch_us(ts) - 3600000000 AS a FROM tickets),
j AS (SELECT k.ticket_id, c.e, c.bid_millis, c.last_millis, row_number() OVER (PARTITION BY k.ticket_id ORDER BY c.e DESC NULLS LAST, c.event_id DESC) AS r
  FROM k LEFT JOIN c ON k.ticker = c.ticker AND c.e <= k.a AND c.e > k.a - 345600000000) SELECT ticket_id, e AS quote_us, bid_millis, last_millis FROM j WHERE r = 1""")
def as_of(t):
    """The quote known an hour before each ticket; both come from one table, and a ticket must not meet its own row."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    right = t.quotes.select("ticker", us.alias("quote_us"), "event_id", "bid_millis", "last_millis")
    left = t.tickets.select("ticket_id", F.col("bettor").alias("ticker"), (us - 3_600_000_000).alias("a"))
    d = jn.asof_backward(left, right, ["ticker"], "a", "quote_us", ["bid_millis", "last_millis"], "event_id", 345_600_000_000, t.hot_events)
    return d.select("ticket_id", "quote_us", "bid_millis", "last_millis")


@query("C12_latest_snapshot", "quotes",
       sql="""s AS (SELECT *, date_trunc('hour', ts) AS snap, event_id % 40 AS contest FROM quotes)
SELECT contest, count(*) AS n, max(last_millis) FILTER (market = 'win') AS win_price, max(last_millis) FILTER (market = 'podium') AS podium_price
FROM s WHERE snap = (SELECT max(snap) FROM s z WHERE z.contest = s.contest) GROUP BY 1""")
def snapshot(t):
    d = t.quotes.withColumn("snap", F.date_trunc("hour", "ts")).withColumn("contest", F.col("event_id") % 40)
    d = jn.latest_snapshot(d, ["contest"], "snap")
    price = lambda m: F.max(F.when(F.col("market") == m, F.col("last_millis")))
    return d.groupBy("contest").agg(F.count(F.lit(1)).alias("n"), price("win").alias("win_price"), price("podium").alias("podium_price"))


@query("C13_head_to_head", "results",
       sql="""SELECT a.year, a.round, a.entrant, CAST(sum(CASE WHEN b.finish_position > a.finish_position THEN 1.0 WHEN b.finish_position = a.finish_position THEN 0.5 ELSE 0 END) AS DOUBLE) AS beaten
FROM results a LEFT JOIN results b ON a.year = b.year AND a.round = b.round AND a.entrant <> b.entrant WHERE a.finish_position IS NOT NULL GROUP BY 1, 2, 3""")
def head_to_head(t):
    d = jn.head_to_head(t.results.where(F.col("finish_position").isNotNull()), sizes(t))
    return d.select(*KEY, "beaten")


@query("C14_traffic", "results",
       sql=BEFORE + """ SELECT a.year, a.round, a.entrant, count(*) FILTER (b.grid_position > a.grid_position AND b.grid_position <= a.grid_position + 5 AND b.cum > a.cum + 25) AS stronger_behind_n,
  count(*) FILTER (b.grid_position < a.grid_position AND b.grid_position >= a.grid_position - 5 AND b.cum < a.cum - 25) AS weaker_ahead_n
FROM pb a JOIN pb b ON a.year = b.year AND a.round = b.round GROUP BY 1, 2, 3""")
def traffic(t):
    s = sizes(t)
    d = jn.traffic(ft.points_before(t.results, s), F.col("cum_points_before"), "entrant", s)
    return d.select(*KEY, "stronger_behind_n", "weaker_ahead_n")


@query("C15_parameter_grid", "results",
       sql="""g AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS temperature) SELECT temperature, year, round, round(sum(exp(-quali_position / temperature)), 6) AS total FROM results, g GROUP BY 1, 2, 3""")
def parameter_grid(t):
    d = jn.with_parameter(t.results, "temperature", [0.5, 1.0, 2.0])
    return d.groupBy("temperature", *RACE).agg(F.round(F.sum(F.exp(-F.col("quali_position") / F.col("temperature"))), 6).alias("total"))


@query("C16_lineup_times_calendar", "results", sql=FUTURE + " SELECT year, round, count(*) AS n_entrants, count(DISTINCT team) AS n_teams FROM fu GROUP BY 1, 2")
def lineup(t):
    d = jn.future_rows(t.results, remaining(t), [])
    return d.groupBy(*RACE).agg(F.count(F.lit(1)).alias("n_entrants"), F.count_distinct("team").alias("n_teams"))


@query("C17_lookup",
       sql="SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'none') AS brand FROM lineitem LEFT JOIN part ON l_partkey = 2 * p_partkey")
def lookup(t):
    """Doubled part keys, so that odd keys have no entry and get the default."""
    table = t.read("part").select((2 * F.col("p_partkey")).alias("l_partkey"), F.col("p_brand").alias("brand"))
    d = jn.lookup(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table, ["l_partkey"], {"brand": "none"})
    return d.select("l_orderkey", "l_linenumber", "brand")


@query("C18_aligned_differences", "results",
       sql="""b AS (SELECT year, round, entrant, points + entrant % 3 AS points, grid_position + round % 2 AS grid_position FROM results WHERE entrant % 4 <> 0),
d AS (SELECT a.year, a.round, a.entrant, abs(a.points - b.points) AS p, abs(a.grid_position - b.grid_position) AS g FROM results a JOIN b USING (year, round, entrant)),
u AS (SELECT 'points' AS column_name, p AS diff, year, round, entrant FROM d UNION ALL SELECT 'grid_position', g, year, round, entrant FROM d)
SELECT column_name, CAST(diff AS DOUBLE) AS max_diff, year, round, entrant FROM u QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY diff DESC, year, round, entrant) = 1""")
def aligned(t):
    b = t.results.where("entrant % 4 <> 0").select(
        *KEY, (F.col("points") + F.col("entrant") % 3).alias("points"), (F.col("grid_position") + F.col("round") % 2).alias("grid_position")
    )
    return jn.aligned_differences(t.results, b, KEY, ["points", "grid_position"])


@query("C19_paired_tables", "results",
       sql="""a AS (SELECT year, round, avg(points) AS v FROM results WHERE entrant % 2 = 0 GROUP BY 1, 2), b AS (SELECT year, round, avg(points) AS v FROM results WHERE entrant % 2 = 1 GROUP BY 1, 2)
SELECT year, round, round(a.v, 6) AS v_a, round(b.v, 6) AS v_b, round(a.v - b.v, 6) AS diff FROM a JOIN b USING (year, round)""")
def paired(t):
    per = t.results.groupBy(*RACE).agg(
        F.avg(F.when(F.col("entrant") % 2 == 0, F.col("points"))).alias("v_a"), F.avg(F.when(F.col("entrant") % 2 == 1, F.col("points"))).alias("v_b")
    )
    a, b = per.select(*RACE, "v_a"), per.select(*RACE, "v_b")
    d = a.join(b, RACE).where("v_a is not null and v_b is not null").withColumn("diff", F.col("v_a") - F.col("v_b"))
    return rounded(d, RACE, "v_a", "v_b", "diff")


SETTLED = """sl AS (SELECT k.*, r.finish_position AS finish, CASE WHEN r.entrant IS NULL THEN 'void' WHEN
  (CASE WHEN event = 'win' THEN coalesce(r.finish_position = 1, false) ELSE coalesce(r.finish_position <= 3, false) END) <> negate THEN 'won' ELSE 'lost' END AS status
  FROM tickets k LEFT JOIN results r ON k.year = r.year AND k.round = r.round AND k.entrant = r.entrant)"""


@query("C20_tickets_with_results", "results", "tickets", sql=SETTLED + " SELECT ticket_id, finish, status FROM sl")
def tickets(t):
    d = lg.settle(t.tickets.withColumn("status", F.lit("open")), t.results)
    return d.select("ticket_id", "finish", "status")


SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]


@query("B08_fuzzy_name",
       sql="""n AS (SELECT unnest(['automobile', 'building', 'furniture', 'household', 'machinery']) AS name),
k AS (SELECT c_custkey, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN replace(lower(c_mktsegment), 'i', 'yy') ELSE substr(lower(c_mktsegment), 1, 5) END AS key FROM customer),
b AS (SELECT c_custkey, key, name, levenshtein(key, name) / greatest(length(key), length(name)) AS far FROM k, n QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY far, name) = 1)
SELECT c_custkey, key, CASE WHEN 1 - far >= 0.72 THEN name END AS match FROM b""")
def fuzzy(t):
    seg, k = F.lower("c_mktsegment"), F.col("c_custkey") % 3
    key = F.when(k == 0, seg).when(k == 1, F.replace(seg, F.lit("i"), F.lit("yy"))).otherwise(F.substring(seg, 1, 5))
    d = t.read("customer").select("c_custkey", key.alias("key"))
    return d.withColumn("match", jn.fuzzy_name(F.col("key"), SEGMENTS))


ALIAS = "(VALUES ('build', 1), ('gold', 2), ('auto', 3), ('mobile', 4), ('machinery', 5), ('house', 6)) v(alias, pri)"
NAMES = ["build", "gold", "auto", "mobile", "machinery", "house"]


@query("B09_substring_lookup",
       sql=f"""SELECT c_custkey, lower(c_mktsegment) AS key, alias FROM customer LEFT JOIN {ALIAS} ON contains(lower(c_mktsegment), alias) OR contains(alias, lower(c_mktsegment))
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN alias = lower(c_mktsegment) THEN 0 ELSE 1 END, pri) = 1""")
def substring(t):
    c = t.read("customer").select("c_custkey", F.lower("c_mktsegment").alias("key"))
    return c.withColumn("alias", jn.substring_alias(F.col("key"), NAMES))


@query("H25_joined_markets", "results",
       sql=BOOK + " SELECT year, round, count(p_win_market) AS n_win, count(p_podium_market) AS n_podium FROM wm FULL JOIN pm USING (year, round, entrant) GROUP BY 1, 2")
def joined_markets(t):
    return markets(t).groupBy(*RACE).agg(F.count("p_win_market").alias("n_win"), F.count("p_podium_market").alias("n_podium"))


@query("J16_model_against_market", "results",
       sql=f"""{PROBS}, {BOOK} SELECT year, round, count(*) AS n, round(avg(abs(p_win - p_win_market)), 6) AS mean_gap, round(max(p_win) - max(p_win_market), 6) AS favourite_gap
FROM pw JOIN wm USING (year, round, entrant) JOIN pm USING (year, round, entrant) GROUP BY 1, 2""")
def model_market(t):
    d = joined_both(t)
    return d.groupBy(*RACE).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p_win") - F.col("p_win_market"))), 6).alias("mean_gap"),
        F.round(F.max("p_win") - F.max("p_win_market"), 6).alias("favourite_gap"),
    )


def joined_both(t):
    m = markets(t).where("p_win_market is not null and p_podium_market is not null")
    return probs(t).join(m, KEY)
