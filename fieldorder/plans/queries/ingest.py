"""Scans, sources, merges and flattening (A)."""

from pyspark.sql import functions as F

from fieldorder.operators.grouping import with_index
from fieldorder.operators.joins import future_rows
from fieldorder.plans.queries.field import SPRINT, sprint_rows
from fieldorder.plans.queries.history import KEY
from fieldorder.plans.registry import query
from fieldorder.sources import flatten as fl
from fieldorder.sources import merge as mg
from fieldorder.sources.tables import SCHEMAS

RACE = ["year", "round"]


@query("A01_scan",
       sql="SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def scan(t):
    d = mg.read_table(t.spark, f"{t.folder}/lineitem.parquet", SCHEMAS["lineitem"])
    d = d.where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


NEW = "(year * 12 + round) % 5 = 0"


def fresh(t):
    """A later delivery: some contests again, with other points."""
    d = t.results.where((F.col("year") * 12 + F.col("round")) % 5 == 0)
    return d.withColumn("points", F.col("points") + 100)


@query("A03_replace_contests", "results",
       sql=f"""n AS (SELECT year, round, entrant, points + 100 AS points FROM results WHERE {NEW} AND entrant % 2 = 0)
SELECT year, round, entrant, points FROM results WHERE (year, round) NOT IN (SELECT (year, round) FROM n) UNION ALL SELECT * FROM n""")
def replace(t):
    new = fresh(t).where(F.col("entrant") % 2 == 0).select(*KEY, "points")
    return mg.replace_contests(t.results.select(*KEY, "points"), new)


@query("A04_upsert", "results",
       sql=f"SELECT year, round, entrant, CASE WHEN {NEW} AND entrant % 2 = 0 THEN points + 100 ELSE points END AS points FROM results")
def upsert(t):
    new = fresh(t).where(F.col("entrant") % 2 == 0).select(*KEY, "points")
    return mg.upsert(t.results.select(*KEY, "points"), new, KEY)


@query("A04_keep_last",
       sql="SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(t):
    d = mg.keep_last(t.read("events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return d.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("A06_json_column",
       sql="SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total FROM events GROUP BY 1")
def json_column(t):
    d = t.read("events").withColumn("p", F.from_json("props", "k bigint"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_total"))


def race_docs(t):
    s = lambda c: F.col(c).cast("string")
    item = F.struct("entrant", "team", s("grid_position").alias("grid"), s("finish_position").alias("position"),
                    s("points").alias("points"), "status")
    return fl.documents(t.results, RACE, ["entrant"], item, "results", t.hot_contest)


@query("A07_read_documents", "results",
       sql="SELECT year, count(*) AS n_rows, count(DISTINCT round) AS n_contests FROM results WHERE (year + round) % 9 <> 0 GROUP BY 1")
def read_documents(t):
    docs = race_docs(t)
    cut = F.when((F.col("year") + F.col("round")) % 9 == 0, F.lit("{not json")).otherwise(F.col("doc"))
    d = fl.race_rows(docs.withColumn("doc", cut))
    return d.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("round").alias("n_contests"))


@query("A08_build_documents", "results",
       sql="""i AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY points DESC, entrant) - 1 AS i FROM results)
SELECT year, round, CAST(i // 1000 AS INT) AS part, '{"year":' || year || ',"round":' || round || ',"predictions":[' || string_agg('{"entrant":' || entrant || ',"team":"' || team || '","points":' || points || '}', ',' ORDER BY i)
  || ']}' AS doc FROM i GROUP BY 1, 2, 3""")
def build_documents(t):
    return fl.documents(t.results, RACE, [F.desc("points"), "entrant"], F.struct("entrant", "team", "points"), "predictions", t.hot_contest)


@query("A09_changed_contests", "results", sql=f"SELECT DISTINCT year, round FROM results WHERE {NEW}")
def changed(t):
    old = t.results.select(*KEY, "points")
    return mg.changed_documents(old, mg.upsert(old, fresh(t).select(*KEY, "points"), KEY), RACE, ["entrant", "points"])


@query("A10_settled_events", "results",
       sql="SELECT year, round FROM results GROUP BY 1, 2 HAVING bool_and(entrant % 97 <> 3)")
def settled(t):
    r = F.when(F.col("entrant") % 97 == 3, None).when(F.col("podium") == 1, "yes").otherwise("no")
    d = t.results.select(F.struct("year", "round").alias("event"), r.alias("result"))
    return mg.settled_events(d, "event", "result").select("event.year", "event.round")


@query("A10_still_to_collect", "results",
       sql="SELECT DISTINCT year, round FROM results WHERE NOT (year * 12 + round) % 5 = 0")
def to_collect(t):
    return mg.to_collect(t.results.select(*RACE).distinct(), fresh(t), RACE)


@query("A11_complete_contests", "results",
       sql="""d AS (SELECT year, round, CASE WHEN round % 4 = 0 THEN NULL ELSE best_time_ms END AS a, finish_position AS b FROM results)
SELECT year, round FROM d GROUP BY 1, 2 HAVING count(a) > 0 AND count(b) > 0""")
def complete(t):
    d = t.results.select(*RACE, F.when(F.col("round") % 4 != 0, F.col("best_time_ms")).alias("a"), F.col("finish_position").alias("b"))
    return mg.complete_contests(d, ["a", "b"])


@query("A12_gaps", "results", "weather",
       sql="SELECT DISTINCT year, round FROM results WHERE (year, round) NOT IN (SELECT (year, round) FROM weather)")
def gaps(t):
    return mg.gaps(t.results, t.weather)


@query("A13_profile", "results", "weather",
       sql="""SELECT 'results' AS table_name, year, count(*) AS n_rows, list_sort(list(DISTINCT round)) AS rounds FROM results GROUP BY year
UNION ALL SELECT 'weather', year, count(*), list_sort(list(DISTINCT round)) FROM weather GROUP BY year""")
def profile(t):
    return mg.profile({"results": t.results, "weather": t.weather})


@query("A14_backfill", "results",
       sql="""d AS (SELECT year, round, entrant, TRY_CAST(CASE WHEN entrant % 10 = 0 THEN 'n/a' ELSE CAST(grid_position AS VARCHAR) END AS DOUBLE) AS g FROM results),
l AS (SELECT year, max(round) AS n FROM results GROUP BY year)
SELECT year, round, entrant, coalesce(g, (SELECT median(g) FROM d)) AS grid_position, round((round - 1) / greatest(n - 1, 1), 6) AS round_fraction,
  CAST(NULL AS DOUBLE) AS fp_longrun_gap_pct, 0.0::DOUBLE AS humidity_pct_mean FROM d JOIN l USING (year)""")
def backfill(t):
    g = F.when(F.col("entrant") % 10 == 0, F.lit("n/a")).otherwise(F.col("grid_position").cast("string"))
    old = t.results.select(*KEY, g.alias("grid_position"))
    cols = ["grid_position", "round_fraction", "fp_longrun_gap_pct", "humidity_pct_mean"]
    d, _ = mg.backfill(old, cols)
    return d.select(*KEY, "grid_position", F.round("round_fraction", 6).alias("round_fraction"), *cols[2:])


@query("A15_flatten_races", "results",
       sql="""SELECT year, round, entrant, team, grid_position, finish_position, dnf, CAST(points AS DOUBLE) AS points, coalesce((finish_position = 1)::INT, 0) AS p1,
  coalesce((finish_position = 2)::INT, 0) AS p2, coalesce((finish_position = 3)::INT, 0) AS p3, coalesce((finish_position <= 3)::INT, 0) AS podium FROM results""")
def flatten_races(t):
    return fl.race_rows(race_docs(t))


QTEXT = "printf('%d:%02d.%03d', best_time_ms // 60000, (best_time_ms % 60000) // 1000, best_time_ms % 1000)"


@query("A16_flatten_qualifying", "results",
       sql="""d AS (SELECT year, round, entrant, quali_position, CASE WHEN best_time_ms IS NULL THEN NULL WHEN quali_position <= 10 THEN best_time_ms - 300
  WHEN quali_position <= 15 THEN best_time_ms - 100 ELSE best_time_ms END / 1000.0 AS best_s FROM results)
SELECT year, round, entrant, quali_position, round(best_s, 6) AS best_s, round(best_s - min(best_s) OVER (PARTITION BY year, round), 6) AS gap_s FROM d""")
def flatten_quali(t):
    ms = F.col("best_time_ms")

    def text(x):
        m = F.floor(x / 60000).cast("string")
        s = F.lpad(F.floor((x % 60000) / 1000).cast("string"), 2, "0")
        return F.concat(m, F.lit(":"), s, F.lit("."), F.lpad((x % 1000).cast("string"), 3, "0"))

    pos = F.col("quali_position")
    item = F.struct("entrant", pos.alias("position"), text(ms).alias("q1"), F.when(pos <= 15, text(ms - 100)).alias("q2"),
                    F.when(pos <= 10, text(ms - 300)).alias("q3"))
    docs = fl.documents(t.results, RACE, ["entrant"], item, "results", t.hot_contest)
    d = fl.quali_rows(docs, t.hot_contest)
    return d.select(*KEY, "quali_position", F.round("best_s", 6).alias("best_s"), F.round("gap_s", 6).alias("gap_s"))


@query("A17_order_from_laps", "laps",
       sql="""b AS (SELECT round, entrant, min(lap_ms) FILTER (lap_ms < 91000) AS best FROM laps GROUP BY 1, 2)
SELECT round, entrant, round(best / 1000.0, 6) AS best_s, CAST(row_number() OVER (PARTITION BY round ORDER BY best NULLS LAST, entrant) AS INT) AS quali_position FROM b""")
def order_from_laps(t):
    lap = F.when(F.col("lap_ms") < 91000, F.col("lap_ms") / 1000.0)
    laps = t.laps.select("round", "entrant", lap.alias("lap_s"))
    d = fl.quali_from_laps(laps, t.laps.select("round", "entrant").distinct(), ["round"], t.hot_events)
    return d.select("round", "entrant", F.round("best_s", 6).alias("best_s"), "quali_position")


@query("A18_flatten_pit_stops",
       sql="""d AS (SELECT year(ts) AS year, day(ts) AS round, user_id AS entrant, value AS t FROM events)
SELECT CAST(year AS INT) AS year, CAST(round AS INT) AS round, entrant, round(median(t), 3) AS avg_pit_s, count(*) AS n_stops FROM d WHERE t BETWEEN 1.5 AND 120 GROUP BY 1, 2, 3""")
def flatten_pits(t):
    ev = t.read("events").select(F.year("ts").alias("year"), F.dayofmonth("ts").alias("round"), "event_id", "user_id", "value")
    item = F.struct(F.col("user_id").alias("entrant"), F.lit(1).alias("lap"), F.col("value").cast("string").alias("duration"))
    docs = fl.documents(ev, RACE, ["event_id"], item, "stops", t.hot_events)
    return fl.pit_rows(docs)


@query("A19_flatten_sprint", "results", sql=SPRINT + " SELECT year, round, entrant, sprint_position, n_starters FROM sp")
def flatten_sprint(t):
    return sprint_rows(t).drop("team")


@query("A20_day_weather",
       sql="""h AS (SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS round, value / 4 AS temperature, CASE WHEN event_type = 'error' THEN value / 400 ELSE 0 END AS precipitation FROM events)
SELECT year, month, round, round(avg(temperature), 6) AS temp_c_mean, round(max(temperature), 6) AS temp_c_max, round(sum(precipitation), 6) AS precip_mm_total,
  round(max(precipitation), 6) AS precip_mm_max_hourly, CASE WHEN sum(precipitation) >= 2 THEN 1 ELSE 0 END AS is_wet_race FROM h GROUP BY ALL""")
def day_weather(t):
    """Every day of the table is a contest's day; a collector fetches its hours and those of the next day."""
    e = t.read("events")
    hours = e.select("ts", F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), -1))).alias("day"), "value", "event_type")
    days = e.select(F.to_date("ts").alias("day")).distinct()
    h = hours.join(days, "day", "left_semi").select(
        F.year("day").alias("year"), F.month("day").alias("month"), F.dayofmonth("day").alias("round"), "ts", "day",
        (F.col("value") / 4).alias("temperature"), F.when(F.col("event_type") == "error", F.col("value") / 400).otherwise(0.0).alias("precipitation"),
    )
    keys = ["year", "month", "round"]
    d = fl.day_weather(h, keys, "ts", F.col("day"))
    nums = ["temp_c_mean", "temp_c_max", "precip_mm_total", "precip_mm_max_hourly"]
    return d.select(*keys, *[F.round(c, 6).alias(c) for c in nums], "is_wet_race")


@query("A21_parallel_arrays",
       sql="""SELECT vec_id, label, i AS hour, round(CAST(embedding[i + 1] AS DOUBLE), 5) AS temperature, round(CAST(embedding[i + 2] AS DOUBLE), 5) AS wind
FROM (SELECT *, unnest(range(0, len(embedding) - 1)) AS i FROM embeddings WHERE vec_id % 6 <> 0)""")
def parallel(t):
    e = t.read("embeddings")
    dead = F.col("vec_id") % 6 == 0
    n = F.size("embedding") - 1
    wide = e.select(
        "vec_id", "label",
        F.sequence(F.lit(0), n - 1).cast("array<bigint>").alias("hour"),
        F.slice("embedding", F.lit(1), n).alias("temperature_previous_day1"),
        F.when(dead, F.array_repeat(F.lit(None).cast("float"), n)).otherwise(F.slice("embedding", F.lit(2), n)).alias("wind_previous_day1"),
    )
    d = fl.parallel_rows(wide, ["hour", "temperature_previous_day1", "wind_previous_day1"])
    return d.select("vec_id", "label", "hour", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("temperature", "wind")])


@query("A22_mean_odds",
       sql="""SELECT o_orderkey AS id, 'brand' || (l_partkey % 20) AS name, round(avg(l_quantity), 3) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2""")
def mean_odds(t):
    li = t.read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    outcome = F.struct(F.concat(F.lit("brand"), (F.col("l_partkey") % 20).cast("string")).alias("name"), F.col("l_quantity").alias("price"))
    market = F.when(F.col("l_linenumber") % 3 == 0, "spread").otherwise("h2h")
    m = li.groupBy("l_orderkey", market.alias("key")).agg(F.collect_list(outcome).alias("outcomes"))  # lines of one order
    b = m.groupBy("l_orderkey").agg(F.collect_list(F.struct("key", "outcomes")).alias("markets"))
    doc = F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.array(F.struct(F.lit("book").alias("key"), F.col("markets"))).alias("bookmakers")))
    return fl.mean_prices(b.select(doc.alias("doc")))


@query("A23_calendar_sessions", "results",
       sql="""c AS (SELECT DISTINCT year, round, make_timestamp(year, round, 20, 14, 0, 0) AS race FROM results),
l AS (SELECT year, round, 'Practice 1' AS session, race - INTERVAL 50 HOUR AS ts FROM c UNION ALL SELECT year, round, CASE WHEN round % 3 = 0 THEN 'Sprint' ELSE 'Practice 2' END, race - INTERVAL 46 HOUR FROM c
 UNION ALL SELECT year, round, 'Qualifying', race - INTERVAL 24 HOUR FROM c WHERE round % 5 <> 0 UNION ALL SELECT year, round, 'Race', race FROM c)
SELECT year, round, session, ts FROM l WHERE round % 5 <> 0""")
def calendar(t):
    race = F.make_timestamp_ntz(F.col("year"), F.col("round"), F.lit(20), F.lit(14), F.lit(0), F.lit(0))
    c = t.results.select(*RACE).distinct().withColumn("race", race)
    at = lambda h: F.col("race") - F.expr(f"INTERVAL {h} HOURS")
    wide = c.select(
        *RACE, F.lit("Practice 1").alias("session1"), at(50).alias("session1_utc"),
        F.when(F.col("round") % 3 == 0, "Sprint").otherwise("Practice 2").alias("session2"), at(46).alias("session2_utc"),
        F.lit(None).cast("string").alias("session3"), at(30).alias("session3_utc"),
        F.lit("Qualifying").alias("session4"), F.when(F.col("round") % 5 != 0, at(24)).alias("session4_utc"),
        F.lit("Race").alias("session5"), F.col("race").alias("session5_utc"),
    )
    return fl.calendar_sessions(wide)


@query("A24_append_missing", "results",
       sql="SELECT year, round, entrant, CASE WHEN year < 2000 THEN points ELSE points + 1 END AS points FROM results")
def append_missing(t):
    d = t.results.select(*KEY, "points")
    return mg.append_missing(d.where("year < 2000"), d.withColumn("points", F.col("points") + 1))


FUTURE = """lst AS (SELECT year, round FROM results ORDER BY year DESC, round DESC LIMIT 1),
rm AS (SELECT DISTINCT (SELECT max(year) + 1 FROM results) AS year, round, venue FROM results WHERE round > 9),
fu AS (SELECT rm.year, rm.round, rm.venue, entrant, team FROM results JOIN lst USING (year, round), rm)"""


def remaining(t):
    r = t.results
    newest = r.agg((F.max("year") + 1).alias("year"))
    return r.where("round > 9").select("round", "venue").distinct().crossJoin(F.broadcast(newest))


@query("A25_future_rows", "results",
       sql=FUTURE + """ SELECT year, round, venue, entrant, team, CAST(NULL AS INT) AS finish_position, CAST(NULL AS INT) AS points FROM fu""")
def future(t):
    return future_rows(t.results, remaining(t), ["finish_position", "points"])


@query("A26_relabel_dnf", "results",
       sql="SELECT year, round, entrant, CASE WHEN status = 'Engine' THEN 1 ELSE 0 END AS dnf FROM results")
def relabel(t):
    return mg.relabel_dnf(t.results.withColumn("dnf", F.lit(0))).select(*KEY, "dnf")


@query("A19_field_size", "results", sql="SELECT year, round, entrant, count(*) OVER (PARTITION BY year, round) AS n_starters FROM results")
def field_size(t):
    return fl.with_field_size(t.results, RACE, "n_starters", t.hot_contest).select(*KEY, "n_starters")


@query("A16_last_segment", "laps",
       sql="""SELECT round, entrant, arg_max(lap_ms, lap_number) FILTER (lap_ms IS NOT NULL) AS last_ms FROM laps GROUP BY 1, 2""")
def last_segment(t):
    known = F.when(F.col("lap_ms").isNotNull(), F.col("lap_number"))
    return t.laps.groupBy("round", "entrant").agg(F.max_by("lap_ms", known).alias("last_ms"))


def _scratch(t, name):
    """A folder of the session's own in the shared one, deleted when the application ends."""
    import uuid

    from fieldorder.operators.grouping import checkpoint_folder

    path = f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    where = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(t.spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@query("A02_whole_write", "results",
       sql="SELECT year, round, entrant, CASE WHEN entrant % 2 = 0 THEN points * 2 ELSE points END AS points, dnf FROM results")
def whole_write(t):
    """Written, then replaced by a table made from itself, then read."""
    path = _scratch(t, "results")
    mg.swap_table(t.results.select(*KEY, "points", "dnf"), path)
    stored = t.spark.read.parquet(path)
    mg.swap_table(stored.withColumn("points", F.when(F.col("entrant") % 2 == 0, F.col("points") * 2).otherwise(F.col("points"))), path)
    return t.spark.read.parquet(path)


@query("A05_append_once", "quotes", sql="SELECT event_id, ts, ticker, market, bid_millis, ask_millis, last_millis, CAST(event_id % 3 AS INT) AS batch FROM quotes")
def append_once(t):
    """Snapshots appended in three batches, one of them delivered twice."""
    path = _scratch(t, "snapshots")
    for batch in (0, 1, 1, 2):
        mg.append_once(t.quotes.where(F.col("event_id") % 3 == batch), path, batch)
    return t.spark.read.parquet(path)
