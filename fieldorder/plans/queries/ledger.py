"""Event log, snapshots, ledger and text mentions (J, K)."""

from pyspark.sql import functions as F

from fieldorder.operators import ledger as lg
from fieldorder.operators import market as mk
from fieldorder.operators import mentions as mt
from fieldorder.plans.queries.history import KEY
from fieldorder.plans.queries.joins import SETTLED
from fieldorder.plans.registry import query

RACE = ["year", "round"]


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@query("J01_price_before_start", "quotes",
       sql="""p AS (SELECT ticker, market, ts, event_id, CASE WHEN bid_millis >= 0 AND ask_millis - bid_millis > 0 AND (ask_millis - bid_millis) * 0.001::DOUBLE <= 0.15 THEN (bid_millis + ask_millis) / 2.0 * 0.001
  WHEN last_millis > 0 THEN last_millis * 0.001::DOUBLE END AS price FROM quotes WHERE ts >= TIMESTAMP '2024-01-10 14:00:00' AND ts < TIMESTAMP '2024-01-21 15:00:00')
SELECT ticker, market, count(*) AS n_snapshots, round(arg_max(price, (ts, event_id)) FILTER (price IS NOT NULL), 6) AS price_start FROM p GROUP BY 1, 2""")
def price_before(t):
    price = mk.quote_price(F.col("bid_millis"), F.col("ask_millis"), F.col("last_millis"), 0.001)
    d = t.quotes.withColumn("price", price)
    g = lg.last_price_before(d, ["ticker", "market"], "ts", "event_id", stamp("2024-01-21 15:00:00"), stamp("2024-01-10 14:00:00"), "price")
    return g.select("ticker", "market", "n_snapshots", F.round("price_start", 6).alias("price_start"))


@query("J02_source_timeline", "oplog",
       sql="""p AS (SELECT *, lag(n) OVER w AS prev, row_number() OVER w AS i FROM oplog WHERE is_error = 0 WINDOW w AS (PARTITION BY source, item ORDER BY ts, event_id))
SELECT source, item, event_id, n, CASE WHEN i = 1 THEN 'first' ELSE 'changed' END AS change FROM p WHERE i = 1 OR n IS DISTINCT FROM prev""")
def timeline(t):
    d = lg.source_timeline(t.oplog, ["source", "item"], ["ts", "event_id"], "n", F.col("is_error") == 1, t.hot_events)
    return d.select("source", "item", "event_id", "n", "change")


@query("J03_tick_table", "oplog",
       sql="""SELECT run_id, count(*) FILTER (kind = 'tick_start') AS starts, count(*) FILTER (kind = 'tick_end') AS ends,
  round(date_diff('microsecond', min(ts) FILTER (kind = 'tick_start'), max(ts) FILTER (kind = 'tick_end')) / 1e6, 3) AS span_s FROM oplog WHERE kind <> 'probe' GROUP BY 1""")
def ticks(t):
    d = lg.tick_table(t.oplog, "run_id", "ts")
    us = F.timestamp_diff("MICROSECOND", F.col("first_start"), F.col("last_end"))
    return d.select("run_id", "starts", "ends", F.round(us / 1e6, 3).alias("span_s"))


@query("J03_delay_summary", "oplog",
       sql="""d AS (SELECT round, event_id, minute(ts) AS delay, row_number() OVER (PARTITION BY round ORDER BY minute(ts), event_id) AS i, count(*) OVER (PARTITION BY round) AS n FROM oplog WHERE kind = 'tick_start')
SELECT round, CAST(min(delay) AS INT) AS low, CAST(max(delay) FILTER (i = n // 2 + 1) AS INT) AS middle, CAST(max(delay) AS INT) AS high, count(*) AS n FROM d GROUP BY 1""")
def delays(t):
    d = t.oplog.where(F.col("kind") == "tick_start").withColumn("delay", F.minute("ts"))
    return lg.delay_summary(d, ["round"], "delay", t.hot_events)


@query("J04_runs_touching", "oplog",
       sql="SELECT event_id, run_id, kind FROM oplog WHERE run_id IN (SELECT run_id FROM oplog WHERE round = 5 AND source = 'src_a' AND item = 2)")
def touching(t):
    c = (F.col("round") == 5) & (F.col("source") == "src_a") & (F.col("item") == 2)
    return lg.touching(t.oplog, "run_id", c).select("event_id", "run_id", "kind")


@query("J05_latest_event", "oplog",
       sql="SELECT kind, round, event_id, n FROM oplog QUALIFY row_number() OVER (PARTITION BY kind, round ORDER BY ts DESC, event_id DESC) = 1")
def latest(t):
    return lg.latest_event(t.oplog, ["kind", "round"], ["ts", "event_id"], ["event_id", "n"])


@query("J06_output_tail",
       sql=r"""l AS (SELECT doc_id, i, rtrim(regexp_replace(lines[i], chr(27) || '\[[0-9;]*m', '', 'g'), ' ') AS line FROM
  (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS k FROM l WHERE line <> '' AND NOT contains(line, '| DEBUG'))
SELECT doc_id, CAST(i AS INT) AS line_no, md5(substr(line, 1, 300)) AS line_hash FROM k WHERE k <= 25""")
def tail(t):
    d = t.read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    d = lg.output_tail(d.withColumn("line_no", F.col("p") + 1).drop("p"), ["doc_id"], "line_no", "line", hot=False)  # lines of one text row
    return d.select("doc_id", "line_no", F.md5("line").alias("line_hash"))


@query("J07_hourly_limit",
       sql="""r AS (SELECT event_id, event_type, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) - 1 AS earlier FROM events)
SELECT event_id, hour, CAST(earlier AS INT) AS earlier, earlier < 2 AS allowed FROM r""")
def hourly(t):
    d = lg.rate_limited(t.read("events").select("event_id", "event_type", "ts"), ["event_type"], "ts", "event_id", 2, t.hot_events)
    return d.select("event_id", "hour", "earlier", "allowed")


@query("J08_first_tickets", "tickets",
       sql="""SELECT year, round, bettor, ticket_id FROM tickets WHERE CASE WHEN negate THEN 100 - p_pct ELSE p_pct END <= 35 QUALIFY row_number() OVER (PARTITION BY year, round, bettor ORDER BY ts, ticket_id) = 1""")
def first_tickets(t):
    p = F.when(F.col("negate"), 100 - F.col("p_pct")).otherwise(F.col("p_pct"))
    return lg.first_tickets(t.tickets, p <= 35, [*RACE, "bettor"], "ts", "ticket_id").select(*RACE, "bettor", "ticket_id")


@query("J09_ticket_sequence", "tickets",
       sql="SELECT ticket_id, year, round, CAST(row_number() OVER (PARTITION BY year, round ORDER BY ts, ticket_id) AS INT) AS seq FROM tickets")
def sequence(t):
    return lg.with_sequence(t.tickets, RACE, "ts", "ticket_id", t.hot_events).select("ticket_id", *RACE, "seq")


@query("J10_betting_window", "results", "tickets",
       sql="""c AS (SELECT DISTINCT year, round, make_timestamp(2024, 1, 4 + round * 2, 13, 0, 0) AS start FROM results WHERE round <> 6)
SELECT ticket_id, coalesce(ts < start, false) AS open FROM tickets LEFT JOIN c USING (year, round)""")
def window(t):
    start = F.make_timestamp_ntz(F.lit(2024), F.lit(1), 4 + F.col("round") * 2, F.lit(13), F.lit(0), F.lit(0))
    c = t.results.where("round <> 6").select(*RACE).distinct().withColumn("start", start)
    d = t.tickets.join(c, RACE, "left")
    return d.select("ticket_id", F.coalesce(F.col("ts") < F.col("start"), F.lit(False)).alias("open"))


@query("J11_settlement", "results", "tickets",
       sql=SETTLED + """ SELECT bettor, count(*) FILTER (status = 'won') AS won, count(*) FILTER (status = 'lost') AS lost, count(*) FILTER (status = 'void') AS void,
  count(*) FILTER (status = 'won') - count(*) FILTER (status = 'lost') AS net FROM sl GROUP BY 1""")
def settlement(t):
    s = lg.settle(t.tickets.withColumn("status", F.lit("open")), t.results)
    return lg.ledger_totals(s, ["bettor"])


CAL = """ca AS (SELECT DISTINCT year, round, make_timestamp(year, round, 20, 14, 0, 0) AS race, make_timestamp(year, round, 19, 13, 0, 0) AS quali, round < 9 AS has_result, (year + round) % 2 = 0 AS has_prediction FROM results)"""


def calendar(t):
    at = lambda d, h: F.make_timestamp_ntz(F.col("year"), F.col("round"), F.lit(d), F.lit(h), F.lit(0), F.lit(0))
    return t.results.select(*RACE).distinct().select(
        *RACE, at(20, 14).alias("race"), at(19, 13).alias("quali"), (F.col("round") < 9).alias("has_result"),
        ((F.col("year") + F.col("round")) % 2 == 0).alias("has_prediction"),
    )


@query("J12_due_work", "results",
       sql=CAL + """, n AS (SELECT *, make_timestamp(year, 10, 20, 12, 30, 0) AS now, min(CASE WHEN make_timestamp(year, 10, 20, 12, 30, 0) < race THEN race END) OVER (PARTITION BY year) AS fu FROM ca)
SELECT year, round, now >= race + INTERVAL 4 HOUR AND NOT has_result AS ingest, CASE WHEN NOT (now < race AND race = fu) THEN 'no' WHEN has_prediction THEN 'regrid' WHEN now >= quali + INTERVAL 105 MINUTE THEN 'predict' ELSE 'wait' END AS predict,
  now >= quali AND now < race AS market FROM n""")
def due(t):
    now = F.make_timestamp_ntz(F.col("year"), F.lit(10), F.lit(20), F.lit(12), F.lit(30), F.lit(0))
    return lg.due_work(calendar(t), now).select(*RACE, "ingest", "predict", "market")


@query("J13_probe_window", "results",
       sql=CAL + """ SELECT year, round, make_timestamp(year, 10, 18, 0, 0, 0) BETWEEN race - INTERVAL 3 DAY AND race + INTERVAL 2 DAY AS probe FROM ca""")
def probe(t):
    now = F.make_timestamp_ntz(F.col("year"), F.lit(10), F.lit(18), F.lit(0), F.lit(0), F.lit(0))
    return lg.due_work(calendar(t), now).select(*RACE, "probe")


@query("J14_podium_record", "results",
       sql="""SELECT year, round, list(entrant ORDER BY quali_position) FILTER (quali_position <= 3) AS predicted, list(entrant ORDER BY finish_position) FILTER (finish_position <= 3) AS actual,
  year % 2 = 0 AS replay, CAST(count(*) FILTER (quali_position <= 3 AND finish_position <= 3) AS INT) AS overlap FROM results GROUP BY 1, 2""")
def record(t):
    return lg.podium_record(t.results, "quali_position", F.col("year") % 2 == 0)


@query("J14_record_summary", "results",
       sql="""r AS (SELECT year, round, year % 2 = 0 AS replay, count(*) FILTER (quali_position <= 3 AND finish_position <= 3) AS o, count(*) FILTER (quali_position = 1 AND finish_position = 1) AS w FROM results GROUP BY 1, 2)
SELECT count(*) AS contests, count(*) FILTER (NOT replay) AS live, round(avg(o), 6) AS mean_overlap, CAST(sum(w) AS BIGINT) AS winner_hits FROM r""")
def record_summary(t):
    d = lg.record_summary(lg.podium_record(t.results, "quali_position", F.col("year") % 2 == 0))
    return d.withColumn("mean_overlap", F.round("mean_overlap", 6))


@query("J15_next_and_last", "results",
       sql="""c AS (SELECT DISTINCT year, round FROM results), r AS (SELECT * FROM c WHERE year < 2000 OR (year = 2000 AND round < 8)), p AS (SELECT * FROM c WHERE year < 2000 OR (year = 2000 AND round < 9)),
l AS (SELECT year, round FROM r ORDER BY year DESC, round DESC LIMIT 1), n AS (SELECT year, round FROM p WHERE (year, round) NOT IN (SELECT (year, round) FROM r) ORDER BY year DESC, round DESC LIMIT 1)
SELECT n.year AS next_year, n.round AS next_round, l.year AS last_year, l.round AS last_round FROM n, l""")
def next_last(t):
    c = t.results.select(*RACE).distinct()
    return lg.next_and_last(c, c.where("year < 2000 or (year = 2000 and round < 9)"), c.where("year < 2000 or (year = 2000 and round < 8)"))


ALIASES = {"one": ["whou", "chtz"], "two": ["getz"], "three": ["tion", "zzzz"]}
ALIAS_SQL = "(VALUES ('one', 'whou'), ('one', 'chtz'), ('two', 'getz'), ('three', 'tion'), ('three', 'zzzz')) a(entity, alias)"
#: Texts: documents as posts, turns of the conversation with the same number as comments.
TEXTS = f"""tx AS (SELECT doc_id, -1 AS turn, text, n_chars % 200 AS score, false AS is_comment FROM documents UNION ALL
  SELECT conv_id, turn, c.text, n_chars % 200, true FROM conversations c JOIN documents ON conv_id = doc_id),
mn AS (SELECT DISTINCT doc_id, turn, score, is_comment, entity FROM tx JOIN {ALIAS_SQL} ON contains(lower(text), alias))"""


def texts(t):
    posts = t.read("documents").select("doc_id", "text", (F.col("n_chars") % 200).alias("score"))
    comments = t.read("conversations").select(F.col("conv_id").alias("doc_id"), "text").join(posts.select("doc_id", "score"), "doc_id")
    return posts.withColumn("is_comment", F.lit(False)).unionByName(comments.withColumn("is_comment", F.lit(True)))


@query("K01_mentions", sql=TEXTS + " SELECT entity, is_comment, count(*) AS n, count(DISTINCT doc_id) AS n_posts FROM mn GROUP BY 1, 2")
def mentions(t):
    d = mt.mentions(texts(t), F.col("text"), ALIASES).drop("text")
    return d.groupBy("entity", "is_comment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_posts"))


@query("K02_weighted_score",
       sql=TEXTS + """, w AS (SELECT entity, quality AS q, ln(1 + greatest(score, 1)) * CASE WHEN is_comment THEN 0.5 ELSE 1 END AS w FROM mn LEFT JOIN labels USING (doc_id))
SELECT entity, round(sum(q * w) / nullif(sum(CASE WHEN q IS NOT NULL THEN w END), 0), 6) AS score, count(*) AS mention_count FROM w GROUP BY 1""")
def weighted(t):
    d = mt.mentions(texts(t), F.col("text"), ALIASES).drop("text")
    d = d.join(t.read("labels"), "doc_id", "left")
    g = mt.weighted_score(d, ["entity"], F.col("quality"), mt.post_weight(F.col("score"), F.col("is_comment")))
    return g.withColumn("score", F.round("score", 6))


@query("K03_window_posts",
       sql="""c AS (SELECT CAST(day(ts) // 5 AS INT) AS round, max(ts) AS start FROM events WHERE day(ts) % 5 = 0 GROUP BY day(ts)),
p AS (SELECT event_id, user_id % 4 AS source, ts, event_id % 200 AS score FROM events WHERE event_id % 200 >= 10)
SELECT round, source, event_id, score FROM p JOIN c ON ts >= start - INTERVAL 7 DAY AND ts <= start QUALIFY row_number() OVER (PARTITION BY round, source ORDER BY score DESC, event_id) <= 100""")
def window_posts(t):
    e = t.read("events")
    day = F.dayofmonth("ts")
    c = e.where(day % 5 == 0).groupBy((day / 5).cast("int").alias("round")).agg(F.max("ts").alias("start"))
    p = e.select("event_id", (F.col("user_id") % 4).alias("source"), "ts", (F.col("event_id") % 200).alias("score"))
    d = mt.window_posts(p, c, "ts", "start", "source", "score", "event_id", hot=t.hot_events)
    return d.select("round", "source", "event_id", "score")


@query("K03_top_comments",
       sql="SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) <= 10")
def top_comments(t):
    return mt.top_comments(t.read("conversations"), "conv_id", [F.length("text").desc(), F.col("turn")], 10, None).select("conv_id", "turn")


@query("K04_attach_scores", "results",
       sql="""s AS (SELECT DISTINCT year, round, 'driver' AS entity_type, CAST(entrant AS VARCHAR) AS entity, entrant % 7 / 10.0 AS score FROM results WHERE entrant % 3 = 0
  UNION ALL SELECT DISTINCT year, round, 'team', team, length(team) / 20.0 FROM results WHERE round % 2 = 0)
SELECT r.year, r.round, r.entrant, round(coalesce(d.score, 0), 6) AS driver_sentiment_7d, round(coalesce(m.score, 0), 6) AS team_sentiment_7d FROM results r
LEFT JOIN s d ON d.entity_type = 'driver' AND d.year = r.year AND d.round = r.round AND d.entity = CAST(r.entrant AS VARCHAR)
LEFT JOIN s m ON m.entity_type = 'team' AND m.year = r.year AND m.round = r.round AND m.entity = r.team""")
def attach(t):
    r = t.results
    a = r.where("entrant % 3 = 0").select(*RACE, F.lit("driver").alias("entity_type"), F.col("entrant").cast("string").alias("entity"), (F.col("entrant") % 7 / 10.0).alias("score"))
    b = r.where("round % 2 = 0").select(*RACE, F.lit("team").alias("entity_type"), F.col("team").alias("entity"), (F.length("team") / 20.0).alias("score")).distinct()
    d = mt.attach_scores(r, a.unionByName(b), RACE)
    return d.select(*KEY, *[F.round(c, 6).alias(c) for c in ("driver_sentiment_7d", "team_sentiment_7d")])
