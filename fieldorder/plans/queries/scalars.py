"""Scalar functions (B)."""

from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.functions import lookups as lk
from fieldorder.functions import scalars as fn
from fieldorder.operators import features as ft
from fieldorder.operators import market as mk
from fieldorder.operators import scoring as sc
from fieldorder.operators.grouping import with_totals
from fieldorder.plans import models as md
from fieldorder.plans.queries.history import GRID_BIN, KEY, rounded, sizes
from fieldorder.plans.registry import query
from fieldorder.plans.venues import VENUE_SQL, venue_name

RACE = ["year", "round"]


@query("B01_is_dnf", "results",
       sql="""SELECT year, round, entrant, CASE WHEN status IN ('Finished', 'Lapped') OR status LIKE '+%' OR trim(status) = '' THEN 0 ELSE 1 END AS is_dnf FROM results""")
def is_dnf(t):
    return t.results.select(*KEY, fn.is_dnf(F.col("status")).alias("is_dnf"))


#: Durations written as text: m:ss.s, plain seconds, junk, empty.
DURATION = """CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat(CAST(1 + event_id % 2 AS VARCHAR), ':', lpad(CAST(event_id % 60 AS VARCHAR), 2, '0'), '.', CAST(event_id % 10 AS VARCHAR))
  WHEN 1 THEN concat(CAST(60 + event_id % 40 AS VARCHAR), '.5') WHEN 2 THEN event_type ELSE NULL END"""


@query("B02_duration", sql=f"""d AS (SELECT event_id, {DURATION} AS text FROM events)
SELECT event_id, text, round(CASE WHEN contains(text, ':') THEN TRY_CAST(split_part(text, ':', 1) AS DOUBLE) * 60 + TRY_CAST(split_part(text, ':', 2) AS DOUBLE)
  ELSE TRY_CAST(text AS DOUBLE) END, 6) AS seconds FROM d""")
def duration(t):
    e = F.col("event_id")
    s = lambda x: x.cast("string")
    text = (
        F.when(e % 4 == 0, F.concat(s(1 + e % 2), F.lit(":"), F.lpad(s(e % 60), 2, "0"), F.lit("."), s(e % 10)))
        .when(e % 4 == 1, F.concat(s(60 + e % 40), F.lit(".5")))
        .when(e % 4 == 2, F.col("event_type"))
    )
    d = t.read("events").select("event_id", text.alias("text"))
    return d.select("event_id", "text", F.round(fn.duration_seconds(F.col("text")), 6).alias("seconds"))


@query("B03_venue_key",
       sql=r"""SELECT doc_id, md5(replace(regexp_replace(trim(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7f]', '', 'g'), ' '), '[- ]', '_', 'g'), 'grand_prix', 'gp')) AS key_hash FROM documents""")
def venue_key(t):
    return t.read("documents").select("doc_id", F.md5(fn.venue_key(F.col("text"))).alias("key_hash"))


@query("B03_person_key",
       sql=r"""SELECT doc_id, md5(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7f]', '', 'g'), '[-.\s]+', ' ', 'g'), ' '), ' '),
  lambda w: w NOT IN ('jr', 'sr')), ' ')) AS key_hash FROM documents""")
def person_key(t):
    return t.read("documents").select("doc_id", F.md5(fn.person_key(F.col("text"))).alias("key_hash"))


@query("B03_first_name_key",
       sql=r"""SELECT conv_id, turn, md5(regexp_replace(strip_accents(replace(replace(replace(replace(replace(lower(text), 'ł', 'l'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')), '[^a-z]', '', 'g')) AS key_hash FROM conversations""")
def first_name_key(t):
    return t.read("conversations").select("conv_id", "turn", F.md5(fn.first_name_key(F.col("text"))).alias("key_hash"))


@query("B04_alnum_key",
       sql="SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part")
def alnum_key(t):
    name = F.concat(F.col("p_name"), F.lit(" / "), F.col("p_type"))
    return t.read("part").select("p_partkey", fn.team_key(name).alias("key"))


def values_sql(m: dict) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in m.items()) + ")"


LOCATIONS = ["Monte-Carlo", "São Paulo", "Spa Francorchamps", "Nowhere", "Yas Marina", "Mexico City"]
EVENTS = ["Spanish Grand Prix", "70th Anniversary Grand Prix", "Emilia Romagna GP", "Lunar Grand Prix", "monza", "Sakhir gp", "British Grand Prix"]


def sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def pick(xs, at):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), at.cast("int"))


NORM = "replace(regexp_replace(strip_accents(lower({0})), '[- ]', '_', 'g'), 'grand_prix', 'gp')"


@query("B05_canonical_venue", "results",
       sql=f"""loc AS (SELECT * FROM {values_sql(fv.VENUE_BY_LOCATION)} v(k, v)), ev AS (SELECT * FROM {values_sql(fv.VENUE_BY_EVENT)} v(k, v)),
d AS (SELECT year + 28 AS year, round, entrant, {NORM.format(f"CASE WHEN entrant % 3 = 0 THEN list_extract({sql_list(LOCATIONS)}, 1 + entrant % 6) END")} AS l,
  {NORM.format(f"CASE WHEN entrant % 8 <> 7 THEN list_extract({sql_list(EVENTS)}, 1 + (entrant + round) % 7) END")} AS e FROM results)
SELECT year, round, entrant, coalesce(a.v, CASE WHEN e = 'spanish_gp' AND year >= 2026 THEN 'madrid' END, b.v, c.v, e, 'unknown') AS venue_key
FROM d LEFT JOIN loc a ON d.l = a.k LEFT JOIN ev b ON d.e = b.k LEFT JOIN loc c ON d.e = c.k""")
def canonical_venue(t):
    n = F.col("entrant")
    loc = F.when(n % 3 == 0, pick(LOCATIONS, 1 + n % 6))
    ev = F.when(n % 8 != 7, pick(EVENTS, 1 + (n + F.col("round")) % 7))
    year = F.col("year") + 28
    return t.results.select(year.alias("year"), "round", "entrant", fn.canonical_venue(ev, loc, year).alias("venue_key"))


TEAMS = ["Scuderia Ferrari", "RB F1 Team", "  Privateer ", "BWT Racing-Point", "Kick Sauber", "Lotus F1"]


@query("B06_canonical_team",
       sql=f"""al AS (SELECT * FROM {values_sql({a: k for k, v in fv.TEAM_LINEAGE.items() for a in v})} v(k, v)),
d AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 6 THEN list_extract({sql_list(TEAMS)}, 1 + s_suppkey % 6) END AS n FROM supplier)
SELECT s_suppkey, CASE WHEN n IS NULL THEN 'Unknown' ELSE coalesce(v, trim(n)) END AS team FROM d
LEFT JOIN al ON trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') = k""")
def canonical_team(t):
    k = F.col("s_suppkey")
    name = F.when(k % 7 != 6, pick(TEAMS, 1 + k % 6))
    return t.read("supplier").select("s_suppkey", fn.canonical_team(name).alias("team"))


CODES = {"carla soto": "SOT", "soto": "SOT", "jan maly": "MAL", "maly": "MAL", "ana rey": "REY", "rey": "REY"}
PEOPLE = ["Carla Soto Jr.", "Jan-Malý", "A. Rey", "Unknown Person", "Soto"]


@query("B07_name_code",
       sql=f"""c AS (SELECT * FROM {values_sql(CODES)} v(k, v)), d AS (SELECT c_custkey,
  array_to_string(list_filter(string_split(trim(regexp_replace(strip_accents(lower(list_extract({sql_list(PEOPLE)}, 1 + c_custkey % 5))), '[-.\\s]+', ' ', 'g')), ' '), lambda w: w NOT IN ('jr', 'sr')), ' ') AS n FROM customer)
SELECT c_custkey, coalesce(a.v, b.v) AS code FROM d LEFT JOIN c a ON n = a.k LEFT JOIN c b ON string_split(n, ' ')[-1] = b.k""")
def name_code(t):
    return t.read("customer").select("c_custkey", fn.code_of(pick(PEOPLE, 1 + F.col("c_custkey") % 5), CODES).alias("code"))


@query("B10_quote_price", "quotes",
       sql="""SELECT event_id, round(CASE WHEN bid_millis >= 0 AND ask_millis - bid_millis > 0 AND (ask_millis - bid_millis) * 0.001::DOUBLE <= 0.15 THEN (bid_millis + ask_millis) / 2.0 * 0.001
  WHEN last_millis > 0 THEN last_millis * 0.001::DOUBLE END, 6) AS price FROM quotes""")
def quote_price(t):
    p = mk.quote_price(F.col("bid_millis"), F.col("ask_millis"), F.col("last_millis"), 0.001)
    return t.quotes.select("event_id", F.round(p, 6).alias("price"))


@query("B11_grid_bin", "results", sql=f"SELECT year, round, entrant, {GRID_BIN} AS bin FROM results")
def grid_bin(t):
    return t.results.select(*KEY, lk.grid_bin(F.col("grid_position")).alias("bin"))


@query("B12_pit_lane_to_back", "results",
       sql="""SELECT year, round, entrant, CASE WHEN grid_position = 0 THEN max(CASE WHEN grid_position > 0 THEN grid_position END) OVER (PARTITION BY year, round) + 1
  ELSE grid_position END AS grid_position FROM results""")
def pit_lane(t):
    return ft.pit_lane_to_back(t.results, sizes(t)).select(*KEY, "grid_position")


@query("B13_grid_score", "results",
       sql="""SELECT year, round, entrant, CAST(CASE WHEN grid_position > 0 THEN grid_position ELSE coalesce(max(CASE WHEN grid_position > 0 THEN grid_position END) OVER (PARTITION BY year, round) + 1,
  count(*) OVER (PARTITION BY year, round)) END AS BIGINT) AS score FROM results""")
def grid_score(t):
    return sc.grid_score(t.results, "grid_position", "score", t.hot_contest).select(*KEY, "score")


@query("B14_target_position", "results",
       sql="SELECT year, round, entrant, CAST(coalesce(finish_position, count(*) OVER (PARTITION BY year, round) + 1) AS DOUBLE) AS target_position FROM results")
def target(t):
    return md.target_position(t.results, t.hot_contest).select(*KEY, "target_position")


@query("B15_relevance_label", "results",
       sql="""SELECT year, round, entrant, greatest(count(*) OVER (PARTITION BY year, round) + 1 - coalesce(finish_position, count(*) OVER (PARTITION BY year, round) + 1), 0) AS relevance FROM results""")
def relevance(t):
    d = with_totals(t.results, RACE, {"n": F.count(F.lit(1))}, t.hot_contest)
    place = F.coalesce(F.col("finish_position"), F.col("n") + 1)
    return d.select(*KEY, F.greatest(F.col("n") + 1 - place, F.lit(0)).alias("relevance"))


@query("B16_street_and_rate", "results",
       sql=f"""SELECT year, round, entrant, CASE WHEN {VENUE_SQL} IN ('monaco', 'singapore') THEN 1.0::DOUBLE ELSE 0.0 END AS is_street_circuit,
  CAST(CASE {VENUE_SQL} WHEN 'monza' THEN 0.10 WHEN 'monaco' THEN 0.30 WHEN 'silverstone' THEN 0.13 WHEN 'bahrain' THEN 0.11 WHEN 'spa' THEN 0.15 WHEN 'singapore' THEN 0.26 ELSE 0.12 END AS DOUBLE)
  AS circuit_safety_car_rate FROM results""")
def street(t):
    v = venue_name(F.col("venue"))
    return t.results.select(*KEY, lk.is_street(v).alias("is_street_circuit"), lk.safety_car_rate(v).alias("circuit_safety_car_rate"))


@query("B17_venue_type", "results",
       sql=f"""SELECT DISTINCT venue, CASE {VENUE_SQL} WHEN 'monza' THEN 'power' WHEN 'spa' THEN 'power' WHEN 'monaco' THEN 'high_downforce' WHEN 'singapore' THEN 'high_downforce'
  WHEN 'silverstone' THEN 'fast_flowing' ELSE 'traction' END AS kind FROM results""")
def venue_type(t):
    return t.results.select("venue").distinct().select("venue", lk.venue_type(venue_name(F.col("venue"))).alias("kind"))


@query("B18_clip",
       sql="""q AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN v IS NOT NULL THEN round(least(v, 5.0), 6) END AS up, CASE WHEN v IS NOT NULL THEN round(greatest(least(v - 20, 5.0), -5.0), 6) END AS both_sides FROM q""")
def clip(t):
    v = F.when(F.col("event_id") % 6 != 0, F.col("value"))
    return t.read("events").select(
        "event_id", F.round(ft.clip(v, high=5.0), 6).alias("up"), F.round(ft.clip(v - 20, -5.0, 5.0), 6).alias("both_sides")
    )


@query("B19_points_tables", "results",
       sql="""SELECT year, round, entrant, coalesce(list_extract([25, 18, 15, 12, 10, 8, 6, 4, 2, 1], finish_position), 0) AS race_points,
  coalesce(CASE WHEN year + 24 <= 2021 THEN list_extract([3, 2, 1], finish_position) ELSE list_extract([8, 7, 6, 5, 4, 3, 2, 1], finish_position) END, 0) AS sprint_points FROM results""")
def points(t):
    p = F.col("finish_position")
    return t.results.select(
        *KEY, lk.race_points(p).alias("race_points"), lk.sprint_points(p, F.col("year") + 24).alias("sprint_points")
    )


@query("B20_logit_sigmoid",
       sql="""p AS (SELECT event_id, (event_id % 101) / 100.0 AS p FROM events), l AS (SELECT event_id, ln(least(greatest(p, 1e-4), 1 - 1e-4) / (1 - least(greatest(p, 1e-4), 1 - 1e-4))) AS z FROM p)
SELECT event_id, round(z, 6) AS logit, round(1 / (1 + exp(-0.5 * z)), 6) AS flattened FROM l""")
def logit(t):
    z = mk.logit((F.col("event_id") % 101) / 100.0)
    return t.read("events").select("event_id", F.round(z, 6).alias("logit"), F.round(mk.sigmoid(z * 0.5), 6).alias("flattened"))


@query("B21_wilson",
       sql="""g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS k FROM events GROUP BY 1), p AS (SELECT *, k / n AS p FROM g)
SELECT user_id, round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
  round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM p""")
def wilson(t):
    g = t.read("events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("k")
    )
    low, high = sc.wilson(F.col("k"), F.col("n"))
    return g.select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("B22_strictly_before", "results",
       sql="SELECT year, round, entrant FROM results WHERE year < 1998 OR (year = 1998 AND round < 5)")
def strictly_before(t):
    return t.results.where(fn.before(F.col("year"), F.col("round"), 1998, 5)).select(*KEY)


@query("B23_category_codes", "results",
       sql="""k AS (SELECT team, row_number() OVER (ORDER BY team) AS code FROM (SELECT DISTINCT team FROM results WHERE year < 1999))
SELECT year, round, entrant, CAST(coalesce(code, 0) AS INT) AS team_idx FROM results LEFT JOIN k USING (team)""")
def category_codes(t):
    from fieldorder.operators.joins import category_codes as codes

    d = codes(t.results, t.results.where(F.col("year") < 1999), "team", "team_idx")
    return d.select(*KEY, "team_idx")


@query("B24_knockout_stage", "results",
       sql="""SELECT year, round, entrant, CASE WHEN quali_position <= 10 THEN 3 WHEN quali_position <= 10 + (count(*) OVER (PARTITION BY year, round) - 10) // 2 THEN 2 ELSE 1 END AS stage FROM results""")
def stage(t):
    d = with_totals(t.results, RACE, {"n": F.count(F.lit(1))}, t.hot_contest)
    return d.select(*KEY, fn.knockout_stage(F.col("quali_position"), F.col("n")).alias("stage"))


@query("B25_claim", "tickets",
       sql="SELECT ticket_id, round(CASE WHEN negate THEN 1 - p_pct / 100.0 ELSE p_pct / 100.0 END, 3) AS p, CASE WHEN negate THEN 1 - p_pct / 100.0 ELSE p_pct / 100.0 END <= 0.35 AS accepted FROM tickets")
def claim(t):
    p = fn.claim_probability(F.col("p_pct") / 100.0, F.col("negate"))
    return t.tickets.select("ticket_id", F.round(p, 3).alias("p"), fn.accepted(p).alias("accepted"))


@query("B26_claim_text", "tickets",
       sql="""SELECT ticket_id, concat(year, '-', lpad(round::VARCHAR, 2, '0'), '-', lpad((ticket_id % 1000)::VARCHAR, 3, '0'), '-', substr(md5(ticket_id::VARCHAR), 1, 4)) AS id,
  concat_ws(' ', bettor, 'says', entrant, CASE WHEN negate THEN 'will not' ELSE 'will' END, CASE WHEN event = 'win' THEN 'win' ELSE 'reach the podium' END) AS line FROM tickets""")
def claim_text(t):
    k = F.col("ticket_id")
    tid = fn.ticket_id(F.col("year"), F.col("round"), k % 1000, F.substring(F.md5(k.cast("string")), 1, 4))
    line = fn.claim_text(F.col("bettor"), F.col("entrant"), F.col("event"), F.col("negate"))
    return t.tickets.select("ticket_id", tid.alias("id"), line.alias("line"))


@query("B27_surname",
       sql=r"""SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[^\p{L}\s''\-]', '', 'g'), '\s+', ' ', 'g')), 1, 30) AS surname FROM conversations""")
def surname(t):
    return t.read("conversations").select("conv_id", "turn", fn.surname(F.col("text")).alias("surname"))


@query("B28_cron_delay",
       sql="""SELECT event_id, round(CASE WHEN m < 17 THEN m + 60 - 17 ELSE m - 17 END, 4) AS hourly, round(CASE WHEN d < 377 THEN d + 1440 - 377 ELSE d - 377 END, 4) AS daily
FROM (SELECT event_id, minute(ts) + floor(second(ts)) / 60.0 AS m, hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0 AS d FROM events)""")
def cron_delay(t):
    ts = F.col("ts")
    return t.read("events").select(
        "event_id", F.round(fn.cron_delay_minutes(ts, 17), 4).alias("hourly"), F.round(fn.cron_delay_minutes(ts, 17, 6), 4).alias("daily")
    )


@query("B29_minutes_to_event",
       sql="""SELECT event_id, CAST(round(date_diff('microsecond', ts, TIMESTAMP '2024-02-01 13:00:00') / 60e6) AS BIGINT) AS minutes FROM events""")
def minutes(t):
    start = F.lit("2024-02-01 13:00:00").cast("timestamp_ntz")
    return t.read("events").select("event_id", fn.minutes_between(F.col("ts"), start).alias("minutes"))


@query("B30_contest_id", "results", sql="SELECT DISTINCT year * 100 + round AS contest_id FROM results")
def contest_id(t):
    return t.results.select(fn.contest_id(F.col("year"), F.col("round")).alias("contest_id")).distinct()
