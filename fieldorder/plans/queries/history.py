"""Lagged history features (D)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldorder.functions.lookups import venue_type
from fieldorder.operators import features as ft
from fieldorder.operators.grouping import with_index
from fieldorder.operators.history import with_last_seen
from fieldorder.plans.registry import query
from fieldorder.plans.venues import VENUE_SQL, venue_name
from fieldorder.sources.tables import Tables

KEY = ["year", "round", "entrant"]
WD = "PARTITION BY entrant ORDER BY year, round"


def sizes(t: Tables) -> ft.Sizes:
    return ft.Sizes(contest=t.hot_contest, history=t.hot_history, league=t.hot_league)


def rounded(df: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in cols])


def ewm_sql(src: str, key: str, x: str, span: int, least: int, out: str, ignore_na: bool, keep: str) -> str:
    """Weighted mean by an explicit self join with power(r, distance)."""
    num = f"count({x}) OVER (PARTITION BY {key} ORDER BY year, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    num = num if ignore_na else f"row_number() OVER (PARTITION BY {key} ORDER BY year, round) - 1"
    r = f"(1.0 - 2.0 / ({span} + 1))"
    return f"""
{out}_n AS (SELECT *, {num} AS k FROM {src}),
{out}_v AS (
  SELECT a.{key}, a.year, a.round,
         CASE WHEN count(b.{x}) >= {least}
              THEN sum(b.{x} * power({r}, a.k - b.k - 1)) / sum(power({r}, a.k - b.k - 1)) END AS {out}
  FROM {out}_n a LEFT JOIN {out}_n b ON a.{key} = b.{key} AND b.{x} IS NOT NULL
       AND (b.year < a.year OR (b.year = a.year AND b.round < a.round))
  GROUP BY a.{key}, a.year, a.round)"""


@query(
    "D01_form_last_5_10", "results",
    sql=f"""SELECT year, round, entrant,
  round(avg(finish_position) OVER ({WD} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS driver_form_5,
  round(avg(finish_position) OVER ({WD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS driver_form_10
FROM results""",
)
def form(t):
    return rounded(ft.driver_form(t.results, sizes(t)), KEY, "driver_form_5", "driver_form_10")


@query(
    "D02_form_ewm", "results",
    sql=ewm_sql("results", "entrant", "finish_position", 5, 1, "v", False, "")
    + " SELECT year, round, entrant, round(v, 6) AS driver_form_ewm FROM v_v",
)
def form_ewm(t):
    return rounded(ft.driver_form_ewm(t.results, sizes(t)), KEY, "driver_form_ewm")


@query(
    "D03_points_before", "results",
    sql="""SELECT year, round, entrant, CAST(coalesce(sum(points) OVER (PARTITION BY year, entrant ORDER BY round
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_points_before FROM results""",
)
def points_before(t):
    return ft.points_before(t.results, sizes(t)).select(*KEY, "cum_points_before")


@query(
    "D04_dnf_rate", "results",
    sql=f"""SELECT year, round, entrant, round(CASE WHEN count(dnf) OVER w >= 3 THEN avg(dnf) OVER w END, 6) AS dnf_rate
FROM results WINDOW w AS ({WD} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def dnf_rate(t):
    return rounded(ft.dnf_rate(t.results, sizes(t)), KEY, "dnf_rate")


@query(
    "D05_venue_history", "results",
    sql="""SELECT a.year, a.round, a.entrant, round(avg(b.finish_position), 6) AS circuit_avg_finish,
  CAST(coalesce(sum(b.podium), 0) AS BIGINT) AS circuit_podiums, count(b.entrant) AS circuit_appearances
FROM results a LEFT JOIN results b ON a.venue = b.venue AND a.entrant = b.entrant AND b.year >= a.year - 5
  AND (b.year < a.year OR (b.year = a.year AND b.round < a.round))
GROUP BY 1, 2, 3""",
)
def venue_history(t):
    d = ft.venue_history(t.results)
    return d.select(
        *KEY,
        F.round("circuit_avg_finish", 6).alias("circuit_avg_finish"),
        "circuit_podiums",
        "circuit_appearances",
    )


@query(
    "D06_wet_form", "results", "weather",
    sql=f"""j AS (SELECT r.*, CASE WHEN w.is_wet = 1 THEN finish_position END AS wf
  FROM results r LEFT JOIN weather w USING (year, round))
SELECT year, round, entrant, round(CASE WHEN count(wf) OVER w >= 3 THEN avg(wf) OVER w END, 6) AS driver_wet_avg_finish
FROM j WINDOW w AS ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def wet_form(t):
    d = t.results.join(t.weather.select("year", "round", F.col("is_wet").alias("is_wet_race")), ["year", "round"], "left")
    return rounded(ft.wet_form(d, sizes(t)), KEY, "driver_wet_avg_finish")


@query(
    "D07_experience", "results",
    sql=f"""SELECT year, round, entrant, round(least((row_number() OVER ({WD}) - 1) / 100.0, 1.0), 6)
  AS driver_experience_norm FROM results""",
)
def experience(t):
    return rounded(ft.experience(t.results, sizes(t)), KEY, "driver_experience_norm")


TEAM_POINTS = """p AS (SELECT year, round, team, sum(points) AS pts FROM results GROUP BY 1, 2, 3),
c AS (SELECT year, round, team, CAST(coalesce(sum(pts) OVER (PARTITION BY year, team ORDER BY round
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS team_cum_points FROM p)"""


@query("D08_team_points_before", "results", sql=TEAM_POINTS + " SELECT * FROM c")
def team_points(t):
    return ft.team_points(t.results, sizes(t)).select(*ft.TEAM_CONTEST, "team_cum_points")


@query(
    "D09_team_reliability", "results",
    sql="""p AS (SELECT year, round, team, avg(dnf) AS r FROM results GROUP BY 1, 2, 3)
SELECT year, round, team, round(1 - CASE WHEN count(r) OVER w >= 3 THEN avg(r) OVER w END, 6) AS team_reliability_rate
FROM p WINDOW w AS (PARTITION BY team ORDER BY year, round ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def team_reliability(t):
    return rounded(ft.team_reliability(t.results, sizes(t)), ft.TEAM_CONTEST, "team_reliability_rate")


@query(
    "D10_team_form", "results",
    sql="""p AS (SELECT year, round, team, min(finish_position) AS b FROM results GROUP BY 1, 2, 3)
SELECT year, round, team, round(avg(b) OVER (PARTITION BY team ORDER BY year, round
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS team_form_5 FROM p""",
)
def team_form(t):
    return rounded(ft.team_form(t.results, sizes(t)), ft.TEAM_CONTEST, "team_form_5")


GRID_BIN = """CASE WHEN grid_position = 1 THEN 'P1' WHEN grid_position = 2 THEN 'P2' WHEN grid_position = 3 THEN 'P3'
  WHEN grid_position <= 6 THEN 'P4-6' WHEN grid_position <= 10 THEN 'P7-10' WHEN grid_position <= 15 THEN 'P11-15'
  ELSE 'P16+' END"""
#: Grid with pit-lane starts at the back.
BACK = """rb AS (SELECT * EXCLUDE (grid_position), CASE WHEN grid_position = 0
  THEN max(CASE WHEN grid_position > 0 THEN grid_position END) OVER (PARTITION BY year, round) + 1
  ELSE grid_position END AS grid_position FROM results)"""


@query(
    "D11_grid_conversion", "results",
    sql=f"""{BACK}, d AS (SELECT *, {GRID_BIN} AS bin FROM rb),
v AS (SELECT venue, bin, year, round, sum(finish_position) AS s, count(finish_position) AS c FROM d GROUP BY 1, 2, 3, 4),
vv AS (SELECT venue, bin, year, round, CASE WHEN sum(c) OVER w > 0 THEN sum(s) OVER w / sum(c) OVER w END AS m
  FROM v WINDOW w AS (PARTITION BY venue, bin ORDER BY year, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT bin, year, round, sum(finish_position) AS s, count(finish_position) AS c FROM d GROUP BY 1, 2, 3),
aa AS (SELECT bin, year, round, CASE WHEN sum(c) OVER w > 0 THEN sum(s) OVER w / sum(c) OVER w END AS m
  FROM a WINDOW w AS (PARTITION BY bin ORDER BY year, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT d.year, d.round, d.entrant, round(coalesce(vv.m, aa.m), 6) AS circuit_grid_conversion
FROM d JOIN vv USING (venue, bin, year, round) JOIN aa USING (bin, year, round)""",
)
def grid_conversion(t):
    s = sizes(t)
    d = ft.grid_conversion(ft.pit_lane_to_back(t.results, s), s)
    return rounded(d, KEY, "circuit_grid_conversion")


RHO = """ok AS (SELECT * FROM results WHERE grid_position > 0 AND finish_position IS NOT NULL AND dnf = 0),
rk AS (SELECT venue, year, round,
    rank() OVER (PARTITION BY year, round ORDER BY grid_position) + (count(*) OVER (PARTITION BY year, round, grid_position) - 1) / 2.0 AS rg,
    rank() OVER (PARTITION BY year, round ORDER BY finish_position) + (count(*) OVER (PARTITION BY year, round, finish_position) - 1) / 2.0 AS rf
  FROM ok),
rho AS (SELECT r.venue, r.year, r.round, CASE WHEN max(n) >= 5 THEN max(c) END AS rho
  FROM (SELECT DISTINCT venue, year, round FROM results) r
  LEFT JOIN (SELECT year, round, corr(rg, rf) AS c, count(*) AS n FROM rk GROUP BY 1, 2) USING (year, round) GROUP BY 1, 2, 3)"""


@query(
    "D12_overtaking_index", "results",
    sql=f"""{RHO}
SELECT venue, year, round, round(1 - coalesce(
  avg(rho) OVER (PARTITION BY venue ORDER BY year, round ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
  avg(rho) OVER (ORDER BY year, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.75), 6) AS circuit_overtaking
FROM rho""",
)
def overtaking(t):
    return rounded(ft.overtaking_index(t.results, sizes(t)), ["venue", "year", "round"], "circuit_overtaking")


GAIN = f"""{BACK},
raw AS (SELECT *, least(grid_position, 22) AS slot,
  CASE WHEN dnf = 0 AND finish_position IS NOT NULL THEN grid_position - finish_position END AS raw_gain FROM rb),
yr AS (SELECT DISTINCT year FROM raw),
past AS (SELECT y.year, (SELECT count(*) FROM raw WHERE raw.year < y.year) AS n FROM yr y),
curve AS (SELECT p.year, r.slot, avg(r.raw_gain) AS usual FROM past p JOIN raw r
  ON (p.n >= 500 AND r.year < p.year) OR (p.n < 500 AND r.year = p.year) GROUP BY 1, 2),
gn AS (SELECT raw.*, raw_gain - usual AS slot_gain FROM raw LEFT JOIN curve USING (year, slot))"""


@query(
    "D13_gain_ewm", "results",
    sql=GAIN + "," + ewm_sql("gn", "entrant", "slot_gain", 8, 3, "v", True, "")
    + " SELECT year, round, entrant, round(v, 6) AS driver_gain_ewm FROM v_v",
)
def gain_ewm(t):
    s = sizes(t)
    d = ft.gain_ewm(ft.slot_gain(ft.pit_lane_to_back(t.results, s)), s)
    return rounded(d, KEY, "driver_gain_ewm")


@query(
    "D14_slot_gain", "results",
    sql=GAIN + " SELECT year, round, entrant, round(slot_gain, 6) AS slot_gain FROM gn",
)
def slot_gain(t):
    return rounded(ft.slot_gain(ft.pit_lane_to_back(t.results, sizes(t))), KEY, "slot_gain")


@query(
    "D15_team_gain_ewm", "results",
    sql=GAIN + ", tg AS (SELECT year, round, team, avg(slot_gain) AS g FROM gn GROUP BY 1, 2, 3),"
    + ewm_sql("tg", "team", "g", 8, 3, "v", True, "")
    + " SELECT year, round, team, round(v, 6) AS team_gain_ewm FROM v_v",
)
def team_gain_ewm(t):
    s = sizes(t)
    d = ft.team_gain_ewm(ft.slot_gain(ft.pit_lane_to_back(t.results, s)), s)
    return rounded(d, ft.TEAM_CONTEST, "team_gain_ewm")


@query(
    "D16_teammate_finish_ewm", "results",
    sql="""fc AS (SELECT *, CASE WHEN dnf = 0 THEN finish_position END AS f FROM results),
tm AS (SELECT *, CASE WHEN count(f) OVER w = 2 AND f IS NOT NULL THEN f - (sum(f) OVER w - f) END AS d
  FROM fc WINDOW w AS (PARTITION BY year, round, team)),"""
    + ewm_sql("tm", "entrant", "d", 10, 3, "v", True, "")
    + " SELECT year, round, entrant, round(v, 6) AS teammate_finish_delta_ewm FROM v_v",
)
def teammate_finish(t):
    return rounded(ft.teammate_finish_ewm(t.results, sizes(t)), KEY, "teammate_finish_delta_ewm")


QUALI = """qg AS (SELECT *, least((best_time_ms - min(best_time_ms) OVER (PARTITION BY year, round)) / 1000.0, 5.0)
  * CASE WHEN best_time_ms IS NOT NULL THEN 1 END AS gap FROM results)"""
MATE = """md AS (SELECT *, gap - (sum(gap) OVER w - gap) / nullif(count(gap) OVER w - 1, 0) AS mate
  FROM qg WINDOW w AS (PARTITION BY year, round, team))"""


@query(
    "D17_teammate_quali_ewm", "results",
    sql=f"{QUALI}, {MATE}," + ewm_sql("md", "entrant", "mate", 10, 3, "v", True, "")
    + " SELECT year, round, entrant, round(v, 6) AS teammate_quali_delta_ewm FROM v_v",
)
def teammate_quali(t):
    s = sizes(t)
    d = ft.teammate_quali_delta(ft.quali_gap(t.results, s), s)
    return rounded(ft.teammate_quali_ewm(d, s), KEY, "teammate_quali_delta_ewm")


@query(
    "D18_venue_type_form", "results",
    sql=f"""vt AS (SELECT *, CASE {VENUE_SQL} WHEN 'monza' THEN 'power' WHEN 'spa' THEN 'power' WHEN 'monaco' THEN 'high_downforce'
    WHEN 'singapore' THEN 'high_downforce' WHEN 'silverstone' THEN 'fast_flowing' ELSE 'traction' END AS kind FROM results),
b AS (SELECT year, round, team, kind, min(CASE WHEN dnf = 0 THEN finish_position END) AS b FROM vt GROUP BY 1, 2, 3, 4)
SELECT year, round, team, round(CASE WHEN count(b) OVER k >= 2 THEN avg(b) OVER k END
  - CASE WHEN count(b) OVER a >= 3 THEN avg(b) OVER a END, 6) AS team_type_form_delta
FROM b WINDOW a AS (PARTITION BY team ORDER BY year, round ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
  k AS (PARTITION BY team, kind ORDER BY year, round ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
)
def venue_type_form(t):
    d = t.results.withColumn("venue_type", venue_type(venue_name(F.col("venue"))))
    return rounded(ft.venue_type_form(d, sizes(t)), ft.TEAM_CONTEST, "team_type_form_delta")


CAR_PACE = """tm AS (SELECT year, round, team, median(gap) AS m FROM qg GROUP BY 1, 2, 3),
tf AS (SELECT *, min(m) OVER (PARTITION BY year, round) AS f FROM tm),
cp AS (SELECT year, round, team, CASE WHEN m IS NULL THEN 0 ELSE
  least(greatest((m - f) / greatest(f, 0.01) * 100, 0), 3) END AS car_pace_delta_pct FROM tf)"""


@query(
    "D19_car_pace_trend", "results",
    sql=f"{QUALI}, {CAR_PACE}," + ewm_sql("cp", "team", "car_pace_delta_pct", 5, 1, "v", False, "")
    + """ SELECT year, round, team, round(car_pace_delta_pct - v, 6) AS car_pace_trend
FROM cp JOIN v_v USING (year, round, team)""",
)
def car_pace_trend(t):
    s = sizes(t)
    d = ft.car_pace_trend(ft.car_pace_delta(ft.quali_gap(t.results, s), s), s)
    return rounded(d, ft.TEAM_CONTEST, "car_pace_trend")


@query(
    "D20_era_progress", "results",
    sql="""y AS (SELECT year, max(round) AS n, CASE WHEN year >= 2000 THEN 2000 WHEN year >= 1996 THEN 1996 ELSE year END AS era
  FROM results GROUP BY year),
s AS (SELECT year, coalesce(sum(n) OVER (PARTITION BY era ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM y)
SELECT year, round, entrant, round(least((st + round - 1) / 44.0, 1.0), 6) AS reg_era_progress FROM results JOIN s USING (year)""",
)
def era_progress(t):
    return rounded(ft.era_progress(t.results, resets=(1996, 2000)), KEY, "reg_era_progress")


PRIOR = """ql AS (SELECT *, (quali_position - 1) / greatest(max(quali_position) OVER (PARTITION BY year, round) - 1, 1) AS rel FROM results),"""
PRIOR += ewm_sql("ql", "entrant", "rel", 5, 2, "own", False, "")
PRIOR += ", qt AS (SELECT year, round, team, avg(rel) AS tr FROM ql GROUP BY 1, 2, 3),"
PRIOR += ewm_sql("qt", "team", "tr", 5, 1, "tp", False, "")
PRIOR += """, vp AS (SELECT year, round, entrant, rel - coalesce(own, tp, 0.5) AS quali_vs_prior
  FROM ql JOIN own_v USING (entrant, year, round) JOIN tp_v USING (team, year, round))"""


@query("D21_quali_vs_prior", "results",
       sql=PRIOR + " SELECT year, round, entrant, round(quali_vs_prior, 6) AS quali_vs_prior FROM vp")
def quali_vs_prior(t):
    return rounded(ft.quali_vs_prior(t.results, sizes(t)), KEY, "quali_vs_prior")


@query(
    "D23_last_seen_gap", "results",
    sql=f"""{QUALI} SELECT year, round, entrant, round(-last_value(gap IGNORE NULLS) OVER ({WD}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS naive_score FROM qg""",
)
def last_seen(t):
    s = sizes(t)
    d = with_last_seen(ft.quali_gap(t.results, s), ["entrant"], ft.TIME, -F.col("quali_gap_s"), "naive_score", s.history)
    return rounded(d, KEY, "naive_score")


@query(
    "D24_half_season_trend", "results",
    sql="""h AS (SELECT year, round, max(CASE WHEN quali_position = 1 AND finish_position = 1 THEN 1 ELSE 0 END) AS hit FROM results GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round) AS i, count(*) OVER (PARTITION BY year) AS n FROM h),
a AS (SELECT year, avg(CASE WHEN i <= n // 2 THEN hit END) AS e, avg(CASE WHEN i > n // 2 THEN hit END) AS l, max(n) AS m FROM n GROUP BY year)
SELECT year, round(coalesce(e, 0), 6) AS early_rate, round(l, 6) AS late_rate, CASE WHEN m < 3 THEN NULL WHEN l > e THEN 'improving'
  WHEN l = e THEN 'flat' ELSE 'declining' END AS trend FROM a""",
)
def half_season(t):
    hit = ((F.col("quali_position") == 1) & (F.col("finish_position") == 1)).cast("int")
    per = t.results.groupBy("year", "round").agg(F.max(F.coalesce(hit, F.lit(0))).alias("hit"))
    per = with_index(per, ["year"], ["round"], "_i", t.hot_history)
    sizes_ = per.groupBy("year").agg(F.count(F.lit(1)).alias("_n"))
    per = per.join(sizes_, "year")
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    g = per.groupBy("year").agg(
        F.coalesce(F.avg(F.when(early, F.col("hit"))), F.lit(0.0)).alias("e"),
        F.avg(F.when(~early, F.col("hit"))).alias("l"),
        F.max("_n").alias("n"),
    )
    label = F.when(F.col("l") > F.col("e"), "improving").when(F.col("l") == F.col("e"), "flat").otherwise("declining")
    return g.select(
        "year",
        F.round("e", 6).alias("early_rate"),
        F.round("l", 6).alias("late_rate"),
        F.when(F.col("n") >= 3, label).alias("trend"),
    )
