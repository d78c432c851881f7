"""Lap and run analytics (F)."""

from pyspark.sql import functions as F

from fieldorder.operators import laps as lp
from fieldorder.operators.grouping import checkpointed, kept
from fieldorder.plans.queries.history import KEY, rounded
from fieldorder.plans.registry import query

WEEKEND = ["round"]
SESSION = ["round", "session"]
RUN = ["round", "session", "entrant", "stint_number"]
OWN = ["round", "session", "entrant"]

#: Laps with a run per session and entrant, seconds and a compound derived from the run.
LAPS = """lq AS (SELECT round, session, entrant, team, ts, lap_number, lap_ms / 1000.0 AS lap_s, is_pit_out_lap AND entrant % 4 = 0 AS is_pit_out_lap FROM laps),
ls AS (SELECT *, CAST(1 + sum(is_pit_out_lap::INT) OVER (PARTITION BY round, session, entrant ORDER BY lap_number) AS INT) AS stint_number FROM lq),
lc AS (SELECT *, CASE (entrant + stint_number) % 4 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HARD' END AS compound FROM ls)"""
LONG = f"""{LAPS}, a1 AS (SELECT *, min(lap_number) OVER (PARTITION BY round, session, entrant, stint_number) AS f FROM lc WHERE lap_s IS NOT NULL AND NOT is_pit_out_lap),
a2 AS (SELECT * EXCLUDE (f), median(lap_s) OVER (PARTITION BY round, session, entrant, stint_number) AS md FROM a1 WHERE lap_number > f),
a3 AS (SELECT * EXCLUDE (md), count(*) OVER (PARTITION BY round, session, entrant, stint_number) AS n FROM a2 WHERE lap_s <= md * 1.07),
lr AS (SELECT * EXCLUDE (n) FROM a3 WHERE n >= 5)"""
AGED = f"""{LONG}, ag AS (SELECT * REPLACE (coalesce(compound, 'UNKNOWN') AS compound), CAST(lap_number - min(lap_number) OVER (PARTITION BY round, session, entrant, stint_number) AS DOUBLE) AS age FROM lr)"""
SLOPE = f"""{AGED}, ctr AS (SELECT *, age - avg(age) OVER w AS x, lap_s - avg(lap_s) OVER w AS y FROM ag WINDOW w AS (PARTITION BY round, session, entrant, stint_number)),
st AS (SELECT round, session, entrant, stint_number, compound, sum(x * y) AS xy, sum(x * x) AS xx FROM ctr GROUP BY ALL),
sc AS (SELECT round, session, compound, CASE WHEN count(*) >= 3 THEN sum(xy) / nullif(sum(xx), 0) ELSE max(sxy) / nullif(max(sxx), 0) END AS comp_slope
  FROM (SELECT *, sum(xy) OVER (PARTITION BY round, session) AS sxy, sum(xx) OVER (PARTITION BY round, session) AS sxx FROM st) GROUP BY 1, 2, 3)"""
PACES = f"""{SLOPE}, rp AS (SELECT a.round, a.session, a.entrant, a.stint_number, median(lap_s) AS pace_s, count(*) AS n_laps, max(a.compound) AS compound,
  (max(st.xy / nullif(st.xx, 0)) - max(comp_slope)) / median(lap_s) * 100 AS deg_pct FROM ag a JOIN st USING (round, session, entrant, stint_number) JOIN sc ON a.round = sc.round AND a.session = sc.session AND a.compound = sc.compound
  GROUP BY 1, 2, 3, 4)"""
BEST = f"""{PACES}, br AS (SELECT round, session, entrant, min(pace_s) AS pace_s, CAST(sum(n_laps) AS BIGINT) AS n_laps, sum(deg_pct * n_laps) / sum(CASE WHEN deg_pct IS NOT NULL THEN n_laps END) AS deg FROM rp GROUP BY 1, 2, 3),
be AS (SELECT round, session, entrant, pace_s, n_laps, least(greatest((pace_s / median(pace_s) OVER w - 1) * 100, -5), 5) AS gap, CASE WHEN deg IS NOT NULL THEN least(greatest(deg, -0.5), 0.5) END AS deg FROM br
  WINDOW w AS (PARTITION BY round, session) QUALIFY count(*) OVER w >= 6)"""
WEIGHTS = {"FP1": 0.5, "FP2": 1.0, "FP3": 0.5}


def run_laps(t):
    d = t.laps.withColumn("lap_s", F.col("lap_ms") / 1000.0)
    d = d.withColumn("is_pit_out_lap", F.col("is_pit_out_lap") & (F.col("entrant") % 4 == 0)).drop("lap_ms")
    d = lp.laps_with_stints(d, OWN, ["lap_number"], t.hot_laps)
    k = (F.col("entrant") + F.col("stint_number")) % 4
    return d.withColumn("compound", F.when(k == 0, "SOFT").when(k == 1, "MEDIUM").when(k == 2, "HARD"))


def long_runs(t, clean=False):
    return lp.long_run_laps(run_laps(t), RUN, SESSION, t.hot_laps, clean)


def aged(t):
    return lp.with_age(long_runs(t), RUN, t.hot_laps)


def aged_once(t):
    """Aged laps, made once where the event table is large: slopes and paces read them several times."""
    return kept(aged(t)) if t.hot_events else aged(t)


def paces(t):
    return lp.run_paces(aged_once(t), RUN, SESSION, t.hot_laps)


def best(t):
    return lp.best_runs(paces(t), SESSION, t.hot_session)


@query("F01_long_run_laps", "laps", sql=f"{LONG} SELECT round, session, entrant, stint_number, lap_number, round(lap_s, 6) AS lap_s FROM lr")
def long_run_laps(t):
    return rounded(long_runs(t), [*RUN, "lap_number"], "lap_s")


@query("F02_clean_runs", "laps",
       sql=f"""{LONG}, q AS (SELECT *, quantile_cont(lap_s, 0.25) OVER w AS q1, quantile_cont(lap_s, 0.5) OVER w AS q2, quantile_cont(lap_s, 0.75) OVER w AS q3 FROM lr
  WINDOW w AS (PARTITION BY round, session, entrant, stint_number)), b AS (SELECT round, session, min(lap_s) AS best FROM lc GROUP BY 1, 2)
SELECT round, session, entrant, stint_number, lap_number FROM q JOIN b USING (round, session) WHERE (q3 - q1) / q2 * 100 <= 3 AND NOT (q2 / best - 1) * 100 > 12""")
def clean_runs(t):
    return long_runs(t, clean=True).select(*RUN, "lap_number")


@query("F03_tyre_age", "laps", sql=f"{AGED} SELECT round, session, entrant, stint_number, lap_number, age FROM ag")
def age(t):
    return aged(t).select(*RUN, "lap_number", "age")


@query("F04_run_slope", "laps", sql=f"{SLOPE} SELECT round, session, entrant, stint_number, round(xy / nullif(xx, 0), 6) AS slope FROM st")
def run_slope(t):
    own, _ = lp.slopes(aged(t), RUN, SESSION, t.hot_laps)
    return rounded(own, RUN, "slope")


@query("F04_compound_slope", "laps", sql=f"{SLOPE} SELECT round, session, compound, round(comp_slope, 6) AS comp_slope FROM sc")
def compound_slope(t):
    _, per = lp.slopes(aged_once(t), RUN, SESSION, t.hot_laps)
    return rounded(per, [*SESSION, "compound"], "comp_slope")


@query("F05_age_adjusted", "laps",
       sql=f"""{SLOPE} SELECT a.round, a.session, entrant, stint_number, lap_number, round(lap_s - least(greatest(coalesce(comp_slope, 0), 0),
  median(lap_s) OVER (PARTITION BY a.round, a.session, entrant, stint_number) * 0.004) * age, 6) AS lap_s FROM ag a JOIN sc USING (round, session, compound)""")
def age_adjusted(t):
    d = aged_once(t)
    _, per = lp.slopes(d, RUN, SESSION, t.hot_laps)
    return rounded(lp.age_adjusted(d, per, RUN, SESSION, t.hot_laps), [*RUN, "lap_number"], "lap_s")


@query("F06_run_pace", "laps",
       sql=f"{PACES} SELECT round, session, entrant, stint_number, round(pace_s, 6) AS pace_s, n_laps, compound, round(deg_pct, 6) AS deg_pct FROM rp")
def run_pace(t):
    return paces(t).select(*RUN, F.round("pace_s", 6).alias("pace_s"), "n_laps", "compound", F.round("deg_pct", 6).alias("deg_pct"))


OFFSETS = f"""{PACES}, bc AS (SELECT round, session, entrant, compound, min(pace_s) AS pace_s, (entrant % 13) / 5.0 AS car FROM rp GROUP BY ALL),
o AS (SELECT round, session, 100 * ln(pace_s) AS y, car AS c, (compound = 'SOFT')::INT::DOUBLE AS s, (compound = 'HARD')::INT::DOUBLE AS h FROM bc WHERE compound <> 'UNKNOWN'),
z AS (SELECT round, session, y - avg(y) OVER w AS y, c - avg(c) OVER w AS c, s - avg(s) OVER w AS s, h - avg(h) OVER w AS h FROM o WINDOW w AS (PARTITION BY round, session)),
b AS (SELECT round, session, coalesce(sum(c * y) / nullif(sum(c * c), 0), 0) AS byy, coalesce(sum(c * s) / nullif(sum(c * c), 0), 0) AS bs, coalesce(sum(c * h) / nullif(sum(c * c), 0), 0) AS bh FROM z GROUP BY 1, 2),
r AS (SELECT round, session, y - byy * c AS y, s - bs * c AS s, h - bh * c AS h FROM z JOIN b USING (round, session)),
m AS (SELECT round, session, sum(s * s) + 3 AS a, sum(s * h) AS k, sum(h * h) + 3 AS d, sum(s * y) + 3 * -0.3 AS p, sum(h * y) + 3 * 0.2 AS q FROM r GROUP BY 1, 2)"""


@query("F07_compound_offsets", "laps",
       sql=f"{OFFSETS} SELECT round, session, round((p * d - q * k) / (a * d - k * k), 5) AS soft_pct, round((a * q - k * p) / (a * d - k * k), 5) AS hard_pct FROM m")
def offsets(t):
    b = paces(t).groupBy(*SESSION, "entrant", "compound").agg(F.min("pace_s").alias("pace_s"))
    d = lp.compound_offsets(b.withColumn("car_pace_delta_pct", (F.col("entrant") % 13) / 5.0), SESSION)
    return d.select(*SESSION, F.round("soft_pct", 5).alias("soft_pct"), F.round("hard_pct", 5).alias("hard_pct"))


@query("F08_best_runs", "laps", sql=f"{BEST} SELECT round, session, entrant, round(pace_s, 6) AS pace_s, n_laps, round(gap, 6) AS gap, round(deg, 6) AS deg FROM be")
def best_runs(t):
    return best(t).select(*OWN, *[F.round(c, 6).alias(c) for c in ("pace_s", "gap", "deg")], "n_laps")


@query("F09_weighted_session_mean", "laps",
       sql=f"""{BEST}, w AS (SELECT *, CASE WHEN session = 'FP2' THEN 1.0 ELSE 0.5 END AS w FROM be)
SELECT round, entrant, round(sum(gap * w) / sum(w), 6) AS fp_longrun_gap_pct, CAST(sum(n_laps) AS BIGINT) AS fp_longrun_laps,
  round(sum(deg * w) / sum(CASE WHEN deg IS NOT NULL THEN w END), 6) AS fp_longrun_deg_pct FROM w GROUP BY 1, 2""")
def weighted(t):
    d = lp.weekend_pace(best(t), WEEKEND, WEIGHTS)
    return d.select("round", "entrant", *[F.round(c, 6).alias(c) for c in ("fp_longrun_gap_pct", "fp_longrun_deg_pct")], "fp_longrun_laps")


@query("F10_practice_features", "laps",
       sql=f"""{BEST}, l AS (SELECT DISTINCT round, entrant, team FROM laps), e AS (SELECT round, entrant, avg(gap) AS g FROM be GROUP BY 1, 2),
tp AS (SELECT round, team, avg(g) AS tg FROM (SELECT round, session, team, min(gap) AS g FROM be JOIN l USING (round, entrant) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT round, entrant, team, round(g, 6) AS fp_longrun_gap_pct, round(tg, 6) AS team_longrun_gap_pct FROM l LEFT JOIN e USING (round, entrant) LEFT JOIN tp USING (round, team) WHERE g IS NOT NULL OR tg IS NOT NULL""")
def practice(t):
    lineup = t.laps.select("round", "entrant", "team").distinct()
    d = lp.practice_pace(run_laps(t), lineup, WEEKEND, t.hot_laps, hot_session=t.hot_session)
    return rounded(d, ["round", "entrant", "team"], "fp_longrun_gap_pct", "team_longrun_gap_pct")


METRICS = f"""{LAPS}, f1 AS (SELECT *, median(lap_s) OVER (PARTITION BY round, session, entrant) AS md FROM lc WHERE lap_s BETWEEN 50 AND 150),
f2 AS (SELECT * FROM f1 WHERE abs(lap_s - md) <= 12), f3 AS (SELECT *, min(lap_s) OVER (PARTITION BY round, session) AS sb, median(lap_s) OVER (PARTITION BY round, session) AS sm,
  count(*) OVER (PARTITION BY round, session, entrant, stint_number) AS n FROM f2),
me AS (SELECT round, session, entrant, count(*) AS n_laps, min(lap_s) - max(sb) AS best_gap_s, avg(lap_s) FILTER (n >= 5) - max(sm) AS long_run_delta_s FROM f3 GROUP BY 1, 2, 3)"""


@query("F11_session_metrics", "laps", sql=f"{METRICS} SELECT round, session, entrant, n_laps, round(best_gap_s, 8) AS best_gap_s, round(long_run_delta_s, 8) AS long_run_delta_s FROM me")
def metrics(t):
    d = lp.session_metrics(run_laps(t), SESSION, t.hot_laps, t.hot_session)
    return d.select(*OWN, "n_laps", *[F.round(c, 8).alias(c) for c in ("best_gap_s", "long_run_delta_s")])


@query("F12_sessions_side_by_side", "laps",
       sql=f"""{METRICS}, s AS (SELECT round, entrant, max(n_laps) FILTER (session = 'FP1') AS fp1_n_laps, max(n_laps) FILTER (session = 'FP2') AS fp2_n_laps, max(n_laps) FILTER (session = 'FP3') AS fp3_n_laps,
  max(session) AS last_session FROM me GROUP BY 1, 2) SELECT * FROM s""")
def side_by_side(t):
    m = lp.session_metrics(run_laps(t), SESSION, t.hot_laps, t.hot_session).withColumn("day", F.substring("session", 3, 1).cast("int"))
    if t.hot_events:  # made once, as every session reads it
        m = checkpointed(m)
    cols = ["round", "entrant", "n_laps", "day"]
    parts = {f"fp{k}": m.where(F.col("session") == f"FP{k}").select(*cols) for k in (1, 2, 3)}
    d = lp.merge_sessions(parts, ["round", "entrant"], ["n_laps"], "day")
    return d.withColumn("last_session", F.upper("last_session"))


@query("F13_sprint_pace", "laps",
       sql=f"""{LAPS}, g AS (SELECT *, max(lap_number) OVER (PARTITION BY round, session) AS mx, min(lap_s) OVER (PARTITION BY round, session) AS sb FROM lc WHERE lap_s BETWEEN 40 AND 200),
h AS (SELECT *, CASE WHEN lap_number > 1 AND lap_number < mx - 1 THEN lap_s END AS mid FROM g),
f AS (SELECT round, session, coalesce(median(mid), median(lap_s)) AS fld FROM h GROUP BY 1, 2),
e AS (SELECT round, session, entrant, min(lap_s) - max(sb) AS b, coalesce(median(mid), median(lap_s)) AS p FROM h GROUP BY 1, 2, 3)
SELECT round, session, entrant, round(least(greatest(b, 0), 10), 6) AS sprint_best_gap_s, round(least(greatest(p - fld, -5), 10), 6) AS sprint_pace_delta_s FROM e JOIN f USING (round, session)""")
def sprint_pace(t):
    d = lp.sprint_pace(run_laps(t), SESSION, t.hot_laps, t.hot_session)
    return rounded(d, OWN, "sprint_best_gap_s", "sprint_pace_delta_s")


@query("F14_start_compound", "laps",
       sql=f"{LAPS} SELECT round, session, entrant, coalesce(upper(max(lower(compound))), 'MEDIUM') AS start_compound FROM lc WHERE stint_number = 1 GROUP BY 1, 2, 3")
def start(t):
    d = run_laps(t).withColumn("compound", F.lower("compound"))
    return lp.start_compound(d, OWN)


@query("F15_grid_changes", "results",
       sql="""p AS (SELECT year, round, entrant, CASE WHEN entrant % 19 = 0 THEN slot + 1 ELSE slot END AS g FROM (SELECT *, quali_position AS slot FROM results) WHERE entrant % 31 <> 0 AND round <> 7)
SELECT r.year, r.round, r.entrant, r.quali_position AS old_grid, coalesce(p.g, b.back) AS new_grid FROM results r JOIN (SELECT year, round, max(g) + 1 AS back FROM p GROUP BY 1, 2) b USING (year, round)
  LEFT JOIN p USING (year, round, entrant) WHERE r.quali_position IS DISTINCT FROM coalesce(p.g, b.back)""")
def grid_changes(t):
    r = t.results
    stored = r.select(*KEY, F.col("quali_position").alias("grid_position"))
    pub = r.where("entrant % 31 <> 0 and round <> 7").select(
        *KEY, F.when(F.col("entrant") % 19 == 0, F.col("quali_position") + 1).otherwise(F.col("quali_position")).alias("grid_position")
    )
    return lp.grid_changes(stored, pub, ["year", "round"], t.hot_contest)
