"""Within-contest aggregates, ranks and analytics (E)."""

from pyspark.sql import functions as F

from fieldorder.operators import features as ft
from fieldorder.operators import field as fd
from fieldorder.operators.grouping import with_index, with_totals
from fieldorder.plans.queries.history import (
    BACK, CAR_PACE, KEY, MATE, PRIOR, QUALI, RHO, TEAM_POINTS, rounded, sizes,
)
from fieldorder.plans.registry import query

BEFORE = """pb AS (SELECT *, coalesce(sum(points) OVER (PARTITION BY year, entrant ORDER BY round
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM results)"""


@query("E01_championship_position", "results",
       sql=BEFORE + " SELECT year, round, entrant, CAST(rank() OVER (PARTITION BY year, round ORDER BY cum DESC) AS INT) AS championship_position FROM pb")
def championship_position(t):
    s = sizes(t)
    return ft.championship_position(ft.points_before(t.results, s), s).select(*KEY, "championship_position")


@query("E01_constructor_standing", "results",
       sql=TEAM_POINTS + " SELECT year, round, team, CAST(rank() OVER (PARTITION BY year, round ORDER BY team_cum_points DESC) AS INT) AS constructor_standing FROM c")
def constructor_standing(t):
    return ft.team_points(t.results, sizes(t)).select(*ft.TEAM_CONTEST, "constructor_standing")


@query("E02_championship_pressure", "results",
       sql=BEFORE + """, l AS (SELECT year, CASE WHEN year = (SELECT max(year) FROM results) THEN greatest(max(round), 12) ELSE max(round) END AS n
  FROM results GROUP BY year)
SELECT year, round, entrant, round(least((max(cum) OVER (PARTITION BY year, round) - cum) / greatest(25 * (n - round), 1), 1.0), 6)
  AS championship_pressure FROM pb JOIN l USING (year)""")
def championship_pressure(t):
    s = sizes(t)
    calendar = t.results.select("year").distinct().withColumn("n_rounds", F.lit(12))
    d = ft.championship_pressure(ft.points_before(t.results, s), s, calendar)
    return rounded(d, KEY, "championship_pressure")


@query("E03_teammate_quali_delta", "results",
       sql=f"{QUALI}, {MATE} SELECT year, round, entrant, round(mate, 6) AS teammate_quali_delta FROM md")
def teammate_delta(t):
    s = sizes(t)
    return rounded(ft.teammate_quali_delta(ft.quali_gap(t.results, s), s), KEY, "teammate_quali_delta")


@query("E04_car_pace_delta", "results",
       sql=f"{QUALI}, {CAR_PACE} SELECT year, round, team, round(car_pace_delta_pct, 6) AS car_pace_delta_pct FROM cp")
def car_pace(t):
    s = sizes(t)
    return rounded(ft.car_pace_delta(ft.quali_gap(t.results, s), s), ft.TEAM_CONTEST, "car_pace_delta_pct")


@query("E05_team_pit_delta", "results",
       sql="""p AS (SELECT *, CASE WHEN entrant % 9 <> 0 THEN (2000 + best_time_ms % 900) / 1000.0 END AS pit FROM results)
SELECT year, round, entrant, round(median(pit) OVER (PARTITION BY year, round, team) - median(pit) OVER (PARTITION BY year, round), 6)
  AS team_pit_delta_s FROM p""")
def pit_delta(t):
    pit = F.when(F.col("entrant") % 9 != 0, (2000 + F.col("best_time_ms") % 900) / 1000.0)
    return rounded(ft.pit_delta(t.results, pit, sizes(t)), KEY, "team_pit_delta_s")


@query("E06_quali_gap_relative", "results",
       sql=f"""{QUALI} SELECT year, round, entrant, round(CASE WHEN max(gap) OVER w >= 0.01 THEN gap / max(gap) OVER w END, 6)
  AS quali_gap_relative FROM qg WINDOW w AS (PARTITION BY year, round)""")
def gap_relative(t):
    s = sizes(t)
    return rounded(ft.quali_gap_relative(ft.quali_gap(t.results, s), s), KEY, "quali_gap_relative")


@query("E07_grid_and_round_relative", "results",
       sql=f"""{BACK}, l AS (SELECT year, max(round) AS n FROM results GROUP BY year)
SELECT year, round, entrant, round((grid_position - 1) / nullif(max(grid_position) OVER (PARTITION BY year, round) - 1, 0), 6) AS grid_position_rel,
  round((round - 1) / greatest(n - 1, 1), 6) AS round_fraction FROM rb JOIN l USING (year)""")
def relative(t):
    s = sizes(t)
    d = ft.round_fraction(ft.grid_relative(ft.pit_lane_to_back(t.results, s), s))
    return rounded(d, KEY, "grid_position_rel", "round_fraction")


#: Sprint rows derived from the results: every third round, those who set a time.
SPRINT = """sp AS (SELECT year, round, entrant, CAST(row_number() OVER (PARTITION BY year, round ORDER BY best_time_ms, entrant) AS INT) AS sprint_position,
  CAST(count(*) OVER (PARTITION BY year, round) AS INT) AS n_starters, best_time_ms FROM results WHERE round % 3 = 0 AND best_time_ms IS NOT NULL)"""


def sprint_rows(t):
    d = t.results.where((F.col("round") % 3 == 0) & F.col("best_time_ms").isNotNull())
    d = with_index(d, ["year", "round"], ["best_time_ms", "entrant"], "sprint_position", t.hot_contest)
    d = with_totals(d, ["year", "round"], {"n_starters": F.count(F.lit(1))}, t.hot_contest)
    return d.select("year", "round", "entrant", "team", "sprint_position", F.col("n_starters").cast("int").alias("n_starters"))


@query("E08_penalty_and_sprint", "results",
       sql=f"""{BACK}, {SPRINT}, j AS (SELECT rb.*, coalesce(sprint_position / coalesce(n_starters, 20), 0.5) AS rel FROM rb LEFT JOIN sp USING (year, round, entrant))
SELECT year, round, entrant, CAST(coalesce(greatest(grid_position - quali_position, 0), 0) AS DOUBLE) AS grid_penalty_places,
  round(rel, 6) AS sprint_position_rel, max(CASE WHEN rel <> 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY year, round) AS is_sprint_weekend FROM j""")
def penalty_sprint(t):
    s = sizes(t)
    d = ft.grid_penalty(ft.pit_lane_to_back(t.results, s))
    d = d.join(sprint_rows(t).drop("team"), KEY, "left")
    d = d.withColumn("rel", ft.sprint_relative(F.col("sprint_position"), F.col("n_starters")))
    flag = F.max(F.when(F.col("rel") != 0.5, 1.0).otherwise(0.0))
    d = with_totals(d, ["year", "round"], {"is_sprint_weekend": flag}, t.hot_contest)
    return d.select(*KEY, "grid_penalty_places", F.round("rel", 6).alias("sprint_position_rel"), "is_sprint_weekend")


@query("E09_contest_spearman", "results",
       sql=f"{RHO} SELECT venue, year, round, round(rho, 6) AS rho FROM rho")
def spearman(t):
    return rounded(ft.contest_rank_correlation(t.results, sizes(t)), ["venue", "year", "round"], "rho")


@query("E10_quali_spread_and_order", "results",
       sql="""q AS (SELECT * FROM results WHERE quali_position IS NOT NULL),
p1 AS (SELECT year, round, max(CASE WHEN quali_position = 1 THEN best_time_ms END) AS t1 FROM q GROUP BY 1, 2),
top AS (SELECT year, round, best_time_ms AS t, row_number() OVER (PARTITION BY year, round ORDER BY quali_position) AS k
  FROM q WHERE quali_position <= 10 AND best_time_ms IS NOT NULL),
m AS (SELECT year, round, count(*) AS n, median(CASE WHEN k > 1 THEN t END) AS rest FROM top GROUP BY 1, 2),
rk AS (SELECT year, round, rank() OVER (PARTITION BY year, round ORDER BY quali_position) AS a,
  rank() OVER (PARTITION BY year, round ORDER BY best_time_ms) + (count(*) OVER (PARTITION BY year, round, best_time_ms) - 1) / 2.0 AS b
  FROM q WHERE best_time_ms IS NOT NULL),
o AS (SELECT year, round, CASE WHEN count(*) >= 10 THEN corr(a, b) END AS c FROM rk GROUP BY 1, 2)
SELECT year, round, round(CASE WHEN n >= 5 AND t1 > 0 THEN least(greatest((rest / t1 - 1) * 100, 0), 10) END, 6) AS quali_spread_pct,
  round(c, 6) AS quali_segment_order FROM p1 LEFT JOIN m USING (year, round) LEFT JOIN o USING (year, round)""")
def quali_stats(t):
    return rounded(ft.quali_stats(t.results, sizes(t)), ["year", "round"], "quali_spread_pct", "quali_segment_order")


@query("E11_quali_shuffle", "results",
       sql=PRIOR + " SELECT year, round, round(avg(abs(quali_vs_prior)), 6) AS quali_shuffle FROM vp GROUP BY 1, 2")
def shuffle(t):
    d = ft.quali_vs_prior(t.results, sizes(t))
    return d.groupBy("year", "round").agg(F.round(F.avg(F.abs("quali_vs_prior")), 6).alias("quali_shuffle"))


#: A rating per row taken from the data: points so far in the year.
@query("E12_rating_rank_gap", "results",
       sql=BEFORE + """ SELECT year, round, entrant, grid_position - (rank() OVER (PARTITION BY year, round ORDER BY cum DESC)
  + (count(*) OVER (PARTITION BY year, round, cum) - 1) / 2.0::DOUBLE) AS elo_rank_gap FROM pb""")
def rank_gap(t):
    s = sizes(t)
    d = fd.elo_rank_gap(ft.points_before(t.results, s), F.col("cum_points_before"), s)
    return d.select(*KEY, "elo_rank_gap")


GAPS = """m AS (SELECT *, count(*) OVER w AS n, min(best_time_ms) OVER w AS best FROM results
  WHERE best_time_ms > 0 AND quali_position IS NOT NULL WINDOW w AS (PARTITION BY year, round)),
rk AS (SELECT year, round, quali_position AS a, rank() OVER (PARTITION BY year, round ORDER BY best_time_ms)
  + (count(*) OVER (PARTITION BY year, round, best_time_ms) - 1) / 2.0 AS b FROM m),
pr AS (SELECT year, round, rank() OVER (PARTITION BY year, round ORDER BY a) AS a, b FROM rk),
o AS (SELECT year, round, corr(a, b) AS c FROM pr GROUP BY 1, 2 HAVING count(*) >= 10),
u AS (SELECT m.*, 100 * ln(best_time_ms / best) AS g,
   CASE WHEN quali_position <= 10 THEN 3 WHEN quali_position <= 10 + (n - 10) // 2 THEN 2 ELSE 1 END AS stage
   FROM m JOIN o USING (year, round) WHERE c >= 0.9),
k AS (SELECT *, median(g) OVER (PARTITION BY year, round) AS med FROM u WHERE g <= 7),
se AS (SELECT year, median(med) AS smed FROM (SELECT DISTINCT year, round, med FROM k) GROUP BY year),
sg AS (SELECT k.*, g * smed / nullif(med, 0) AS y FROM k JOIN se USING (year))"""


@query("E13_session_gaps", "results", sql=GAPS + " SELECT year, round, entrant, round(y, 6) AS y, stage FROM sg")
def session_gaps(t):
    d = fd.session_gaps(t.results, sizes(t))
    return d.select(*KEY, F.round("y", 6).alias("y"), "stage")


@query("E14_field_flags", "results",
       sql="""SELECT year, round, count(*) AS n_starters, count(finish_position) AS n_classified, bool_or(dnf = 1) AS any_dnf,
  bool_and(best_time_ms IS NOT NULL) AS all_timed, count(DISTINCT team) AS n_teams FROM results GROUP BY 1, 2""")
def field_flags(t):
    return t.results.groupBy("year", "round").agg(
        F.count(F.lit(1)).alias("n_starters"),
        F.count("finish_position").alias("n_classified"),
        F.bool_or(F.col("dnf") == 1).alias("any_dnf"),
        F.bool_and(F.col("best_time_ms").isNotNull()).alias("all_timed"),
        F.countDistinct("team").alias("n_teams"),
    )


@query("E15_podium", "results",
       sql="""SELECT year, round, entrant, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY finish_position, entrant) AS place
  FROM results WHERE dnf = 0 AND finish_position IS NOT NULL) WHERE place <= 3""")
def podium(t):
    d = fd.top_k(fd.finishers(t.results), ["year", "round"], ["finish_position", "entrant"], 3, t.hot_contest)
    return d.select(*KEY, "place")


@query("E16_pick_winner", "results",
       sql="""SELECT year, round, arg_max(entrant, points * 1000000 - entrant) AS top_scorer,
  arg_min(entrant, best_time_ms * 1000000 + entrant) FILTER (best_time_ms IS NOT NULL) AS fastest FROM results GROUP BY 1, 2""")
def picks(t):
    timed = F.col("best_time_ms").isNotNull()
    return t.results.groupBy("year", "round").agg(
        fd.best(F.col("entrant"), F.col("points"), F.col("entrant")).alias("top_scorer"),
        F.min_by(F.when(timed, F.col("entrant")), F.when(timed, F.struct("best_time_ms", "entrant"))).alias("fastest"),
    )


@query("E17_sequential_picks", "results",
       sql="""s AS (SELECT *, 100000 - quali_position * 7 % 1000 AS s1, points * 10 - entrant % 7 AS s2, -best_time_ms AS s3 FROM results),
p1 AS (SELECT year, round, entrant AS a FROM s QUALIFY row_number() OVER (PARTITION BY year, round ORDER BY s1 DESC NULLS LAST, entrant) = 1),
p2 AS (SELECT s.year, s.round, a, entrant AS b FROM s JOIN p1 USING (year, round) WHERE entrant <> a
  QUALIFY row_number() OVER (PARTITION BY s.year, s.round ORDER BY s2 DESC NULLS LAST, entrant) = 1),
p3 AS (SELECT s.year, s.round, a, b, entrant AS c FROM s JOIN p2 USING (year, round) WHERE entrant <> a AND entrant <> b
  QUALIFY row_number() OVER (PARTITION BY s.year, s.round ORDER BY s3 DESC NULLS LAST, entrant) = 1)
SELECT year, round, a AS pick_1, b AS pick_2, c AS pick_3 FROM p3""")
def sequential(t):
    d = t.results.select(
        "year", "round", "entrant",
        (100000 - F.col("quali_position") * 7 % 1000).alias("s1"),
        (F.col("points") * 10 - F.col("entrant") % 7).alias("s2"),
        (-F.col("best_time_ms")).alias("s3"),
    )
    return fd.sequential_picks(d, ["year", "round"], ["s1", "s2", "s3"], "entrant", t.hot_contest)


@query("E18_podium_overlap", "results",
       sql="""SELECT year, round, CAST(sum(CASE WHEN quali_position <= 3 AND podium = 1 THEN 1 ELSE 0 END) AS INT) AS overlap FROM results GROUP BY 1, 2""")
def podium_overlap(t):
    d = t.results.where((F.col("quali_position") <= 3) | (F.col("podium") == 1))  # at most six rows per contest
    g = d.groupBy("year", "round").agg(
        F.collect_set(F.when(F.col("quali_position") <= 3, F.col("entrant"))).alias("a"),
        F.collect_set(F.when(F.col("podium") == 1, F.col("entrant"))).alias("b"),
    )
    return g.select("year", "round", fd.overlap(F.col("a"), F.col("b")).alias("overlap"))


STAND = f"""{SPRINT}, sx AS (SELECT sp.year, sp.round, sp.entrant, CASE sprint_position WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS points FROM sp),
st AS (SELECT year, entrant, CAST(sum(points) AS BIGINT) AS points FROM (SELECT year, round, entrant, points FROM results
  UNION ALL SELECT * FROM sx) WHERE round <= 8 GROUP BY 1, 2)"""


def sprint_scored(t):
    from fieldorder.functions.lookups import sprint_points

    return sprint_rows(t).withColumn("points", sprint_points(F.col("sprint_position"), F.col("year")))


@query("E19_standings_through_round", "results", sql=STAND + " SELECT * FROM st")
def standings(t):
    return fd.standings(t.results, sprint_scored(t), "entrant", 8)


@query("E19_team_standings", "results",
       sql=f"""{SPRINT}, sx AS (SELECT r.year, r.round, r.team, CASE sprint_position WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS points
  FROM sp JOIN results r USING (year, round, entrant))
SELECT year, team, CAST(sum(points) AS BIGINT) AS points FROM (SELECT year, round, team, points FROM results UNION ALL SELECT * FROM sx)
WHERE round <= 8 GROUP BY 1, 2""")
def team_standings(t):
    return fd.standings(t.results, sprint_scored(t), "team", 8)


@query("E20_season_leader", "results",
       sql=STAND.replace("round <= 8", "round <= 12") + " SELECT year, arg_max(entrant, points * 1000000 - entrant) AS leader, max(points) AS points FROM st GROUP BY year")
def leader(t):
    d = fd.standings(t.results, sprint_scored(t), "entrant", 12)  # a season is over after its last month
    return d.groupBy("year").agg(
        fd.best(F.col("entrant"), F.col("points"), F.col("entrant")).alias("leader"), F.max("points").alias("points")
    )


@query("E21_contest_constants", "results", "weather",
       sql="""SELECT r.year, r.round, max(venue) AS venue, max(is_wet) AS is_wet, max(league) AS some_league
FROM results r LEFT JOIN weather USING (year, round) GROUP BY 1, 2""")
def constants(t):
    d = t.results.join(t.weather, ["year", "round"], "left")
    return d.groupBy("year", "round").agg(
        F.any_value("venue").alias("venue"), F.first("is_wet", ignorenulls=True).alias("is_wet"),
        F.max("league").alias("some_league"),
    )


IMPUTE = ["grid_position", "best_time_ms", "finish_position"]


@query("E22_median_fill", "results",
       sql="""SELECT year, round, entrant, CAST(coalesce(grid_position, (SELECT median(grid_position) FROM results)) AS DOUBLE) AS grid_position,
  CAST(coalesce(best_time_ms, (SELECT median(best_time_ms) FROM results)) AS DOUBLE) AS best_time_ms,
  CAST(coalesce(finish_position, (SELECT median(finish_position) FROM results)) AS DOUBLE) AS finish_position FROM results""")
def median_fill(t):
    return fd.with_fill(t.results, IMPUTE).select(*KEY, *[F.col(c).cast("double").alias(c) for c in IMPUTE])


@query("E22_fill_values", "results",
       sql="SELECT " + ", ".join(f"CAST(median({c}) AS DOUBLE) AS {c}" for c in IMPUTE) + " FROM results")
def fill_values(t):
    return fd.fill_values(t.results, IMPUTE)


@query("E23_weather_fill", "results", "weather",
       sql="""j AS (SELECT r.year, r.round, r.entrant, w.* EXCLUDE (year, round) FROM results r LEFT JOIN weather w USING (year, round))
SELECT year, round, entrant, coalesce(precip_tenths_mm, (SELECT median(precip_tenths_mm) FROM j)) AS precip_tenths_mm,
  coalesce(temp_c, (SELECT median(temp_c) FROM j)) AS temp_c, coalesce(is_wet, 0) AS is_wet FROM j""")
def weather_fill(t):
    d = fd.attach_weather(t.results, t.weather, ["precip_tenths_mm", "temp_c"])
    return d.select(*KEY, "precip_tenths_mm", "temp_c", "is_wet")


@query("E24_large_groups", "results",
       sql="SELECT year, round, entrant, team FROM (SELECT *, count(*) OVER (PARTITION BY year, round, team) AS n FROM results) WHERE n >= 5")
def large_groups(t):
    return fd.group_filter(t.results, ft.TEAM_CONTEST, 5, t.hot_contest).select(*KEY, "team")


@query("E25_pivot_status", "results",
       sql="""SELECT year, team, count(*) FILTER (status = 'Finished') AS finished, count(*) FILTER (status = 'Lapped') AS lapped,
  count(*) FILTER (status = '+1 Lap') AS plus_lap, count(*) FILTER (status = 'Engine') AS engine FROM results GROUP BY 1, 2""")
def pivot_status(t):
    d = fd.pivot(t.results, ["year", "team"], "status", ["Finished", "Lapped", "+1 Lap", "Engine"], {"n": F.count(F.lit(1))})
    names = {"Finished": "finished", "Lapped": "lapped", "+1 Lap": "plus_lap", "Engine": "engine"}
    return d.select("year", "team", *[F.coalesce(F.col(k), F.lit(0)).alias(v) for k, v in names.items()])


@query("E26_first_per_team", "results",
       sql="SELECT year, round, team, min(entrant) AS entrant FROM results GROUP BY 1, 2, 3")
def first_per_team(t):
    return t.results.groupBy(*ft.TEAM_CONTEST).agg(F.min("entrant").alias("entrant"))


@query("E27_set_operations", "results", "weather",
       sql="""SELECT year, round, 'both' AS side FROM (SELECT year, round FROM results INTERSECT SELECT year, round FROM weather)
UNION ALL SELECT year, round, 'no weather' FROM (SELECT year, round FROM results EXCEPT SELECT year, round FROM weather)""")
def set_operations(t):
    a, b = t.results.select("year", "round"), t.weather.select("year", "round")
    both = a.intersect(b).withColumn("side", F.lit("both"))
    return both.unionByName(a.subtract(b).withColumn("side", F.lit("no weather")))
