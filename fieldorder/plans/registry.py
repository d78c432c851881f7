"""Queries by name, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fieldorder.sources.tables import Tables

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}

#: The derived views in SQL, for checking.
VIEWS: dict[str, str] = {
    "results": """
WITH cell AS (
  SELECT year(o_orderdate) AS year, month(o_orderdate) AS round, l_suppkey AS entrant,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret, COUNT(*) AS n_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY qty DESC, entrant) AS quali_position,
             MAX(qty) OVER (PARTITION BY year, round) AS max_qty,
             CASE WHEN 2 * n_ret > n_lines THEN 1 ELSE 0 END AS dnf FROM cell),
g AS (SELECT *, row_number() OVER (PARTITION BY year, round ORDER BY quali_position
               + CASE WHEN (entrant + round) % 7 = 0 THEN 5.5 ELSE 0.0 END, entrant) AS slot,
             row_number() OVER (PARTITION BY year, round ORDER BY dnf, cents DESC, entrant) AS place FROM q)
SELECT CAST(g.year AS INT) AS year, CAST(g.round AS INT) AS round, CAST((g.round - 1) % 6 AS INT) AS venue,
       g.entrant, n_name AS team, r_name AS league,
       CAST(g.quali_position AS INT) AS quali_position,
       CAST(CASE WHEN (g.entrant + g.year + g.round) % 41 = 0 THEN 0 ELSE g.slot END AS INT) AS grid_position,
       CAST(CASE WHEN g.dnf = 1 AND g.entrant % 2 = 0 THEN NULL ELSE g.place END AS INT) AS finish_position,
       g.dnf,
       CASE WHEN g.dnf = 1 THEN 'Engine' WHEN g.place > 15 THEN '+1 Lap' WHEN g.place > 10 THEN 'Lapped'
            ELSE 'Finished' END AS status,
       CASE WHEN g.dnf = 1 THEN 0 WHEN g.place = 1 THEN 25 WHEN g.place = 2 THEN 18 WHEN g.place = 3 THEN 15
            WHEN g.place = 4 THEN 12 WHEN g.place = 5 THEN 10 WHEN g.place = 6 THEN 8 WHEN g.place = 7 THEN 6
            WHEN g.place = 8 THEN 4 WHEN g.place = 9 THEN 2 WHEN g.place = 10 THEN 1 ELSE 0 END AS points,
       CASE WHEN g.dnf = 0 AND g.place <= 3 THEN 1 ELSE 0 END AS podium,
       CASE WHEN (g.entrant + g.round) % 23 = 0 THEN NULL
            ELSE 80000 + (g.max_qty - g.qty) * 10 + g.entrant % 10 END AS best_time_ms
FROM g JOIN supplier ON s_suppkey = g.entrant JOIN nation ON n_nationkey = s_nationkey
       JOIN region ON r_regionkey = n_regionkey""",
    "weather": """
SELECT DISTINCT year, round, ((year * 7 + round * 3) % 10) * 5 AS precip_tenths_mm,
       CASE WHEN ((year * 7 + round * 3) % 10) * 5 >= 20 THEN 1 ELSE 0 END AS is_wet,
       10 + (year + 2 * round) % 20 AS temp_c
FROM results WHERE (year + round) % 11 <> 0""",
    "laps": """
SELECT CAST(floor((day(ts) - 1) / 7) AS INT) AS round,
       CASE WHEN day(ts) % 7 IN (1, 2) THEN 'FP1' WHEN day(ts) % 7 IN (3, 4, 5) THEN 'FP2' ELSE 'FP3' END AS session,
       user_id AS entrant, user_id % 10 AS team, ts,
       CAST(row_number() OVER (PARTITION BY floor((day(ts) - 1) / 7), user_id ORDER BY ts, event_id) AS INT) AS lap_number,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE 90000 + CAST(ROUND(value * 100) AS BIGINT) / 2 END AS lap_ms,
       event_id % 9 = 0 AS is_pit_out_lap
FROM events""",
    "quotes": """
SELECT event_id, ts, user_id AS ticker, CASE WHEN user_id % 2 = 0 THEN 'win' ELSE 'podium' END AS market,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ROUND(value) AS BIGINT) END AS bid_millis,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(ROUND(value) AS BIGINT) + (event_id % 40) * 5 END AS ask_millis,
       CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(ROUND(value) AS BIGINT) + 3 END AS last_millis
FROM events""",
    "oplog": """
SELECT event_id, ts, date_trunc('hour', ts) AS run_id,
       CASE WHEN event_type = 'signup' THEN 'tick_start' WHEN event_type = 'purchase' THEN 'tick_end' ELSE 'probe' END AS kind,
       CAST(day(ts) AS INT) AS round, CASE WHEN user_id % 2 = 0 THEN 'src_a' ELSE 'src_b' END AS source,
       user_id % 5 AS item, event_id % 3 AS n, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error
FROM events""",
    "tickets": """
SELECT event_id AS ticket_id, ts, user_id AS bettor, CAST(1995 + user_id % 6 AS INT) AS year,
       CAST(1 + event_id % 12 AS INT) AS round, 1 + event_id % 120 AS entrant,
       CASE WHEN event_id % 2 = 0 THEN 'win' ELSE 'podium' END AS event, event_id % 3 = 0 AS negate,
       (event_id * 7) % 100 AS p_pct
FROM events WHERE event_type = 'purchase'""",
}
_NEEDS = {"weather": ("results",)}


def with_views(body: str, *uses: str) -> str:
    """Prefix a query body (``SELECT ...`` or ``name AS (...) ... SELECT``) with its views."""
    names: list[str] = []
    for u in uses:
        for n in (*_NEEDS.get(u, ()), u):
            if n not in names:
                names.append(n)
    ctes = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names]
    body = body.strip()
    if not ctes:
        return body if body[:6].upper() == "SELECT" else "WITH " + body
    glue = " " if body[:6].upper() == "SELECT" else ", "
    return "WITH " + ",\n".join(ctes) + glue + body


def query(name: str, *uses: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, None if sql is None else with_views(sql, *uses))
        return build

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(Tables(spark, sf_dir))

    run.__name__ = q.name
    return run
