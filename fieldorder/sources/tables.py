"""The given tables and the contest views derived from them.

``Tables`` reads lazily; every view is a DataFrame plan over the parquet files. Group-size bounds
come from row counts in parquet footers, so no view is built just to learn how big a group is.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldorder.operators.grouping import GROUP_ROW_LIMIT, is_hot, kept, with_index, with_totals

CONTEST = ["year", "round"]

#: Stated schemas: no job is spent on inference, and a wrong file fails at once.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

#: A keyed side is broadcast up to this many counted rows.
BROADCAST_ROWS = 200_000

_ROWS: dict[tuple[str, str, str], int] = {}


def whole(x: Column) -> Column:
    return x.cast("bigint")


def ladder(x: Column, *values: int) -> Column:
    """value for place 1, 2, ...; 0 beyond the table."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in values]), x.cast("int")), F.lit(0))


def lap_round() -> Column:
    return F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")


class Tables:
    """Views for one data folder. ``hot=True`` forces the split plans (tests)."""

    def __init__(self, spark: SparkSession, folder: str, hot: bool | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._hot = hot

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Row count (from footers), remembered for the life of the application."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _ROWS:
            _ROWS[key] = self.read(name).count()
        return _ROWS[key]

    def _bound(self, name: str) -> bool:
        return self.rows(name) > GROUP_ROW_LIMIT if self._hot is None else self._hot

    @property
    def forced(self) -> bool | None:
        """True where the split plans are asked for (tests); for operators that measure what they need by themselves."""
        return self._hot or None

    @cached_property
    def hot_contest(self) -> bool:
        """A contest holds at most one row per supplier."""
        return self._bound("supplier")

    @cached_property
    def hot_history(self) -> bool:
        """An entrant has at most one row per contest, and contests are calendar months."""
        return False if self._hot is None else self._hot

    @cached_property
    def hot_league(self) -> bool | None:
        """A league has at most one result row per order line; beyond that bound it is measured."""
        if self._hot is not None:
            return self._hot
        return False if self.rows("lineitem") <= GROUP_ROW_LIMIT else None

    @cached_property
    def hot_events(self) -> bool:
        """Any group of event rows is at most the whole event table."""
        return self._bound("events")

    @cached_property
    def hot_laps(self) -> bool:
        """The laps of an entrant in a round: runs and sessions of one entrant lie inside. Measured in a large table."""
        if self._hot is not None or not self.hot_events:
            return self.hot_events
        per = self.read("events").select(lap_round().alias("round"), F.col("user_id").alias("entrant"))
        return is_hot(per, ["round", "entrant"], None)

    @cached_property
    def hot_session(self) -> bool | None:
        """A session holds at most all events; operators measure the rows that reach them in a large table."""
        return None if self._hot is None and self.hot_events else self.hot_events

    @cached_property
    def hot_lines(self) -> bool:
        """Any group of order lines is at most the whole table."""
        return self._bound("lineitem")

    def settle_results(self) -> None:
        """Make ``results`` once, for a query that reads them many times; a small order table is read anew each time."""
        if self.hot_lines:
            self.__dict__["results"] = kept(self.results)
            self.__dict__.pop("weather", None)

    @cached_property
    def results(self) -> DataFrame:
        """One row per entrant and contest: lines of one supplier in one order month."""
        hot = self.hot_contest
        orders = self.read("orders").select(
            "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("round")
        )
        lines = self.read("lineitem").select(
            "l_orderkey",
            F.col("l_suppkey").alias("entrant"),
            whole(F.col("l_quantity")).alias("q"),
            whole(F.round(F.col("l_extendedprice") * 100)).alias("c"),
            (F.col("l_returnflag") == "R").cast("int").alias("r"),
        )
        cell = (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("year", "round", "entrant")
            .agg(
                F.sum("q").alias("qty"),
                F.sum("c").alias("cents"),
                (2 * F.sum("r") > F.count(F.lit(1))).cast("int").alias("dnf"),
            )
        )
        q = with_totals(cell, CONTEST, {"max_qty": F.max("qty")}, hot)
        q = with_index(q, CONTEST, [F.desc("qty"), "entrant"], "quali_position", hot)
        late = F.when((F.col("entrant") + F.col("round")) % 7 == 0, 5.5).otherwise(0.0)
        q = with_index(q, CONTEST, [F.col("quali_position") + late, "entrant"], "slot", hot)
        q = with_index(q, CONTEST, ["dnf", F.desc("cents"), "entrant"], "place", hot)
        teams = (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("n_name").alias("team"), F.col("r_name").alias("league"))
        )
        if self.rows("supplier") <= BROADCAST_ROWS:  # counted, so the wide side need not be shuffled
            teams = F.broadcast(teams)
        place, dnf = F.col("place"), F.col("dnf")
        status = (
            F.when(dnf == 1, "Engine")
            .when(place > 15, "+1 Lap")
            .when(place > 10, "Lapped")
            .otherwise("Finished")
        )
        points = F.when(dnf == 1, 0).otherwise(ladder(place, 25, 18, 15, 12, 10, 8, 6, 4, 2, 1))
        pit_lane = (F.col("entrant") + F.col("year") + F.col("round")) % 41 == 0
        time = 80000 + (F.col("max_qty") - F.col("qty")) * 10 + F.col("entrant") % 10
        return q.join(teams, F.col("entrant") == F.col("s_suppkey")).select(
            "year",
            "round",
            ((F.col("round") - 1) % 6).cast("int").alias("venue"),
            "entrant",
            "team",
            "league",
            "quali_position",
            F.when(pit_lane, 0).otherwise(F.col("slot")).alias("grid_position"),
            F.when((dnf == 0) | (F.col("entrant") % 2 != 0), place).alias("finish_position"),
            "dnf",
            status.alias("status"),
            points.alias("points"),
            ((dnf == 0) & (place <= 3)).cast("int").alias("podium"),
            F.when((F.col("entrant") + F.col("round")) % 23 != 0, time).alias("best_time_ms"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        wet = ((F.col("year") * 7 + F.col("round") * 3) % 10) * 5
        return (
            self.results.where((F.col("year") + F.col("round")) % 11 != 0)
            .select(*CONTEST)
            .distinct()
            .select(
                *CONTEST,
                wet.alias("precip_tenths_mm"),
                (wet >= 20).cast("int").alias("is_wet"),
                (10 + (F.col("year") + 2 * F.col("round")) % 20).alias("temp_c"),
            )
        )

    @cached_property
    def laps(self) -> DataFrame:
        day = F.dayofmonth("ts")
        session = F.when((day % 7).isin(1, 2), "FP1").when((day % 7).isin(3, 4, 5), "FP2").otherwise("FP3")
        ms = 90000 + whole(F.round(F.col("value") * 100)) / 2
        laps = self.read("events").select(
            lap_round().alias("round"),
            session.alias("session"),
            F.col("user_id").alias("entrant"),
            (F.col("user_id") % 10).alias("team"),
            "ts",
            "event_id",
            F.when(F.col("event_id") % 29 != 0, ms).alias("lap_ms"),
            (F.col("event_id") % 9 == 0).alias("is_pit_out_lap"),
        )
        laps = with_index(laps, ["round", "entrant"], ["ts", "event_id"], "lap_number", self.hot_laps)
        return laps.drop("event_id")

    @cached_property
    def quotes(self) -> DataFrame:
        value = whole(F.round("value"))
        eid = F.col("event_id")
        return self.read("events").select(
            "event_id",
            "ts",
            F.col("user_id").alias("ticker"),
            F.when(F.col("user_id") % 2 == 0, "win").otherwise("podium").alias("market"),
            F.when(eid % 13 != 0, value).alias("bid_millis"),
            F.when(eid % 17 != 0, value + (eid % 40) * 5).alias("ask_millis"),
            F.when(eid % 5 == 0, 0).otherwise(value + 3).alias("last_millis"),
        )

    @cached_property
    def oplog(self) -> DataFrame:
        kind = F.col("event_type")
        return self.read("events").select(
            "event_id",
            "ts",
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run_id"),
            F.when(kind == "signup", "tick_start")
            .when(kind == "purchase", "tick_end")
            .otherwise("probe")
            .alias("kind"),
            F.dayofmonth("ts").alias("round"),
            F.when(F.col("user_id") % 2 == 0, "src_a").otherwise("src_b").alias("source"),
            (F.col("user_id") % 5).alias("item"),
            (F.col("event_id") % 3).alias("n"),
            (kind == "error").cast("int").alias("is_error"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        eid, who = F.col("event_id"), F.col("user_id")
        return (
            self.read("events")
            .where(F.col("event_type") == "purchase")
            .select(
                eid.alias("ticket_id"),
                "ts",
                who.alias("bettor"),
                (1995 + who % 6).cast("int").alias("year"),
                (1 + eid % 12).cast("int").alias("round"),
                (1 + eid % 120).alias("entrant"),
                F.when(eid % 2 == 0, "win").otherwise("podium").alias("event"),
                (eid % 3 == 0).alias("negate"),
                ((eid * 7) % 100).alias("p_pct"),
            )
        )
