"""Nested JSON documents to rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.functions.scalars import canonical_team, duration_seconds, is_dnf
from fieldorder.operators.grouping import with_index, with_totals

#: Rows per document part; a larger group spans several documents.
PART_ROWS = 1000

RACE_SCHEMA = (
    "year int, round int, results array<struct<entrant:bigint, team:string, grid:string, position:string, "
    "points:string, status:string>>"
)
QUALI_SCHEMA = "year int, round int, results array<struct<entrant:bigint, position:int, q1:string, q2:string, q3:string>>"
PIT_SCHEMA = "year int, round int, stops array<struct<entrant:bigint, lap:int, duration:string>>"
ODDS_SCHEMA = (
    "id bigint, bookmakers array<struct<key:string, markets:array<struct<key:string, "
    "outcomes:array<struct<name:string, price:double>>>>>>"
)


def documents(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], item: Column, name: str, hot: bool | None
) -> DataFrame:
    """One JSON document per key and part: the keys and an ordered array of items.

    Items are numbered first and cut into parts, so no document collects an unbounded group.
    """
    d = with_index(df, keys, order, "_i", hot)
    d = d.select(*keys, F.floor((F.col("_i") - 1) / PART_ROWS).cast("int").alias("part"), "_i", item.alias("item"))
    sorted_items = F.transform(F.array_sort(F.collect_list(F.struct("_i", "item"))), lambda x: x["item"])
    g = d.groupBy(*keys, "part").agg(sorted_items.alias(name))
    return g.select(*keys, "part", F.to_json(F.struct(*keys, name)).alias("doc"))


def parsed(docs: DataFrame, schema: str, doc: str = "doc") -> DataFrame:
    """Documents that parse; unreadable ones are skipped.

    The explode of one element keeps the parse a single expression: without it the filter and every
    selected field would parse the text again.
    """
    once = F.explode(F.array(F.from_json(doc, schema, {"mode": "PERMISSIVE"})))
    d = docs.select(once.alias("d")).where(F.col("d").isNotNull())
    return d.select("d.*")


def race_rows(docs: DataFrame) -> DataFrame:
    """Race documents to result rows with dnf and place flags."""
    d = parsed(docs, RACE_SCHEMA).where(F.col("results").isNotNull())
    d = d.select("year", "round", F.explode("results").alias("r")).select("year", "round", "r.*")
    place = F.col("position").try_cast("int")
    flags = [F.coalesce((place == k).cast("int"), F.lit(0)).alias(f"p{k}") for k in (1, 2, 3)]
    return d.select(
        "year",
        "round",
        "entrant",
        canonical_team(F.col("team")).alias("team"),
        F.col("grid").try_cast("int").alias("grid_position"),
        place.alias("finish_position"),
        is_dnf(F.col("status")).alias("dnf"),
        F.coalesce(F.col("points").try_cast("double"), F.lit(0.0)).alias("points"),
        *flags,
        F.coalesce(place.between(1, 3).cast("int"), F.lit(0)).alias("podium"),
    )


def quali_rows(docs: DataFrame, hot: bool | None) -> DataFrame:
    """Best time is the latest segment reached; the gap is to the fastest of the contest."""
    d = parsed(docs, QUALI_SCHEMA)
    d = d.select("year", "round", F.explode("results").alias("r")).select("year", "round", "r.*")
    best = F.coalesce(*[duration_seconds(F.col(c)) for c in ("q3", "q2", "q1")])
    d = d.select("year", "round", "entrant", F.col("position").alias("quali_position"), best.alias("best_s"))
    d = with_totals(d, ["year", "round"], {"_f": F.min("best_s")}, hot)
    return d.withColumn("gap_s", F.col("best_s") - F.col("_f")).drop("_f")


def last_known(values: Column) -> Column:
    """Last non-null element of an array."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def quali_from_laps(laps: DataFrame, lineup: DataFrame, keys: Sequence[str], hot: bool | None) -> DataFrame:
    """Without an official order: rank by fastest lap; entrants without a lap come last."""
    best = laps.where(F.col("lap_s").isNotNull()).groupBy(*keys, "entrant").agg(F.min("lap_s").alias("best_s"))
    d = lineup.join(best, [*keys, "entrant"], "left")
    return with_index(d, keys, [F.col("best_s").asc_nulls_last(), "entrant"], "quali_position", hot)


def pit_rows(docs: DataFrame, low: float = 1.5, high: float = 120.0) -> DataFrame:
    """Median usable stop per entrant (3 places) and the number of stops."""
    d = parsed(docs, PIT_SCHEMA)
    d = d.select("year", "round", F.explode("stops").alias("s")).select("year", "round", "s.*")
    d = d.withColumn("t", duration_seconds(F.col("duration"))).where(F.col("t").between(low, high))
    return d.groupBy("year", "round", "entrant").agg(
        F.round(F.median("t"), 3).alias("avg_pit_s"), F.count(F.lit(1)).alias("n_stops")
    )


def with_field_size(df: DataFrame, keys: Sequence[str], out: str, hot: bool | None) -> DataFrame:
    return with_totals(df, keys, {out: F.count(F.lit(1))}, hot)


def parallel_rows(df: DataFrame, arrays: Sequence[str], suffix: str = "_previous_day1") -> DataFrame:
    """Parallel arrays to rows; a name suffix is stripped; all-null variables reject the record."""
    clean = {c: c.removesuffix(suffix) for c in arrays}
    usable = None
    for c in arrays:
        some = F.exists(F.col(c), lambda x: x.isNotNull())
        usable = some if usable is None else usable & some
    rest = [c for c in df.columns if c not in arrays]
    d = df.where(usable).withColumn("_z", F.explode(F.arrays_zip(*arrays)))
    return d.select(*rest, *[F.col(f"_z.{c}").alias(n) for c, n in clean.items()])


def day_weather(hourly: DataFrame, keys: Sequence[str], time: str, day: Column) -> DataFrame:
    """Hours of the given day to means, maxima and totals; wet from 2 mm."""
    d = hourly.where(F.to_date(time) == day)
    return d.groupBy(*keys).agg(
        F.avg("temperature").alias("temp_c_mean"), F.max("temperature").alias("temp_c_max"),
        F.sum("precipitation").alias("precip_mm_total"), F.max("precipitation").alias("precip_mm_max_hourly"),
        (F.sum("precipitation") >= 2.0).cast("int").alias("is_wet_race"),
    )


def mean_prices(docs: DataFrame, market: str = "h2h") -> DataFrame:
    """events / bookmakers / markets / outcomes to the mean price per name."""
    d = parsed(docs, ODDS_SCHEMA).select("id", F.explode("bookmakers").alias("b"))
    d = d.select("id", F.explode("b.markets").alias("m")).where(F.col("m.key") == market)
    d = d.select("id", F.explode("m.outcomes").alias("o")).where(F.col("o.price").isNotNull() & (F.col("o.name") != ""))
    return d.groupBy("id", F.col("o.name").alias("name")).agg(F.round(F.avg("o.price"), 3).alias("price"))


def calendar_sessions(calendar: DataFrame, slots: int = 5) -> DataFrame:
    """Session1..n / Session1..n time columns to rows, for rounds that have Qualifying and Race."""
    pairs = F.array(
        *[F.struct(F.col(f"session{i}").alias("session"), F.col(f"session{i}_utc").alias("ts")) for i in range(1, slots + 1)]
    )
    d = calendar.select("year", "round", F.explode(pairs).alias("s")).select("year", "round", "s.*")
    d = d.where(F.col("session").isNotNull() & F.col("ts").isNotNull())
    full = d.groupBy("year", "round").agg(
        F.bool_or(F.col("session") == "Qualifying").alias("q"), F.bool_or(F.col("session") == "Race").alias("r")
    )
    return d.join(full.where("q and r").select("year", "round"), ["year", "round"], "left_semi")
