"""Event log, snapshots and the claim ledger as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.operators.grouping import with_index, with_totals

HOURLY_LIMITS = {"login": 8, "bet": 40}


def seconds(ts: Column) -> Column:
    """Whole microseconds since 1970 of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def last_price_before(quotes: DataFrame, keys: Sequence[str], ts: str, tie: str, start: Column, open_from: Column, price: str) -> DataFrame:
    """Snapshots in [open_from, start): number of them and the last price before the start."""
    d = quotes.where((F.col(ts) >= open_from) & (F.col(ts) < start))
    known = F.col(price).isNotNull()
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.max_by(F.when(known, F.col(price)), F.when(known, F.struct(ts, tie))).alias("price_start"),
    )


def source_timeline(log: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str, is_error: Column, hot: bool | None) -> DataFrame:
    """First probe and every change of payload per key; errors are skipped and change nothing.

    A row's predecessor is found by number, so a busy source is not one task's job.
    """
    d = log.where(~is_error).withColumn("_p", F.col(payload))
    d = with_index(d, keys, order, "_i", hot)
    if hot:
        prev = d.select(*keys, (F.col("_i") + 1).alias("_i"), F.col("_p").alias("_prev"), F.lit(True).alias("_has"))
        d = d.join(prev, [*keys, "_i"], "left")
    else:
        w = Window.partitionBy(*keys).orderBy("_i")
        d = d.withColumn("_prev", F.lag("_p").over(w)).withColumn("_has", F.when(F.col("_i") > 1, True))
    first = F.col("_has").isNull()
    changed = ~first & ~F.col("_p").eqNullSafe(F.col("_prev"))
    d = d.withColumn("change", F.when(first, "first").when(changed, "changed"))
    return d.where(F.col("change").isNotNull()).drop("_p", "_i", "_prev", "_has")


def tick_table(log: DataFrame, run: str, ts: str) -> DataFrame:
    """Per run: number of starts and ends, and the time between the first of each."""
    d = log.where(F.col("kind").isin("tick_start", "tick_end"))
    start, end = F.col("kind") == "tick_start", F.col("kind") == "tick_end"
    return d.groupBy(run).agg(
        F.count_if(start).alias("starts"), F.count_if(end).alias("ends"),
        F.min(F.when(start, F.col(ts))).alias("first_start"), F.max(F.when(end, F.col(ts))).alias("last_end"),
    )


def delay_summary(df: DataFrame, keys: Sequence[str], x: str, hot: bool | None) -> DataFrame:
    """Minimum, upper median (element n // 2 of the sorted values) and maximum."""
    d = with_index(df.where(F.col(x).isNotNull()), keys, [x, "event_id"], "_i", hot)
    d = with_totals(d, keys, {"_n": F.count(F.lit(1))}, hot)
    mid = F.col("_i") == F.floor(F.col("_n") / 2) + 1
    return d.groupBy(*keys).agg(
        F.min(x).alias("low"), F.max(F.when(mid, F.col(x))).alias("middle"), F.max(x).alias("high"), F.count(F.lit(1)).alias("n")
    )


def touching(log: DataFrame, run: str, condition: Column) -> DataFrame:
    """All rows of runs in which some row meets the condition."""
    return log.join(log.where(condition).select(run).distinct(), run, "left_semi")


def latest_event(log: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_m"))
    return picked.select(*keys, "_m.*")


def output_tail(lines: DataFrame, step: Sequence[str], at: str, text: str, keep: int = 25, width: int = 300, hot: bool | None = None) -> DataFrame:
    """The last non-empty, non-debug lines of a step without terminal codes, cut to a width."""
    clean = F.rtrim(F.regexp_replace(text, "\x1b\\[[0-9;]*m", ""))
    d = lines.withColumn(text, clean).where((F.col(text) != "") & ~F.col(text).contains("| DEBUG"))
    d = with_index(d, step, [F.desc(at)], "_k", hot).where(F.col("_k") <= keep)
    return d.withColumn(text, F.substring(text, 1, width)).drop("_k")


def rate_limited(requests: DataFrame, keys: Sequence[str], ts: str, tie: str, limit: int, hot: bool | None) -> DataFrame:
    """Number requests per key and clock hour; the first ``limit`` pass."""
    d = requests.withColumn("hour", F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz"))
    d = with_index(d, [*keys, "hour"], [ts, tie], "_k", hot)
    return d.withColumn("earlier", F.col("_k") - 1).withColumn("allowed", F.col("_k") <= limit).drop("_k")


def first_tickets(tickets: DataFrame, accept: Column, slot: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The first accepted ticket of every slot (contest and bettor)."""
    rest = [c for c in tickets.columns if c not in slot]
    picked = tickets.where(accept).groupBy(*slot).agg(F.min_by(F.struct(*rest), F.struct(ts, tie)).alias("_m"))
    return picked.select(*slot, "_m.*")


def with_sequence(tickets: DataFrame, keys: Sequence[str], ts: str, tie: str, hot: bool | None) -> DataFrame:
    return with_index(tickets, keys, [ts, tie], "seq", hot)


def settle(tickets: DataFrame, results: DataFrame) -> DataFrame:
    """Open tickets against the finish: won, lost, or void without a result row.

    tickets: year, round, entrant, event, negate, status. Settled ones pass through unchanged.
    """
    fin = results.select("year", "round", "entrant", F.col("finish_position").alias("finish"), F.lit(True).alias("_found"))
    d = tickets.join(fin, ["year", "round", "entrant"], "left")
    happened = F.when(F.col("event") == "win", F.col("finish") == 1).otherwise(F.col("finish") <= 3)
    true_claim = F.when(F.col("negate"), ~F.coalesce(happened, F.lit(False))).otherwise(F.coalesce(happened, F.lit(False)))
    verdict = F.when(F.col("_found").isNull(), "void").when(true_claim, "won").otherwise("lost")
    return d.withColumn("status", F.when(F.col("status") == "open", verdict).otherwise(F.col("status"))).drop("_found")


def ledger_totals(settled: DataFrame, keys: Sequence[str]) -> DataFrame:
    won, lost = F.count_if(F.col("status") == "won"), F.count_if(F.col("status") == "lost")
    return settled.groupBy(*keys).agg(
        won.alias("won"), lost.alias("lost"), F.count_if(F.col("status") == "void").alias("void"), (won - lost).alias("net")
    )


def due_work(calendar: DataFrame, now: Column, have_result: str = "has_result", have_prediction: str = "has_prediction") -> DataFrame:
    """What a tick at ``now`` should do per contest. calendar: quali, race timestamps and flags.

    Results are due 4 h after the race; a prediction 1 h 45 min after qualifying starts, afterwards
    the grid is checked again until the race; market snapshots run between qualifying and race.
    """
    hours = F.expr
    results_due = (now >= F.col("race") + hours("INTERVAL 4 HOURS")) & ~F.col(have_result)
    ready = now >= F.col("quali") + hours("INTERVAL 105 MINUTES")
    upcoming = now < F.col("race")
    first_upcoming = F.min(F.when(upcoming, F.col("race"))).over(Window.partitionBy("year"))  # a season's calendar
    mine = upcoming & (F.col("race") == first_upcoming)
    predict = (
        F.when(~mine, "no").when(F.col(have_prediction), "regrid").when(ready, "predict").otherwise("wait")
    )
    return calendar.select(
        "*",
        results_due.alias("ingest"),
        predict.alias("predict"),
        ((now >= F.col("quali")) & upcoming).alias("market"),
        ((now >= F.col("race") - hours("INTERVAL 3 DAYS")) & (now <= F.col("race") + hours("INTERVAL 2 DAYS"))).alias("probe"),
    )


def next_and_last(calendar: DataFrame, predictions: DataFrame, results: DataFrame) -> DataFrame:
    """One row: the contest to show next and the last one with a result.

    Next is the newest prediction without a result, else the first scheduled contest after the last.
    """
    key = F.struct("year", "round")
    last = results.agg(F.max(key).alias("last"))
    open_ = predictions.join(results.select("year", "round").distinct(), ["year", "round"], "left_anti")
    pending = open_.agg(F.max(key).alias("pending"))
    later = calendar.crossJoin(F.broadcast(last)).where(key > F.col("last")).agg(F.min(key).alias("later"))
    d = last.crossJoin(pending).crossJoin(later)  # one row each
    pick = F.coalesce("pending", "later")
    return d.select(
        pick["year"].alias("next_year"), pick["round"].alias("next_round"),
        F.col("last.year").alias("last_year"), F.col("last.round").alias("last_round"),
    )


def podium_record(df: DataFrame, predicted_rank: str, replay: Column) -> DataFrame:
    """Per contest: predicted and actual podium as ordered lists, their overlap, a replay flag."""
    fin = F.col("finish_position")
    d = df.where((F.col(predicted_rank) <= 3) | fin.between(1, 3))  # at most six rows per contest
    ordered = lambda c, at: F.transform(
        F.array_sort(F.collect_list(F.when(c, F.struct(at.alias("k"), F.col("entrant").alias("e"))))), lambda x: x["e"]
    )
    g = d.groupBy("year", "round").agg(
        ordered(F.col(predicted_rank) <= 3, F.col(predicted_rank)).alias("predicted"),
        ordered(fin.between(1, 3), fin).alias("actual"), F.bool_or(replay).alias("replay"),
    )
    return g.withColumn("overlap", F.size(F.array_intersect("predicted", "actual")))


def record_summary(record: DataFrame) -> DataFrame:
    live = ~F.col("replay")
    return record.agg(
        F.count(F.lit(1)).alias("contests"), F.count_if(live).alias("live"), F.avg("overlap").alias("mean_overlap"),
        F.count_if(F.col("predicted")[0] == F.col("actual")[0]).alias("winner_hits"),
    )

