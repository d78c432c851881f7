"""Streams whose result depends on the order of events: rows wait in keyed state until the watermark has passed them.

Files may come in any order, late or twice. A row is kept under its time and id, so a second delivery changes nothing;
once the watermark is beyond its time no earlier row can come, and the rows are worked off in order. A position behind
the last one worked off is a repeat. What arrives later than the watermark allows is dropped by Spark, as everywhere.

State per key: the rows still waiting, the last position, and what the operator remembers.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldorder.functions.scalars import accepted, claim_probability
from fieldorder.operators.ratings import STEP, Elo, win_sums

#: The processors travel to Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HOUR = 3_600_000_000

#: Types that a payload may have.
TYPES = {"int": int, "long": int, "double": float, "string": str}


class InOrder(StatefulProcessor):
    """Base: ``advance(key, rows)`` gets rows (ts in microseconds, id, *payload) in order, each once."""

    #: Columns beside ts and id, with types.
    payload = ""
    #: Result columns, in order.
    out: Sequence[str] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, id long", self.payload)
        self.last = handle.getValueState("last", "ts long, id long")
        self.remember(handle)

    def remember(self, handle: StatefulProcessorHandle) -> None:
        """Open the operator's own state."""

    def advance(self, key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else (-(2**63), 0)
        kinds = [TYPES[c.split()[1]] for c in self.payload.split(",")]  # pandas holds numbers beside nulls as floats
        first = None
        for pdf in rows:
            for at, i, *payload in pdf.drop(columns=list(pdf.columns[: len(key)])).itertuples(index=False, name=None):
                place = (pd.Timestamp(at).value // 1000, int(i))
                if place > last:
                    self.waiting.updateValue(place, tuple(None if pd.isna(v) else kind(v) for kind, v in zip(kinds, payload)))
                    first = place[0] if first is None else min(first, place[0])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, next_ = [], None
        for place, payload in self.waiting.iterator():
            if place[0] < passed:
                due.append((*place, *payload))
            else:
                next_ = place[0] if next_ is None else min(next_, place[0])
        if next_ is not None:
            self.handle.registerTimer(next_ // 1000 + 1)
        if due:
            due.sort(key=lambda r: r[:2])
            found = list(self.advance(key, due))
            for r in due:
                self.waiting.removeKey(r[:2])
            self.last.update(due[-1][:2])
            if found:
                yield pd.DataFrame(found, columns=list(self.out))

    def close(self) -> None:
        pass


def in_order(df: DataFrame, keys: Sequence[str], ts: str, order: str, payload: Sequence[str], late: str, processor: InOrder, schema: str) -> DataFrame:
    """Run a processor over the stream; ``order`` is a whole-number id that breaks ties of time."""
    spark: SparkSession = df.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)  # keyed state with timers needs it
    d = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    d = d.select(*keys, "_ts", F.col(order).cast("long").alias("_id"), *payload)
    return d.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Timeline(InOrder):
    payload = "n long, is_error int"
    out = ("source", "item", "event_id", "n", "change")

    def remember(self, handle):
        self.seen = handle.getValueState("seen", "n long")

    def advance(self, key, rows):
        had = self.seen.exists()
        n = self.seen.get()[0] if had else None
        for _, event, new, error in rows:
            if error:
                continue
            if not had or new != n:
                yield (*key, event, new, "changed" if had else "first")
            had, n = True, new
        if had:
            self.seen.update((n,))


def source_changes(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """First probe and every payload change per (source, item) in time order; errors change nothing."""
    schema = "source string, item long, event_id long, n long, change string"
    d = log.withColumn("item", F.col("item").cast("long")).withColumn("n", F.col("n").cast("long"))
    return in_order(d, ["source", "item"], "ts", "event_id", ["n", "is_error"], late, Timeline(), schema)


class Requests(InOrder):
    payload = "_none int"
    out = ("key", "event_id", "hour_us", "earlier", "allowed")

    def __init__(self, limit: int):
        self.limit = limit

    def remember(self, handle):
        self.count = handle.getValueState("count", "hour long, n long")

    def advance(self, key, rows):
        hour, n = self.count.get() if self.count.exists() else (None, 0)
        for at, event, _ in rows:
            if at - at % HOUR != hour:
                hour, n = at - at % HOUR, 0
            yield key[0], event, hour, n, n < self.limit
            n += 1
        self.count.update((hour, n))


def request_decisions(requests: DataFrame, key: str, limit: int, late: str = "1 hour", order: str = "event_id") -> DataFrame:
    """Number of earlier requests of the key in the clock hour, and whether the request passes."""
    d = requests.withColumn("_none", F.lit(0))
    schema = "key string, event_id long, hour_us long, earlier long, allowed boolean"
    got = in_order(d, [key], "ts", order, ["_none"], late, Requests(limit), schema)
    return got.select(F.col("key").alias(key), F.col("event_id").alias(order), F.timestamp_micros("hour_us").alias("hour"), "earlier", "allowed")


class Tickets(InOrder):
    payload = "settles long"
    out = ("year", "round", "bettor", "ticket_id")

    def remember(self, handle):
        self.taken = handle.getValueState("taken", "ticket long, settles long")

    def advance(self, key, rows):
        if not self.taken.exists():
            _, ticket, settles = rows[0]
            self.taken.update((ticket, settles))
            if settles is not None:
                self.handle.registerTimer(settles)
            yield (*key, ticket)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        if self.taken.exists():
            settles = self.taken.get()[1]
            if settles is not None and settles <= timerValues.getCurrentWatermarkInMs():  # no ticket is taken any more
                self.taken.clear()
                self.waiting.clear()


def accepted_tickets(tickets: DataFrame, late: str = "7 days", settles: str | None = None) -> DataFrame:
    """The earliest accepted ticket per contest and bettor, whatever order tickets arrive in.

    A slot is held until its contest is settled (``settles``: a time after all its tickets), without one for good.
    """
    p = claim_probability(F.col("p_pct") / 100.0, F.col("negate"))
    until = F.unix_millis(F.col(settles).cast("timestamp")) if settles else F.lit(None).cast("long")
    d = tickets.where(accepted(p)).withColumn("settles", until)
    schema = "year int, round int, bettor long, ticket_id long"
    return in_order(d, ["year", "round", "bettor"], "ts", "ticket_id", ["settles"], late, Tickets(), schema)


class Ratings(InOrder):
    payload = "year int, round int, finish_position int, dnf int"
    out = ("league", "year", "round", "entrant", "driver_elo")

    def __init__(self, p: Elo):
        self.p = p

    def remember(self, handle):
        self.rating = handle.getMapState("rating", "entrant long", "value double, season long")
        self.season = handle.getValueState("season", "year int, season long")

    def value(self, entrant: int, season: int) -> float:
        """The rating with the carries of the seasons since it was stored."""
        if not self.rating.containsKey((entrant,)):
            return self.p.start
        v, then = self.rating.getValue((entrant,))
        for _ in range(season - then):
            v = v * self.p.carry + self.p.start * (1 - self.p.carry)
        return v

    def advance(self, key, rows):
        year, season = self.season.get() if self.season.exists() else (None, 0)
        for (now, rnd), contest in groupby(rows, key=lambda r: (r[2], r[3])):
            contest = list(contest)
            if year is not None and now > year:
                season += 1
            year = now
            who = [r[1] for r in contest]
            pre = np.array([self.value(w, season) for w in who])
            yield from ((key[0], now, rnd, w, float(v)) for w, v in zip(who, pre))
            ok = np.array([r[5] == 0 and r[4] is not None for r in contest])
            post = pre.copy()
            if ok.sum() > 1:
                place = pd.Series([r[4] for r, k in zip(contest, ok) if k]).rank(method="average").to_numpy()
                post[ok] += self.p.k / (ok.sum() - 1) * (1.0 - place + win_sums(pre[ok] * STEP))
            for w, v in zip(who, post):
                self.rating.updateValue((w,), (float(v), season))
        self.season.update((year, season))


def elo_stream(results: DataFrame, late: str = "31 days", p: Elo = Elo()) -> DataFrame:
    """Ratings before each contest, per league: a contest is rated once the watermark passes its day.

    ``results``: league, year, round, entrant, finish_position, dnf, and ``ts``, the same for all rows of a contest
    and rising from contest to contest. State holds one number per entrant; a new season's carry is applied when an
    entrant is next read, so no contest touches entrants who are not in it.
    """
    schema = "league string, year int, round int, entrant long, driver_elo double"
    return in_order(results, ["league"], "ts", "entrant", ["year", "round", "finish_position", "dnf"], late, Ratings(p), schema)
