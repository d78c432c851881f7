"""Stream twins end up with the batch operators' rows on the same files."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldorder.functions.scalars import accepted, claim_probability
from fieldorder.operators import ledger as lg
from fieldorder.operators import ratings as rt
from fieldorder.sources.tables import Tables
from fieldorder.streaming import log_streams as st
from fieldorder.streaming import ordered_streams as ost

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def feed(spark, tables, tmp_path_factory):
    """A view written as several files in time order, to be read one file per batch."""

    def write(name):
        path = str(tmp_path_factory.mktemp(name))
        df = getattr(tables, name)
        rows = df.orderBy("ts", df.columns[0]).coalesce(1)
        n = rows.count()
        schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
        rows.write.option("maxRecordsPerFile", n // 4 + 1).mode("overwrite").parquet(path)
        return path, schema

    return write


def run(df, tmp_path, name):
    out, cp = str(tmp_path / name), str(tmp_path / (name + "_cp"))
    st.append_sink(df, out, cp).awaitTermination(120)
    return df.sparkSession.read.parquet(out)


def test_snapshot_stream(spark, tables, feed, tmp_path):
    path, schema = feed("quotes")
    lo, hi = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 00:00:00", "2024-01-12 00:00:00")]
    got = run(st.snapshots(st.read_stream(spark, path, schema, files_per_trigger=1), hi, lo, "30 days"), tmp_path, "snap")
    want = tables.quotes.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in want.select("event_id").collect())


@pytest.fixture(scope="module")
def disordered(spark, tmp_path_factory):
    """Rows as files in any order, some of them twice; a last file far ahead lets the watermark pass everything else."""

    def write(df, close):
        path = str(tmp_path_factory.mktemp("disordered"))
        rows = df.orderBy(F.xxhash64(F.lit(11), *df.columns)).coalesce(1).collect()
        r, n = random.Random(5), len(rows)
        files = [rows[n * k // 5 : n * (k + 1) // 5] + r.sample(rows, n // 10) for k in range(5)] + [r.sample(rows, n // 3), [close]]
        for k, part in enumerate(files):
            r.shuffle(part)
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
            for f in glob.glob(f"{path}/part-*.parquet"):
                os.utime(f, (1_700_000_000 + k,) * 2) if os.path.getmtime(f) > 1_700_001_000 else None
        return path, df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    return write


FAR = datetime.datetime(2100, 1, 1)


def closing(df, **values):
    """A row like the others, far ahead in time."""
    return df.first().asDict() | {"ts": FAR} | values


def rows_of(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_timeline_stream(spark, tables, disordered, tmp_path):
    log = tables.oplog.select("source", "item", "event_id", "ts", "n", "is_error")
    path, schema = disordered(log, tuple(closing(log, source="end", event_id=-1).values()))
    got = run(ost.source_changes(st.read_stream(spark, path, schema, files_per_trigger=1), "3000 days"), tmp_path, "tl")
    want = lg.source_timeline(tables.oplog, ["source", "item"], ["ts", "event_id"], "n", F.col("is_error") == 1, False)
    cols = ["source", "item", "event_id", "n", "change"]
    assert rows_of(got, cols) == rows_of(want, cols)


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    """In order and on time: early results come before the stream ends, and a row that is too late is left out."""
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    files = [[(1, day(1), 5), (2, day(1, 1), 5)], [(4, day(3), 7)], [(3, day(2, 23), 6)], [(5, day(9), 8)], [(8, day(10), 8)], [(6, day(1, 2), 99)], [(7, day(20), 8)]]
    schema = "event_id long, ts timestamp_ntz, n long"
    path = str(tmp_path / "in")
    for k, part in enumerate(files):
        d = spark.createDataFrame(part, schema).selectExpr("'s' AS source", "1L AS item", "event_id", "ts", "n", "0 AS is_error")
        d.coalesce(1).write.mode("append").parquet(path)
        for f in glob.glob(f"{path}/part-*.parquet"):
            os.utime(f, (1_700_000_000 + k,) * 2) if os.path.getmtime(f) > 1_700_001_000 else None
    s = st.read_stream(spark, path, "source string, item long, event_id long, ts timestamp_ntz, n long, is_error int", files_per_trigger=1)
    got = run(ost.source_changes(s, "2 days"), tmp_path, "late")
    assert rows_of(got, ["event_id", "change"]) == [(1, "first"), (3, "changed"), (4, "changed"), (5, "changed")]


def test_request_decisions_stream(spark, tables, disordered, tmp_path):
    e = tables.read("events").select("event_id", "event_type", "ts")
    path, schema = disordered(e, tuple(closing(e, event_type="end", event_id=-1).values()))
    got = run(ost.request_decisions(st.read_stream(spark, path, schema, files_per_trigger=1), "event_type", 2, "3000 days"), tmp_path, "req")
    want = lg.rate_limited(e, ["event_type"], "ts", "event_id", 2, False).withColumn("hour", F.col("hour").cast("timestamp"))
    cols = ["event_type", "event_id", "hour", "earlier", "allowed"]
    assert rows_of(got, cols) == rows_of(want, cols)


def test_ticket_stream(spark, tables, disordered, tmp_path):
    t = tables.tickets
    path, schema = disordered(t, tuple(closing(t, year=2100, ticket_id=-1, p_pct=1, negate=False).values()))
    s = st.read_stream(spark, path, schema, files_per_trigger=1)
    p = claim_probability(F.col("p_pct") / 100.0, F.col("negate"))
    keys = ["year", "round", "bettor", "ticket_id"]
    want = rows_of(lg.first_tickets(t, accepted(p), keys[:3], "ts", "ticket_id"), keys)
    assert rows_of(run(ost.accepted_tickets(s, "3000 days"), tmp_path, "tk"), keys) == want
    held = s.withColumn("over", F.lit("2090-01-01").cast("timestamp"))
    assert rows_of(run(ost.accepted_tickets(held, "3000 days", "over"), tmp_path, "tk2"), keys) == want


def test_elo_stream(spark, tables, disordered, tmp_path):
    cols = ["league", "year", "round", "entrant"]
    r = tables.results.where("year < 1997").select(*cols, "finish_position", "dnf", F.make_timestamp_ntz("year", "round", F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"))
    path, schema = disordered(r, tuple(closing(r, league="end").values()))
    got = run(ost.elo_stream(st.read_stream(spark, path, schema, files_per_trigger=1), "9000 days"), tmp_path, "elo")
    want = rt.elo_ratings(tables.results.where("year < 1997"), hot=False)
    a, b = ({tuple(x[c] for c in cols): x["driver_elo"] for x in d.collect()} for d in (got, want))
    assert set(a) == set(b) and max(abs(a[k] - b[k]) for k in a) < 1e-9 and len({round(v, 3) for v in a.values()}) > 10


def test_hourly_count_stream(spark, tables, feed, tmp_path):
    """Hours the watermark has passed are emitted once, with the batch counts."""
    path, schema = feed("oplog")
    got = run(st.request_counts(st.read_stream(spark, path, schema, files_per_trigger=1), ["kind"]), tmp_path, "rate")
    d = tables.oplog.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp"))
    want = {(r["kind"], r["hour"]): r["n"] for r in d.groupBy("kind", "hour").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = got.collect()
    assert rows and len({(r["kind"], r["hour"]) for r in rows}) == len(rows)
    assert all(want[(r["kind"], r["hour"])] == r["n"] for r in rows)
    assert len(rows) >= len(want) - 10


def test_settlement_stream(spark, tables, feed, tmp_path):
    path, schema = feed("tickets")
    res = tables.results.select("year", "round", "entrant", "finish_position")
    got = run(st.settled_stream(st.read_stream(spark, path, schema, files_per_trigger=1), res), tmp_path, "set")
    want = lg.settle(tables.tickets.withColumn("status", F.lit("open")), res)
    cols = ["ticket_id", "finish", "status"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
