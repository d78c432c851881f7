"""Small hand-computed frames for the rules that are easy to get wrong."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldorder.functions import lookups as lk
from fieldorder.functions import scalars as fn
from fieldorder.operators import features as ft
from fieldorder.operators import joins as jn
from fieldorder.operators import ledger as lg
from fieldorder.operators import market as mk
from fieldorder.operators import scoring as sc
from fieldorder.sources import flatten as fl
from fieldorder.sources import merge as mg

S = ft.Sizes(contest=False, history=False)


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("status,dnf", [("", 0), (None, 0), ("Finished", 0), ("+2 Laps", 0), (" Lapped ", 0), ("Engine", 1)])
def test_dnf(spark, status, dnf):
    assert one(spark, fn.is_dnf, status) == dnf


@pytest.mark.parametrize("text,s", [("1:23.5", 83.5), ("83.5", 83.5), ("1:xx", None), ("", None), (None, None), ("1:2:3", None)])
def test_duration(spark, text, s):
    assert one(spark, fn.duration_seconds, text) == s


def test_accent_table_is_the_unicode_one():
    for a, b in zip(fn.ACCENTED, fn.BASE, strict=True):
        assert unicodedata.normalize("NFKD", a).encode("ascii", "ignore").decode() == b


@pytest.mark.parametrize("event,loc,year,venue", [
    ("Spanish Grand Prix", None, 2025, "barcelona"), ("Spanish Grand Prix", None, 2026, "madrid"),
    ("Spanish Grand Prix", "Barcelona", 2026, "barcelona"), ("Bahrain GP", "Kuala Lumpur", 2026, "sepang"),
    ("Moon GP", None, 2026, "moon_gp"), (None, None, 2026, "unknown"), (None, "São Paulo", 2020, "interlagos"),
])
def test_venue(spark, event, loc, year, venue):
    df = spark.createDataFrame([(event, loc, year)], "e string, l string, y int")
    assert df.select(fn.canonical_venue(F.col("e"), F.col("l"), F.col("y")).alias("v")).first()["v"] == venue


def test_grid_bins(spark):
    got = [one(spark, lk.grid_bin, v, "int") for v in (1, 2, 3, 6, 10, 15, 16, None)]
    assert got == ["P1", "P2", "P3", "P4-6", "P7-10", "P11-15", "P16+", "P16+"]


def test_clip_keeps_missing(spark):
    assert one(spark, lambda x: ft.clip(x, -1.0, 1.0), None, "double") is None


def test_price_rules(spark):
    rows = [(0.0, 0.01, 0.10), (0.0, 0.99, 0.2), (None, 0.4, 0.0), (0.3, 0.3, 0.31)]
    df = spark.createDataFrame(rows, "b double, a double, l double")
    got = [r["p"] for r in df.select(mk.quote_price(F.col("b"), F.col("a"), F.col("l")).alias("p")).collect()]
    assert got == [0.005, 0.2, None, 0.31]


def test_calibration_error_drops_p_one(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 0.05, 0)], "g int, p double, y int")
    got = sc.calibration_error(df, ["g"], F.col("p"), F.col("y"), "e").first()["e"]
    assert abs(got - 0.05 / 2) < 1e-12


def test_single_entrant_contest(spark):
    df = spark.createDataFrame([(2000, 1, 7, 1, 1, 0, 3)], "year int, round int, entrant bigint, grid_position int, finish_position int, dnf int, points int")
    assert ft.grid_relative(df, S).first()["grid_position_rel"] is None


def test_classified_dnf_is_no_finisher(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (None, 0)], "finish_position int, dnf int")
    assert [r["finish_position"] for r in df.where(ft.classified()).collect()] == [1]


@pytest.mark.parametrize("crowd", [64, 1])
def test_later_span_wins_and_longer_one_is_found(spark, crowd, monkeypatch):
    monkeypatch.setattr(jn, "CROWD", crowd)
    spans = spark.createDataFrame([(1, 1, 1, 30), (2, 1, 5, 10), (3, 1, 8, 9)], "id bigint, k int, lo int, hi int")
    pts = spark.createDataFrame([(1, 1, 8), (2, 1, 10), (3, 1, 20), (4, 1, 31), (5, 1, 0), (6, 2, 5)], "row bigint, k int, at int")
    d = jn.covering_span(pts, spans, ["k"], "at", "lo", "hi", ["id"], "id")
    assert {r["row"]: r["id"] for r in d.collect()} == {1: 3, 2: 2, 3: 1, 4: None, 5: None, 6: None}
    assert jn.covering_span(pts, spans.where("false"), ["k"], "at", "lo", "hi", ["id"], "id").where("id IS NULL").count() == 6


@pytest.mark.parametrize("crowd", [64, 10_000])
def test_nested_spans_leave_one_row_a_block(spark, crowd, monkeypatch):
    monkeypatch.setattr(jn, "CROWD", crowd)
    import random

    rnd = random.Random(2)
    rows = [(i, 1, i, 4000 - i) for i in range(1500)]  # each lies in the one before
    for i in range(1500, 1800):
        lo = rnd.randrange(-500, 4500)
        rows.append((i, rnd.choice([1, 2]), lo, lo + rnd.choice([-1, 0, 1, 7, 600])))
    spans = spark.createDataFrame(rows, "id bigint, k int, lo int, hi int")
    asked = [(i, rnd.choice([1, 1, 2, None]), rnd.choice([rnd.randrange(-600, 5000), None])) for i in range(400)] + [(9, 1, 5)] * 2
    d = jn.covering_span(spark.createDataFrame(asked, "row bigint, k int, at int"), spans, ["k"], "at", "lo", "hi", ["id"], "id")
    want = []
    for row, k, at in asked:
        fit = [(lo, i) for i, kk, lo, hi in rows if k == kk and at is not None and lo <= at <= hi]
        want.append((row, max(fit)[1] if fit else -1))
    assert sorted((r["row"], -1 if r["id"] is None else r["id"]) for r in d.collect()) == sorted(want)
    blocks = spans.select(F.explode(jn.aligned_blocks(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"), 13)).alias("b"), "id")
    most = blocks.groupBy("id").count().agg(F.max("count")).first()[0]
    assert most <= 24 and spans.where("hi >= lo").select("id").distinct().count() == blocks.select("id").distinct().count()


@pytest.mark.parametrize("hot", [True, False])
def test_as_of_directions(spark, hot):
    right = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 5, 3)], "k int, t int, id bigint")
    left = spark.createDataFrame([(1, 1, 20), (2, 1, 9), (3, 1, 15), (4, 2, 100), (5, 3, 1)], "row bigint, k int, a int")
    back = jn.asof(left, right, ["k"], "a", "t", ["id"], "id", hot)
    assert {r["row"]: r["match"] and r["match"]["id"] for r in back.collect()} == {1: 2, 2: None, 3: 1, 4: 3, 5: None}
    ahead = jn.asof(left, right, ["k"], "a", "t", ["id"], "id", hot, forward=True)
    assert {r["row"]: r["match"] and r["match"]["id"] for r in ahead.collect()} == {1: 2, 2: 1, 3: 2, 4: None, 5: None}


@pytest.mark.parametrize("hot", [True, False])
def test_neighbours_in_time_against_pairs(spark, hot):
    import random

    rnd = random.Random(7)
    marks = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([*range(0, 300, 3), None]), i) for i in range(200)]
    asks = [(i, rnd.choice([1, 1, 2, 3, None]), rnd.choice([*range(-20, 320), None])) for i in range(300)] + [(7, 1, 30)] * 3
    right = spark.createDataFrame(marks, "k int, t int, id bigint").repartition(3)
    left = spark.createDataFrame(asks, "row bigint, k int, a int").repartition(5)
    both = [jn.asof(left, right, ["k"], "a", "t", ["id"], "id", hot, forward=x) for x in (False, True)]
    got = [sorted((r["row"], r["match"]["id"] if r["match"] else -1) for r in d.collect()) for d in both]
    want = [[], []]
    for row, k, a in asks:
        fit = [(t, i) for kk, t, i in marks if kk is not None and kk == k and t is not None and a is not None]
        want[0].append((row, max([x for x in fit if x[0] <= a], default=(0, -1))[1] if fit else -1))
        want[1].append((row, min([x for x in fit if x[0] >= a], default=(0, -1))[1] if fit else -1))
    assert got == [sorted(w) for w in want]
    near, first = [], []
    for row, _, a in asks:
        fit = [(t, i) for _, t, i in marks if t is not None and a is not None]
        near.append((row, min([(abs(t - a), i) for t, i in fit if abs(t - a) <= 10], default=(0, -1))[1]))
        first.append((row, min([(t, i) for t, i in fit if 0 <= t - a <= 10], default=(0, -1))[1]))
    for f, rows in ((jn.nearest, near), (jn.first_after, first)):
        out = f(left, right, "a", "t", "id", 10, hot)
        assert out.columns == ["row", "k", "a", "id"]
        assert sorted((r["row"], -1 if r["id"] is None else r["id"]) for r in out.collect()) == sorted(rows)
        assert f(left, right.where("false"), "a", "t", "id", 10, hot).where("id IS NULL").count() == len(asks)


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize("crowd", [64, 2])
def test_traffic_against_pairs(spark, hot, crowd, monkeypatch):
    monkeypatch.setattr(jn, "CROWD", crowd)
    import random

    rnd = random.Random(4)
    rows = [(2000, 1, i, rnd.choice([*range(1, 12), 12, 12, 12, 19]), float(rnd.randrange(1400, 1600, 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "year int, round int, entrant bigint, grid_position int, e double")
    s = ft.Sizes(contest=hot, history=False)
    got = {r["entrant"]: (r["stronger_behind_n"], r["weaker_ahead_n"]) for r in jn.traffic(df, F.col("e"), "entrant", s).collect()}
    for _, _, i, g, e in rows:
        sb = sum(1 for r in rows if g < r[3] <= g + 5 and r[4] > e + 25)
        wa = sum(1 for r in rows if g - 5 <= r[3] < g and r[4] < e - 25)
        assert got[i] == (sb, wa)


def test_replace_takes_whole_contests(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "a")], "year int, round int, who string")
    new = spark.createDataFrame([(1, 1, "c")], "year int, round int, who string")
    assert sorted(map(tuple, mg.replace_contests(old, new).collect())) == [(1, 1, "c"), (1, 2, "a")]
    assert len(mg.upsert(old, new, ["year", "round", "who"]).collect()) == 4


def test_change_only_write(spark, tmp_path):
    path = str(tmp_path / "doc")
    df = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "k int, v string, ts string")
    assert mg.write_if_changed(spark, df, path, ["k"], ["v"])
    later = df.withColumn("ts", F.lit("t2"))
    assert not mg.write_if_changed(spark, later, path, ["k"], ["v"])
    moved = later.withColumn("v", F.when(F.col("k") == 2, "c").otherwise(F.col("v")))
    assert [r["k"] for r in mg.changed_documents(df, moved, ["k"], ["v"]).collect()] == [2]
    assert mg.write_if_changed(spark, moved, path, ["k"], ["v"])


def test_table_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "round int, v int, year int"
    mg.write_table(spark.createDataFrame([(1, 1, 2000), (1, 2, 2001)], schema), path, ["year"])
    mg.write_table(spark.createDataFrame([(2, 9, 2001)], schema), path, ["year"])
    got = sorted((r["year"], r["v"]) for r in mg.read_table(spark, path, schema).collect())
    assert got == [(2000, 1), (2001, 9)]
    with pytest.raises(FileNotFoundError, match="collector"):
        mg.read_table(spark, str(tmp_path / "none"), schema)
    log = str(tmp_path / "log")
    mg.append_event_log(spark.createDataFrame([("t", 1)], "kind string, n int"), log)
    mg.append_event_log(spark.createDataFrame([("u", 2)], "kind string, n int"), log)
    assert mg.read_event_log(spark, log, "kind string, n int").count() == 2
    snap = str(tmp_path / "snap")
    mg.append_rows(spark.createDataFrame([(1,)], "n int"), snap)
    mg.append_rows(spark.createDataFrame([(2,)], "n int"), snap)
    assert spark.read.parquet(snap).count() == 2


def test_settlement_rules(spark):
    res = spark.createDataFrame([(1, 1, 7, 1), (1, 1, 8, None), (1, 1, 9, 3)], "year int, round int, entrant bigint, finish_position int")
    rows = [(7, "win", False, "open"), (8, "podium", False, "open"), (8, "podium", True, "open"), (9, "podium", True, "open"), (5, "win", False, "open"), (7, "win", False, "lost")]
    t = spark.createDataFrame([(1, 1, *r) for r in rows], "year int, round int, entrant bigint, event string, negate boolean, status string")
    got = sorted((r["entrant"], r["negate"], r["status"]) for r in lg.settle(t, res).collect())
    assert got == sorted([(7, False, "won"), (8, False, "lost"), (8, True, "won"), (9, True, "lost"), (5, False, "void"), (7, False, "lost")])


def test_long_document_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(fl, "PART_ROWS", 3)
    df = spark.createDataFrame([(1, i) for i in range(8)], "k int, v int")
    docs = fl.documents(df, ["k"], ["v"], F.struct("v"), "items", False)
    assert sorted(r["part"] for r in docs.collect()) == [0, 1, 2]


def test_backfill_reports_added_columns(spark):
    df = spark.createDataFrame([(2000, 1, "5"), (2000, 3, "x")], "year int, round int, grid_position string")
    d, added = mg.backfill(df, ["grid_position", "round_fraction", "fp_longrun_gap_pct"])
    assert added == ["round_fraction", "fp_longrun_gap_pct"]
    got = {r["round"]: (r["grid_position"], r["round_fraction"], r["fp_longrun_gap_pct"]) for r in d.collect()}
    assert got == {1: (5.0, 0.0, None), 3: (5.0, 1.0, None)}


def test_changed_documents_sees_values_that_move_between_columns(spark):
    old = spark.createDataFrame([(1, None, 5), (2, 1, None)], "k long, a long, b long")
    new = spark.createDataFrame([(1, 5, None), (2, 1, None)], "k long, a long, b long")
    assert [r["k"] for r in mg.changed_documents(old, new, ["k"], ["a", "b"]).collect()] == [1]


def test_walk_forward_on_the_season_tested_last(spark):
    from fieldorder.operators import scoring as sc

    loss = {1990: {0.5: 1.0, 1.0: 9.0, 2.0: 3.0}, 1991: {0.5: 4.0, 1.0: 0.0, 2.0: 2.0}, 1994: {0.5: 7.0, 1.0: 1.0, 2.0: 8.0}}
    rows = [(y, 1, t, x) for y, by in loss.items() for t, x in by.items()]
    got = sc.walk_forward(spark.createDataFrame(rows, "year int, round int, temperature double, ll_top3 double"), True).collect()
    assert sorted((r["year"], r["temperature"], r["ll_top3"]) for r in got) == [(1990, 1.0, 9.0), (1991, 0.5, 4.0), (1994, 2.0, 8.0)]


def test_ewm_of_a_long_history_for_any_span(spark):
    import numpy as np
    import pandas as pd

    from fieldorder.operators.history import with_ewm

    x = np.random.default_rng(1).integers(1, 100, 1500).astype(float)
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    for span in (5, 50, 200, 500):
        want = pd.Series(x).ewm(span=span).mean().shift(1)
        for hot in (False, True):
            got = with_ewm(d, ["k"], ["i"], d["v"], span, "m", hot=hot).orderBy("i").toPandas()["m"]
            assert np.allclose(got[1:], want[1:], rtol=1e-9, atol=0)


def test_appended_batches_come_once(spark, tmp_path):
    path = str(tmp_path / "log")
    d = spark.range(10).repartition(3)
    assert mg.append_once(d, path, 4) and not mg.append_once(d, path, 4) and mg.append_once(d.where("id < 2"), path, 5)
    broken = d.select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception):
        mg.append_once(broken, path, 6)
    assert mg.append_once(d.where("id = 9"), path, 6)
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.collect())) == sorted([(i, 4) for i in range(10)] + [(0, 5), (1, 5), (9, 6)])


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    mg.swap_table(spark.range(5), path)
    with pytest.raises(Exception):
        mg.swap_table(spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    mg.swap_table(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
