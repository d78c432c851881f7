"""The split plans for large groups give the same rows as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldorder.operators import grouping as g
from fieldorder.operators import history as h


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 900
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, 1, rng.integers(2, 12, n)),  # one key holds most rows
        "t": rng.permutation(n), "v": rng.integers(0, 15, n).astype(float),
    })
    pdf.loc[rng.random(n) < 0.15, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.repartition(5).cache(), pdf


def rows(df, *cols):
    return sorted(tuple(None if x is None else round(float(x), 9) for x in r) for r in df.select(*cols).collect())


def test_index_both_ways(frame):
    df, _ = frame
    a = g.with_index(df, ["k"], [F.desc("v"), "t"], "i", hot=False)
    b = g.with_index(df, ["k"], [F.desc("v"), "t"], "i", hot=True)
    assert rows(a, "k", "t", "i") == rows(b, "k", "t", "i")


@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_both_ways(frame, inclusive):
    df, _ = frame
    sums = {"s": F.col("v"), "n": F.lit(1)}
    a = g.with_prefix(df, ["k"], ["t"], sums, hot=False, inclusive=inclusive)
    b = g.with_prefix(df, ["k"], ["t"], sums, hot=True, inclusive=inclusive)
    assert rows(a, "k", "t", "s", "n") == rows(b, "k", "t", "s", "n")


@pytest.mark.parametrize("method", ["min", "average"])
@pytest.mark.parametrize("hot", [True, False])
def test_rank_matches_pandas(frame, method, hot):
    df, pdf = frame
    got = g.with_rank(df, ["k"], F.col("v"), "r", method, descending=True, hot=hot)
    want = pdf.assign(r=pdf.groupby("k")["v"].rank(ascending=False, method=method))
    want = sorted((float(k), float(t), None if pd.isna(r) else round(float(r), 9)) for k, t, r in want[["k", "t", "r"]].to_numpy())
    assert rows(got, "k", "t", "r") == want


@pytest.mark.parametrize("hot", [True, False])
def test_quantiles_match_pandas(frame, hot):
    df, pdf = frame
    got = g.quantiles(df, ["k"], F.col("v"), {"a": 0.25, "m": 0.5, "z": 0.9}, hot)
    want = pdf.groupby("k")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    want = sorted((float(k), *[round(float(x), 9) for x in r]) for k, r in zip(want.index, want.to_numpy()))
    assert rows(got, "k", "a", "m", "z") == want


def test_totals_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    for hot in (True, False):
        got = {(r["k"], r["v"]): r["s"] for r in g.with_totals(df, ["k"], {"s": F.sum("v")}, hot).collect()}
        assert got == {(None, 1): 3, (None, 2): 3, ("a", 5): 5}


@pytest.mark.parametrize("hot", [True, False])
def test_rolling_counts_rows_not_values(frame, hot, monkeypatch):
    monkeypatch.setattr(h, "CHUNK_ROWS", 64)  # several chunks per key
    df, pdf = frame
    got = h.with_rolling_means(df, ["k"], ["t"], {"m": (F.col("v"), 5, 2), "x": (F.col("v"), 10, 1)}, hot)
    o = pdf.sort_values("t")
    by = o.groupby("k")["v"]
    o["m"] = by.transform(lambda s: s.shift(1).rolling(5, min_periods=2).mean())
    o["x"] = by.transform(lambda s: s.shift(1).rolling(10, min_periods=1).mean())
    want = sorted(tuple(None if pd.isna(x) else round(float(x), 9) for x in r) for r in o[["k", "t", "m", "x"]].to_numpy())
    assert rows(got, "k", "t", "m", "x") == want


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize("ignore_na,least,span", [(False, 1, 5), (True, 3, 8), (True, 3, 10)])
def test_weighted_mean_matches_pandas(frame, hot, ignore_na, least, span):
    """The big key has more rows than one block, so the carried part is exercised."""
    df, pdf = frame
    got = h.with_ewm(df, ["k"], ["t"], F.col("v"), span, "m", least, ignore_na, hot)
    o = pdf.sort_values("t")
    o["m"] = o.groupby("k")["v"].transform(lambda s: s.shift(1).ewm(span=span, min_periods=least, ignore_na=ignore_na).mean())
    want = sorted(tuple(None if pd.isna(x) else round(float(x), 9) for x in r) for r in o[["k", "t", "m"]].to_numpy())
    assert rows(got, "k", "t", "m") == want


@pytest.mark.parametrize("hot", [True, False])
def test_last_seen(frame, hot):
    df, pdf = frame
    got = h.with_last_seen(df, ["k"], ["t"], F.col("v"), "p", hot)
    o = pdf.sort_values("t")
    o["p"] = o.groupby("k")["v"].transform(lambda s: s.ffill().shift(1))
    want = sorted(tuple(None if pd.isna(x) else round(float(x), 9) for x in r) for r in o[["k", "t", "p"]].to_numpy())
    assert rows(got, "k", "t", "p") == want


def test_recent_years_counts_same_year_visits(spark):
    df = spark.createDataFrame([(1, 2000, 1, 9), (1, 2005, 2, 4), (1, 2005, 9, 2), (1, 2006, 1, 1)], "k int, year int, round int, v int")
    got = h.with_recent_years(df, ["k"], "year", ["round"], 5, {"s": F.col("v"), "n": F.lit(1)})
    got = {(r["year"], r["round"]): (r["s"], r["n"]) for r in got.collect()}
    assert got == {(2000, 1): (0, 0), (2005, 2): (9, 1), (2005, 9): (13, 2), (2006, 1): (6, 2)}


@pytest.mark.parametrize("hot", [True, False])
def test_running_max_and_log_prefix(frame, hot):
    df, pdf = frame
    x = F.col("v") * 200 - F.col("t")
    d = g.with_log_prefix(g.with_running_max(df, ["k"], ["t"], x, "m", hot), ["k"], ["t"], x, "l", hot)
    want = []
    for k, part in pdf.sort_values("t").groupby("k"):
        seen = []
        for t, v in zip(part["t"], part["v"]):
            if not np.isnan(v):
                seen.append(v * 200 - t)
            top = max(seen, default=None)
            want.append((float(k), float(t), top, top if top is None else round(top + float(np.log(np.exp(np.array(seen) - top).sum())), 9)))
    assert rows(d, "k", "t", "m", "l") == sorted(want)


@pytest.mark.parametrize("hot", [True, False])
def test_no_frame_to_the_end_of_a_group(frame, hot):
    """Such a frame is gone through anew for every row; what lies behind is read in reverse order."""
    df, pdf = frame
    d = g.with_nearby(df, ["k"], ["t"], F.col("v"), "b", "a", hot)
    assert "unboundedfollowing" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
    o = pdf.sort_values("t")
    o["b"] = o.groupby("k")["v"].transform(lambda s: s.ffill())
    o["a"] = o.groupby("k")["v"].transform(lambda s: s.bfill().shift(-1))
    want = sorted(tuple(None if pd.isna(x) else round(float(x), 9) for x in r) for r in o[["k", "t", "b", "a"]].to_numpy())
    assert rows(d, "k", "t", "b", "a") == want


@pytest.mark.parametrize("name", ["F08_best_runs", "F10_practice_features", "F12_sessions_side_by_side", "C09_first_within_four_days", "C10_nearest_within_36h"])
def test_a_large_table_is_not_a_large_group(spark, monkeypatch, name):
    """More events than one group may have: runs of an entrant and a few races are still no reason to sort all rows."""
    from fieldorder.plans import load_queries
    from fieldorder.sources import tables

    folder = "/root/testdata/sf0.001"
    want = load_queries()[name].build(tables.Tables(spark, folder)).collect()
    monkeypatch.setattr(tables, "GROUP_ROW_LIMIT", 10)
    sorts = []
    monkeypatch.setattr(g, "_runs", lambda *a, **k: sorts.append(a))
    t = tables.Tables(spark, folder)
    assert t.hot_events and not t.hot_laps
    d = load_queries()[name].build(t)
    assert not sorts and sorted(d.collect(), key=str) == sorted(want, key=str)
