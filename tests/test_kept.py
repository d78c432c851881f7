"""Queries that read a derived table many times make it once where the tables are large."""

import datetime as dt

import pytest

from fieldorder.plans.queries import laps, probability, ratings, scoring
from fieldorder.sources.tables import SCHEMAS, Tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kept"))
    day = lambda i: dt.datetime(1998 + i % 4, 1 + i % 12, 1)
    rows = {
        "region": [(0, "R")],
        "nation": [(0, "N", 0), (1, "M", 0)],
        "supplier": [(i, f"S{i}", i % 2, 0.0) for i in range(8)],
        "orders": [(i, i, "O", 1.0, day(i), "1") for i in range(48)],
        "lineitem": [(o, 0, s, s, 1.0 + (o * s) % 7, 10.0 + o + s, 0.0, 0.0, "R" if (o + s) % 5 == 0 else "N", "O", day(o)) for o in range(48) for s in range(8)],
        "events": [(i, dt.datetime(2024, 1, 1 + i % 7, i % 24, i % 60), i % 9, "view", float(i % 50), "{}") for i in range(900)],
    }
    for name, r in rows.items():
        spark.createDataFrame(r, SCHEMAS[name]).write.parquet(f"{path}/{name}.parquet")
    return path


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(df.collect(), key=str)


def test_results_are_made_once(spark, folder):
    t = Tables(spark, folder, hot=True)
    results, weather = rows(t.results), rows(t.weather)
    t.settle_results()
    assert "l_orderkey" not in plan(t.results) and "l_orderkey" not in plan(t.weather)
    assert rows(t.results) == results and rows(t.weather) == weather and results
    small = Tables(spark, folder, hot=False)
    small.settle_results()
    assert "l_orderkey" in plan(small.results)


@pytest.mark.parametrize("build", [scoring.summary, probability.expected, ratings.finish_equations])
def test_readers_of_results_do_not_read_order_lines_again(spark, folder, build):
    assert "l_orderkey" not in plan(build(Tables(spark, folder, hot=True)))


def test_model_rows_are_made_once(spark, folder):
    train, test = ratings.split_rows(Tables(spark, folder, hot=True))
    assert plan(test).count("Window") == 0
    old = [rows(d.select("year", "round", "entrant", *ratings.COLUMNS)) for d in ratings.split_rows(Tables(spark, folder, hot=False))]
    assert [rows(d.select("year", "round", "entrant", *ratings.COLUMNS)) for d in (train, test)] == old and all(old)


def test_paces_read_the_events_once(spark, folder):
    d = laps.paces(Tables(spark, folder, hot=True))
    assert "event_id" not in plan(d)
    assert rows(d.select("round", "entrant", "n_laps")) == rows(laps.paces(Tables(spark, folder, hot=False)).select("round", "entrant", "n_laps"))
