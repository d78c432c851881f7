"""One pass of season sums gives every fold's fit."""

import numpy as np

from fieldorder.plans.models import finish_model
from fieldorder.plans.walk_forward import LeastSquares, by_season


def rows(spark):
    r = np.random.default_rng(4)
    out = []
    for year in (2001, 2002, 2004, 2007):
        for i in range(60):
            a, b = r.standard_normal(2) + 1000
            y = None if i == 7 else float(2 * a - b + r.standard_normal())
            out.append((year, i, None if i == 9 else float(a), float(b), y, int(r.random() < 0.3)))
    return out, spark.createDataFrame(out, "year int, entrant int, a double, b double, y double, dnf int").repartition(3)


def test_season_sums_fit_every_fold(spark):
    data, df = rows(spark)
    for half_life in (None, 2.0):
        model = LeastSquares(["a", "b"], "y", half_life)
        got = {(x.year, x.entrant): x.predicted for x in model.walk(df).collect()}
        assert {y for y, _ in got} == {2002, 2004, 2007}
        for year in (2002, 2004, 2007):
            t = [x for x in data if x[0] < year and None not in x]
            last = max(x[0] for x in t)
            w = np.sqrt([0.5 ** ((last - x[0]) / half_life) if half_life else 1.0 for x in t])
            m = np.array([[1, x[2] - 1000, x[3] - 1000] for x in t]) * w[:, None]
            k = np.linalg.lstsq(m, np.array([x[4] for x in t]) * w, rcond=None)[0]
            for x in data:
                if x[0] == year:
                    want = None if x[2] is None else k @ [1, x[2] - 1000, x[3] - 1000]
                    assert got[year, x[1]] == want or abs(got[year, x[1]] - want) < 1e-6


def test_any_predictor_is_walked_season_by_season(spark):
    _, df = rows(spark)
    model = LeastSquares(["a", "b"], "y")
    a, b = ({(x.year, x.entrant): x.predicted for x in d.collect()} for d in (model.walk(df), by_season(df, model)))
    assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-8 for k in a)
    p = by_season(df, lambda train, test: finish_model(train, test, ["a", "b"], out="p"), first=2004).collect()
    assert {x.year for x in p} == {2004, 2007} and all(0 < x.p < 1 for x in p)
    assert by_season(df.where("false"), model).count() == 0
