"""Fitted models do their operators' whole job."""

import inspect
import math

import numpy as np

from fieldorder.plans import models as md
from fieldorder.plans import newton as nw
from fieldorder.plans.queries import ratings as q
from fieldorder.sources.tables import Tables


def test_order_model_converges(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    train, _ = q.split_rows(t)
    beta = md.order_model(train, q.COLUMNS, t.hot_contest)
    data = md.standardised(train, q.COLUMNS)
    row = md.order_loss_gradient(data, q.COLUMNS, beta, t.hot_contest, 0.01).first()
    assert math.sqrt(sum(row[f"d_{c}"] ** 2 for c in q.COLUMNS)) < 1e-3


def test_regressor_has_the_operators_trees(spark, monkeypatch):
    seen = {}

    def fit(*args, **kw):
        call = inspect.signature(real).bind(*args, **kw)
        call.apply_defaults()
        seen.update(call.arguments)
        raise StopIteration

    real = md.position_regressor
    monkeypatch.setattr(md, "position_regressor", fit)
    try:
        q.regressor(Tables(spark, "/root/testdata/sf0.001"))
    except StopIteration:
        pass
    assert (seen["trees"], seen["depth"]) == (20, 4)


def newton_logistic(x, y, w, ridge):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (w * (q - y)) / w.sum() + ridge * b
        b -= np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x / w.sum() + np.diag(ridge), g)
    return b


def test_logistic_fit_is_that_of_dense_newton(spark):
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), r.standard_normal((400, 3))])
    y = (r.random(400) < 1 / (1 + np.exp(-x @ [0.3, 2.0, -1.0, 0.0]))).astype(float)
    w, ridge = r.random(400) + 0.5, np.array([0.0, 0.01, 0.01, 0.01])
    cols = ["a", "b", "c", "d"]
    d = spark.createDataFrame([(*map(float, row), float(v), float(u)) for row, v, u in zip(x, y, w)], [*cols, "y", "w"])
    beta, passes = nw.newton(lambda b: nw.logistic_moments(d, cols, b, "y", "w"), cols, ridge)
    assert passes < 10 and np.allclose(beta, newton_logistic(x, y, w, ridge), atol=1e-9)
    none, _ = nw.newton(lambda b: nw.logistic_moments(d.where("false"), cols, b, "y"), cols, ridge)
    assert none == [0.0] * 4


def test_order_moments_are_those_of_a_loop(spark):
    r = np.random.default_rng(2)
    beta, rows, losses = np.array([0.7, -0.4]), [], []
    for race in range(12):
        n = int(r.integers(3, 9))
        x, order = r.standard_normal((n, 2)), r.permutation(n)
        place = [int(p) + 1 if p < max(3, n - 2) else None for p in order]
        rows += [(2000, race, p, *map(float, v)) for p, v in zip(place, x)]
        if race == 5:  # without a second place the contest does not count
            rows = [(y, k, None if k == 5 and p == 2 else p, *v) for y, k, p, *v in rows]
            continue
        losses.append((x, [place.index(p) for p in (1, 2, 3)]))

    def loss(b):
        out = 0.0
        for x, top in losses:
            z, left = x @ b, list(range(len(x)))
            for i in top:
                out += np.log(np.exp(z[left]).sum()) - z[i]
                left.remove(i)
        return out / len(losses)

    row = nw.order_moments(spark.createDataFrame(rows, "year int, round int, finish_position int, u double, v double"), ["u", "v"], beta).first()
    h = 1e-4
    e = np.eye(2) * h
    slope = [(loss(beta + e[i]) - loss(beta - e[i])) / (2 * h) for i in range(2)]
    curve = lambda i, j: (loss(beta + e[i] + e[j]) - loss(beta + e[i] - e[j]) - loss(beta - e[i] + e[j]) + loss(beta - e[i] - e[j])) / (4 * h * h)
    assert row["n"] == 11 and abs(row["loss"] - loss(beta)) < 1e-12
    assert np.allclose([row["g_u"], row["g_v"]], slope, atol=1e-6)
    assert np.allclose([row["h_u_u"], row["h_u_v"], row["h_v_v"]], [curve(0, 0), curve(0, 1), curve(1, 1)], atol=1e-5)


def test_fits_take_few_passes(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    train, _ = q.split_rows(t)
    fits = [md.OrderFit(train, q.COLUMNS), md.FinishFit(train, q.COLUMNS, "weight"), md.RankerFit(train, q.COLUMNS, t.hot_contest, "weight")]
    assert max(f.passes for f in fits) < 10
    assert all(x.equation < 1e-8 for f in fits for x in f.equations().collect())
