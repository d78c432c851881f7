import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldorder.operators import probability as pr


def field(spark, groups):
    rows = [(g, i, float(s)) for g, ss in groups.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "g int, who bigint, s double")


def enumerate_places(s, lam=(1.0, 1.0, 1.0)):
    n = len(s)
    w = [np.exp(np.array(s) * p) for p in lam]
    out = np.zeros((n, 3))
    for i in range(n):
        p1 = w[0][i] / w[0].sum()
        out[i, 0] += p1
        for j in range(n):
            if j == i:
                continue
            p2 = p1 * w[1][j] / (w[1].sum() - w[1][i])
            out[j, 1] += p2
            for k in range(n):
                if k in (i, j):
                    continue
                out[k, 2] += p2 * w[2][k] / (w[2].sum() - w[2][i] - w[2][j])
    return out


@pytest.mark.parametrize("lam", [(1.0, 1.0, 1.0), (1.0, 0.8, 0.65)])
@pytest.mark.parametrize("hot", [True, False])
def test_places_match_enumeration(spark, lam, hot):
    rng = np.random.default_rng(5)
    groups = {1: rng.normal(0, 1, 40), 2: [4.0, 3.5, *rng.normal(-1, 1, 25)], 3: [0.3, 0.1], 4: [1.0], 5: [0.5, 0.2, -1.0], 6: np.zeros(30)}
    d = pr.place_probabilities(field(spark, groups), ["g"], "who", F.col("s"), hot, lam)
    got = {(r["g"], r["who"]): (r["p_win"], r["p_p2"], r["p_p3"]) for r in d.collect()}
    for g, s in groups.items():
        want = enumerate_places(s, lam)
        for i in range(len(s)):
            assert np.allclose(got[(g, i)], want[i], atol=1e-12), (g, i)


def test_logistic_sums_match_pairs(spark):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(0, 3, 200), 2: rng.uniform(-300, 300, 60), 3: [2.0], 4: np.zeros(50)}
    d = pr.logistic_sums(field(spark, groups), ["g"], F.col("s"), F.lit(1.0), "out")
    got = {(r["g"], r["who"]): r["out"] for r in d.collect()}
    for g, s in groups.items():
        s = np.array(s)
        for i in range(len(s)):
            want = sum(1 / (1 + math.exp(min(700, s[i] - s[j]))) for j in range(len(s)) if j != i)
            assert abs(got[(g, i)] - want) < 1e-10, (g, i)


def test_logistic_sums_of_a_wide_field(spark):
    """Cells on both sides of a block's end meet, sums are weighted, and no row carries its rivals' points."""
    rng = np.random.default_rng(2)
    edge = float(pr.BLOCK)
    s = np.concatenate([rng.uniform(edge - 60, edge + 60, 150), rng.uniform(-edge - 60, -edge + 60, 100), [5 * edge, -3 * edge]])
    rows = [(g, i, float(v), 1.0 + i % 3) for g in (None, 1) for i, v in enumerate(s)]
    d = pr.logistic_sums(spark.createDataFrame(rows, "g int, who bigint, s double, w double"), ["g"], F.col("s"), F.col("w"), "out")
    got = {(r["g"], r["who"]): r["out"] for r in d.collect()}
    w = 1.0 + np.arange(len(s)) % 3
    want = (w / (1 + np.exp(np.clip(s[:, None] - s, -700, 700)))).sum(1) - 0.5 * w
    assert np.allclose([got[(1, i)] for i in range(len(s))], want, atol=1e-9)
    assert np.allclose([got[(None, i)] for i in range(len(s))], want, atol=1e-9)
    plan = d._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "collect_list" not in plan and "unboundedfollowing" not in plan


def test_top_nll_survives_a_dominant_row(spark):
    df = spark.createDataFrame([(1, 0, 900.0, 1), (1, 1, 1.0, 2), (1, 2, 0.5, 3), (1, 3, 0.0, None)], "g int, who bigint, s double, p int")
    got = pr.top_nll(df, ["g"], F.col("s"), F.col("p"), 3, False).first()["nll"]
    s = [1.0, 0.5, 0.0]
    want = math.log(sum(map(math.exp, s))) - 1.0 + math.log(math.exp(0.5) + 1.0) - 0.5
    assert abs(got - want) < 1e-12


@pytest.mark.parametrize("hot", [True, False])
def test_gradient_matches_direct_sum(spark, hot):
    s = [0.4, -0.2, 1.1, 0.0, -0.7]
    df = spark.createDataFrame([(1, i, v, i + 1) for i, v in enumerate(s)], "g int, who bigint, s double, p int")
    got = {r["who"]: (r["gradient"], r["order_ll"]) for r in pr.order_gradient(df, ["g"], F.col("s"), F.col("p"), hot).collect()}
    g, ll = np.zeros(5), 0.0
    for j in range(4):
        p = np.exp(s[j:]) / np.exp(s[j:]).sum()
        g[j:] -= p
        g[j] += 1
        ll += math.log(p[0])
    assert np.allclose([got[i][0] for i in range(5)], g, atol=1e-12)
    assert abs(sum(v[1] for v in got.values()) - ll) < 1e-12


def test_subset_nll_near_exact_expectation(spark):
    """Draws over finisher subsets approach the sum over all subsets."""
    rng = np.random.default_rng(0)
    s, q = rng.normal(0, 1, 8), rng.uniform(0.5, 0.95, 8)
    rows = [(1, i, float(s[i]), float(q[i]), i + 1 if i < 3 else None) for i in range(8)]
    df = spark.createDataFrame(rows, "g int, who bigint, s double, q double, p int")
    got = pr.subset_nll(df, ["g"], "who", F.col("s"), F.col("q"), F.col("p"), 4000, False).first()["nll"]
    w, e = np.exp(s), 0.0
    for mask in itertools.product([0, 1], repeat=5):
        prob = np.prod([q[3 + i] if m else 1 - q[3 + i] for i, m in enumerate(mask)])
        rest = sum(w[3 + i] for i, m in enumerate(mask) if m)
        e += prob * np.prod([w[j] / (rest + w[j:3].sum()) for j in range(3)])
    assert abs(got - -(np.log(q[:3]).sum() + math.log(e))) < 0.02


@pytest.mark.parametrize("hot", [True, False])
def test_gradient_of_rows_far_behind(spark, hot):
    """Strengths further apart than exp can hold: each row is measured against what is left when its place is drawn."""
    s = [0.0, -3.0, -1500.0, -1500.5, -900.0, -4000.0, -4001.0]
    df = spark.createDataFrame([(1, i, v, i + 1) for i, v in enumerate(s)], "g int, who bigint, s double, p int")
    got = {r["who"]: (r["gradient"], r["order_ll"]) for r in pr.order_gradient(df, ["g"], F.col("s"), F.col("p"), hot).collect()}
    g, ll = np.zeros(len(s)), np.zeros(len(s))
    for j in range(len(s) - 1):
        left = np.array(s[j:])
        total = left.max() + math.log(np.exp(left - left.max()).sum())
        g[j:] -= np.exp(left - total)
        g[j] += 1
        ll[j] = s[j] - total
    assert np.allclose([got[i][0] for i in range(len(s))], g, atol=1e-9)
    assert np.allclose([got[i][1] for i in range(len(s))], ll, atol=1e-9)


def test_subset_draws_only_what_counts(spark):
    """Rows that no sum can tell are not drawn; the loss is that of a loop over all rows and samples."""
    import hashlib

    s = [0.0, -1.0, -2.0, -0.5, -1.5, *(-60.0 - i for i in range(200)), -2000.0]
    q = [0.75 + (i % 5) * 0.05 for i in range(len(s))]
    rows = [(7, i, v, q[i], i + 1 if i < 3 else None) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "g int, who bigint, s double, q double, p int")
    d = pr.subset_nll(df, ["g"], "who", F.col("s"), F.col("q"), F.col("p"), 50, False)
    total = 0.0
    for b in range(1, 51):
        ran = [i for i in range(3, len(s)) if int(hashlib.md5(f"7|{i}|{b}".encode()).hexdigest()[:8], 16) / 2**32 < q[i]]
        rest = sum(math.exp(s[i]) for i in ran)
        total += np.prod([math.exp(s[j]) / (rest + sum(map(math.exp, s[j:3]))) for j in range(3)])
    assert abs(d.first()["nll"] - -(sum(map(math.log, q[:3])) + math.log(total / 50))) < 1e-12
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") < plan.index("_rows")  # the filter on strength lies below the draws


def test_grid_of_weights_moves_no_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(b), p) for g in (1, 2, 3) for p, a, b in zip([1, 2, 3, None, 5, 6], rng.normal(0, 3, 6), rng.normal(0, 3, 6))]
    rows += [(4, 1.0, 2.0, 1), (4, 2.0, 1.0, 3)]  # no second place
    df = spark.createDataFrame(rows, "g int, a double, b double, p int")
    pairs = [(0.0, 1.0), (0.5, 0.25), (40.0, 900.0)]
    d = pr.top_nll_by_weights(df, ["g"], lambda w: w[0] * F.col("a") + w[1] * F.col("b"), pairs, F.col("p"))
    assert "Window" not in d._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["g"], tuple(r["weights"])): r["nll"] for r in d.collect()}
    want = {}
    for w in pairs:
        for r in pr.top_nll(df, ["g"], w[0] * F.col("a") + w[1] * F.col("b"), F.col("p"), 3, False).collect():
            want[r["g"], w] = r["nll"]
    assert got.keys() == want.keys() and len(got) == 9
    assert all(abs(got[k] - want[k]) <= 1e-12 * max(1.0, abs(want[k])) for k in got)


def test_order_likelihood_of_blends(spark):
    """Every weight and scale of two scores, with a shared place, a row without a score and scores far apart; rows are not multiplied."""
    rows = [(1, 1, 2.0, 5.0), (1, 2, 1.0, 9.0), (1, 4, 6000.0, 7.0), (1, 4, 3.0, 3.0), (1, 5, None, 4.0), (1, 6, 4.0, 90000.0), (1, None, 1.0, 1.0),
            (2, 1, 3.0, 1.0), (2, 2, 1.0, None), (None, 2, 1.0, 2.0), (None, 1, 4.0, 2.0), (3, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, p int, a double, b double")
    values, scales = [0.0, 0.3, 1.0], [0.5, 2.0]

    def found(hot):
        d = pr.order_ll_by_blend(df, ["g"], (F.col("a"), F.col("b")), values, scales, F.col("p"), hot)
        assert hot or "Generate" not in d._jdf.queryExecution().optimizedPlan().toString()
        return {(r["g"], r["value"], r["scale"]): (r["ll"], r["n"]) for r in d.collect()}

    got, split = found(False), found(True)
    assert got.keys() == split.keys() and len(got) == 4 * 6
    for (g, v, c), (ll, n) in got.items():
        x = [(p, -(v * a + (1 - v) * b) * c) for i, p, a, b in rows if i == g and p is not None and a is not None and b is not None]
        x.sort(key=lambda r: (r[0], -r[1]))
        last = max(p for i, p, *_ in rows if i == g and p is not None)
        want = sum(s - np.logaddexp.reduce([z for _, z in x[k:]]) for k, (p, s) in enumerate(x) if p < last)
        assert abs(ll - want) < 1e-9 * max(1, abs(want)) and abs(split[g, v, c][0] - want) < 1e-9 * max(1, abs(want))
        assert n == split[g, v, c][1] == sum(1 for i, p, *_ in rows if i == g and p is not None)
