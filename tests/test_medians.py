"""Medians by digits and codes by sorted partitions against plain ones."""

import math
import random

import numpy as np

from fieldorder.operators import joins as jn
from fieldorder.operators.medians import column_medians, from_bits, ordered_bits


def test_bits_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    b = ordered_bits(x)
    assert (np.diff(b) > 0).all() and [from_bits(v) for v in b] == x.tolist()
    assert ordered_bits(np.array([-0.0]))[0] == ordered_bits(np.array([0.0]))[0]


def test_medians_of_many_columns(spark):
    r = random.Random(3)
    cols = {
        "normal": [r.gauss(0, 1) for _ in range(5001)], "wide": [math.copysign(10 ** r.uniform(-300, 300), r.random() - 0.5) for _ in range(5001)],
        "few": [float(r.choice([1, 2, 2, 3])) for _ in range(5001)], "close": [1 + k * 2**-52 for k in r.sample(range(5001), 5001)],
        "half": [r.choice([None, -1.0, 4.0]) for _ in range(5001)], "empty": [None] * 5001, "one": [None] * 5000 + [7.5], "same": [-3.25] * 5001,
    }
    d = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(6)
    for frame, n in ((d, 5001), (d.where("few <> 2"), None)):
        got = column_medians(frame, list(cols))
        rows = [x.asDict() for x in frame.collect()]
        for c in cols:
            have = [x[c] for x in rows if x[c] is not None]
            assert got[c] == (float(np.median(have)) if have else None), c
    assert column_medians(d.where("false"), ["few", "one"]) == {"few": None, "one": None}


def test_category_codes(spark):
    seen = spark.createDataFrame([(x,) for x in ["b", "a", "ü", None, "a", "c", "Z"]], "t string").repartition(3)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "Z", "ü", None, "new", "c", "b", "a"])], "i int, t string")
    got = {x.i: x.code for x in jn.category_codes(df, seen, "t", "code").collect()}
    order = sorted({"b", "a", "ü", "c", "Z"})
    assert got == {i: order.index(x) + 1 if x in order else 0 for i, x in enumerate(["a", "Z", "ü", None, "new", "c", "b", "a"])}
    assert jn.category_codes(df, seen.where("false"), "t", "code").where("code <> 0").count() == 0
