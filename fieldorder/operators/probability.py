"""Finishing probabilities and order likelihoods (Plackett-Luce family).

Nothing here enumerates pairs or triples of a field. Sums over rivals are rearranged into group
totals, a short list of the strongest rows, power sums, or moments per strength cell, so the work
is linear in the rows and combines map-side however large one contest is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldorder.operators.grouping import is_hot, join_groups, settled, with_index, with_log_prefix, with_totals

#: Strongest rows handled one by one in exact third-place sums.
HEAD = 16
#: Terms of the power series for all others; each term is at most 1/HEAD of the one before.
TERMS = 15
#: Interpolation points per strength cell in pairwise sums (error below 1e-15).
POINTS = 14
#: A part of a sum that leaves it as it is in double precision (an eighth of half a unit in the last place).
LOST = 2.0**-56
#: Beyond this distance the logistic curve is 0 or 1 in double precision.
FAR = 40
#: Cells that one task turns into polynomials at a time.
BLOCK = 1024


def softmax(df: DataFrame, keys: Sequence[str], s: Column, out: str, hot: bool | None) -> DataFrame:
    """exp(s) / sum(exp(s)) per group, shifted by the maximum."""
    d = with_totals(df.withColumn("_s", s), keys, {"_m": F.max("_s")}, hot)
    d = d.withColumn("_w", F.exp(F.col("_s") - F.col("_m")))
    d = with_totals(d, keys, {"_sum": F.sum("_w")}, hot)
    return d.withColumn(out, F.col("_w") / F.col("_sum")).drop("_s", "_m", "_w", "_sum")


def win_probability(df: DataFrame, keys: Sequence[str], pred: Column, temperature, out: str, hot) -> DataFrame:
    return softmax(df, keys, -pred / temperature, out, hot)


def top_nll(
    df: DataFrame,
    keys: Sequence[str],
    s: Column,
    place: Column,
    k: int,
    hot: bool | None,
    powers: Sequence[float] = (1.0,),
    out: str = "nll",
    complete: int | None = None,
) -> DataFrame:
    """-log P(the rows placed 1..k come in that order), one row per group.

    Place j is drawn from the rows not placed before it, with strengths powers[j] * s (the last
    power repeats). Each stage has its own maximum, so a dominant row loses no precision. Groups
    without all of places 1..``complete`` (default k) give no row.
    """
    d = df.select(*keys, s.alias("_s"), place.alias("_p"))
    open_at = [F.col("_p").isNull() | (F.col("_p") >= j) | (F.col("_p") < 1) for j in range(1, k + 1)]
    d = with_totals(d, keys, {f"_m{j}": F.max(F.when(o, F.col("_s"))) for j, o in enumerate(open_at)}, hot)
    power = [powers[min(j, len(powers) - 1)] for j in range(k)]
    aggs = []
    for j, o in enumerate(open_at):
        z = (F.col("_s") - F.col(f"_m{j}")) * power[j]
        aggs.append(F.sum(F.when(o, F.exp(z))).alias(f"_w{j}"))
        aggs.append(F.max(F.when(F.col("_p") == j + 1, z)).alias(f"_z{j}"))
    need = complete or k
    aggs.append(F.count_distinct(F.when(F.col("_p").between(1, need), F.col("_p"))).alias("_n"))
    g = d.groupBy(*keys).agg(*aggs).where(F.col("_n") == need)
    total = sum((F.log(f"_w{j}") - F.col(f"_z{j}") for j in range(1, k)), F.log("_w0") - F.col("_z0"))
    return g.select(*keys, total.alias(out))


def top_nll_by_weights(
    df: DataFrame, keys: Sequence[str], score: Callable[[Column], Column], weights: Sequence[Sequence[float]], place: Column, k: int = 3
) -> DataFrame:
    """``top_nll`` of every group at every point of a grid (column weights): ``score`` makes s of the array of weights.

    The product of rows and points is combined map-side, once for the stage maxima and once for the sums; a group's
    maxima travel as one row, so no copy of a row is shuffled.
    """
    grid = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
    d = df.withColumn("_p", place)
    open_at = [F.col("_p").isNull() | (F.col("_p") >= j) | (F.col("_p") < 1) for j in range(1, k + 1)]
    e = d.select("*", F.posexplode(grid).alias("_i", "weights")).withColumn("_s", score(F.col("weights")))
    tops = e.groupBy(*keys, "_i").agg(*[F.max(F.when(o, F.col("_s"))).alias(f"m{j}") for j, o in enumerate(open_at)])
    tops = tops.groupBy(*keys).agg(F.collect_list(F.struct("_i", *[f"m{j}" for j in range(k)])).alias("_tops"))
    e = join_groups(d, settled(tops), keys).withColumn("_t", F.explode("_tops"))
    e = e.withColumn("weights", F.element_at(grid, F.col("_t._i") + 1)).withColumn("_s", score(F.col("weights")))
    aggs = []
    for j, o in enumerate(open_at):
        z = F.col("_s") - F.col(f"_t.m{j}")
        here = F.col("_p") == j + 1
        aggs += [F.sum(F.when(o, F.exp(z))).alias(f"_w{j}"), F.max(F.when(here, z)).alias(f"_z{j}"), F.count_if(here).alias(f"_n{j}")]
    g = e.groupBy(*keys, "weights").agg(*aggs)
    for j in range(k):
        g = g.where(F.col(f"_n{j}") > 0)
    total = sum((F.log(f"_w{j}") - F.col(f"_z{j}") for j in range(1, k)), F.log("_w0") - F.col("_z0"))
    return g.select(*keys, "weights", total.alias("nll"))


def nll_by_temperature(
    df: DataFrame, keys: Sequence[str], pred: Column, place: Column, grid: Sequence[float], hot: bool | None
) -> DataFrame:
    """Top-1 and top-3 log loss of every contest at every temperature of the grid.

    The stage maxima do not depend on the temperature, and the row x grid product is combined
    map-side into one row per contest and temperature.
    """
    d = df.select(*keys, (-pred).alias("_s"), place.alias("_p"))
    open_at = [F.col("_p").isNull() | (F.col("_p") >= j) | (F.col("_p") < 1) for j in (1, 2, 3)]
    d = with_totals(d, keys, {f"_m{j}": F.max(F.when(o, F.col("_s"))) for j, o in enumerate(open_at)}, hot)
    d = d.withColumn("temperature", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    aggs = []
    for j, o in enumerate(open_at):
        z = (F.col("_s") - F.col(f"_m{j}")) / F.col("temperature")
        aggs.append(F.sum(F.when(o, F.exp(z))).alias(f"_w{j}"))
        aggs.append(F.max(F.when(F.col("_p") == j + 1, z)).alias(f"_z{j}"))
    g = d.groupBy(*keys, "temperature").agg(*aggs)
    parts = [F.log(f"_w{j}") - F.col(f"_z{j}") for j in range(3)]
    g = g.select(*keys, "temperature", parts[0].alias("ll_winner"), sum(parts[1:], parts[0]).alias("ll_top3"))
    return g.where(F.col("ll_top3").isNotNull())


def order_gradient(
    df: DataFrame, keys: Sequence[str], s: Column, place: Column, hot: bool | None
) -> DataFrame:
    """Gradient of the order log-likelihood for each placed row, plus the row's own term.

    Rows need a place 1..n without gaps in meaning only (order counts). Remaining strength S_j is a
    running sum from the back; the inverse sums run from the front. Both are kept as logarithms, so a
    row far behind the strongest has its own shares instead of 0 / 0. ``order_ll`` is s_j - ln S_j
    (0 for the last row), so its group sum is the log-likelihood.
    """
    d = df.where(place.isNotNull()).withColumn("_s", s).withColumn("_p", place)
    d = with_totals(d, keys, {"_last": F.max("_p")}, hot)
    d = with_log_prefix(d, keys, [F.desc("_p"), F.asc_nulls_first("_s")], F.col("_s"), "_rem", hot)
    final = F.col("_p") == F.col("_last")
    d = with_log_prefix(d, keys, ["_p", F.desc_nulls_last("_s")], F.when(~final, -F.col("_rem")), "_inv", hot)
    won = F.when(final, 0.0).otherwise(1.0)
    lost = F.when(F.col("_s").isNotNull(), F.coalesce(F.exp(F.col("_s") + F.col("_inv")), F.lit(0.0)))
    own = F.when(final, 0.0).otherwise(F.col("_s") - F.col("_rem"))
    d = d.withColumn("gradient", won - lost).withColumn("order_ll", own)
    return d.drop("_s", "_p", "_last", "_rem", "_inv")


def order_ll_by_blend(
    df: DataFrame, keys: Sequence[str], scores: tuple[Column, Column], weights: Sequence[float], scales: Sequence[float],
    place: Column, hot: bool | None,
) -> DataFrame:
    """Order log-likelihood ``ll`` of each group's ``n`` placed rows for s = -(value * one + (1 - value) * other) * scale.

    A group meets all values and scales in one Arrow call, one point after the other, so rows travel once and not once a
    point. A row without a score has no term. Groups that are split take ``order_gradient`` on rows times points.
    """
    d = df.where(place.isNotNull())
    if is_hot(d, keys, hot):
        d = d.select(*keys, place.alias("_p"), scores[0].alias("_one"), scores[1].alias("_other"))
        for name, values in (("value", weights), ("scale", scales)):
            d = d.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
        s = -(F.col("value") * F.col("_one") + (1 - F.col("value")) * F.col("_other")) * F.col("scale")
        every = ["value", "scale", *keys]
        g = order_gradient(d, every, s, F.col("_p"), True).groupBy(*every)
        return g.agg(F.sum("order_ll").alias("ll"), F.count(F.lit(1)).alias("n")).select(*keys, "value", "scale", "ll", "n")
    d = d.select(*keys, place.cast("double").alias("_p"), *[x.cast("double").alias(n) for x, n in zip(scores, ("_one", "_other"))])
    points = [(float(v), float(c)) for v in weights for c in scales]

    def run(t: pa.Table) -> pa.Table:
        p, one, other = (t[c].to_numpy() for c in ("_p", "_one", "_other"))
        order = np.argsort(-p, kind="stable")
        final = p[order] == p[order[0]]
        order, final = (x[~np.isnan(one[order] + other[order])] for x in (order, final))
        p, one, other = p[order], one[order], other[order]
        shared = bool((np.diff(p) == 0).any())
        ll = np.zeros(len(points))
        for i, (v, c) in enumerate(points):
            s = -(v * one + (1 - v) * other) * c
            if shared:  # rows that share a place: the weaker one stays longer
                s = s[np.lexsort((s, -p))]
            ll[i] = (s - np.logaddexp.accumulate(s))[~final].sum()
        head = {k: pa.repeat(t[k][0], len(points)) for k in keys}
        v, c = np.array(points).T
        return pa.table({**head, "value": v, "scale": c, "ll": ll, "n": np.full(len(points), t.num_rows)})

    schema = T.StructType([*[d.schema[k] for k in keys], *T.StructType.fromDDL("value double, scale double, ll double, n long")])
    return d.groupBy(*keys).applyInArrow(run, schema)


def place_probabilities(
    df: DataFrame,
    keys: Sequence[str],
    who: str,
    s: Column,
    hot: bool | None,
    powers: Sequence[float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Exact p_win, p_p2, p_p3 and p_podium.

    With p, v, u the strength shares for places 1, 2, 3 and a_j = p_j / (1 - v_j):
    P2_i = v_i * (sum a - a_i), and P3_i = u_i * (T - R_i), where R_i sums
    (a_i v_k + a_k v_i) / (1 - u_i - u_k) over rivals k and T is half the sum of all R.
    R is exact for the HEAD strongest rivals; for the others 1 / (1 - u_i - u_k) is a power series
    in u_k whose ratio is at most 1/HEAD, so it needs only sums of v u^m and a u^m per group.
    """
    lam = [powers[min(j, len(powers) - 1)] for j in range(3)]
    d = with_totals(df.withColumn("_s", s), keys, {"_m": F.max("_s"), "_n": F.count(F.lit(1))}, hot)
    for name, power in zip("pvu", lam):
        d = d.withColumn(f"_w{name}", F.exp((F.col("_s") - F.col("_m")) * power))
    d = with_totals(d, keys, {f"_tot{n}": F.sum(f"_w{n}") for n in "pvu"}, hot)
    for n in "pvu":
        d = d.withColumn(f"_{n}", F.col(f"_w{n}") / F.col(f"_tot{n}"))
    d = d.drop(*[f"_{a}{n}" for a in ("w", "tot") for n in "pvu"], "_s", "_m")
    d = d.withColumn("_a", F.coalesce(F.try_divide(F.col("_p"), 1.0 - F.col("_v")), F.lit(0.0)))
    d = with_index(d, keys, [F.desc("_u"), who], "_k", hot)
    tail = F.col("_k") > HEAD
    head = F.array_sort(
        F.collect_list(F.when(~tail, F.struct("_k", F.col("_a").alias("a"), F.col("_v").alias("v"), F.col("_u").alias("u"))))
    )
    sums = [F.sum("_a").alias("_sumA"), head.alias("_head")]
    for m in range(TERMS):
        um = F.pow(F.col("_u"), F.lit(float(m)))
        sums.append(F.coalesce(F.sum(F.when(tail, F.col("_v") * um)), F.lit(0.0)).alias(f"_V{m}"))
        sums.append(F.coalesce(F.sum(F.when(tail, F.col("_a") * um)), F.lit(0.0)).alias(f"_B{m}"))
    d = join_groups(d, d.groupBy(*keys).agg(*sums), keys)
    left = 1.0 - F.col("_u")
    near = F.aggregate(
        "_head",
        F.lit(0.0),
        lambda acc, h: acc
        + F.when(
            h["_k"] != F.col("_k"),
            (F.col("_a") * h["v"] + h["a"] * F.col("_v")) / F.greatest(left - h["u"], F.lit(1e-300)),
        ).otherwise(0.0),
    )
    series = F.lit(0.0)
    for m in reversed(range(TERMS)):
        series = (series + F.col("_a") * F.col(f"_V{m}") + F.col("_v") * F.col(f"_B{m}")) / left
    own = F.when(tail, 2.0 * F.col("_a") * F.col("_v") / (left - F.col("_u"))).otherwise(0.0)
    rest = F.when(F.col("_n") > HEAD, series - own).otherwise(0.0)
    d = d.withColumn("_R", F.when(F.col("_n") > 2, near + rest))
    d = with_totals(d, keys, {"_T": F.sum("_R")}, hot)
    d = d.withColumn("p_win", F.col("_p"))
    d = d.withColumn("p_p2", F.when(F.col("_n") > 1, F.col("_v") * (F.col("_sumA") - F.col("_a"))).otherwise(0.0))
    d = d.withColumn("p_p3", F.coalesce(F.col("_u") * (F.col("_T") / 2.0 - F.col("_R")), F.lit(0.0)))
    d = d.withColumn("p_podium", F.least(F.col("p_win") + F.col("p_p2") + F.col("p_p3"), F.lit(1.0)))
    gone = [f"_{x}{m}" for x in "VB" for m in range(TERMS)]
    return d.drop("_n", "_p", "_v", "_u", "_a", "_k", "_sumA", "_head", "_R", "_T", *gone)


def _rivals_near(keys: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """Per cell of a block: Chebyshev coefficients, over the cell, of the sum over the rivals of all cells within FAR.

    ``_q`` holds a cell's moments. They give weights at POINTS interpolation points that reproduce the smooth curve to
    rounding error; distances between points of two cells depend on how far the cells are apart alone.
    """
    theta = (2 * np.arange(POINTS) + 1) * np.pi / (2 * POINTS)
    basis = np.cos(np.outer(theta, np.arange(POINTS))) * (2.0 / POINTS)
    basis[:, 0] /= 2
    at = 0.5 + 0.5 * np.cos(theta)
    apart = np.arange(-FAR, FAR + 1)[:, None] + at  # points of the cells near by
    curve = 1.0 / (1.0 + np.exp(at[None, None, :] - apart[:, :, None]))
    # a cell's points in a row: (cells near by * points, coefficients)
    table = curve.reshape(-1, POINTS) @ basis

    def run(t: pa.Table) -> pa.Table:
        block, cell = t.column("_block")[0].as_py(), t.column("_cell").to_numpy()
        first = block * BLOCK - FAR
        weights = np.zeros((BLOCK + 2 * FAR, POINTS))
        q = t.column("_q").combine_chunks()
        weights[cell - first] = q.flatten().to_numpy(zero_copy_only=False).reshape(-1, POINTS) @ basis.T
        own = np.flatnonzero(cell // BLOCK == block)
        near = np.lib.stride_tricks.sliding_window_view(weights, 2 * FAR + 1, axis=0)[cell[own] - first - FAR]
        c = near.transpose(0, 2, 1).reshape(len(own), len(table)) @ table
        out = t.select([*keys, "_cell", "_above"]).take(pa.array(own))
        offsets = pa.array(np.arange(0, POINTS * len(own) + 1, POINTS, dtype=np.int32))
        return out.append_column("_c", pa.ListArray.from_arrays(offsets, pa.array(c.ravel())))

    return run


def logistic_sums(
    df: DataFrame, keys: Sequence[str], x: Column, weight: Column, out: str
) -> DataFrame:
    """sum over rivals k of weight_k / (1 + exp(x_i - x_k)), without pairing rows.

    The x axis is cut into unit cells. A cell is summarised by Chebyshev moments of its rows, which are plain sums.
    Blocks of cells, with those within FAR of them, turn the moments into one polynomial a cell for the rivals near by;
    a row meets its cell's polynomial and one total for the cells beyond, however many rivals those hold.
    """
    d = df.withColumn("_x", x.cast("double")).withColumn("_wt", weight.cast("double"))
    d = d.withColumn("_cell", F.floor("_x"))
    xi = F.greatest(F.least(2 * (F.col("_x") - F.col("_cell")) - 1, F.lit(1.0)), F.lit(-1.0))
    angle = F.acos(xi)
    moments = (
        d.where(F.col("_x").isNotNull() & F.col("_wt").isNotNull())
        .groupBy(*keys, "_cell")
        .agg(
            F.sum("_wt").alias("_q0"),
            *[F.sum(F.col("_wt") * F.cos(angle * r)).alias(f"_q{r}") for r in range(1, POINTS)],
        )
    )
    # from above: a frame up to the end of the group is gone through anew for every row
    w = Window.partitionBy(*keys).orderBy("_down").rangeBetween(Window.unboundedPreceding, -(FAR + 1))
    cells = moments.withColumn("_down", -F.col("_cell")).select(
        *keys,
        "_cell",
        F.array(*[f"_q{r}" for r in range(POINTS)]).alias("_q"),
        F.coalesce(F.sum("_q0").over(w), F.lit(0.0)).alias("_above"),
    )
    meets = F.array_distinct(F.array(*[F.floor((F.col("_cell") + side) / BLOCK) for side in (-FAR, FAR)]))
    blocks = cells.withColumn("_block", F.explode(meets)).groupBy(*keys, "_block")
    schema = T.StructType([*[moments.schema[k] for k in keys], *T.StructType.fromDDL("_cell long, _above double, _c array<double>")])
    d = join_groups(d, blocks.applyInArrow(_rivals_near(keys), schema), [*keys, "_cell"])
    near = sum((F.col("_c")[r] * F.cos(angle * r) for r in range(1, POINTS)), F.col("_c")[0])
    value = F.col("_above") + near - 0.5 * F.col("_wt")
    return d.withColumn(out, value).drop("_x", "_wt", "_cell", "_above", "_c")


def expected_position(df: DataFrame, keys: Sequence[str], s: Column, out: str) -> DataFrame:
    """1 + sum over rivals of P(rival ahead) under Plackett-Luce with log-strengths s."""
    d = logistic_sums(df, keys, s, F.lit(1.0), "_ahead")
    return d.withColumn(out, 1.0 + F.col("_ahead")).drop("_ahead")


def from_positions(df: DataFrame, keys: Sequence[str], position: str, p: str) -> DataFrame:
    """Place probabilities and the expected place from a (keys, position, p) table."""
    at = F.col(position)

    def upto(k: int) -> Column:
        return F.least(F.sum(F.when(at <= k, F.col(p)).otherwise(0.0)), F.lit(1.0))

    def exactly(k: int) -> Column:
        return F.least(F.sum(F.when(at == k, F.col(p)).otherwise(0.0)), F.lit(1.0))

    return df.groupBy(*keys).agg(
        exactly(1).alias("p_win"),
        exactly(2).alias("p_p2"),
        exactly(3).alias("p_p3"),
        upto(3).alias("p_podium"),
        upto(6).alias("p_top6"),
        upto(10).alias("p_top10"),
        F.sum(at * F.col(p)).alias("expected_position"),
    )


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts: the first 32 bits of their md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def subset_nll(
    df: DataFrame,
    keys: Sequence[str],
    who: str,
    s: Column,
    q: Column,
    place: Column,
    n_samples: int,
    hot: bool | None,
    powers: Sequence[float] = (1.0,),
    k: int = 3,
) -> DataFrame:
    """-log P(top k in order) when each other row only finishes with probability q.

    The random set of other finishers is drawn ``n_samples`` times with draws fixed by hashes of
    (group, row, sample). Rows and samples meet as a projection; sums per (group, sample) are
    combined map-side. Rows so weak that all of them together are lost in the rounding of every sum
    (LOST of the smallest one it is added to) are not drawn.
    """
    d = df.select(*keys, who, s.alias("_s"), F.least(F.greatest(q, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("_q"),
                  F.when(place.between(1, k), place).alias("_p"))
    placed = F.col("_p").isNotNull()
    d = with_totals(d, keys, {"_m": F.max("_s"), "_n": F.count_if(placed), "_rows": F.count(F.lit(1)),
                              "_lq": F.sum(F.when(placed, F.log("_q")))}, hot)
    d = d.where(F.col("_n") == k)
    lam = [powers[min(j, len(powers) - 1)] for j in range(k)]
    fixed = {}
    for j in range(k):
        z = (F.col("_s") - F.col("_m")) * lam[j]
        d = d.withColumn(f"_w{j}", F.exp(z))
        fixed[f"_c{j}"] = F.sum(F.when(F.col("_p") >= j + 1, F.col(f"_w{j}")))
        fixed[f"_z{j}"] = F.max(F.when(F.col("_p") == j + 1, z))
    d = with_totals(d, keys, fixed, hot)
    counts = F.lit(False)
    for j in range(k):
        counts = counts | ~(F.col(f"_w{j}") * F.col("_rows") <= F.col(f"_c{j}") * LOST)
    d = d.where(placed | counts)
    # the draws cost far more than the rows: spread them anew
    spread = max(d.sparkSession.sparkContext.defaultParallelism, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.withColumn("_limit", F.lower(F.lpad(F.hex(F.ceil(F.col("_q") * float(2**32))), 8, "0"))).repartition(spread, *keys, who)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, who, "_b")])
    # a hash as text is below the limit as text where its first 32 bits are below it as a number
    drawn = d.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n_samples)))).where(placed | (F.md5(text) < F.col("_limit")))
    drawn = drawn.groupBy(*keys, "_b").agg(
        F.max("_lq").alias("_lq"), *[F.max(f"_{x}{j}").alias(f"_{x}{j}") for j in range(k) for x in "cz"],
        *[F.sum(F.when(~placed, F.col(f"_w{j}")).otherwise(0.0)).alias(f"_W{j}") for j in range(k)],
    )
    chance, first = F.lit(1.0), F.max("_lq")
    for j in range(k):
        chance = chance / (F.col(f"_W{j}") + F.col(f"_c{j}"))
        first = first + F.max(f"_z{j}")
    return drawn.groupBy(*keys).agg((-(first + F.log(F.avg(chance)))).alias("nll"))
