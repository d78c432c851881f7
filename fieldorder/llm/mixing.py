"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words by its weight, never more than ``most`` times what it has; what is cut off goes
to the other sources by weight. A document of a source with ratio r = target / size is expected r times: floor(r)
whole copies are certain, the rest p = r - floor(r) is its inclusion odds. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)) with u a hash of the id, and each source takes the head of its ranking until its
words are spent; the last place goes to the document that brings the source nearest to its target.

No task orders a whole source: sizes are summed by (source, slice of the ranking), the slice in which the words run
out is found on those sums, and only its documents are ranked one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.llm.common import size_of, written

#: Words to take, as a share of all words; times a document may be taken at most; weights of sources in turn.
SHARE, MOST, WEIGHTS = 1.5, 2, (3, 1, 2)

#: Slices of a source's ranking.
SLICES = 1024


def draw(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """Uniform in (0, 1), the same for an id in every run: 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target. ``sizes``: a row per source (source, source_size).

    Sources are numbered by code point, null last, on a sorted table. Each pass caps the sources whose part by
    weight would be above ``most`` times their size; two sums reach the driver per pass.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    kind = {f.name: f.dataType.simpleString() for f in sizes.schema}
    s = sizes.sparkSession.createDataFrame(ordered, f"source {kind['source']}, source_size long, at long")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    s = written(s.select("source", "source_size", w.alias("weight")), "sources")
    cap = most * F.col("source_size")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        free = F.lit(True) if full is None else cap > level * F.col("weight")
        r = s.agg(F.sum(F.when(~free, cap)).alias("c"), F.sum(F.when(free, F.col("weight"))).alias("w"), F.count(F.when(~free, 1)).alias("n")).first()
        if full == r["n"] or not r["w"]:
            break
        full, level = r["n"], (share * total - (r["c"] or 0)) / r["w"]
    return s.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (= copies x size), one row per row of ``docs``.

    A null text has size 0; a null source is a source of its own and comes last. Documents of size 0 are never
    taken beyond their certain copies. Rows with the same id share their draw; ties of the ranking go by size, so
    rows that agree in both are taken in either order with the same totals, and the last place of a source goes to one
    row only. ``carry`` names columns of ``docs`` to come along. An empty table gives no rows.
    """
    d = docs.select("doc_id", "source", size_of().alias("size"), draw().alias("_u"), F.monotonically_increasing_id().alias("_n"), *carry)
    d = written(d, "mix-sizes")  # row numbers are those of this table from here on
    t = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = t.withColumn("_whole", F.floor(ratio)).withColumn("_p", ratio - F.floor(ratio))
    t = t.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumnRenamed("source", "_s")
    d = d.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    d = d.withColumn("_q", F.when(F.col("_p") > 0, odds))
    # q / (1 + q) grows with q and lies in (0, 1): equal slices of it cut every source finely
    d = d.withColumn("_slice", F.floor(SLICES * F.col("_q") / (1 + F.col("_q"))).cast("int"))

    by = Window.partitionBy("source").orderBy("_slice")
    sums = d.groupBy("source", "_slice", "_rest").agg(F.sum("size").alias("_in"))
    sums = sums.where("_slice IS NOT NULL").withColumn("_to", F.sum("_in").over(by))
    sums = sums.select(
        F.col("source").alias("_s"), F.col("_slice").alias("_c"), (F.col("_to") - F.col("_in")).alias("_before"),
        F.when(F.col("_to") <= F.col("_rest"), "all").when(F.col("_to") - F.col("_in") < F.col("_rest"), "cut").otherwise("none").alias("_part"),
    )
    d = written(d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_c")), "left").drop("_s", "_c"), "mix-slices")

    # only the slice in which the words run out is ranked row by row: the head that fits is taken
    rank = Window.partitionBy("source").orderBy("_q", "doc_id", "size", "_n")
    cut = d.where("_part = 'cut'").withColumn("_run", F.col("_before") + F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("_more", (F.col("_run") <= F.col("_rest")).cast("int")).drop("_run")
    d = d.where("_part IS NULL OR _part <> 'cut'").withColumn("_more", F.coalesce((F.col("_part") == "all").cast("int"), F.lit(0))).unionByName(cut)
    d = written(d, "mix-heads")

    # the last place: of the documents not taken, the one whose size comes nearest to what is missing
    short = d.groupBy("source").agg((F.first("_rest") - F.sum(F.col("_more") * F.col("size"))).alias("_short"))
    short = short.withColumnRenamed("source", "_s")
    left = d.where("_more = 0 AND size > 0 AND _p > 0").join(short, F.col("source").eqNullSafe(F.col("_s")))
    off = F.abs(F.col("_short") - F.col("size"))
    last = left.where(off < F.abs("_short")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "_q", "doc_id", "size", "_n")).alias("_l"))
    last = last.select(F.col("source").alias("_s"), F.col("_l._n").alias("_last"))
    d = d.join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
    chosen = F.col("_last") == F.col("_n")
    copies = (F.coalesce(F.col("_whole"), F.lit(0)) + F.col("_more") + F.coalesce(chosen, F.lit(False)).cast("int")).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry)
