"""Connected components of links, and links of group members without pairing everything in a group.

All tables stay distributed; per round only a few sums reach the driver. Every round ends in a written table, so a
lost executor costs no more than the round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.llm.common import released, written

#: Members outside a group's largest component up to which all its open pairs are compared at once.
OUTSIDE = 32

#: Rounds of pivots before all open pairs are compared, and open pairs a member up to which no second one is worth it.
PIVOT_ROUNDS, OPEN = 2, 64


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id of the component) for every id in ``links`` (a, b); ids of any ordered type.

    Alternates large and small stars until nothing changes: each id points its larger neighbours to the smallest
    it knows, then its smaller ones; the number of rounds grows with the logarithm of the longest path.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark or mark[0] == 0:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label"))).distinct()


def link_members(
    members: DataFrame,
    extra: list[str],
    fits: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    central: str | None = None,
    least: str | None = None,
    known: DataFrame | None = None,
) -> DataFrame | None:
    """Links (a, b) that connect all members of shared groups which fit and verify, or None if there are no pairs.

    ``members``: a written table (key, id, *extra). Two members of a key are compared if ``fits`` holds on their
    extra columns, prefixed as given, and linked if ``verify`` returns their pair (a < b). A pair is verified once.
    ``known`` is a written table of further pairs (a < b) that are verified with those of the first round.

    Close members share many keys. ``least`` names an extra column with some of a member's least keys: where two
    members' have one in common, they are paired under the least such and not again under greater keys.

    In a group of near copies comparing everything costs the square of its size, and is idle: as soon as most are
    known to belong together only pairs across components can add anything. So each round takes one pivot per open
    group and compares the others with it: the member with the least ``central`` (later: outside the largest
    component). At last all pairs between a group's
    minor components and everything else are compared. No pair across components is left out.
    """
    tried: list[DataFrame] = []
    links: list[DataFrame] = []
    done: list[DataFrame] = []
    labels = worked = None
    members = members.select("key", "id", *extra)

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    for turn in range(PIVOT_ROUNDS + 1):
        m = members
        if labels is None:
            m = m.withColumn("label", F.col("id"))
        else:
            named = labels.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
            m = m.join(named, F.col("id") == F.col("_i"), "left").withColumn("label", F.coalesce("_l", "id")).drop("_i", "_l")
        parts = m.groupBy("key", "label").count() if labels is not None else m.withColumn("count", F.lit(1))
        groups = parts.groupBy("key").agg(
            F.sum("count").alias("n"), F.max("count").alias("most"), F.max_by("label", "count").alias("major"),
            F.min("label").alias("_lo"), F.max("label").alias("_hi"),
        ).where("_lo <> _hi").drop("_lo", "_hi")
        groups = written(groups.withColumnRenamed("key", "_k"), "groups")
        rest, n = F.col("n") - F.col("most"), F.col("n").cast("double")
        outside, work, size = groups.agg(F.max(rest), F.sum(n * rest), F.sum(n)).first()
        if outside is None:
            if known is not None and not tried:
                links.append(written(verify(known), "links"))
            break
        idle = bool(links) and links[-1].isEmpty()
        last = idle or outside <= OUTSIDE or turn == PIVOT_ROUNDS or (turn > 0 and (work <= OPEN * size or 2 * work > worked))
        worked = work
        if labels is None and not last:
            m = m.withColumn("major", F.lit(None).cast(m.schema["label"].dataType))
            done.append(groups)
        else:
            m = written(m.join(groups.select("_k", "major"), F.col("key") == F.col("_k")).drop("_k"), "open")
            released(m.sparkSession, groups, *done)
            done = [m]
            members = m.select("key", "id", *extra)  # groups in one component stay so
        cols = ["key", "id", "label", *extra]
        right = m.select(*[F.col(c).alias(f"r_{c}") for c in cols])
        if last:
            left = m.where("label <> major").select(*[F.col(c).alias(f"l_{c}") for c in cols])
        else:
            first = [(F.col("label") == F.col("major")) & F.lit(turn > 0), F.col(central or "id"), F.xxhash64("id", F.lit(turn))]
            pivot = m.groupBy("key").agg(F.min_by(F.struct(*cols[1:]), F.struct(*first)).alias("p"))
            left = pivot.select(F.col("key").alias("l_key"), *[F.col(f"p.{c}").alias(f"l_{c}") for c in cols[1:]])
        on = (F.col("l_key") == F.col("r_key")) & (F.col("l_label") != F.col("r_label")) & fits("l_", "r_")
        if last and least:
            common = F.array_min(F.array_intersect(f"l_{least}", f"r_{least}"))
            on = on & F.coalesce(common >= F.col("l_key"), F.lit(True))
        pairs = left.join(right, on).select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))
        if known is not None and not tried:
            pairs = pairs.unionByName(known)
        pairs = pairs.distinct()
        if tried:
            pairs = pairs.join(union(tried), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tried.append(pairs)
        links.append(written(verify(pairs), "links"))
        if last:
            break
        if not links[-1].isEmpty():
            labels = written(components(union(links)), "labels")
    return union(links) if links else None
