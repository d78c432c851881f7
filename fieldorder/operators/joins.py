"""Joins beyond plain equality: bucketed range and as-of joins, theta counts, lookups, aligned diffs.

Range conditions are turned into equi-joins on aligned blocks or into one ordered sweep, so no join falls back to
comparing everything with everything.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldorder.operators.features import CONTEST, Sizes
from fieldorder.operators.grouping import join_groups, with_index, with_nearby, with_prefix, with_rank, with_totals

#: Rows that are held together as a list; larger groups go another way.
CROWD = 64

#: A lookup table is broadcast up to this many rows.
LOOKUP_ROWS = 200_000


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], defaults: dict | None = None) -> DataFrame:
    """Left join to a keyed table, broadcast only after its size is checked; then defaults."""
    small = table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    d = df.join(F.broadcast(table) if small else table, list(keys), "left")
    return d.fillna(defaults) if defaults else d


def category_codes(df: DataFrame, seen: DataFrame, column: str, out: str) -> DataFrame:
    """1..n in sorted order of the values seen; 0 for anything else.

    The dictionary is range-sorted once; a value's code is its place in its partition behind the counts of the
    partitions before. It goes to every task only while it is counted small.
    """
    values = seen.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(0))
    codes = with_index(values, ["_one"], [column], out, hot=True).drop("_one")
    return lookup(df, codes, [column], {out: 0})


def _sweep(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, value: Sequence[str], tie: str, hot: bool | None, side: int = 1,
) -> DataFrame:
    """Left rows with ``_before`` and ``_after``: the right rows next to them in time, per key.

    Both sides go through one ordered pass that carries the right row met last. Right rows at a left row's time count
    as before it (``side`` 1) or after it (-1). Rows without a time or a key meet nothing.
    """
    known = F.col(when).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    marks = right.where(known).select(
        *keys, F.col(when).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(when, *value).alias("_m"),
        F.lit(None).cast(left.schema).alias("_l"),
    )
    asks = left.select(
        *keys, F.col(at).alias("_t"), F.lit(side).alias("_side"), F.lit(None).cast(marks.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(marks.schema["_m"].dataType).alias("_m"), F.struct(*left.columns).alias("_l"),
    )
    u = with_nearby(marks.unionByName(asks), keys, ["_t", "_side", "_tie"], F.col("_m"), "_before", "_after", hot)
    timed = F.col("_t").isNotNull()
    return u.where(F.col("_l").isNotNull()).select("_l.*", *[F.when(timed, F.col(c)).alias(c) for c in ("_before", "_after")])


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, value: Sequence[str], tie: str, hot: bool | None,
    forward: bool = False,
) -> DataFrame:
    """``match``: the last right row at or before each left row (forward: the first at or after), per key.

    Of right rows of one time the largest ``tie`` counts (forward: the smallest). Left rows without a match get nulls;
    repeated left rows stay as they are.
    """
    d = _sweep(left, right, keys, at, when, value, tie, hot, -1 if forward else 1)
    return d.select(*left.columns, F.col("_after" if forward else "_before").alias("match"))


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, value: Sequence[str], tie: str, within: int,
    hot: bool | None = None,
) -> DataFrame:
    """Columns of the latest right row with at - within < when <= at."""
    d = asof(left, right, keys, at, when, value, tie, hot)
    near = F.col(f"match.{when}") > F.col(at) - within
    return d.select(*left.columns, *[F.when(near, F.col(f"match.{c}")).alias(c) for c in (when, *value)])


def _neighbours(left: DataFrame, right: DataFrame, at: str, when: str, pick: str, hot: bool | None) -> DataFrame:
    """Left rows with the smallest ``pick`` of the last time up to them (_before) and of the next one (_after).

    A right side counted small is looked up by binary search, and the left side does not move at all.
    """
    r = right.where(F.col(when).isNotNull() & F.col(pick).isNotNull()).groupBy(when).agg(F.min(pick).alias(pick))
    if hot or r.limit(LOOKUP_ROWS + 1).count() > LOOKUP_ROWS:
        return _sweep(left, r, [], at, when, [pick], pick, hot)
    found = sorted((x[when], x[pick]) for x in r.collect())  # at most LOOKUP_ROWS
    table = left.sparkSession.sparkContext.broadcast([np.array(c, np.int64) for c in zip(*found)] or [np.empty(0, np.int64)] * 2)
    kinds = {n: dict(r.dtypes)[n] for n in (when, pick)}

    def look(step: int):
        @F.pandas_udf("struct<t: bigint, p: bigint>")
        def place(t: pd.Series) -> pd.DataFrame:
            times, picks = table.value
            asked = t.isna().to_numpy()
            i = np.searchsorted(times, t.fillna(0).to_numpy(np.int64), "right") - 1 + step
            none = asked | (i < 0) | (i >= len(times))
            i = np.where(none, 0, i)
            value = lambda a: pd.Series(a[i] if len(a) else i).astype("Int64").mask(none)
            return pd.DataFrame({"t": value(times), "p": value(picks)})

        return place(F.col(at).cast("bigint"))

    d = left.withColumn("_b", look(0)).withColumn("_a", look(1))
    named = lambda c: F.when(F.col(f"{c}.t").isNotNull(), F.struct(F.col(f"{c}.t").cast(kinds[when]).alias(when), F.col(f"{c}.p").cast(kinds[pick]).alias(pick)))
    return d.select(*left.columns, named("_b").alias("_before"), named("_a").alias("_after"))


def nearest(left: DataFrame, right: DataFrame, at: str, when: str, pick: str, within: int, hot: bool | None = None) -> DataFrame:
    """The right row closest in time, at most ``within`` away (ties: smaller ``pick``)."""

    def offer(m: str) -> Column:
        gap = F.abs(F.col(f"{m}.{when}") - F.col(at))
        return F.when(gap <= within, F.struct(gap.alias("gap"), F.col(f"{m}.{pick}").alias("pick")))

    d = _neighbours(left, right, at, when, pick, hot)
    return d.select(*left.columns, F.least(offer("_before"), offer("_after"))["pick"].alias(pick))


def first_after(left: DataFrame, right: DataFrame, at: str, when: str, pick: str, within: int, hot: bool | None = None) -> DataFrame:
    """The first right row with 0 <= when - at <= within (ties: smaller ``pick``)."""
    d = _neighbours(left, right, at, when, pick, hot)
    now = F.col(f"_before.{when}") == F.col(at)
    near = F.col(f"_after.{when}") - F.col(at) <= within
    return d.select(*left.columns, F.when(now, F.col(f"_before.{pick}")).when(near, F.col(f"_after.{pick}")).alias(pick))


def aligned_blocks(start: Column, end: Column, levels: int) -> Column:
    """The fewest aligned blocks that make up the whole numbers from start to end: (level, block) of 2^level each.

    At every level at most the first and the last block are open to the level above, so there are two a level at most.
    """
    found = []
    for k in range(levels):
        low = -F.shiftright(-start, k)  # rounded up
        high = F.shiftright(end + 1, k)
        for odd, block in ((low, low), (high, high - 1)):
            taken = (low < high) & (odd.bitwiseAND(F.lit(1).cast("bigint")) == 1)
            found.append(F.when(taken, F.struct(F.lit(k).alias("level"), block.alias("block"))))
    return F.array_compact(F.array(*found))


def covering_span(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, value: Sequence[str], tie: str
) -> DataFrame:
    """The span of the same key that covers ``at``; of several the one that starts last, then the largest ``tie``.

    Times are whole numbers, both ends count. Time is cut into pieces as long as the longest span, so a span touches
    two at most. Where no piece is touched by more than CROWD spans of a key, they are one short list and a point
    picks from the list of its piece. Otherwise (``_by_blocks``) a span stands for the aligned blocks it is made of.
    Points without a time or a key, and points outside all spans, get nulls; repeated points stay as they are.
    """
    cols = list(dict.fromkeys([*value, start]))
    s = spans.where(F.col(end) >= F.col(start)).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"),
        F.col(tie).alias("_tie"), F.struct(*cols).alias("_m"),
    )
    longest = s.agg(F.max(F.col("_e") - F.col("_s") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    piece = lambda c: F.shiftright(c, levels)
    names = [f"_r_{k}" for k in keys]
    s = s.withColumn("_r_piece", F.explode(F.array_distinct(F.array(piece(F.col("_s")), piece(F.col("_e"))))))
    most = s.groupBy(*names, "_r_piece").count().agg(F.max("count")).first()[0] or 0
    if most > CROWD:
        return _by_blocks(points, s.drop("_r_piece").distinct(), keys, at, levels, cols)
    lists = s.groupBy(*names, "_r_piece").agg(F.collect_list(F.struct("_s", "_tie", "_e", "_m")).alias("_l"))
    time = F.col(at).cast("bigint")
    cond = piece(time) == F.col("_r_piece")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    fit = F.filter("_l", lambda x: (x["_s"] <= time) & (x["_e"] >= time))
    d = points.join(lists, cond, "left").withColumn("_w", F.array_max(fit))
    return d.select(*points.columns, *[F.col(f"_w._m.{c}").alias(c) for c in cols])


def _by_blocks(points: DataFrame, s: DataFrame, keys: Sequence[str], at: str, levels: int, cols: Sequence[str]) -> DataFrame:
    """Of the spans of a block only the one that wins is kept, so spans that lie in each other by the thousand leave one
    row a block. A point asks the one block of each level that holds it: equality joins with one row at most, and
    nothing left to compare."""
    names = [f"_r_{k}" for k in keys]
    b = s.withColumn("_b", F.explode(aligned_blocks(F.col("_s"), F.col("_e"), levels)))
    best = b.groupBy(*names, F.col("_b.level").alias("_r_level"), F.col("_b.block").alias("_r_block"))
    best = best.agg(F.max(F.struct("_s", "_tie", "_m")).alias("_w"))
    asked = points.select(*keys, F.col(at).cast("bigint").alias("_t")).where("_t IS NOT NULL").distinct()
    levels_of = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_t", k).alias("block")) for k in range(levels)])
    asked = asked.withColumn("_b", F.explode(levels_of))
    cond = (F.col("_b.level") == F.col("_r_level")) & (F.col("_b.block") == F.col("_r_block"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    met = asked.join(best, cond).groupBy(*[F.col(k).alias(f"_a_{k}") for k in keys], "_t").agg(F.max("_w").alias("_w"))
    cond = F.col(at).cast("bigint") == F.col("_t")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_a_{k}"))
    d = points.join(met, cond, "left")
    return d.select(*points.columns, *[F.col(f"_w._m.{c}").alias(c) for c in cols])


def head_to_head(df: DataFrame, s: Sizes) -> DataFrame:
    """Rivals beaten in the contest (ties count half), from ranks instead of pairs."""
    d = with_rank(df, CONTEST, F.col("finish_position"), "_r", "average", hot=s.contest)
    d = with_totals(d, CONTEST, {"_n": F.count("finish_position")}, s.contest)
    return d.withColumn("beaten", F.col("_n") - F.col("_r")).drop("_r", "_n")


def traffic(
    df: DataFrame, rating: Column, who: str, s: Sizes, slots: int = 5, margin: float = 25.0
) -> DataFrame:
    """stronger_behind_n and weaker_ahead_n: rivals within ``slots`` grid places and beyond a margin.

    A row holds the ratings of the next and the last few slots as short lists and counts in them. Where a contest may
    be too large for one task, slots send their lists to their neighbours instead. Slots with more than CROWD rows are
    in no list and answered by ordered running counts (``_crowded``): a crowded slot is a sort, not a product.
    """
    d = df.withColumn("_e", rating.cast("double"))
    slot = F.col("grid_position").cast("long")
    known = slot.isNotNull() & F.col("_e").isNotNull()
    sizes = df.where(slot.isNotNull()).groupBy(*CONTEST, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    crowd = sizes.where(F.col("_n") > CROWD).select(*CONTEST, "_slot")
    any_crowd = not crowd.isEmpty()
    higher, lower = (lambda x: x > F.col("_e") + margin), (lambda x: x < F.col("_e") - margin)
    if not s.contest and not any_crowd:
        w = Window.partitionBy(*CONTEST).orderBy(slot)
        e = F.collect_list(F.when(known, F.col("_e")))
        d = d.withColumn("_b", e.over(w.rangeBetween(1, slots))).withColumn("_a", e.over(w.rangeBetween(-slots, -1)))
        counted = lambda c, f: F.when(known, F.size(F.filter(c, f)).cast("long")).otherwise(F.lit(0).cast("long"))
        return d.withColumn("stronger_behind_n", counted("_b", higher)).withColumn("weaker_ahead_n", counted("_a", lower)).drop("_e", "_a", "_b")
    rows = d.where(known).select(*CONTEST, F.col(who).alias("_who"), slot.alias("_slot"), "_e")
    calm = rows.join(crowd, [*CONTEST, "_slot"], "left_anti") if any_crowd else rows
    lists = calm.groupBy(*CONTEST, "_slot").agg(F.collect_list("_e").alias("_l"))  # at most CROWD numbers
    here = rows.select(*CONTEST, "_slot").distinct() if any_crowd else lists.select(*CONTEST, "_slot")
    if s.contest:  # a contest may have too many slots for one task: every slot sends its list to its neighbours
        steps = F.explode(F.array(*[F.lit(k) for k in range(-slots, slots + 1) if k])).alias("_k")
        sent = lists.select(*CONTEST, "_slot", "_l", steps)
        sent = sent.groupBy(*CONTEST, (F.col("_slot") + F.col("_k")).alias("_slot")).agg(
            F.flatten(F.collect_list(F.when(F.col("_k") < 0, F.col("_l")))).alias("_behind"),
            F.flatten(F.collect_list(F.when(F.col("_k") > 0, F.col("_l")))).alias("_ahead"),
        )
        near = here.join(sent, [*CONTEST, "_slot"])
    else:
        both = lists if not any_crowd else here.join(lists, [*CONTEST, "_slot"], "left")
        w = Window.partitionBy(*CONTEST).orderBy("_slot")
        near = both.select(
            *CONTEST, "_slot", F.flatten(F.collect_list("_l").over(w.rangeBetween(1, slots))).alias("_behind"),
            F.flatten(F.collect_list("_l").over(w.rangeBetween(-slots, -1))).alias("_ahead"),
        )
    count = lambda c, f: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<double>")), f)).cast("long")
    counts = rows.join(near, [*CONTEST, "_slot"], "left").select(
        *CONTEST, "_who", count("_behind", higher).alias("_sb"), count("_ahead", lower).alias("_wa"),
    )
    if any_crowd:
        counts = counts.unionByName(_crowded(rows, crowd, s, slots, margin))
        counts = counts.groupBy(*CONTEST, "_who").agg(F.sum("_sb").alias("_sb"), F.sum("_wa").alias("_wa"))
    d = join_groups(d.drop("_e"), counts.withColumnRenamed("_who", who), [*CONTEST, who])
    named = {"stronger_behind_n": "_sb", "weaker_ahead_n": "_wa"}
    return d.withColumns({n: F.coalesce(c, F.lit(0).cast("long")) for n, c in named.items()}).drop(*named.values())


def _crowded(rows: DataFrame, crowd: DataFrame, s: Sizes, slots: int, margin: float) -> DataFrame:
    """What rows within reach of a crowded slot count there (_who, _sb, _wa).

    Questions and rows of a slot share one ordered running count.
    """
    held = rows.join(crowd, [*CONTEST, "_slot"], "left_semi").select(
        *CONTEST, "_slot", F.col("_e").alias("_at"), F.lit(1).alias("_is"), F.lit(0).alias("_ask"), F.lit(None).cast(dict(rows.dtypes)["_who"]).alias("_who")
    )
    steps = F.explode(F.array(*[F.lit(k) for k in range(-slots, slots + 1) if k])).alias("_k")
    bound = F.when(F.col("_k") > 0, F.col("_e") + margin).otherwise(F.col("_e") - margin)
    # behind: rows with rating > bound, so rows at the bound sort before the question (2);
    # ahead: rows with rating < bound, so the question (-2) sorts before rows at the bound (0)
    ask = rows.select(*CONTEST, "_who", "_e", "_slot", steps).select(
        *CONTEST, (F.col("_slot") + F.col("_k")).alias("_slot"), bound.alias("_at"), F.lit(0).alias("_is"),
        F.when(F.col("_k") > 0, 2).otherwise(-2).alias("_ask"), "_who",
    ).join(crowd, [*CONTEST, "_slot"], "left_semi")
    keys = [*CONTEST, "_slot"]
    u = with_prefix(held.unionByName(ask), keys, ["_at", "_ask", "_who"], {"_low": F.col("_is")}, s.contest)
    u = with_totals(u, keys, {"_all": F.sum("_is")}, s.contest)
    low = F.coalesce(F.col("_low"), F.lit(0))
    return u.where(F.col("_ask") != 0).groupBy(*CONTEST, "_who").agg(
        F.sum(F.when(F.col("_ask") == 2, F.col("_all") - low).otherwise(0)).alias("_sb"),
        F.sum(F.when(F.col("_ask") == -2, low).otherwise(0)).alias("_wa"),
    )


def latest_snapshot(quotes: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows at the newest time of their key (all rows of that instant)."""
    newest = quotes.groupBy(*keys).agg(F.max(ts).alias(ts))
    return quotes.join(newest, [*keys, ts], "left_semi")


def with_parameter(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Every row once per parameter value (a projection, not a join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def aligned_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column the largest |a - b| on common keys, and the key where it occurs."""
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in columns])
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in columns])
    d = left.join(right, list(keys))
    wide = d.select(*keys, *[F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in columns])
    long = wide.unpivot(list(keys), list(columns), "column_name", "diff").where(F.col("diff").isNotNull())
    return long.groupBy("column_name").agg(
        F.max(F.struct("diff", *[(-F.col(k)).alias(k) for k in keys])).alias("m")
    ).select("column_name", F.col("m.diff").alias("max_diff"), *[(-F.col(f"m.{k}")).alias(k) for k in keys])


def future_rows(df: DataFrame, remaining: DataFrame, null_columns: Sequence[str]) -> DataFrame:
    """The lineup of the last contest repeated for every remaining contest, outcomes empty.

    remaining: year, round, venue; it goes to every task only while it is counted small.
    """
    small = remaining.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    last = df.agg(F.max(F.struct("year", "round")).alias("m")).select("m.year", "m.round")
    lineup = df.join(F.broadcast(last), ["year", "round"], "left_semi").select("entrant", "team")
    types = dict(df.dtypes)
    empty = [F.lit(None).cast(types[c]).alias(c) for c in null_columns]
    return lineup.crossJoin(F.broadcast(remaining) if small else remaining).select("year", "round", "venue", "entrant", "team", *empty)


def fuzzy_name(key: Column, names: Sequence[str], least: float = 0.72) -> Column:
    """The listed name equal to the key, else the most similar one (edit distance) if close enough.

    The list is a fixed dictionary, so the comparison is an expression on the row.
    """

    def scored(n: Column) -> Column:
        far = F.levenshtein(key, n) / F.greatest(F.length(key), F.length(n))
        return F.struct(far.alias("far"), n.alias("name"))

    best = F.array_min(F.transform(F.array(*[F.lit(n) for n in names]), scored))
    return F.when(key.isin(*names), key).when(1 - best["far"] >= least, best["name"])


def substring_alias(key: Column, aliases: Sequence[str]) -> Column:
    """The alias equal to the key, else the first in list order contained in it or containing it."""
    found = F.lit(None).cast("string")
    for a in reversed(list(aliases)):
        found = F.when(F.contains(key, F.lit(a)) | F.contains(F.lit(a), key), F.lit(a)).otherwise(found)
    return F.when(key.isin(*aliases), key).otherwise(found)
