"""Group-wise aggregates, ranks, prefix sums and quantiles that stay distributed.

A Spark window sorts each group inside one task. That is the cheapest plan while groups
are moderate, and a dead end when one contest or session holds a large share of all rows.
Every function here therefore takes ``hot``:

* ``False``: the caller knows a bound on the group size; a plain window is used;
* ``True``:  the group is split: aggregates become map-side combined ``groupBy`` + join, and
  anything ordered goes through a global range sort whose partitions cut through groups;
* ``None``:  the largest group is measured first (one aggregated number).

Both ways give the same rows.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest group that is left to one window task.
GROUP_ROW_LIMIT = 1_000_000

#: Width of a stretch of logarithms whose exponentials are added up as they are.
CELL = 256.0

#: Group rows up to which a table of groups goes to every task instead of both sides being shuffled.
BROADCAST_GROUPS = 200_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group (a single number reaches the driver)."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def is_hot(df: DataFrame, keys: Sequence[str], hot: bool | None) -> bool:
    return largest_group(df, keys) > GROUP_ROW_LIMIT if hot is None else hot


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the reliable checkpoint folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Write a table that is read many times as Parquet beside the checkpoints, and read it back.

    Readers take the columns they need. The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _names(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _reversed(order: Sequence[str]) -> list[Column]:
    """The exact reverse of an ascending order (nulls last)."""
    return [F.col(o).desc_nulls_last() for o in order]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one row per group to the detail rows; null keys match each other."""
    right = groups.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return df.join(right, _same(df, right, keys), "left").drop(*[f"_r_{k}" for k in keys])


def settled(groups: DataFrame) -> DataFrame:
    """A checkpointed table of groups, broadcast while it is counted small.

    The detail rows then stand in the plan once, so a chain of split steps grows by one join a step instead of
    doubling, and a hot key's rows need not move to meet their group.
    """
    groups = checkpointed(groups)
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def with_totals(
    df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], hot: bool | None = None
) -> DataFrame:
    """Add whole-group aggregates to every row of the group."""
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return join_groups(df, settled(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])), keys)


def _runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range-sort by (keys, order) and number the rows; a hot group spans many partitions.

    ``_run`` is the partition, ``_at`` the row's place in it. The sorted rows are checkpointed
    so that both reads below see the same split.
    """
    s = df.orderBy(*keys, *_names(order)).withColumn("_gid", F.monotonically_increasing_id())
    s = s.withColumn("_run", F.shiftright("_gid", 33))
    return checkpointed(s)


def _with_run_offsets(s: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], how=F.sum) -> DataFrame:
    """Totals of the earlier runs of the same group: one row per (group, run)."""
    w = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = s.groupBy(*keys, "_run").agg(
        F.min("_gid").alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
        *[how(c).alias(f"_t_{n}") for n, c in sums.items()],
    )
    per_run = per_run.select(
        *keys,
        "_run",
        "_first",
        F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_skip"),
        *[how(f"_t_{n}").over(w).alias(f"_o_{n}") for n in sums],
    )
    return join_groups(s, per_run, [*keys, "_run"])


def with_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str,
    hot: bool | None = None,
) -> DataFrame:
    """Position 1..n of each row in its group; ``order`` must be total within a group."""
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys).orderBy(*_names(order))
        return df.withColumn(out, F.row_number().over(w))
    s = _with_run_offsets(_runs(df, keys, order), keys, {})
    place = (F.col("_skip") + F.col("_gid") - F.col("_first") + 1).cast("int")
    return s.withColumn(out, place).drop("_gid", "_run", "_first", "_skip")


def with_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    hot: bool | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Running sums over the earlier rows of the group (and the row itself if inclusive)."""
    last = 0 if inclusive else -1
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys).orderBy(*_names(order))
        w = w.rowsBetween(Window.unboundedPreceding, last)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    measured = df.select("*", *[c.alias(f"_m_{n}") for n, c in sums.items()])
    s = _runs(measured, keys, order)
    s = _with_run_offsets(s, keys, {n: F.col(f"_m_{n}") for n in sums})
    w = Window.partitionBy(*keys, "_run").orderBy("_gid").rowsBetween(Window.unboundedPreceding, last)
    cols = []
    for n in sums:
        inside = F.sum(f"_m_{n}").over(w)
        before = F.col(f"_o_{n}")
        total = F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
        cols.append(F.when(before.isNotNull() | inside.isNotNull(), total).alias(n))
    return s.select(*[F.col(c) for c in df.columns], *cols)


def with_running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, hot: bool | None = None
) -> DataFrame:
    """The largest value of the row and the earlier rows of its group."""
    last = (Window.unboundedPreceding, Window.currentRow)
    if not is_hot(df, keys, hot):
        return df.withColumn(out, F.max(value).over(Window.partitionBy(*keys).orderBy(*_names(order)).rowsBetween(*last)))
    s = _with_run_offsets(_runs(df.withColumn("_m", value), keys, order), keys, {"m": F.col("_m")}, F.max)
    inside = F.max("_m").over(Window.partitionBy(*keys, "_run").orderBy("_gid").rowsBetween(*last))
    return s.select(*[F.col(c) for c in df.columns], F.greatest("_o_m", inside).alias(out))


def with_log_prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, hot: bool | None = None
) -> DataFrame:
    """log(sum(exp(value))) over the row and the earlier rows of its group, at any distance between values.

    The running maximum only grows, so it cuts a group into stretches of CELL. Inside a stretch the terms are scaled by
    its upper end, and of the stretches before only the one next to it is not lost in rounding: no sum is 0.
    """
    d = with_running_max(df.withColumn("_x", value.cast("double")), keys, order, F.col("_x"), "_top", hot)
    d = d.withColumn("_cell", F.floor(F.col("_top") / CELL))
    hot = is_hot(d, keys, hot)
    term = F.exp(F.col("_x") - (F.col("_cell") + 1) * CELL)
    d = with_prefix(d, [*keys, "_cell"], order, {"_part": term}, hot, inclusive=True)
    if hot:
        ends = d.groupBy(*keys, (F.col("_cell") + 1).alias("_cell")).agg(F.sum(term).alias("_carry"))
        d = join_groups(d, settled(ends), [*keys, "_cell"])
    else:
        d = d.withColumn("_carry", F.sum(term).over(Window.partitionBy(*keys).orderBy("_cell").rangeBetween(-1, -1)))
    total = F.col("_part") + F.coalesce("_carry", F.lit(0.0)) * math.exp(-CELL)
    return d.withColumn(out, (F.col("_cell") + 1) * CELL + F.log(total)).drop("_x", "_top", "_cell", "_part", "_carry")


def with_nearby(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, before: str, after: str, hot: bool | None = None,
) -> DataFrame:
    """The last value that is not null up to each row of its group, and the first one behind it.

    Split, a group runs over several sorted partitions: what one of them ends (begins) with is carried to the next
    (one before) as one row per group and partition. What lies behind is read in reverse order, so that the frame only
    grows: a frame up to the end of the group is gone through anew for every row.
    """
    v = df.withColumn("_v", value)
    back = (Window.unboundedPreceding, Window.currentRow)
    if keys and not is_hot(df, keys, hot):
        w, behind = (Window.partitionBy(*keys).orderBy(*o) for o in (_names(order), _reversed(order)))
        d = v.withColumn(before, F.last("_v", True).over(w.rowsBetween(*back)))
        return d.withColumn(after, F.last("_v", True).over(behind.rowsBetween(Window.unboundedPreceding, -1))).drop("_v")
    every = [*keys, "_one"]
    s = _runs(v.withColumn("_one", F.lit(0)), every, order)
    at = F.when(F.col("_v").isNotNull(), F.col("_gid"))
    ends = s.groupBy(*every, "_run").agg(F.max_by("_v", at).alias("_z"), F.min_by("_v", at).alias("_a"))
    w, behind = (Window.partitionBy(*every).orderBy(o) for o in ("_run", F.desc("_run")))  # one row per group and partition
    earlier = (Window.unboundedPreceding, -1)
    ends = ends.select(
        *every, "_run", F.last("_z", True).over(w.rowsBetween(*earlier)).alias("_from"),
        F.last("_a", True).over(behind.rowsBetween(*earlier)).alias("_to"),
    )
    d = join_groups(s, ends, [*every, "_run"])
    w, behind = (Window.partitionBy(*every, "_run").orderBy(o) for o in ("_gid", F.desc("_gid")))
    d = d.withColumn(before, F.coalesce(F.last("_v", True).over(w.rowsBetween(*back)), "_from"))
    d = d.withColumn(after, F.coalesce(F.last("_v", True).over(behind.rowsBetween(*earlier)), "_to"))
    return d.drop("_v", "_one", "_gid", "_run", "_from", "_to")


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    method: str = "min",
    descending: bool = False,
    hot: bool | None = None,
) -> DataFrame:
    """Rank of ``value`` in its group with tied values sharing a rank; nulls get no rank.

    ``min`` gives the smallest place of the tie, ``average`` the middle of it.
    """
    v = df.withColumn("_v", value)
    key = F.col("_v").desc_nulls_last() if descending else F.col("_v").asc_nulls_last()
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys).orderBy(key)
        ties = F.count("_v").over(Window.partitionBy(*keys, "_v"))
        low = F.rank().over(w)
    else:
        levels = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_ties"))
        levels = with_prefix(levels, keys, [key], {"_below": F.col("_ties")}, hot=True)
        v = join_groups(v, levels, [*keys, "_v"])
        low = F.coalesce(F.col("_below"), F.lit(0)) + 1
        ties = F.col("_ties")
    rank = low.cast("int") if method == "min" else low + (ties - 1) / F.lit(2.0)
    v = v.withColumn(out, F.when(F.col("_v").isNotNull(), rank))
    return v.drop("_v", "_ties", "_below")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    hot: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group (one row per group)."""
    if not is_hot(df, keys, hot):
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])
    return df.select(*keys).distinct().join(_split_quantiles(df, keys, value, probs), list(keys), "left")


def _split_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of the groups that have a value."""
    v = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    levels = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    levels = with_prefix(levels, keys, ["_v"], {"_to": F.col("_c")}, hot=True, inclusive=True)
    levels = with_totals(levels, keys, {"_n": F.sum("_c")}, hot=True)
    picks = []
    for n, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_to") > pos) & (F.col("_to") - F.col("_c") <= pos)
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{n}"))
    g = levels.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    cols = []
    for n, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        cols.append((lo + (at - F.floor(at)) * (hi - lo)).alias(n))
    return g.select(*keys, *cols)


def with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    hot: bool | None = None,
) -> DataFrame:
    """Attach exact group quantiles to every row."""
    if not is_hot(df, keys, hot):
        w = Window.partitionBy(*keys)
        return df.select(
            "*", *[F.percentile(value, F.lit(p)).over(w).alias(n) for n, p in probs.items()]
        )
    return join_groups(df, settled(_split_quantiles(df, keys, value, probs)), keys)
