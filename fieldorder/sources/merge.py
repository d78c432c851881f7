"""Merging new data into stored tables, and the sinks that keep them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldorder.functions import fixed_values as fv
from fieldorder.functions.scalars import is_dnf
from fieldorder.operators.medians import column_medians

CONTEST = ["year", "round"]


def read_table(spark: SparkSession, path: str, schema: str, hint: str = "run the collector first") -> DataFrame:
    """Parquet with a stated schema; a missing table fails with a hint."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        raise FileNotFoundError(f"{path} does not exist; {hint}")
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Whole-table write. With partitions, only those present in df are replaced."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def swap_table(df: DataFrame, path: str) -> None:
    """Whole-table write that never shows half a table: the new files are staged and renamed into place.

    ``df`` may read the table it replaces. A job that fails leaves the stored table as it was.
    """
    spark = df.sparkSession
    staged, old = (f"{path}.{x}-{uuid.uuid4().hex}" for x in ("staged", "old"))
    df.write.parquet(staged)
    (new, fs), (there, _), (aside, _) = (_folder(spark, p) for p in (staged, path, old))
    if fs.exists(there) and not fs.rename(there, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(new, there):
        raise OSError(f"{staged} could not be renamed to {path}")
    fs.delete(aside, True)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_once(df: DataFrame, path: str, batch: int) -> bool:
    """Append a batch exactly once: its files are staged and renamed to ``batch=<id>``; False if it is there already.

    A batch that is delivered again, or whose first writer died before the rename, leaves no double rows. Readers see
    whole batches only, with the id as column ``batch``.
    """
    spark = df.sparkSession
    target, fs = _folder(spark, f"{path}/batch={batch}")
    if fs.exists(target):
        return False
    staged, _ = _folder(spark, f"{path}/_staged-{uuid.uuid4().hex}/batch={batch}")
    df.write.parquet(staged.toString())
    done = not fs.exists(target) and fs.rename(staged, target)
    fs.delete(staged.getParent(), True)
    return bool(done)


def replace_contests(stored: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(CONTEST)) -> DataFrame:
    """Every contest in ``new`` replaces the stored one as a whole; others stay."""
    fresh = new.select(*keys).distinct()
    return stored.join(fresh, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-wise: rows of ``new`` win over stored rows with the same key (``new`` has unique keys)."""
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order; combined map-side, no sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def append_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(CONTEST)) -> DataFrame:
    """Add only contests that the stored table does not have."""
    have = stored.select(*keys).distinct()
    return stored.unionByName(new.join(have, list(keys), "left_anti"), allowMissingColumns=True)


def to_collect(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def settled_events(rows: DataFrame, event: str, result: str) -> DataFrame:
    """Events whose every row has a final result."""
    final = F.coalesce(F.col(result).isin("yes", "no"), F.lit(False))
    return rows.groupBy(event).agg(F.bool_and(final).alias("done")).where("done").select(event)


def complete_contests(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Contests in which every value column has at least one value."""
    g = df.groupBy(*CONTEST).agg(*[F.count(c).alias(c) for c in values])
    return g.where(" and ".join(f"{c} > 0" for c in values)).select(*CONTEST)


def gaps(scheduled: DataFrame, have: DataFrame, keys: Sequence[str] = tuple(CONTEST)) -> DataFrame:
    return scheduled.select(*keys).distinct().join(have.select(*keys).distinct(), list(keys), "left_anti")


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and year: rows and the sorted rounds."""
    parts = [
        df.groupBy("year")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set("round")).alias("rounds"))
        .select(F.lit(name).alias("table_name"), "year", "n_rows", "rounds")
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backfill(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Bring an older table to the current columns: add, coerce to number, fill by median.

    Returns the frame and the added columns.
    """
    added = [c for c in columns if c not in df.columns]
    d = df
    if "round_fraction" in added and {"year", "round"} <= set(df.columns):
        last = df.groupBy("year").agg(F.max("round").alias("_l"))
        d = d.join(last, "year", "left")
        d = d.withColumn("round_fraction", (F.col("round") - 1) / F.greatest(F.col("_l") - 1, F.lit(1))).drop("_l")
    new = {c: F.lit(None).cast("double") for c in added if c not in d.columns}
    d = d.withColumns(new) if new else d
    d = d.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
    fill = [c for c in columns if c not in fv.MISSING_ALLOWED]
    med = column_medians(d, fill)
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(med[c] or 0.0)) for c in fill}), added


def relabel_dnf(df: DataFrame) -> DataFrame:
    return df.withColumn("dnf", is_dnf(F.col("status")))


def changed_documents(old: DataFrame, new: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys whose content (timestamps left out) differs from the stored one or is new.

    Each side keeps an order-free digest per key, so a group of any size is one combined aggregate.
    """

    def digest(df: DataFrame, out: str) -> DataFrame:
        # the hash skips nulls, so each column comes with its null bit
        h = F.xxhash64(*[x for c in content for x in (F.col(c).isNull(), F.col(c))])
        mix = F.shiftright(h, 20)  # sums of parts: no overflow below 2**19 rows per partial, decimal beyond
        total = F.sum(mix.cast("decimal(20,0)")).cast("string")
        low = F.sum((h.bitwiseAND(F.lit(1048575))).cast("decimal(20,0)")).cast("string")
        return df.groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total, low).alias(out))

    d = digest(new, "_new").join(digest(old, "_old"), list(keys), "left")
    return d.where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*keys)


def write_if_changed(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], content: Sequence[str]) -> bool:
    """Write only when some document changed; True if written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.schema(df.schema).parquet(path)
        same_keys = old.select(*keys).distinct().join(df.select(*keys).distinct(), list(keys), "left_anti").limit(1).count() == 0
        if same_keys and changed_documents(old, df, keys, content).limit(1).count() == 0:
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_event_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

