"""Helpers that the operators share: written tables, columns that may be missing, word memos."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting of rows per Arrow batch, its default, and what whole documents use in its place.
BATCH, DEFAULT_ROWS, DOCUMENT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"

#: Entries that a worker's memo may hold before it starts anew.
MEMO = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows survives lost executors.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables whose last reader is written, and let Spark drop the shuffle files of plans that are done."""
    for t in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, whose buffers are as long as its texts; a session's own setting stays."""
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, DOCUMENT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers started from here on find this package where the driver does."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def size_of(text: str = "text"):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, make: Callable, read: list[str], keep: list[str], out: str) -> DataFrame:
    """Arrow-batched map: ``make(rows)`` sees tuples of the ``read`` columns and yields (row number, *values).

    A row may give none, one or many results; each gets the ``keep`` columns of its row and the columns of ``out``
    (DDL). Work goes in slices of 256 rows, so memory follows the longest texts and not the batch.
    """
    small_batches(df.sparkSession)
    made = T.StructType.fromDDL(out)
    need = list(dict.fromkeys([*keep, *read]))
    schema = T.StructType([*[df.schema[c] for c in keep], *made])
    types = [to_arrow_type(f.dataType) for f in made]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = list(make(list(zip(*[part.column(need.index(c)).to_pylist() for c in read]))))
                cols = list(zip(*got)) if got else [[]] * (1 + len(types))
                kept = part.take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[kept.column(need.index(c)) for c in keep], *[pa.array(c, t) for c, t in zip(cols[1:], types)]],
                    names=[*keep, *made.names],
                )
        give_back()

    return df.select(*need).mapInArrow(run, schema)


_HELD: list[dict | None] = [None]


def hold(memo: dict | None) -> None:
    """A worker serves one operator after another; it keeps the memo in use and gives back what the one before took."""
    if _HELD[0] is not memo:
        if _HELD[0] is not None:
            _HELD[0].clear()
            give_back()
        _HELD[0] = memo


def give_back() -> None:
    """Freed memory goes from the worker to the system; an idle worker keeps its freed blocks without it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Digests(dict):
    """Word to digest bytes, for as many words as MEMO says at most."""

    def __init__(self, digest: Callable[[bytes], bytes]):
        super().__init__()
        self.digest = digest

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = self.digest(word)
        return out

    def of(self, words: list) -> bytes:
        hold(self)
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, words))


def digest64(x: bytes) -> bytes:
    return xxhash.xxh3_64_digest(x)


def digest128(x: bytes) -> bytes:
    return xxhash.xxh3_128_digest(x)
