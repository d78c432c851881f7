"""A corpus pipeline of five stages: quality rules, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; its result is written
as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldorder.llm import line_dedup, mixing, ngram_join, packing, quality
from fieldorder.llm.common import WORD, table, written

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages are not expressible in SQL (compression, SimHash, tokenizer); tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are taken out; a document that loses all its words goes."""
    d = line_dedup.dedup_lines(docs.select(*COLUMNS))
    d = d.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return d.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): smallest id (null last), then hash of the text.

    A row is known by both, so two texts under one id are two documents, and repeated rows are one.
    """
    docs = docs.select(*COLUMNS)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    keyed = docs.withColumn("_k", key)
    groups = ngram_join.ngram_join(keyed.select(F.col("_k").alias("doc_id"), "text"), n=5, percent=80)
    rows = groups.groupBy(F.col("doc_id").alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("component_id") == F.col("doc_id")).alias("first")
    )
    rows = written(rows.where("n > 1 OR NOT first"), "near-rows")
    once = keyed.join(rows.select("_k"), "_k", "left_anti")
    again = keyed.join(rows.where("first").select("_k"), "_k", "left_semi").dropDuplicates(["_k"])
    return once.unionByName(again).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A row is known by its id and its text, so two texts under one id (or none) have their own numbers; repeated rows
    are one document that is taken as often as all of them together.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text", "lang", "source", "n_chars").alias("hash"))
    docs = docs.select(*COLUMNS).withColumn("_k", key)
    copies = mixing.mix(docs, carry=["_k"]).groupBy(F.col("_k.id").alias("_i"), F.col("_k.hash").alias("_h")).agg(F.sum("copies").alias("_n"))
    d = docs.withColumn("_hash", F.col("_k.hash")).drop("_k")
    d = d.join(copies.where("_n > 0"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
    d = d.dropDuplicates(["doc_id", "_hash"])
    return d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
