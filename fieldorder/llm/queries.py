"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldorder.llm import ann, chat, hard_negatives, html_text, lexical, line_dedup, mixing, ngram_join, packing, quality, syncmers, tokens, url_filter
from fieldorder.llm.common import table

TOKENIZER = "word_bpe_49k.json"

#: Host words of the pages whose URLs make up the list of operator 10.
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op3_hash_prefix_forest")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 100 = 0"))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


MIX_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5)
           / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
o AS (SELECT *, 2 * source_size / weight AS full_at,
        COALESCE(SUM(2 * source_size) OVER r, 0) AS capped, SUM(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, SUM(source_size) OVER () AS total
      FROM w WINDOW r AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min((1.5 * total - capped) / open_weight, full_at) FILTER (WHERE (1.5 * total - capped) / open_weight <= full_at) AS level FROM o),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * weight) AS target FROM w, lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t),
j AS (SELECT d.*, source_size, target, floor(ratio) AS whole, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS rest
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM j),
h AS (SELECT *, q IS NOT NULL AND SUM(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS more FROM q),
m AS (SELECT source AS ms, rest - COALESCE(SUM(size) FILTER (WHERE more), 0) AS short FROM h GROUP BY source, rest),
l AS (SELECT source AS ls, n AS l_n FROM (
        SELECT h.*, row_number() OVER (PARTITION BY source ORDER BY abs(short - size), q, doc_id, size, n) AS k
        FROM h JOIN m ON h.source IS NOT DISTINCT FROM ms WHERE NOT more AND size > 0 AND p > 0 AND abs(short - size) < abs(short)) WHERE k = 1)
SELECT doc_id, source, size, source_size, target,
       CAST(whole + CAST(more AS INT) + CASE WHEN n = l_n THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(size * (whole + CAST(more AS INT) + CASE WHEN n = l_n THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM h LEFT JOIN l ON source IS NOT DISTINCT FROM ls"""


@query("op8_source_mixing", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_chat_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], chats.schema)
    return chat.read_back(chat.examples(chats.unionByName(more)))


URL_SQL = r"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
c AS (SELECT *, nullif(regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(/|\.html)$', ''), '') AS canonical,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u),
l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam']))
SELECT page_id, host, path, canonical, rule, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) AS listed,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END END AS verdict
FROM c"""


@query("op10_url_filters", URL_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    words = F.array(*[F.lit(w) for w in LISTED_WORDS])
    listed = pages.where(F.arrays_overlap(F.split(url_filter.host(), "[.-]"), words))
    return url_filter.judge(pages, listed)


SEARCH_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT item_id, term, COUNT(*) AS times FROM i GROUP BY item_id, term),
s AS (SELECT COUNT(*) AS total, CAST(SUM(len(words)) AS BIGINT) AS words FROM t WHERE len(words) > 0),
p AS MATERIALIZED (
  SELECT r, doc_id, n, term, COUNT(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM t) w
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, total),
c AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // words)) AS part FROM p, s),
m AS (SELECT item_id, r, doc_id, CAST(SUM(times * weight * part) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN c USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM m WHERE score > 0 QUALIFY rank <= 20"""


@query("op11_ranked_search", SEARCH_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_syncmer_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH r AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
m AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM m WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN m USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), "id % 50 = 0")
