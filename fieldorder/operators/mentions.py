"""Mentions of entrants in texts and their weighted scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldorder.operators.grouping import with_index


def mentions(texts: DataFrame, text: Column, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per text and entity with any alias in the lower-cased text.

    The alias list is part of the expression: texts are read once and never shuffled here.
    """
    low = F.lower(text)
    hits = []
    for entity, names in aliases.items():
        found = F.lit(False)
        for n in names:
            found = found | F.contains(F.col("_low"), F.lit(n.lower()))
        hits.append(F.when(found, F.lit(entity)))
    d = texts.withColumn("_low", F.coalesce(low, F.lit("")))
    d = d.withColumn("entity", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return d.drop("_low")


def post_weight(score: Column, comment: Column) -> Column:
    """log(1 + max(score, 1)); comments count half."""
    return F.log1p(F.greatest(score, F.lit(1)).cast("double")) * F.when(comment, 0.5).otherwise(1.0)


def weighted_score(df: DataFrame, keys: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """Weighted mean over rows with a value, and the number of mentions."""
    w = F.when(value.isNotNull(), weight)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(value * weight), F.nullif(F.sum(w), F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("mention_count")
    )


def window_posts(
    posts: DataFrame, contests: DataFrame, ts: str, start: str, source: str, score: str, tie: str,
    days: int = 7, least: int = 10, per_source: int = 100, hot: bool | None = None,
) -> DataFrame:
    """The best-scored posts of each source in the days before a contest (a top-k per source).

    Posts and contests meet on day buckets; a post belongs to every contest whose window covers it.
    """
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 86_400_000_000)
    c = contests.withColumn("_day", F.explode(F.sequence(day(start) - days, day(start))))
    p = posts.where(F.col(score) >= least).withColumn("_day", day(ts))
    d = p.join(c, "_day").where((F.col(ts) >= F.col(start) - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= F.col(start)))
    keys = [k for k in contests.columns if k != start]
    d = with_index(d.drop("_day"), [*keys, source], [F.desc(score), tie], "_k", hot)
    return d.where(F.col("_k") <= per_source).drop("_k")


def top_comments(comments: DataFrame, post: str, order: Sequence[Column], keep: int, hot: bool | None) -> DataFrame:
    return with_index(comments, [post], order, "_k", hot).where(F.col("_k") <= keep).drop("_k")


def attach_scores(df: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """driver and team scores of (keys, entity_type, entity) beside each row; missing is 0.

    df has entrant and team as strings to match ``entity``.
    """
    d = df
    for kind, column, out in (("driver", "entrant", "driver_sentiment_7d"), ("team", "team", "team_sentiment_7d")):
        s = scores.where(F.col("entity_type") == kind).select(*keys, F.col("entity").alias("_e"), F.col("score").alias(out))
        cond = F.col(f"d.{column}").cast("string") == F.col("s._e")
        for k in keys:
            cond = cond & (F.col(f"d.{k}") == F.col(f"s.{k}"))
        d = d.alias("d").join(s.alias("s"), cond, "left").select("d.*", F.coalesce(f"s.{out}", F.lit(0.0)).alias(out))
    return d
