"""Usage, caches, incremental indexing and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_totals(ledger: DataFrame, model: Column) -> DataFrame:
    """ledger, model, tokens_used, token_limit, requests, remaining, percent_used, exhausted; nulls count as 0.

    The limit is the largest of the group; without one, everything is used up.
    """
    by = ledger.groupBy("ledger", model.alias("model")).agg(
        F.sum(F.coalesce("tokens_used", F.lit(0))).alias("tokens_used"), F.max(F.coalesce("token_limit", F.lit(0))).alias("token_limit"), F.sum(F.coalesce("requests_count", F.lit(0))).alias("requests")
    )
    used, limit = F.col("tokens_used"), F.col("token_limit")
    return by.select(
        "*", F.greatest(F.lit(0), limit - used).alias("remaining"),
        F.round(F.when(limit == 0, 100.0).otherwise(used * 100.0 / limit), 6).alias("percent_used"), (used >= limit).alias("exhausted"),
    )


def quota(usage: DataFrame, asked: Column, warn: float = 90.0) -> DataFrame:
    """usage (of usage_totals) with decision: refuse beyond the limit, warn from warn percent on, else accept."""
    after = F.col("tokens_used") + asked
    decision = F.when(F.col("exhausted") | (after > F.col("token_limit")), "refuse").when(after * 100.0 > F.col("token_limit") * warn, "warn").otherwise("accept")
    return usage.withColumn("decision", decision)


def lru_contents(log: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """key, last_seq, position: what an LRU cache holds after a log of accesses, the latest first."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(seq).alias("last_seq")).orderBy(F.col("last_seq").desc(), key).limit(capacity)
    return last.withColumn("position", F.row_number().over(W.orderBy(F.col("last_seq").desc(), key)))


def cache_lookup(texts: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """texts with text_key (SHA-256) and hit, by whether cache (text_key) has it; a null text is never a hit."""
    keyed = texts.withColumn("text_key", F.sha2(text, 256))
    known = cache.select("text_key").where("text_key is not null").distinct().withColumn("hit", F.lit(True))
    return keyed.join(known, "text_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def not_processed(rows: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the processed; rows with a null key stay."""
    return rows.join(processed.select(key).distinct(), key, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key and change (new, changed, deleted) between two loads of (key, content); equal rows are left out."""
    a = old.select(F.col(key).alias("k"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("a")).where("k is not null")
    b = new.select(F.col(key).alias("k"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("b")).where("k is not null")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "k", "full_outer").select(F.col("k").alias(key), change.alias("change")).where("change is not null")


METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
WEIGHTS = (0.3, 0.3, 0.2, 0.2)


def report(scores: DataFrame, metrics: tuple[str, ...] = METRICS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row: number of cases, mean of each metric and weighted overall, rounded to six places; NaN counts as missing."""
    clean = scores.select(*[F.nanvl(m, F.lit(None).cast("double")).alias(m) for m in metrics])
    means = clean.agg(F.count("*").alias("n_cases"), *[F.avg(m).alias(m) for m in metrics])
    overall = sum(F.coalesce(m, F.lit(0.0)) * w for m, w in zip(metrics, weights))
    return means.select("n_cases", *[F.round(m, 6).alias(m) for m in metrics], F.round(overall, 6).alias("overall"))


def failed(scores: DataFrame, threshold: float, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Cases whose lowest metric is below the threshold; NaN and null count as missing."""
    return scores.where(F.least(*[F.nanvl(m, F.lit(None).cast("double")) for m in metrics]) < threshold)
