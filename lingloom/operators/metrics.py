"""Call metrics of jobs and comparisons of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_up


def call_metrics(call_log: DataFrame, keys: list[str]) -> DataFrame:
    """Requests, retries, rounded mean and greatest latency and summed time of each key; failed calls count as requests."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return call_log.groupBy(*keys).agg(F.count("*").alias("requests"), z(F.sum("retry_count")).alias("retries"), z(half_up(F.avg("latency_ms"))).alias("avg_latency_ms"), z(F.max("latency_ms")).alias("max_latency_ms"), z(F.sum("latency_ms")).alias("api_time_ms"))


def provider_summary(call_log: DataFrame, results: DataFrame) -> DataFrame:
    """call_metrics of each provider with its completed and failed segments."""
    counts = results.groupBy("provider").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return call_metrics(call_log, ["provider"]).join(counts, "provider", "left").na.fill(0, ["completed", "failed"])


def samples(results: DataFrame, segments: DataFrame, key: str = "provider", k: int = 5) -> DataFrame:
    """The first k results of each key in document order, with their source texts."""
    w = Window.partitionBy(key).orderBy("doc_id", "seg_index")
    first = results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return first.join(segments.select("doc_id", "segment_id", "source_text"), ["doc_id", "segment_id"]).select(key, "rank", "doc_id", "segment_id", "source_text", "translated_text")


def compare_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two providers' texts side by side by segment; '(failed)' for a blank one."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(failed)"))
    keys = ["doc_id", "segment_id"]
    both = a.select(*keys, F.col("translated_text").alias("_a")).join(b.select(*keys, F.col("translated_text").alias("_b")), keys, "left")
    return both.select(*keys, shown("_a").alias("text_a"), shown("_b").alias("text_b"))


def provider_verdict(summary: DataFrame) -> DataFrame:
    """One row: the fastest provider with its lead over the slowest in %, and the one with the fewest failures; ties are 'equal'.

    The summary has a row for each provider, so its one-task aggregate is of that size.
    """
    row = summary.agg(F.min("api_time_ms").alias("lo"), F.max("api_time_ms").alias("hi"), F.min("failed").alias("fl"), F.min_by("provider", "api_time_ms").alias("fast"), F.min_by("provider", "failed").alias("sure"), F.collect_list("api_time_ms").alias("t"), F.collect_list("failed").alias("f"))
    ties = lambda xs, lo: F.size(F.filter(xs, lambda x: x == lo))
    fast_tie = ties(F.col("t"), F.col("lo")) > 1
    return row.select(
        F.when(fast_tie, "equal").otherwise(F.col("fast")).alias("fastest_provider"),
        F.when(fast_tie, 0).otherwise(half_up(F.try_divide((F.col("hi") - F.col("lo")) * 100.0, F.col("hi")))).cast("long").alias("speedup_percentage"),
        F.when(ties(F.col("f"), F.col("fl")) > 1, "equal").otherwise(F.col("sure")).alias("most_reliable_provider"),
    )


def slowest_call(call_log: DataFrame, key: str) -> DataFrame:
    """The call of greatest latency of each key, the earliest batch of equals."""
    best = call_log.groupBy(key).agg(F.max_by(F.struct("batch_no", "latency_ms"), F.struct("latency_ms", -F.col("batch_no"))).alias("b"))
    return best.select(key, "b.batch_no", "b.latency_ms")
