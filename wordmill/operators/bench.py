"""Summaries of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "query string, mode string, ok int, elapsed_ms double, hits int, score_min double, score_med double, score_max double"


def score_summary(results: DataFrame) -> DataFrame:
    """(query, hits, score_min, score_med, score_max) of result rows (query, score)."""
    return results.groupBy("query").agg(F.count("*").cast("int").alias("hits"), F.min("score").alias("score_min"), F.percentile("score", 0.5).alias("score_med"), F.max("score").alias("score_max"))


def summary(runs: DataFrame) -> DataFrame:
    """A row for each query: runs, good ones, the usual mode, median hits, latencies and score medians
    of the good runs. The 95th percentile is the element at int(0.95 * (n - 1)) in order."""
    good = F.col("ok") == 1
    ms, med = F.when(good, F.col("elapsed_ms")), F.when(good, F.col("score_med"))
    ordered = F.sort_array(F.collect_list(ms))
    n = F.size(ordered)
    return runs.groupBy("query").agg(
        F.count("*").alias("runs"),
        F.count_if(good).alias("good"),
        F.mode("mode", True).alias("mode"),
        F.percentile(F.when(good, F.col("hits")), 0.5).alias("hits_median"),
        F.min(ms).alias("ms_min"),
        F.percentile(ms, 0.5).alias("ms_median"),
        F.when(n > 0, F.get(ordered, F.floor(0.95 * (n - 1)).cast("int"))).alias("ms_p95"),
        F.max(ms).alias("ms_max"),
        F.min(med).alias("score_min"),
        F.percentile(med, 0.5).alias("score_median"),
        F.max(med).alias("score_max"),
    )
