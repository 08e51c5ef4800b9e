"""Lexical statistics: term frequencies, Zipf table, top and rare terms, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.session import materialise, spread, written


def corpus_tokens(documents: DataFrame, keep_numbers: bool = True, yo_to_e: bool = True, min_len: int = 2, limit_docs: int = -1, max_file_bytes: int = 0) -> DataFrame:
    """(doc_id, term) of hyphenated words. ``limit_docs`` takes the first documents by id."""
    docs = documents.where("doc_id <> 0 and text is not null")
    if max_file_bytes:
        docs = docs.where(F.octet_length("text") <= max_file_bytes)
    if limit_docs >= 0:
        docs = docs.orderBy("doc_id").limit(limit_docs)
    return spread(docs.select("doc_id", "text")).select("doc_id", F.explode(T.corpus_words(F.col("text"), keep_numbers, yo_to_e, min_len)).alias("term"))


def term_freq(tokens: DataFrame) -> DataFrame:
    """(term, freq)."""
    return tokens.groupBy("term").agg(F.count("*").alias("freq"))


def ranked_terms(freqs: DataFrame) -> DataFrame:
    """(term, freq, rank) by falling frequency, then term.

    Ranks are counted within ranges of the sort order and shifted by the sizes of the ranges before,
    so no task has to hold the whole vocabulary."""
    w = Window.partitionBy("part").orderBy(F.desc("freq"), "term")
    ranged = written(freqs, "freqs").repartitionByRange(F.desc("freq"), F.asc("term")).withColumn("part", F.spark_partition_id())
    # The partition of a row must not be worked out twice, so the ranges are written first.
    ranged = materialise(ranged, "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    local = ranged.withColumn("at", F.row_number().over(w))
    return local.join(F.broadcast(before), "part").select("term", "freq", (F.col("at") + F.coalesce("before", F.lit(0))).cast("long").alias("rank"))


def zipf(freqs: DataFrame) -> DataFrame:
    """(rank, freq, zipf_pred): the prediction is the largest frequency over the rank."""
    freqs = written(freqs, "freqs")  # read twice: not tokenised twice
    top = freqs.agg(F.max("freq").alias("f1")).first()[0]
    return ranked_terms(freqs).select("rank", "freq", F.round(F.lit(float(top or 0)) / F.col("rank"), 6).alias("zipf_pred"))


def log_sample(ranked: DataFrame, points: int = 2000) -> DataFrame:
    """Rows of a ranked table at ranks spaced evenly in the logarithm; all of them if there are few."""
    n = ranked.count()
    if n <= points:
        return ranked
    spark = ranked.sparkSession
    at = spark.range(points).select(F.least(F.lit(n), F.greatest(F.lit(1), F.floor(F.pow(F.lit(10.0), F.col("id") * F.log10(F.lit(float(n))) / (points - 1))))).cast("long").alias("rank")).distinct()
    return ranked.join(F.broadcast(at), "rank")


def tokenizer_stats(documents: DataFrame, **options) -> DataFrame:
    """(docs, tokens, unique_terms, avg_token_len, bytes_in)."""
    by_term = term_freq(corpus_tokens(documents, **options))
    size = documents.where("doc_id <> 0 and text is not null").agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes_in")).first()
    t = by_term.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"), F.count("*").alias("unique_terms"), F.coalesce(F.sum(F.col("freq") * F.char_length("term")), F.lit(0)).alias("chars"))
    return t.select(
        F.lit(size["docs"]).cast("long").alias("docs"), "tokens", "unique_terms",
        F.when(F.col("tokens") > 0, F.col("chars") / F.col("tokens")).otherwise(0.0).alias("avg_token_len"), F.lit(size["bytes_in"]).cast("long").alias("bytes_in"),
    )


def top_terms(freqs: DataFrame, n: int = 20, keep_stop_words: bool = True) -> DataFrame:
    """(term, freq, share) of the ``n`` most frequent; the share is of all tokens, in percent."""
    freqs = written(freqs, "freqs")
    total = freqs.agg(F.sum("freq")).first()[0] or 0
    rows = freqs if keep_stop_words else freqs.where(~T.is_query_stop(F.col("term")))
    return rows.orderBy(F.desc("freq"), "term").limit(max(1, n)).select("term", "freq", (F.lit(100.0) * F.col("freq") / total).alias("share"))


def rare_bands(freqs: DataFrame) -> DataFrame:
    """(terms, tokens, once, twice, few, once_pct, twice_pct, few_pct): terms of one, two, three to five occurrences."""
    c = lambda cond, name: F.count_if(cond).alias(name)
    f = F.col("freq")
    t = freqs.agg(F.count("*").alias("terms"), F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"), c(f == 1, "once"), c(f == 2, "twice"), c(f.between(3, 5), "few"))
    pct = lambda name: F.when(F.col("terms") > 0, 100.0 * F.col(name) / F.col("terms")).otherwise(0.0).alias(f"{name}_pct")
    return t.select("*", pct("once"), pct("twice"), pct("few"))


def hapax_sample(freqs: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """A repeatable sample of terms that occur once, in order of the term."""
    return freqs.where("freq = 1").orderBy(F.xxhash64("term", F.lit(seed)), "term").limit(n).select("term").orderBy("term")


def write_tables(freqs: DataFrame, path: str) -> None:
    """``term_freq`` and ``zipf`` as CSV with headers."""
    freqs.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(f"{path}/term_freq")
    zipf(freqs).sort("rank").write.mode("overwrite").option("header", True).csv(f"{path}/zipf")
