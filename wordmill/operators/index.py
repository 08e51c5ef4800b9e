"""The inverted index as tables: tokens, postings, dictionary, documents with norms; its statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.session import materialise, spread, written


@dataclass(frozen=True)
class IndexOptions:
    keep_numbers: bool = False
    yo_to_e: bool = True
    min_len: int = 2
    max_doc_bytes: int = 0
    log_mode: str = "reference"


DEFAULT = IndexOptions()


def corpus(documents: DataFrame, options: IndexOptions = DEFAULT) -> DataFrame:
    """Documents that are indexed: an id other than 0, a text that isn't empty or over the size limit."""
    docs = documents.where("doc_id <> 0 and octet_length(text) > 0")
    return docs.where(F.octet_length("text") <= options.max_doc_bytes) if options.max_doc_bytes else docs


def tokens(documents: DataFrame, options: IndexOptions = DEFAULT) -> DataFrame:
    """(doc_id, term, chars): a row for each kept token; ``chars`` is its length before stemming.

    Characters are counted before stemming, bytes after, as the query language's index does."""
    words = T.index_words(F.col("text"), options.keep_numbers, options.yo_to_e, options.min_len)
    rows = spread(corpus(documents, options).select("doc_id", "text")).select("doc_id", F.explode(words).alias("word"))
    return (
        rows.select("doc_id", T.stem(T.cap(F.col("word"))).alias("term"), F.char_length("word").alias("chars"))
        .where(F.octet_length("term") >= options.min_len)
        .where(~T.is_index_stop(F.col("term")))
    )


def postings(documents: DataFrame, options: IndexOptions = DEFAULT) -> DataFrame:
    """(term, doc_id, tf); counts combine before the shuffle."""
    return tokens(documents, options).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def dictionary(postings: DataFrame, n_docs: int | None = None, log_mode: str = "reference") -> DataFrame:
    """(term, df), and with ``n_docs`` the inverse document frequency."""
    d = postings.groupBy("term").agg(F.count("*").alias("df"))
    if n_docs is None:
        return d
    return d.withColumn("idf", T.log_of(F.lit(float(n_docs)) / F.col("df"), log_mode))


#: A dictionary of at most so many terms is sent to all tasks; in a larger one only terms in so many documents are.
BROADCAST_TERMS, HOT_DF = 500_000, 100_000


def weights(postings: DataFrame, n_docs: int, log_mode: str = "reference", words: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, tf, df, w) with w = (1 + f(tf)) * f(N / df).

    The dictionary is written and its size looked at: a small one is sent to all tasks, so postings
    aren't shuffled; of a larger one the terms of ``HOT_DF`` or more documents are (at most the
    terms of a document * N / ``HOT_DF``), and the others, whose lists are bounded, meet by term."""
    words = materialise(dictionary(postings, n_docs, log_mode), "dictionary") if words is None else words
    scored = lambda rows: rows.select("term", "doc_id", "tf", "df", ((1 + T.log_count("tf", log_mode)) * F.col("idf")).alias("w"))
    if words.count() <= BROADCAST_TERMS:
        return scored(postings.join(F.broadcast(words), "term"))
    hot = F.broadcast(words.where(F.col("df") >= HOT_DF))
    rest = postings.join(hot.select("term"), "term", "left_anti").join(words.where(F.col("df") < HOT_DF), "term")
    return scored(postings.join(hot, "term")).unionByName(scored(rest))


def documents_table(documents: DataFrame, postings: DataFrame, options: IndexOptions = DEFAULT, n_docs: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, url, title, doc_len, norm) of every document, those without tokens included.

    Repeated ids count as documents each (N), their postings add up, and the row with the largest
    ``fetch_ts`` gives URL and title. A column ``title`` of the documents (of their meta data) is
    the title where it isn't blank; else the first line of the text is."""
    docs = corpus(documents, options)
    n = docs.count() if n_docs is None else n_docs
    norms = weights(postings, n, options.log_mode, words).groupBy("doc_id").agg(F.sum("tf").alias("doc_len"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    url = F.col("url") if "url" in documents.columns else F.concat(F.lit("doc://"), F.col("doc_id"))
    title = T.title_of_text(F.col("text"))
    if "title" in documents.columns:
        title = F.when(F.trim("title") != "", T.title_of_text(F.col("title"))).otherwise(title)
    rows = docs.select("doc_id", url.alias("url"), title.alias("title"), *(["fetch_ts"] if "fetch_ts" in documents.columns else []))
    last = F.struct(*(["fetch_ts"] if "fetch_ts" in documents.columns else []), "url", "title")
    rows = rows.groupBy("doc_id").agg(F.max(last).alias("last")).select("doc_id", "last.url", "last.title")
    return rows.join(norms, "doc_id", "left").select("doc_id", "url", "title", F.coalesce("doc_len", F.lit(0)).alias("doc_len"), F.coalesce("norm", F.lit(0.0)).alias("norm"))


def write_index(documents: DataFrame, path: str, options: IndexOptions = DEFAULT) -> None:
    """Postings sorted by term (row groups are skipped by term), dictionary and documents as Parquet."""
    spark = documents.sparkSession
    # Finding the ranges reads the rows once more: from a table, not from the texts.
    posted = materialise(postings(documents, options), "postings")
    posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    posted = spark.read.parquet(f"{path}/postings")
    n = corpus(documents, options).count()
    dictionary(posted, n, options.log_mode).sort("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    words = spark.read.parquet(f"{path}/dictionary")
    documents_table(documents, posted, options, n, words).write.mode("overwrite").parquet(f"{path}/docs")


@dataclass
class Index:
    """An index opened for searching."""

    postings: DataFrame
    docs: DataFrame
    n_docs: int
    log_mode: str = "reference"
    words: DataFrame | None = None
    known: dict[str, int] = field(default_factory=dict)

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequencies of the terms of a query that are in the index: a row each comes to the
        driver, which remembers the last hundred thousand or so."""
        new = [t for t in terms if t not in self.known]
        if new:
            if self.words is not None:
                rows = self.words.where(F.col("term").isin(new)).select("term", "df")
            else:
                rows = dictionary(self.postings.where(F.col("term").isin(new)))
            if len(self.known) > 100_000:
                self.known.clear()
                return self.frequencies(terms)
            self.known.update(dict.fromkeys(new, 0) | {r["term"]: r["df"] for r in rows.collect()})
        return {t: self.known[t] for t in terms if self.known[t]}


def read_index(spark, path: str, log_mode: str = "reference") -> Index:
    docs = spark.read.parquet(f"{path}/docs")
    return Index(spark.read.parquet(f"{path}/postings"), docs, docs.count(), log_mode, spark.read.parquet(f"{path}/dictionary"))


def index_of(documents: DataFrame, options: IndexOptions = DEFAULT) -> Index:
    """An index for one session: postings and dictionary are written to the shared folder once, so
    the texts are read and cut into tokens once; documents stay lazy."""
    posted = materialise(postings(documents, options), "postings")
    n = corpus(documents, options).count()
    words = materialise(dictionary(posted, n, options.log_mode), "dictionary")
    return Index(posted, documents_table(documents, posted, options, n, words), n, options.log_mode, words)


def posting_gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap): the first id of a list stands for itself.

    Lists are cut into ranges of (term, doc_id), so a term of every document is in many tasks; the
    last posting of each range, one row a task, is handed on to the next."""
    ranged = written(postings.select("term", "doc_id", "tf"), "postings").repartitionByRange("term", "doc_id").withColumn("part", F.spark_partition_id())
    # The partition of a row must not be worked out twice, so the ranges are written first.
    ranged = materialise(ranged, "ranges")
    ends = ranged.groupBy("part").agg(F.max(F.struct("term", "doc_id")).alias("end"))
    before = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("before"))
    w = Window.partitionBy("part").orderBy("term", "doc_id")
    last = F.coalesce(F.lag(F.struct("term", "doc_id")).over(w), F.col("before"))
    rows = ranged.join(F.broadcast(before), "part").withColumn("last", last)
    return rows.select("term", "doc_id", "tf", (F.col("doc_id") - F.when(F.col("last.term") == F.col("term"), F.col("last.doc_id")).otherwise(F.lit(0))).alias("gap"))


def compression_stats(postings: DataFrame) -> DataFrame:
    """(postings, raw_bytes, packed_bytes, ratio): eight bytes a posting against variable-byte gaps and counts."""
    packed = F.sum(T.vbyte_length(F.col("gap")) + T.vbyte_length(F.col("tf")))
    return posting_gaps(postings).agg(F.count("*").alias("postings"), (F.count("*") * 8).alias("raw_bytes"), F.coalesce(packed, F.lit(0)).cast("long").alias("packed_bytes")).withColumn(
        "ratio", F.when(F.col("packed_bytes") > 0, F.col("raw_bytes") / F.col("packed_bytes")).otherwise(F.lit(0.0))
    )


def index_stats(documents: DataFrame, options: IndexOptions = DEFAULT) -> DataFrame:
    """(docs, unique_terms, tokens, avg_token_len, avg_term_len): token length in characters before
    stemming, term length in bytes after. Tokens are aggregated by term first, so one pass serves both."""
    by_term = tokens(documents, options).groupBy("term").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    totals = by_term.agg(
        F.count("*").alias("unique_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")
    )
    n = corpus(documents, options).count()
    return totals.select(
        F.lit(n).cast("long").alias("docs"), "unique_terms", "tokens",
        F.when(F.col("tokens") > 0, F.col("chars") / F.col("tokens")).otherwise(0.0).alias("avg_token_len"),
        F.when(F.col("unique_terms") > 0, F.col("bytes") / F.col("unique_terms")).otherwise(0.0).alias("avg_term_len"),
    )
