"""How distinctive a term is of a record: Dunning's log-likelihood ratio.

For term t of document d the table of counts is

    =============  =======  =========
    \\              t        others
    d              k11      k12
    all others     k21      k22
    =============  =======  =========

and ``G2 = 2 * sum k_ij * ln(k_ij * N / (row_i * col_j))``. The score is G2, negative where the term
is rarer in the document than elsewhere, so a word used everywhere scores about 0.

Defined results: rows that don't count (see ``postings``) are left out; repeated rows add up; an
empty table gives no rows; a collection of one document scores 0 everywhere; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.postings import counted
from wordmill.session import materialise


#: Documents from which a term's rows are too many to be gathered by one join key.
HOT_DF = 100_000


def _part(k: Column, row: Column, col: Column, n: Column) -> Column:
    return F.when(k > 0, k * F.ln(k * n / (row * col))).otherwise(F.lit(0.0))


def log_likelihood(k11: Column, in_doc: Column, of_term: Column, n: Column) -> Column:
    """Signed G2 of a term from its count in the document, the document's length, the term's
    count in the collection and the collection's length (all as double)."""
    k12, k21 = in_doc - k11, of_term - k11
    k22 = n - in_doc - k21
    rest_row, rest_col = n - in_doc, n - of_term
    g2 = F.lit(2.0) * (_part(k11, in_doc, of_term, n) + _part(k12, in_doc, rest_col, n) + _part(k21, rest_row, of_term, n) + _part(k22, rest_row, rest_col, n))
    g2 = F.greatest(g2, F.lit(0.0))
    return F.when(k11 * n >= in_doc * of_term, g2).otherwise(-g2)


def term_salience(postings: DataFrame, min_tf: int = 1, max_df: int | None = None, hot_df: int = HOT_DF) -> DataFrame:
    """(doc_id, term, tf, df, score) of each document and term. ``min_tf`` and ``max_df`` keep the
    rows of at least that count and at most that document frequency; the statistics (df, lengths)
    always cover all rows.

    One shuffle by (term, document) sums the counts, which are written once; term and document
    totals are aggregates of that table. Totals of hot terms (at least ``HOT_DF`` documents; there are at
    most the pairs / ``HOT_DF`` of them) are sent to the rows, so no join gathers their rows; those of all
    other terms meet rows by term."""
    base = materialise(counted(postings), "postings")
    docs = base.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
    terms = materialise(base.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "terms")
    total = base.agg(F.sum("tf")).first()[0] or 0
    rows = base.where(F.col("tf") >= min_tf)
    hot = F.broadcast(terms.where(F.col("df") >= hot_df))
    cold = terms.where(F.col("df") < (hot_df if max_df is None else min(hot_df, max_df + 1)))
    scored = rows.join(hot.select("term"), "term", "left_anti").join(cold, "term")
    if max_df is None or max_df >= hot_df:
        scored = scored.unionByName(rows.join(hot if max_df is None else hot.where(F.col("df") <= max_df), "term"))
    d = lambda c: F.col(c).cast("double")
    return (
        scored.join(docs, "doc_id")
        .select("doc_id", "term", "tf", "df", log_likelihood(d("tf"), d("doc_len"), d("cf"), F.lit(float(total))).alias("score"))
    )
