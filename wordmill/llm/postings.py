"""Counted rows of a posting table: which rows count and which spellings are one term."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_spelling(term: str) -> str:
    """Composed (NFC), trimmed, lower case, ``е`` for ``ё``."""
    return unicodedata.normalize("NFC", term).strip().lower().replace("ё", "е")


class Spellings:
    """Normal spellings of columns of terms, worked out once for each distinct spelling."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[str, str] = {}
        self.limit = limit

    def __call__(self, terms: pa.Array) -> pa.Array:
        coded = terms.dictionary_encode() if not isinstance(terms, pa.DictionaryArray) else terms
        known, out = self.known, []
        for t in coded.dictionary.to_pylist():
            n = known.get(t)
            if n is None:
                if len(known) > self.limit:  # forgets, so memory stays bounded; only costs time
                    known.clear()
                n = known[t] = normal_spelling(t)
            out.append(n)
        return pa.DictionaryArray.from_arrays(coded.indices, pa.array(out, pa.string())).cast(pa.string())


def countable(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of the rows that count, spelling as it stands: null or empty terms, null
    or non-positive ``tf``, null documents and document 0 are left out. Other columns are not read."""
    return postings.select("term", F.col("doc_id").cast("long").alias("doc_id"), F.col("tf").cast("long").alias("tf")).where(
        "term is not null and term <> '' and doc_id <> 0 and tf >= 1"
    )


def _spell(batches):
    spelled = Spellings()
    for b in batches:
        yield pa.RecordBatch.from_arrays([spelled(b.column(0)), b.column(1), b.column(2)], ["term", "doc_id", "tf"])


def counted(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf): one row for each normal term and document, ``tf`` added up.

    Spellings repeat, so Arrow batches are dictionary-encoded and only distinct ones are worked on."""
    rows = countable(postings).mapInArrow(_spell, "term string, doc_id long, tf long")
    return rows.where("term <> ''").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
