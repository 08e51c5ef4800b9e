"""Lines that recur within one source, and texts without them.

Lines are compared after normalising (white space to one blank and trimmed, lower case, each run of
digits to ``0``, closing characters that aren't letters, digits or ``_`` dropped) by a 128-bit hash
pair. A document counts once for a line however often it holds it; hot lines and sources are
pre-aggregated before the shuffle, which carries only hashes and counts.

Defined results: null, empty and blank texts have no lines that count (their rows count for the
size of the source); a null source is a source of its own; lines without a letter or digit are
never frequent; repeated rows are documents of their own, told apart only by ``doc_id``; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.session import materialise, spread

#: Frequent lines that are sent to all tasks (two hashes each); of more, the documents' lines are joined with them.
SENT_LINES = 200_000

_DIGITS = re.compile(r"\d+")


def normal_line(line: str) -> str:
    """What lines are compared by; empty for a line without a letter, digit or ``_``."""
    t = _DIGITS.sub("0", " ".join(line.split()).lower())
    end = len(t)
    while end and not (t[end - 1].isalnum() or t[end - 1] == "_"):
        end -= 1
    return t[:end]


def first_of(line: str) -> str:
    """The first character of a line's normal form, without working it out."""
    c = line.lstrip()[:1].lower()[:1]
    return "0" if c.isdecimal() else c


def _hash_task(batches):
    import xxhash

    h = xxhash.xxh3_128_intdigest
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            docs, sources, numbers, hashes, firsts = [], [], [], [], []
            part = b.slice(lo, 1024)
            for i, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                for k, line in enumerate(text.split("\n"), 1):
                    n = normal_line(line)
                    if n and (n[-1] != "_" or any(ch.isalnum() for ch in n)):
                        docs.append(i)
                        sources.append(source)
                        numbers.append(k)
                        firsts.append(n[0])
                        hashes.append(h(n.encode("utf-8", "surrogatepass")).to_bytes(16, "little"))
            pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(sources, pa.string()), pa.array(numbers, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(firsts, pa.string())],
                ["doc_id", "source", "line_no", "h1", "h2", "first"],
            )


def hashed_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, source, line_no, h1, h2, first) of the lines that hold a letter or digit; lines are what stands
    between ``\\n``, ``first`` is the first character of the normal form. Done in Arrow batches: string methods take a fifth of the time that chained
    regular expressions of the JVM do on these texts."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where("text is not null")
    return spread(rows).mapInArrow(_hash_task, "doc_id long, source string, line_no int, h1 long, h2 long, first string")


def frequent_lines(documents: DataFrame, min_docs: int = 5, min_share: float = 0.05, lines: DataFrame | None = None) -> DataFrame:
    """(source, h1, h2, documents, first): lines in at least ``min_docs`` documents of their source and in at
    least ``min_share`` of all its rows. At most (lines of a document) / ``min_share`` rows a source."""
    lines = hashed_lines(documents) if lines is None else lines
    # A document lies in one task until the first shuffle, but its lines are told apart by the
    # aggregate: (document, line) first, then documents of a line, both combined map-side.
    per_doc = lines.groupBy("source", "h1", "h2", "doc_id").agg(F.min("first").alias("first"))
    seen = per_doc.groupBy("source", "h1", "h2").agg(F.count("*").alias("documents"), F.min("first").alias("first"))
    sizes = documents.groupBy("source").agg(F.count("*").alias("size"))
    return (
        seen.where(F.col("documents") >= min_docs)
        .join(sizes, seen["source"].eqNullSafe(sizes["source"]))
        .where(F.col("documents") >= min_share * F.col("size"))
        .select(seen["source"], "h1", "h2", "documents", "first")
    )


def repeated_lines(documents: DataFrame, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """(doc_id, line_no, documents) of each line that recurs within its source. The hashed lines are
    written once and read for counting and for joining back."""
    lines = materialise(hashed_lines(documents), "lines")
    often = frequent_lines(documents, min_docs, min_share, lines)
    cond = lines["source"].eqNullSafe(often["source"]) & (lines["h1"] == often["h1"]) & (lines["h2"] == often["h2"])
    return lines.join(often, cond).select("doc_id", "line_no", "documents")


class Sent:
    """Frequent lines of every source in the memory of a task."""

    def __init__(self, rows: list):
        self.of: dict = {}
        self.firsts: dict = {}  # first characters of the normal forms: few other lines are worth hashing
        for r in rows:
            self.of.setdefault(r["source"], set()).add(r["h1"].to_bytes(8, "little", signed=True) + r["h2"].to_bytes(8, "little", signed=True))
            self.firsts.setdefault(r["source"], set()).add(r["first"])

    def recurring(self, source: str | None, lines: list[str]) -> set[int]:
        """Numbers, from 1, of the lines that recur."""
        import xxhash

        known = self.of.get(source)
        if not known:
            return set()
        h, firsts = xxhash.xxh3_128_intdigest, self.firsts[source]
        return {k for k, line in enumerate(lines, 1) if first_of(line) in firsts and (n := normal_line(line)) and h(n.encode("utf-8", "surrogatepass")).to_bytes(16, "little") in known}


def sent_lines(documents: DataFrame, min_docs: int = 5, min_share: float = 0.05, most: int = SENT_LINES):
    """The frequent lines as a broadcast, or None if they are more than ``most``."""
    often = materialise(frequent_lines(documents, min_docs, min_share), "often")
    rows = often.limit(most + 1).collect()
    return documents.sparkSession.sparkContext.broadcast(Sent(rows)) if len(rows) <= most else None


def _rebuild(sent):
    def run(batches):
        for b in batches:
            texts, removed = [], []
            for source, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone: set[int] = set()
                if text is not None:
                    lines = text.split("\n")
                    gone = sent.value.recurring(source, lines)
                    text = "\n".join(x for k, x in enumerate(lines, 1) if k not in gone) if gone else text
                texts.append(text)
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "removed"])

    return run


def without_repeated_lines(documents: DataFrame, min_docs: int = 5, min_share: float = 0.05, most: int = SENT_LINES) -> DataFrame:
    """(doc_id, text, removed): every document, its text without recurring lines. Null stays null.

    Frequent lines are few beside the texts, so they go to the tasks and texts are rebuilt where they are
    read; only of more than ``most`` the line numbers are joined back instead."""
    sent = sent_lines(documents, min_docs, min_share, most)
    if sent is not None:
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
        return spread(rows).mapInArrow(_rebuild(sent), "doc_id long, text string, removed int")
    drop = repeated_lines(documents, min_docs, min_share).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("drop"), i + 1))
    cleaned = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return documents.select("doc_id", "text").join(drop, "doc_id", "left").select("doc_id", cleaned.alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
