"""Frequency of every term: recursive radix spilling with out-of-core aggregation in DuckDB.

The rows are spread over tasks by document, so each (term, document) pair is in one task and a hot
term is in all of them. A task writes all its rows to radix partitions on disk by bits of the
term's hash, a buffer of ``SPILL_ROWS`` at a time, splits partitions over ``PARTITION_ROWS`` by further
bits (by document bits once only one term is left), and lets DuckDB aggregate each partition under
a memory limit. The sums of the tasks add up to exact counts, because no two tasks share a document;
how many documents a task has is counted the same way, from radix partitions of its document ids.

Spill files go to the shared folder where that is a path of the file system, else to the scratch
folders that the cluster gives Spark itself (``SPARK_LOCAL_DIRS``, ``LOCAL_DIRS``).

Defined results: rows that don't count (see ``postings``) are left out; repeated rows add up; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.postings import Spellings, countable
from wordmill.session import local_path, materialise, scratch, shared_dir

FANOUT_BITS = 3
#: Rows that a task holds before they go to disk, and rows that one aggregation of DuckDB takes in.
SPILL_ROWS, PARTITION_ROWS = 250_000, 250_000


class RadixAggregator:
    """Adds batches of (term, doc_id, tf), spills them by hash bits, yields (term, occurrences, documents)."""

    def __init__(self, folder: str, partition_rows: int = PARTITION_ROWS, spill_rows: int = SPILL_ROWS, memory: str = "256MB"):
        import duckdb

        self.folder, self.limit, self.buffer = folder, partition_rows, spill_rows
        self.db = duckdb.connect(":memory:")
        self.db.execute("set threads=1")
        self.db.execute(f"set memory_limit='{memory}'")
        self.db.execute(f"set temp_directory='{folder}/duckdb'")
        self.db.execute("set preserve_insertion_order=false")
        self.spelled = Spellings()
        self.held: list[pa.RecordBatch] = []
        self.held_rows = 0
        self.files: list[str] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.held.append(pa.RecordBatch.from_arrays([self.spelled(batch.column(0)), batch.column(1), batch.column(2)], ["term", "doc_id", "tf"]))
            self.held_rows += batch.num_rows
            self.rows += batch.num_rows
            if self.held_rows >= self.buffer:
                self._spill()

    def _spill(self) -> None:
        """Partial sums of what is held go to disk by the first radix bits, and its documents by theirs."""
        part = pa.Table.from_batches(self.held)
        self.held, self.held_rows = [], 0
        at = f"{self.folder}/spill-{len(self.files)}"
        self.db.register("part", part)
        self.db.execute(
            f"copy (select term, doc_id, sum(tf)::bigint tf, hash(term) & {(1 << FANOUT_BITS) - 1} radix from part where term <> '' group by term, doc_id) "
            f"to '{at}' (format parquet, partition_by (radix), compression lz4_raw)"
        )
        self.db.execute(
            f"copy (select doc_id, hash(doc_id) & {(1 << FANOUT_BITS) - 1} radix from part where term <> '' group by doc_id) to '{at}-docs' (format parquet, partition_by (radix), compression lz4_raw)"
        )
        self.db.unregister("part")
        self.files.append(at)

    def _aggregate(self, source: str) -> Iterator[pa.RecordBatch]:
        """One row for each term; the distinct (term, document) pairs come first, so no distinct count is held."""
        query = f"select term, sum(tf)::bigint occurrences, count(*)::bigint documents from (select term, doc_id, sum(tf) tf from {source} where term <> '' group by term, doc_id) group by term"
        yield from self.db.sql(query).to_arrow_reader(100_000)

    def _split(self, source: str, level: int, by: str) -> Iterator[pa.RecordBatch]:
        n, terms = self.db.execute(f"select count(*), approx_count_distinct(term) from {source}").fetchall()[0]
        if n <= self.limit or level * FANOUT_BITS >= 60:
            if n:
                yield from self._aggregate(source)
            return
        if by == "term" and terms <= 1:
            # A partition of one term can't be split by term bits: its document ranges add up.
            yield from self._split(source, 0, "doc_id")
            return
        at = f"{self.folder}/split-{by}-{level}-{abs(hash(source)):x}"
        self.db.execute(
            f"copy (select term, doc_id, tf, (hash({by}) >> {level * FANOUT_BITS}) & {(1 << FANOUT_BITS) - 1} radix from {source}) to '{at}' (format parquet, partition_by (radix), compression lz4_raw)"
        )
        for r in sorted(os.listdir(at)):
            yield from self._split(f"read_parquet('{at}/{r}/*.parquet', hive_partitioning=false)", level + 1, by)
        shutil.rmtree(at, ignore_errors=True)

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._spill()
        for r in range(1 << FANOUT_BITS):
            if source := self._radix(r):
                yield from self._split(source, 1, "term")

    def _radix(self, r: int, suffix: str = "") -> str | None:
        found = [f"{d}{suffix}/radix={r}" for d in self.files if os.path.isdir(f"{d}{suffix}/radix={r}")]
        return f"read_parquet([{', '.join(repr(f'{d}/*.parquet') for d in found)}], hive_partitioning=false)" if found else None

    def documents(self) -> int:
        """Documents with a counted row; after ``results``."""
        return sum(self.db.execute(f"select count(distinct doc_id) from {source}").fetchall()[0][0] for r in range(1 << FANOUT_BITS) if (source := self._radix(r, "-docs")))

    def close(self) -> None:
        self.db.close()


def _radix_task(folder: str | None, partition_rows: int, spill_rows: int):
    def run(batches):
        base = folder or next((d for v in ("SPARK_LOCAL_DIRS", "LOCAL_DIRS") for d in [os.environ.get(v, "").split(",")[0]] if d), None)
        if base is None:
            raise RuntimeError("no folder to spill to: spark.checkpoint.dir isn't a path of the file system and Spark has no scratch folders")
        os.makedirs(base, exist_ok=True)
        own = tempfile.mkdtemp(prefix="radix-", dir=base)
        try:
            agg = RadixAggregator(own, partition_rows, spill_rows)
            for b in batches:
                agg.add(b)
            for b in agg.results():
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)], ["term", "occurrences", "documents"])
            yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "occurrences": pa.array([0], pa.int64()), "documents": pa.array([agg.documents()], pa.int64())})
            agg.close()
        finally:
            shutil.rmtree(own, ignore_errors=True)

    return run


def term_frequencies(postings: DataFrame, rare_below: int = 3, common_share: float = 0.25, partition_rows: int = PARTITION_ROWS, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """(term, occurrences, documents, mark): ``rare`` for a term in fewer than ``rare_below``
    documents, ``common`` for one in at least ``common_share`` of all documents with a counted row
    (a term that is both is rare), null otherwise."""
    spark = postings.sparkSession
    folder = local_path(scratch(spark, "radix")) if local_path(shared_dir(spark)) else None
    parts = countable(postings).repartition("doc_id").mapInArrow(_radix_task(folder, partition_rows, spill_rows), "term string, occurrences long, documents long")
    sums = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    sums = materialise(sums, "termfreq")
    total = sums.where("term is null").agg(F.sum("documents")).first()[0] or 0
    mark = F.when(F.col("documents") < rare_below, "rare").when(F.col("documents") >= common_share * total, "common")
    return sums.where("term is not null").withColumn("mark", mark)
