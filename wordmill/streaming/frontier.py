"""The crawl frontier and the robot's collection as tables: seeding, leasing, finishing, upserts.

Each operator is a plan from one state to the next, so it serves batches and the micro-batches of a
stream alike; ``run_batch`` chains them for ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions.text import sha256_hex
from wordmill.functions.urls import html_links, normal_url
from wordmill.operators.corpus import page_caps
from wordmill.operators.rules import judged
from wordmill.sources.tables import RobotConfig

SCHEMA = "url_norm string, url string, source_id string, depth int, status string, next_fetch_at long, added_at long, started_at long, lease_until long, updated_at long, last_error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def one_per_url(frontier: DataFrame) -> DataFrame:
    """Repeated URLs to one row: the earliest added, then the earliest due."""
    rest = [c for c in COLUMNS if c not in ("url_norm", "added_at", "next_fetch_at")]
    return frontier.groupBy("url_norm").agg(F.min(F.struct("added_at", "next_fetch_at", *rest)).alias("r")).select(*(F.col("url_norm") if c == "url_norm" else F.col(f"r.{c}").alias(c) for c in COLUMNS))


def seed(frontier: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """Adds URLs that aren't there as pending and due; ``found`` is (url_norm, url, source_id, depth),
    of repeated ones the smallest depth counts."""
    new = found.groupBy("url_norm").agg(F.min(F.struct("depth", "url", "source_id")).alias("r"))
    new = new.join(frontier.select("url_norm"), "url_norm", "left_anti").select(
        "url_norm", "r.url", "r.source_id", F.col("r.depth").cast("int").alias("depth"), F.lit("pending").alias("status"),
        F.lit(now).cast("long").alias("next_fetch_at"), F.lit(now).cast("long").alias("added_at"),
        *(F.lit(None).cast("string" if c == "last_error" else "long").alias(c) for c in COLUMNS[7:]),
    )
    return frontier.select(*COLUMNS).unionByName(new)


def reset_stuck(frontier: DataFrame, now: int, after_sec: int) -> DataFrame:
    """Items in progress since ``after_sec`` or longer become pending again; the lease isn't looked at."""
    stuck = (F.col("status") == "in_progress") & (F.col("started_at") <= now - after_sec)
    stuck = F.coalesce(stuck, F.lit(False))
    return frontier.withColumns(
        {"status": F.when(stuck, "pending").otherwise(F.col("status")), "lease_until": F.when(~stuck, F.col("lease_until")), "started_at": F.when(~stuck, F.col("started_at"))}
    )


def due(frontier: DataFrame, now: int, limit: int = 1) -> DataFrame:
    """The next items to fetch: pending and due, in order of due and added time."""
    return frontier.where((F.col("status") == "pending") & (F.col("next_fetch_at") <= now)).orderBy("next_fetch_at", "added_at", "url_norm").limit(limit)


def lease(frontier: DataFrame, now: int, lease_sec: int, limit: int = 1) -> DataFrame:
    """The frontier with the next items in progress."""
    taken = due(frontier, now, limit).select("url_norm", F.lit(True).alias("taken"))
    rows = frontier.join(taken, "url_norm", "left")
    t = F.coalesce("taken", F.lit(False))
    return rows.withColumns(
        {"status": F.when(t, "in_progress").otherwise(F.col("status")), "started_at": F.when(t, F.lit(now)).otherwise(F.col("started_at")), "lease_until": F.when(t, F.lit(now + lease_sec)).otherwise(F.col("lease_until"))}
    ).select(*COLUMNS)


def finish(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Applies (url_norm, now, next_at, error): done without a next time, else pending; an error is
    kept, success clears it; the lease ends."""
    r = results.select("url_norm", F.col("now").alias("_now"), F.col("next_at").alias("_next"), F.col("error").alias("_error"))
    rows = frontier.join(r, "url_norm", "left")
    hit, again = F.col("_now").isNotNull(), F.col("_next").isNotNull()
    keep = lambda c: F.when(~hit, F.col(c))
    return rows.withColumns(
        {
            "status": F.when(hit & again, "pending").when(hit, "done").otherwise(F.col("status")),
            "next_fetch_at": F.when(hit & again, F.col("_next")).otherwise(F.col("next_fetch_at")),
            "updated_at": F.when(hit, F.col("_now")).otherwise(F.col("updated_at")),
            "last_error": F.when(hit, F.nullif("_error", F.lit(""))).otherwise(F.col("last_error")),
            "lease_until": keep("lease_until"),
            "started_at": keep("started_at"),
        }
    ).select(*COLUMNS)


def outcomes(leased: DataFrame, fetched: DataFrame, sources: DataFrame, config: RobotConfig, now: int) -> DataFrame:
    """(url_norm, now, next_at, error, save) of leased items: outside the rules or too deep is done; not
    fetched, or ended by an exception, is tried again later; saved is visited again; not savable is done.

    ``fetched`` holds a row for each URL that was tried; a column ``error``, if there, is the text of the
    exception that ended the try (null for none). Of several tries one without an error counts."""
    rows = judged(leased, sources, "url_norm").join(F.broadcast(sources.select(F.col("id").alias("matched"), F.col("max_depth").alias("_depth"))), "matched", "left")
    error = F.nullif(F.col("error"), F.lit("")) if "error" in fetched.columns else F.lit(None).cast("string")
    tried = fetched.select("url_norm", error.alias("_error")).groupBy("url_norm").agg(F.when(F.count_if(F.col("_error").isNull()) == 0, F.min("_error")).alias("_error"), F.lit(True).alias("_got"))
    rows = rows.join(tried, "url_norm", "left")
    out = F.col("matched").isNull() | ~F.col("allowed") | (F.col("depth") > F.least(F.lit(config.max_depth), "_depth"))
    failed = F.col("_got").isNull() | F.col("_error").isNotNull()
    save = ~out & ~failed & F.col("savable")
    return rows.select(
        "url_norm", F.lit(now).cast("long").alias("now"),
        F.when(out, F.lit(None)).when(failed, F.lit(now + config.error_backoff_sec)).when(save, F.lit(now + config.revisit_after_sec)).cast("long").alias("next_at"),
        F.when(~out & failed, F.coalesce("_error", F.lit("fetch_failed"))).alias("error"), save.alias("save"),
    )


def discovered(fetched: DataFrame, leased: DataFrame, sources: DataFrame, drop_query: bool = True, drop_fragment: bool = True) -> DataFrame:
    """(url_norm, url, source_id, depth) of the links on fetched pages that a source allows."""
    pages = fetched.join(leased.select("url_norm", "depth"), "url_norm")
    base = F.coalesce("final_url", "url") if "final_url" in fetched.columns else F.col("url")
    links = pages.select(F.explode(html_links(F.col("raw_html"), base)).alias("url"), (F.col("depth") + 1).alias("depth"))
    rows = links.withColumn("url_norm", normal_url(F.col("url"), drop_query, drop_fragment))
    return judged(rows, sources, "url_norm").where("allowed").select("url_norm", "url", F.col("matched").alias("source_id"), "depth")


DOCUMENT = "url_norm string, url string, source_id string, source_name string, raw_html string, checked_at long, first_seen_at long, crawled_at long, status int, content_type string, encoding string, bytes_len long, content_hash string"
DOCUMENT_COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]


def upsert(collection: DataFrame, pages: DataFrame) -> DataFrame:
    """The collection with new and rechecked pages, and whether each row changed.

    Every check refreshes content and times; hash and ``crawled_at`` only when the content changed;
    ``first_seen_at`` only on insertion. Of several checks of a URL in ``pages`` the last one holds."""
    fresh = ["url", "source_id", "source_name", "raw_html", "status", "content_type", "encoding", "bytes_len"]
    new = pages.withColumn("_hash", sha256_hex(F.coalesce("raw_html", F.lit(""))))
    new = new.groupBy("url_norm").agg(F.max(F.struct("checked_at", "_hash", *fresh)).alias("n"))
    rows = collection.select(F.struct(*DOCUMENT_COLUMNS).alias("o"), "url_norm").join(new, "url_norm", "full")
    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    changed = seen & (~known | ~F.col("o.content_hash").eqNullSafe(F.col("n._hash")))
    pick = {c: F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in fresh}
    pick["checked_at"] = F.when(seen, F.col("n.checked_at")).otherwise(F.col("o.checked_at"))
    pick["first_seen_at"] = F.when(known, F.col("o.first_seen_at")).otherwise(F.col("n.checked_at"))
    pick["crawled_at"] = F.when(changed, F.col("n.checked_at")).otherwise(F.col("o.crawled_at"))
    pick["content_hash"] = F.when(changed, F.col("n._hash")).otherwise(F.col("o.content_hash"))
    return rows.select(*(F.col(c) if c == "url_norm" else pick[c].alias(c) for c in DOCUMENT_COLUMNS), changed.alias("changed"), (seen & known).alias("existed"))


PAGE = "url_norm string, url string, raw_html string, status int, content_type string, encoding string, bytes_len long, error string"
PAGE_COLUMNS = [c.split()[0] for c in PAGE.split(", ")]


class Robot:
    """State tables in a folder, advanced by micro-batches of fetched pages.

    Each version adds the rows that changed, and a row of ``versions`` makes it count; the newest row
    of a URL holds. So a batch writes what it touches, not the whole frontier or collection, and
    one that dies before its row leaves the state as it was. The row names the stream and batch, so a
    batch that comes again after its version counts is skipped. Every ``COMPACT`` versions the state
    is written whole, and what no later version reads is removed.

    Pages whose URL isn't to be fetched yet (unknown to the frontier, or not due) wait in a table of
    their own for a later batch; no page is dropped but those outside all rules."""

    COMPACT = 10

    def __init__(self, spark: SparkSession, path: str, sources: DataFrame, config: RobotConfig | None = None):
        self.spark, self.path, self.sources, self.config = spark, path.rstrip("/"), sources, config or RobotConfig()

    def _versions(self) -> list:
        """(version, base, stream, batch) in order; ``base`` is where the last whole state is."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version long, base long, stream string, batch long").json(f"{self.path}/versions").orderBy("version").collect()
        except AnalysisException:
            return []

    def version(self) -> int:
        rows = self._versions()
        return rows[-1]["version"] if rows else -1

    def _at(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/v={version}"

    def _state(self, name: str, schema: str, columns: list[str]) -> DataFrame:
        rows = self._versions()
        if not rows:
            return self.spark.createDataFrame([], schema)
        parts = self.spark.read.schema(f"{schema}, _v long").parquet(*(self._at(name, v) for v in range(rows[-1]["base"], rows[-1]["version"] + 1)))
        rest = [c for c in columns if c != "url_norm"]
        return parts.groupBy("url_norm").agg(F.max_by(F.struct(*rest), "_v").alias("r")).select(*(F.col(c if c == "url_norm" else f"r.{c}").alias(c) for c in columns))

    def frontier(self) -> DataFrame:
        return self._state("frontier", SCHEMA, COLUMNS)

    def collection(self) -> DataFrame:
        return self._state("collection", DOCUMENT, DOCUMENT_COLUMNS)

    def waiting(self) -> DataFrame:
        """Pages that no batch has used yet."""
        v = self.version()
        return self.spark.createDataFrame([], PAGE) if v < 0 else self.spark.read.schema(PAGE).parquet(self._at("waiting", v))

    def _commit(self, frontier: DataFrame, collection: DataFrame | None = None, waiting: DataFrame | None = None, stream: str | None = None, batch: int | None = None) -> None:
        rows = self._versions()
        base, version = (rows[-1]["base"], rows[-1]["version"] + 1) if rows else (0, 0)
        v = F.lit(version).cast("long").alias("_v")
        collection = self.spark.createDataFrame([], DOCUMENT) if collection is None else collection
        frontier.select(*COLUMNS, v).write.mode("overwrite").parquet(self._at("frontier", version))
        collection.select(*DOCUMENT_COLUMNS, v).write.mode("overwrite").parquet(self._at("collection", version))
        (self.waiting() if waiting is None else waiting).select(*PAGE_COLUMNS).write.mode("overwrite").parquet(self._at("waiting", version))
        self._point(version, base, stream, batch)
        if version - base >= self.COMPACT:
            whole, pages, rest = self.frontier(), self.collection(), self.waiting()
            v = F.lit(version + 1).cast("long").alias("_v")
            whole.select(*COLUMNS, v).write.mode("overwrite").parquet(self._at("frontier", version + 1))
            pages.select(*DOCUMENT_COLUMNS, v).write.mode("overwrite").parquet(self._at("collection", version + 1))
            rest.write.mode("overwrite").parquet(self._at("waiting", version + 1))
            self._point(version + 1, version + 1, stream, batch)
            self._remove(version + 1)
        elif version > base + 1:
            self._remove(version - 1, ("waiting",))

    def _point(self, version: int, base: int, stream: str | None, batch: int | None) -> None:
        self.spark.createDataFrame([(version, base, stream, batch)], "version long, base long, stream string, batch long").coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def _remove(self, before: int, names: tuple[str, ...] = ("frontier", "collection", "waiting")) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for found in fs.listStatus(folder):
                at = found.getPath()
                if at.getName().startswith("v=") and int(at.getName()[2:]) < before:
                    fs.delete(at, True)

    def start(self, now: int) -> None:
        """Seeds the start URLs of all sources."""
        found = self.sources.select(F.explode("start_urls").alias("url"), F.col("id").alias("source_id")).select(normal_url(F.col("url")).alias("url_norm"), "url", "source_id", F.lit(0).alias("depth"))
        before = self.frontier()
        self._commit(seed(before, found, now).join(before.select("url_norm"), "url_norm", "left_anti"))

    def lease(self, now: int, limit: int = 1000) -> DataFrame:
        """The next items for a fetcher, in progress from now on; those stuck are due again first."""
        before = self.frontier()
        state = lease(reset_stuck(before, now, self.config.reset_stuck_after_sec), now, self.config.lease_sec, limit)
        self._commit(_changed(state, before))
        return self.frontier().where((F.col("status") == "in_progress") & (F.col("started_at") == now))

    def step(self, pages: DataFrame, now: int, stream: str | None = None, batch: int | None = None) -> bool:
        """One round: judge what was fetched, discover, upsert, finish. Items that are due or in progress
        and whose page came are taken, however many; items whose page didn't come stay as they are.
        False for a batch that was applied before."""
        if batch is not None and any(r["stream"] == stream and r["batch"] is not None and r["batch"] >= batch for r in self._versions()):
            return False
        from wordmill.session import materialise

        for c in PAGE_COLUMNS:
            if c not in pages.columns:
                pages = pages.withColumn(c, F.lit(None).cast("string"))
        # What waited comes first in time: of several pages of a URL the new one holds.
        came = pages.select(*PAGE_COLUMNS, F.lit(1).alias("_age")).unionByName(self.waiting().withColumn("_age", F.lit(0)))
        rest = [c for c in PAGE_COLUMNS if c != "url_norm"]
        came = came.where("url_norm is not null").groupBy("url_norm").agg(F.max(F.struct("_age", *rest)).alias("p")).select("url_norm", *(F.col(f"p.{c}").alias(c) for c in rest))
        came = materialise(came, "came")
        before = self.frontier()
        state = reset_stuck(before, now, self.config.reset_stuck_after_sec)
        ready = (F.col("status") == "in_progress") | ((F.col("status") == "pending") & (F.col("next_fetch_at") <= now))
        taken = materialise(state.where(ready).join(came.select("url_norm"), "url_norm", "left_semi"), "taken")
        got = came.join(taken.select("url_norm"), "url_norm", "left_semi")
        result = materialise(outcomes(taken, got, self.sources, self.config, now), "outcomes")
        named = self.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
        saved = got.join(result.where("save").select("url_norm"), "url_norm", "left_semi")
        saved = judged(saved, self.sources, "url_norm").withColumnRenamed("matched", "source_id").join(F.broadcast(named), "source_id", "left").withColumn("checked_at", F.lit(now).cast("long"))
        known = self.collection().join(saved.select("url_norm"), "url_norm", "left_semi")
        answered = got.where("error is null or error = ''")
        after = _changed(finish(seed(state, discovered(answered, taken, self.sources), now), result), before)
        left = judged(came.join(taken.select("url_norm"), "url_norm", "left_anti"), self.sources, "url_norm").where("allowed")
        self._commit(after, upsert(known, saved).where("changed or existed"), left, stream, batch)
        return True

    def run(self, stream: DataFrame, checkpoint: str, clock=None, **trigger):
        """Applies ``step`` to each micro-batch of a stream of fetched pages; by default to all there is."""
        import time

        tick = clock or (lambda batch_id: int(time.time()))
        return stream.writeStream.foreachBatch(lambda df, i: self.step(df, tick(i), checkpoint, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _changed(after: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of a state that are new or differ from the one before."""
    rest = F.struct(*(c for c in COLUMNS if c != "url_norm"))
    old = before.select("url_norm", rest.alias("_old"))
    return after.join(old, "url_norm", "left").where(~F.col("_old").eqNullSafe(rest)).select(*COLUMNS)


def new_urls(stream: DataFrame, watermark: str = "1 day", time: str = "fetch_ts") -> DataFrame:
    """URLs of a stream that weren't seen within the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["url_norm"])


def crawl(start: DataFrame, pages: DataFrame, sources: DataFrame, max_depth: int = 10, max_total: int | None = None, per_source: bool = False) -> DataFrame:
    """(url_norm, source_id, depth) reached from ``start`` over a table of pages, breadth first.

    One join and one anti join a level; each level is written, so lineage stays short. ``max_total``
    and, with ``per_source``, each source's ``max_pages`` end the crawl: of a level only as many URLs
    (in order) are visited as they leave; what isn't visited leads nowhere."""
    from wordmill.session import materialise

    links = pages.select(F.col("url_norm").alias("from"), F.explode(html_links(F.col("raw_html"), F.col("url"))).alias("url"))
    links = links.select("from", normal_url(F.col("url")).alias("url_norm")).distinct()
    links = materialise(judged(links, sources, "url_norm").where("allowed").select("from", "url_norm", F.col("matched").alias("source_id")), "links")
    level = judged(start.select("url_norm").distinct(), sources, "url_norm").where("allowed").select("url_norm", F.col("matched").alias("source_id"), F.lit(0).alias("depth"))
    limits = {r["id"]: r["max_pages"] for r in sources.select("id", "max_pages").collect()} if per_source else {}
    taken: dict[str, int] = {}

    def gated(level: DataFrame) -> DataFrame:
        if per_source:
            room = {s: max(0, n - taken.get(s, 0)) for s, n in limits.items()}
            caps = sources.sparkSession.createDataFrame(list(room.items()), "id string, max_pages int")
            level = page_caps(level, caps, ("url_norm",))
        if max_total is not None:
            level = level.orderBy("url_norm").limit(max(0, max_total - sum(taken.values())))
        return materialise(level.select("url_norm", "source_id", "depth"), "level")

    level = gated(level)
    seen = level
    for depth in range(1, max_depth + 1):
        if limits or max_total is not None:
            for r in level.groupBy("source_id").count().collect():  # a row for each source
                taken[r["source_id"]] = taken.get(r["source_id"], 0) + r["count"]
        nxt = links.join(level.select(F.col("url_norm").alias("from")), "from").groupBy("url_norm").agg(F.min("source_id").alias("source_id"))
        nxt = nxt.join(seen.select("url_norm"), "url_norm", "left_anti").select("url_norm", "source_id", F.lit(depth).alias("depth"))
        level = gated(nxt.join(F.broadcast(sources.select(F.col("id").alias("source_id"), "max_depth")), "source_id").where(F.col("depth") <= F.col("max_depth")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
