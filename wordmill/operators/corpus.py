"""The corpus as a table: statistics, manifest repair, storing pages, removing equal contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.functions.text import sha256_hex


def size_summary(sizes: DataFrame, column: str) -> DataFrame:
    """(files, total, average, median, smallest, largest, missing) of sizes; 0 and null are missing
    files and only counted. Average and median are cut to whole numbers."""
    s = F.when(F.col(column) > 0, F.col(column))
    return sizes.agg(
        F.count(s).alias("files"),
        F.coalesce(F.sum(s), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.floor(F.sum(s) / F.count(s)), F.lit(0)).cast("long").alias("average"),
        F.coalesce(F.floor(F.percentile(s, 0.5)), F.lit(0)).cast("long").alias("median"),
        F.coalesce(F.min(s), F.lit(0)).cast("long").alias("smallest"),
        F.coalesce(F.max(s), F.lit(0)).cast("long").alias("largest"),
        F.count_if(s.isNull()).alias("missing"),
    )


def per_source(manifest: DataFrame) -> DataFrame:
    """(source_id, docs); rows without a document id don't count."""
    return manifest.where("doc_id is not null").groupBy("source_id").agg(F.count("*").alias("docs"))


def repair_manifest(manifest: DataFrame, texts: DataFrame, raws: DataFrame | None = None) -> DataFrame:
    """Manifest rows with paths, sizes and hashes of what is there.

    ``texts`` is (doc_id, text), ``raws`` (doc_id, raw_bytes). A found text gives path, length in
    characters and hash without its closing line ends; a missing or empty one keeps the old length,
    or 0. Rows without an id pass as they are."""
    path = lambda kind, end: F.concat(F.lit(f"{kind}\\"), F.col("m.doc_id").cast("string"), F.lit(end))
    t = texts.select("doc_id", F.regexp_replace("text", "[\\r\\n]+$", "").alias("found")).where("found <> ''")
    m = manifest.alias("m").join(t.alias("t"), "doc_id", "left")
    has = F.col("t.found").isNotNull()
    changes = {
        "text_path": F.when(has, path("text", ".txt")).otherwise(F.col("m.text_path")),
        "text_len": F.when(has, F.char_length("t.found").cast("long")).otherwise(F.coalesce("m.text_len", F.lit(0))),
        "sha256_text": F.when(has, sha256_hex(F.col("t.found"))).otherwise(F.col("m.sha256_text")),
    }
    if raws is not None:
        m = m.join(raws.alias("r"), "doc_id", "left")
        there = F.col("r.raw_bytes") > 0
        changes["raw_path"] = F.when(there, path("raw_html", ".html")).otherwise(F.col("m.raw_path"))
        changes["bytes_len"] = F.when(there, F.col("r.raw_bytes")).otherwise(F.col("m.bytes_len"))
    return m.select(*(changes.get(c, F.col(c) if c == "doc_id" else F.col(f"m.{c}")).alias(c) for c in manifest.columns))


def missing_files(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id) of manifest rows without a text."""
    return manifest.select("doc_id").where("doc_id is not null").distinct().join(texts.select("doc_id").where("text <> ''"), "doc_id", "left_anti")


def first_of_content(rows: DataFrame, content: str = "text", order: str = "doc_id") -> DataFrame:
    """One row for each content hash: the first by ``order``; rows without content are left out.

    An aggregate by hash, so equal contents combine before the shuffle however many there are."""
    keyed = rows.where(F.col(content).isNotNull()).withColumn("content_hash", sha256_hex(F.col(content)))
    first = keyed.groupBy("content_hash").agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return first.select(order, "content_hash", "copies")


def numbered(rows: DataFrame, by: tuple[str, ...], start: int = 0) -> DataFrame:
    """Document ids in order of arrival from ``start`` + 1, without a sort in one task."""
    from wordmill.session import materialise

    w = Window.partitionBy("part").orderBy(*by)
    ranged = materialise(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "arrivals")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.withColumn("at", F.row_number().over(w)).join(F.broadcast(before), "part").withColumn("doc_id", F.col("at") + F.col("before") + start).drop("at", "before", "part")


def page_caps(pages: DataFrame, sources: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The first ``max_pages`` pages of each source by ``order``.

    The largest cap is a limit that holds for all sources, so every task cuts its rows of a source at
    it before they are shuffled."""
    w = Window.partitionBy("source_id").orderBy(*order)
    most = sources.agg(F.max("max_pages")).first()[0] or 0
    capped = pages.join(F.broadcast(sources.select(F.col("id").alias("source_id"), "max_pages")), "source_id")
    first = capped.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    return first.where("at <= max_pages").drop("at", "max_pages")


def stored(pages: DataFrame, extract_text: bool = True) -> DataFrame:
    """Pages with what is stored of each: ``text`` of its HTML, paths, content hash, length and ``meta`` as
    JSON. ``pages`` is (doc_id, source_id, url, final_url, fetch_ts, status, content_type, encoding,
    bytes_len, html). Without extraction the text isn't kept: path empty, length 0, the hash is still its."""
    from wordmill.functions.urls import html_text

    path = lambda kind, end: F.concat(F.lit(f"{kind}/"), F.col("doc_id").cast("string"), F.lit(end))
    rows = pages.withColumn("text", F.coalesce(html_text(F.col("html")), F.lit("")))
    rows = rows.withColumns(
        {
            "raw_path": path("raw_html", ".html"), "meta_path": path("meta", ".json"), "text_path": path("text", ".txt") if extract_text else F.lit(""),
            "sha256_text": sha256_hex(F.col("text")), "text_len": (F.char_length("text") if extract_text else F.lit(0)).cast("long"),
        }
    )
    meta = ["doc_id", "source_id", "url", "final_url", "fetch_ts", "status", "content_type", F.col("encoding").alias("encoding_detected"), "bytes_len", "raw_path", "text_path", "sha256_text", "text_len"]
    return rows.withColumn("meta", F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}))


def store(pages: DataFrame, root: str, extract_text: bool = True) -> None:
    """Appends pages to a collection below ``root``: tables ``raw_html``, ``text`` and ``meta`` keyed by path, and
    ``manifest`` as CSV with a header. Contents of many pages share files, so hundreds of millions fit."""
    from wordmill.session import materialise
    from wordmill.sources.tables import MANIFEST

    rows = materialise(stored(pages, extract_text), "stored")
    add = lambda df, name: df.write.mode("append").parquet(f"{root}/{name}")
    add(rows.select("doc_id", F.col("raw_path").alias("path"), "html"), "raw_html")
    if extract_text:
        add(rows.select("doc_id", F.col("text_path").alias("path"), "text"), "text")
    add(rows.select("doc_id", F.col("meta_path").alias("path"), "meta"), "meta")
    rows.select(*MANIFEST).write.mode("append").option("header", True).option("escape", '"').csv(f"{root}/manifest")


def extraction(manifest: DataFrame, raws: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of manifest rows that have none yet, and what became of all rows.

    (doc_id, text) of pages with HTML and without a stored text that isn't empty, each id once; and (extracted,
    skipped, missing_raw), rows without an id counting nowhere. ``raws`` is (doc_id, html), ``texts`` (doc_id, text)."""
    from wordmill.functions.urls import html_text

    rows = manifest.where("doc_id is not null").select("doc_id")
    had = texts.where("text <> ''").select("doc_id").distinct()
    html = raws.where("html is not null").groupBy("doc_id").agg(F.max("html").alias("html"))
    marked = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(had.withColumn("had", F.lit(True)), "doc_id", "left").join(html, "doc_id", "left")
    new = marked.where("had is null and html is not null").select("doc_id", html_text(F.col("html")).alias("text"))
    # A repeated row finds the text that the first one wrote, if that isn't empty.
    has, raw = F.col("had").isNotNull(), F.col("html").isNotNull()
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    counts = marked.agg(
        total(F.when(~has & raw, 1), "extracted"), total(F.when(has, F.col("n")).when(raw, F.col("n") - 1), "skipped"), total(F.when(~has & ~raw, F.col("n")), "missing_raw")
    )
    return new, counts


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The newest row of each key; equal ones are one."""
    others = [c for c in rows.columns if c not in (key, by)]
    return rows.groupBy(key).agg(F.max(F.struct(by, *others)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in (by, *others)))
