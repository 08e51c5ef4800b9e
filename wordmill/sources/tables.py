"""Sources: manifests, text files, term frequencies, queries, source and robot configurations."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a manifest in order; all are text in its file.
MANIFEST = "doc_id source_id url final_url fetch_ts status content_type encoding bytes_len raw_path text_path meta_path sha256_text text_len".split()
_TYPES = {"doc_id": "bigint", "status": "int", "bytes_len": "bigint", "text_len": "bigint", "fetch_ts": "timestamp"}


def csv_field(line: str, idx: int) -> str | None:
    """A field of one CSV line: quotes with ``""`` escapes; CR or LF end it, in quotes too; None beyond the last."""
    out, k, quoted, n = [], 0, False, len(line)
    fields = 0
    while k < n:
        c = line[k]
        if c in "\r\n":
            break
        if quoted:
            if c == '"' and line[k + 1 : k + 2] == '"':
                k += 1
                out.append(c)
            elif c == '"':
                quoted = False
            else:
                out.append(c)
        elif c == '"':
            quoted = True
        elif c == ",":
            if fields == idx:
                return "".join(out)
            fields, out = fields + 1, []
        else:
            out.append(c)
        k += 1
    return "".join(out) if fields == idx else None


def csv_column(header: str, name: str) -> int:
    """Where a column stands in a header, -1 if it is missing."""
    for k in range(256):
        f = csv_field(header, k)
        if f is None:
            return -1
        if f == name:
            return k
    return -1


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file, columns found by name; missing optional ones are null."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    missing = {"doc_id", "final_url", "text_path"} - set(raw.columns)
    if missing:
        raise ValueError(f"manifest lacks {sorted(missing)}")
    return raw.select(*(typed(F.col(c), c) if c in raw.columns else F.lit(None).cast(_TYPES.get(c, "string")).alias(c) for c in MANIFEST))


def typed(column: Column, name: str) -> Column:
    if name == "doc_id":
        return doc_number(column).alias(name)
    return column.try_cast(_TYPES.get(name, "string")).alias(name)


def doc_number(column: Column) -> Column:
    """Leading digits as a number; 0 without any."""
    return F.coalesce(F.regexp_extract(column, "^\\s*\\+?(\\d+)", 1).try_cast("bigint"), F.lit(0))


def indexable(manifest: DataFrame) -> DataFrame:
    """Rows with an id other than 0, a final URL and a text path."""
    return manifest.where("doc_id <> 0 and final_url <> '' and text_path <> ''")


def join_path(root: Column, rel: Column) -> Column:
    """``rel`` below ``root``; backslashes become slashes, an absolute ``rel`` stands alone."""
    r = F.regexp_replace(rel, "\\\\", "/")
    base = F.regexp_replace(F.regexp_replace(root, "\\\\", "/"), "/+$", "")
    return F.when(r.startswith("/") | r.rlike("^[A-Za-z]:"), r).when(base == "", r).otherwise(F.concat_ws("/", base, r))


def read_texts(spark: SparkSession, root: str, max_bytes: int = 0) -> DataFrame:
    """(path, text, n_bytes) of the files below ``root``; empty files and those over the limit are left out, not cut."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes:
        files = files.where(F.col("length") <= max_bytes)
    return files.where(F.col("length") > 0).select("path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("n_bytes"))


def with_texts(manifest: DataFrame, texts: DataFrame, root: str = "") -> DataFrame:
    """Manifest rows joined with their text by path (inner)."""
    keyed = indexable(manifest).withColumn("path", join_path(F.lit(root), F.col("text_path")))
    return keyed.join(texts, "path")


def read_term_freq(spark: SparkSession, path: str) -> DataFrame:
    """(term, freq) with a positive count; rows with a bad number are skipped."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("term string, freq string").csv(path)
    return raw.select("term", F.trim("freq").try_cast("bigint").alias("freq")).where("freq > 0")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query): one query a line, blank lines skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("qid"), F.regexp_replace("value", "[\\r\\n]+$", "").alias("query"))


@dataclass
class CrawlPolicy:
    max_depth: int
    max_pages: int
    request_delay_sec: float = 1.0
    timeout_sec: int = 20
    max_response_bytes: int = 5_000_000
    accept_only_content_types: list[str] = field(default_factory=lambda: ["text/html"])


@dataclass
class SourceConfig:
    id: str
    name: str
    base_url: str
    start_urls: list[str]
    allowed_domains: list[str]
    allow_regex: list[str]
    deny_regex: list[str]
    save_regex: list[str]
    crawl_policy: CrawlPolicy


def load_sources(path: str) -> list[SourceConfig]:
    """Source configurations of a YAML file; a missing required key is an error."""
    import yaml

    data = yaml.safe_load(Path(path).read_text("utf-8"))
    out = []
    for s in data["sources"]:
        p = s["crawl_policy"]
        known = {k: p[k] for k in CrawlPolicy.__dataclass_fields__ if k in p}
        out.append(
            SourceConfig(s["id"], s["name"], s["base_url"], s["start_urls"], s["allowed_domains"], s.get("allow_regex") or [], s.get("deny_regex") or [], s.get("save_regex") or [], CrawlPolicy(**known))
        )
    return out


def sources_table(spark: SparkSession, sources: list[SourceConfig]) -> DataFrame:
    rows = [(s.id, k, s.name, s.base_url, s.start_urls, s.allowed_domains, s.allow_regex, s.save_regex, s.deny_regex, s.crawl_policy.max_depth, s.crawl_policy.max_pages) for k, s in enumerate(sources)]
    return spark.createDataFrame(
        rows,
        "id string, ord int, name string, base_url string, start_urls array<string>, allowed_domains array<string>, allow_regex array<string>, save_regex array<string>, deny_regex array<string>, max_depth int, max_pages int",
    )


@dataclass
class RobotConfig:
    max_depth: int = 10
    revisit_after_sec: int = 86_400
    error_backoff_sec: int = 600
    reset_stuck_after_sec: int = 900
    lease_sec: int = 120
    concurrency: int = 1
    request_delay_sec: float = 1.0
    run_forever: bool = False


#: Sections of a robot's file and the keys each must have.
ROBOT_KEYS = {"db": ("uri", "database", "documents_collection", "frontier_collection"), "logic": tuple(RobotConfig.__dataclass_fields__), "crawl_config_path": ()}


def load_robot(path: str) -> RobotConfig:
    """The logic of a robot's YAML file; any missing key of any section is an error that names it."""
    import yaml

    data = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    missing = [s for s in ROBOT_KEYS if s not in data] + [f"{s}.{k}" for s, keys in ROBOT_KEYS.items() if s in data for k in keys if k not in (data[s] or {})]
    if missing:
        raise ValueError(f"the robot's configuration lacks {', '.join(missing)}")
    kinds = {k: type(f.default) for k, f in RobotConfig.__dataclass_fields__.items()}
    return RobotConfig(**{k: kind(data["logic"][k]) for k, kind in kinds.items()})


def fetched(pages: DataFrame, content_types: tuple[str, ...] = ("text/html",), max_bytes: int = 5_000_000) -> DataFrame:
    """Fetched pages of an allowed content type (parameters stripped) and size; any status."""
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    return pages.where(kind.isin(*content_types) & (F.col("bytes_len") <= max_bytes))


def resume_state(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a crawl needs to resume: (max_doc_id), (source_id, n), (url) seen, normalised, (sha256_text) seen."""
    from wordmill.functions.urls import normal_url

    top = manifest.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("max_doc_id"))
    counts = manifest.groupBy("source_id").agg(F.count("*").alias("n"))
    urls = manifest.select(F.explode(F.array("url", "final_url")).alias("url")).where("url <> ''").select(normal_url(F.col("url")).alias("url")).distinct()
    hashes = manifest.select(F.trim("sha256_text").alias("sha256_text")).where("sha256_text <> ''").distinct()
    return top, counts, urls, hashes


def with_titles(documents: DataFrame, metas: DataFrame) -> DataFrame:
    """Documents with the title of their meta data, ``metas`` (doc_id, meta) being JSON text; null without one,
    which the index replaces by the first line. Of repeated ids the largest text counts."""
    from wordmill.functions.text import title_of_json

    titles = metas.groupBy("doc_id").agg(F.max("meta").alias("meta")).select("doc_id", title_of_json(F.col("meta")).alias("title"))
    return documents.drop("title").join(titles, "doc_id", "left")


