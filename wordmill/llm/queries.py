"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm import cases
from wordmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.salience import term_salience

    scored = term_salience(table(spark, sf_dir, "postings"), min_tf=4, max_df=8)
    return scored.where("score > 0").select("doc_id", "term")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.salience import term_salience

    return term_salience(table(spark, sf_dir, "postings")).select("doc_id", "term", (F.round("score", 3) + F.lit(0.0)).alias("score"))  # no negative zero


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.neardup import duplicate_pairs

    return duplicate_pairs(table(spark, sf_dir, "documents"), words=3, theta=0.5)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.sitelines import repeated_lines

    return repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no")


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.sitelines import without_repeated_lines

    return without_repeated_lines(table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.mainbody import main_blocks

    return main_blocks(table(spark, sf_dir, "robot_pages")).select("page_id", "block_md5")


def p4_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm import cases

    return cases.main_body_cases(spark)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.termfreq import term_frequencies

    return term_frequencies(table(spark, sf_dir, "postings")).where("mark is not null").select("term", "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.termfreq import term_frequencies

    return term_frequencies(table(spark, sf_dir, "postings"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.residue import residue_pages

    return residue_pages(table(spark, sf_dir, "robot_pages")).select("page_id")


def p6_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm import cases

    return cases.residue_cases(spark)


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.residue import without_residue

    return without_residue(table(spark, sf_dir, "robot_pages"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.quality import text_quality

    return text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).where("not is_prose").select("doc_id")


def p7_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).drop("is_prose")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.encode import encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.encode import token_counts
    from wordmill.llm.packing import pack
    from wordmill.session import materialise

    docs = table(spark, sf_dir, "documents")
    counts = token_counts(docs.where(F.col("text").rlike("[^\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")))
    sizes = materialise(counts, "sizes").select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))
    return pack(sizes).withColumnsRenamed({"item": "doc_id", "size": "n_tokens", "start": "start_token"})


def p9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has containers, and whether the rules hold for it: pieces that follow each
    other without gaps, cut only above the capacity, no container beyond it, places counted from 0."""
    from wordmill.llm.packing import CAPACITY

    rows = p9_containers(spark, sf_dir)
    bins = rows.groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.countDistinct("place").alias("places"), F.count("*").alias("n"), F.max("place").alias("last"))
    good = (F.col("fill") <= CAPACITY) & (F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    docs = rows.join(bins.select("container", good.alias("good")), "container").groupBy("doc_id").agg(
        F.min("good").alias("good"), F.sum("n_tokens").alias("total"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("parts"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"),
        F.min(F.col("start_token") == F.col("piece") * CAPACITY).alias("follow"), F.min("start_token").alias("begin"),
    )
    whole = F.col("good") & F.col("follow") & (F.col("begin") == 0) & (F.col("end") == F.col("total")) & (F.col("pieces") == F.col("parts")) & (F.col("pieces") == F.ceil(F.col("total") / CAPACITY))
    return docs.select("doc_id", whole.alias("whole"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the least number that the tokens ask for, and the fill."""
    from wordmill.llm.packing import CAPACITY

    rows = p9_containers(spark, sf_dir)
    n, tokens = F.countDistinct("container"), F.sum("n_tokens")
    return rows.agg(n.alias("containers"), tokens.alias("tokens"), F.ceil(tokens / CAPACITY).alias("least"), (tokens / (n * CAPACITY)).alias("fill"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.pii import personal_items

    return personal_items(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_pos")


def p10_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm import cases

    return cases.personal_cases(spark)


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordmill.llm.pii import masked_texts

    return masked_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_scores, p2_found, p3_found, p3_texts, p4_found, p4_cases, p5_found, p5_counts, p6_found, p6_cases, p6_clean, p7_found, p7_figures, p8_ids, p9_containers, p9_rules, p9_fill, p10_found, p10_cases, p10_texts)
}

_TERM = "replace(lower(trim(nfc_normalize(term), ' ' || chr(9) || chr(10) || chr(13) || chr(160))), 'ё', 'е')"
_COUNTED = f"counted as (select term, doc_id, sum(tf)::bigint tf from (select {_TERM} term, doc_id, tf from postings where term is not null and tf >= 1 and doc_id <> 0) where term <> '' group by all)"
_LINES = r"""lines as (
  select doc_id, source, line_no::int line_no,
    regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{N}_]+$', '') n
  from (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents where text is not null)),
often as (
  select source, n from lines join (select source, count(*) size from documents group by 1) using (source)
  where regexp_matches(n, '[\p{L}\p{N}]') group by source, n, size having count(distinct doc_id) >= 5 and count(distinct doc_id) >= 0.05 * size)"""

#: Runs of three words: which documents share at least half of those that either has.
_PAIRS = r"""with w as (select doc_id, regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}]+') w from documents where text is not null),
s as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) s from w where len(w) >= 3),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2)
select x doc_id_a, y doc_id_b from c join n p on p.doc_id = x join n q on q.doc_id = y where 2 * c >= p.n + q.n - c"""

SQL: dict[str, str] = {
    "p2_found": _PAIRS,
    "p4_cases": cases.main_body_sql(),
    "p6_cases": cases.residue_sql(),
    "p9_rules": r"select doc_id, true whole from documents where regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')",
    "p10_cases": cases.personal_sql(),
    "p1_found": f"with {_COUNTED} select doc_id, term from (select *, count(*) over (partition by term) df from counted) where tf >= 4 and df <= 8",
    "p1_scores": f"with {_COUNTED}, " + """d as (select doc_id, sum(tf)::double row1 from counted group by 1), t as (select term, sum(tf)::double col1 from counted group by 1), n as (select sum(tf)::double n from counted),
k as (select doc_id, term, tf::double k11, row1 - tf k12, col1 - tf k21, n - row1 - col1 + tf k22, row1, col1, n - row1 row2, n - col1 col2, n from counted join d using (doc_id) join t using (term), n),
g as (select *, greatest(0, 2 * (case when k11 > 0 then k11 * ln(k11 * n / (row1 * col1)) else 0 end + case when k12 > 0 then k12 * ln(k12 * n / (row1 * col2)) else 0 end
  + case when k21 > 0 then k21 * ln(k21 * n / (row2 * col1)) else 0 end + case when k22 > 0 then k22 * ln(k22 * n / (row2 * col2)) else 0 end)) g2 from k)
select doc_id, term, round(case when k11 * n >= row1 * col1 then g2 else -g2 end, 3) + 0.0::double score from g""",
    "p3_found": f"with {_LINES} select doc_id, line_no from lines join often using (source, n)",
    "p5_found": f"with {_COUNTED}, t as (select term, count(*) df from counted group by 1), d as (select count(distinct doc_id) n from counted) "
    "select term, case when df < 3 then 'rare' else 'common' end mark from t, d where df < 3 or df >= 0.25 * n",
    "p5_counts": f"with {_COUNTED}, t as (select term, sum(tf)::bigint occurrences, count(*) documents from counted group by 1), d as (select count(distinct doc_id) n from counted) "
    "select term, occurrences, documents, case when documents < 3 then 'rare' when documents >= 0.25 * n then 'common' end mark from t, d",
    "p3_texts": f"""with {_LINES}, gone as (select doc_id, list(line_no) nos from lines join often using (source, n) group by 1)
select doc_id, case when nos is null then text else coalesce((select string_agg(l, chr(10) order by k) from (select unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) k) where not list_contains(nos, k)), '') end text, coalesce(len(nos), 0)::int removed from documents left join gone using (doc_id)""",
}
