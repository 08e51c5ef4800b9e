"""The registered queries of the retrieval engine, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions import text as T
from wordmill.functions import urls as U
from wordmill.operators import bench, codec, corpus, index, lexstats, rules
from wordmill.plans import query, rank
from wordmill.sources import tables
from wordmill.streaming import frontier as fr
from wordmill.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _index(spark: SparkSession, d: str) -> index.Index:
    return index.index_of(_docs(spark, d))


# What must hold whatever the constants of ``functions.text`` are: typed out again, so a slip there shows.
_SQL_SUFFIXES = "ыми|ими|ого|его|ому|ему|ами|ями|ов|ев|ей|ой|ою|ею|ах|ях|ам|ям|ом|ем|ым|им|ать|ять|еть|оть|уть|ешь|ишь|ете|ите|ают|яют|уют|ют|ут|лся|лась|лись|лось|ия|ий|ый|ое|ее|ая|яя|а|я|о|е|ы|и|у|ю"
_SQL_STOP = (
    "'и', 'в', 'не', 'на', 'с', 'по', 'для', 'как', 'из', 'к', 'а', 'то', 'что', 'это', 'он', 'она', 'оно', 'они', 'мы', 'вы', 'я', 'его', 'ее', 'их', 'наш', 'ваш', 'мой', 'твой', 'этот', 'тот', 'такой', 'какой', "
    "'где', 'когда', 'почему', 'если', 'или', 'но', 'да', 'нет', 'ну', 'вот', 'здесь', 'там', 'тут', 'туда', 'сюда', 'от', 'до', 'под', 'над', 'за', 'перед', 'после', 'во', 'со', 'про', 'через', 'между', 'без', 'о', 'об', 'при', 'у'"
)


def _value(v) -> str:
    return "null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else str(v)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def _log(x: str) -> str:
    """The logarithm's series in SQL."""
    k = f"(case when {x} > 2 then ceil(log2({x})) - 1 else 0 end)"
    y = f"({x} / pow(2.0, {k}) - 1)"
    return f"(case when {x} > 1 then {k} * 0.693147 + list_sum(list_transform(range(1, 50, 2), lambda odd: case when pow({y}, odd) > 1e-10 then pow({y}, odd) / odd else 0.0 end)) else 0.0 end)"


_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁё"
_TO = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяее"
_FOLD = f"translate(text, '{_FROM}', '{_TO}')"
_STEM = f"^((?:[а-яё].|[a-z0-9][а-яё]|[a-z0-9]{{2}}.).*?)(?:{_SQL_SUFFIXES})$"
#: Characters before which fewer bytes stand than a token may have.
_CAP = f"(case when strlen(w) <= {T.TOKEN_BYTES} then w else left(w, len(list_filter(range(1, length(w) + 1), lambda k: strlen(left(w, k - 1)) < {T.TOKEN_BYTES}))) end)"
_WITH = f"""with docs as (select doc_id, text, url from documents where doc_id <> 0 and strlen(text) > 0),
tok as (select doc_id, w, regexp_replace({_CAP}, '{_STEM}', '\\1') term from (select doc_id, unnest(regexp_split_to_array({_FOLD}, '[^a-zа-я]+')) w from docs) where length(w) >= 2),
kept as (select * from tok where strlen(term) >= 2 and term not in ({_SQL_STOP})),
post as (select term, doc_id, count(*) tf from kept group by all),
n as (select count(*)::double n from docs),
dict as (select term, count(*) df from post group by 1),
idf as (select term, df, {_log('(n / df)')} idf from dict, n),
w as (select post.term, doc_id, tf, df, (1 + {_log('tf::double')}) * idf w from post join idf using (term)),
norm as (select doc_id, sum(tf)::bigint doc_len, sqrt(sum(w * w)) norm from w group by 1),
title as (select doc_id, url, regexp_extract(text, '^[\\r\\n\\t ]*([^\\r\\n]*)', 1) line from docs) """
#: Titles of at most 200 bytes, characters whole.
_TITLE = "(case when strlen(line) <= 200 then line else list_reduce(list_transform(list_filter(range(1, 201), lambda k: strlen(left(line, k)) <= 200), lambda k: left(line, k)), lambda a, b: b) end)"


@registered("tokens", _WITH + "select doc_id, term, length(w)::int chars from kept")
def _(spark, d):
    return index.tokens(_docs(spark, d))


@registered("postings", _WITH + "select term, doc_id, tf from post")
def _(spark, d):
    return index.postings(_docs(spark, d))


@registered("dictionary", _WITH + "select term, df, round(idf, 6) idf from idf")
def _(spark, d):
    docs = _docs(spark, d)
    return index.dictionary(index.postings(docs), index.corpus(docs).count()).withColumn("idf", F.round("idf", 6))


@registered("doc_norms", _WITH + "select doc_id, round(coalesce(norm, 0), 6) norm from docs left join norm using (doc_id)")
def _(spark, d):
    return _index(spark, d).docs.select("doc_id", F.round("norm", 6).alias("norm"))


@registered("doc_lengths", _WITH + "select doc_id, coalesce(doc_len, 0) doc_len from docs left join norm using (doc_id)")
def _(spark, d):
    return _index(spark, d).docs.select("doc_id", "doc_len")


@registered("doc_titles", _WITH + f"select doc_id, url, {_TITLE} title from title")
def _(spark, d):
    return _index(spark, d).docs.select("doc_id", "url", "title")


#: Stems of the words asked for, by hand.
_TERMS = {"школа": "школ", "район": "район", "полиция": "полиц", "суд": "суд", "город": "город", "дело": "дел", "договор": "договор", "новый": "нов", "автобус": "автобус"}


def _has(word: str) -> str:
    return f"(select doc_id from post where term = '{_TERMS[word]}')"


def _boolean(name: str, q: str, sql: str) -> None:
    @registered(name, _WITH + f"select doc_id, {_TITLE} title, url from title where doc_id in ({sql})")
    def _(spark, d):
        ix = _index(spark, d)
        return query.matches(ix, q).join(ix.docs, "doc_id").select("doc_id", "title", "url")


_boolean("bool_and", "школа && район", f"{_has('школа')} intersect {_has('район')}")
_boolean("bool_or", "полиция || суд", f"{_has('полиция')} union {_has('суд')}")
_boolean("bool_not", "город && !район", f"{_has('город')} except {_has('район')}")
_boolean("bool_not_alone", "!город", f"select doc_id from docs except {_has('город')}")
_boolean("bool_parens", "(полиция || суд) && (дело || договор)", f"({_has('полиция')} union {_has('суд')}) intersect ({_has('дело')} union {_has('договор')})")
_boolean("bool_implicit_and", "школа район !город", f"({_has('школа')} intersect {_has('район')}) except {_has('город')}")
_boolean("bool_malformed", "|| школа && (район", f"{_has('школа')} intersect {_has('район')}")
_boolean("bool_stop_word", "школа !и", f"select doc_id from docs except {_has('школа')}")


@registered("bool_by_sets", _WITH + f"select doc_id from (({_has('полиция')} union {_has('суд')}) except {_has('город')})")
def _(spark, d):
    return query.matches_by_sets(_index(spark, d), "(полиция || суд) && !город")


@registered("bool_page", _WITH + f"select doc_id, {_TITLE} title, url from title where doc_id in {_has('город')} order by doc_id limit 20 offset 20")
def _(spark, d):
    return query.boolean_search(_index(spark, d), "город &&", 20, 20)


def _ranked(words: list[str]) -> str:
    terms = [_TERMS[w] for w in words]
    every = " intersect ".join(_has(w) for w in dict.fromkeys(words))
    total = " + ".join(f"coalesce(sum(case when term = '{t}' then w end), 0)" for t in terms)
    return f"select doc_id, s / (case when norm > 0 then norm else 1 end) score from (select doc_id, {total} s from w where doc_id in ({every}) group by 1) join norm using (doc_id) where s > 0"


def _ranking(name: str, q: str, offset: int = 0, limit: int = 50) -> None:
    sql = f"select doc_id, round(score, 6) score, {_TITLE} title, url from ({_ranked(q.split())} order by score desc, doc_id limit {limit} offset {offset}) join title using (doc_id)"

    @registered(name, _WITH + sql)
    def _(spark, d):
        return rank.search(_index(spark, d), q, offset, limit)


_ranking("ranked_topk", "школа район")
_ranking("ranked_page", "город", 50, 50)
_ranking("ranked_one_word", "новый автобус")


_BATCH = ["школа район", "новый автобус", "школа && район", "город && !район", "город школа", "и", ""]
_BATCH_SQL = [
    f"select {k} qid, doc_id, round(score, 6) score from ({_ranked(q.split())} order by score desc, doc_id limit 50)" for k, q in enumerate(_BATCH) if k in (0, 1, 4)
] + [f"select {k} qid, doc_id, null::double score from ({sql}) order by doc_id limit 50" for k, sql in ((2, f"{_has('школа')} intersect {_has('район')}"), (3, f"{_has('город')} except {_has('район')}"))]


@registered("batch_search", _WITH + " union all ".join(f"(from ({x}))" for x in _BATCH_SQL))
def _(spark, d):
    queries = spark.createDataFrame(list(enumerate(_BATCH)), "qid long, query string")
    return rank.batch_search(_index(spark, d), queries).select(F.col("qid").cast("int").alias("qid"), "doc_id", "score")


@registered("ranked_scores", _WITH + f"select doc_id, round(score, 6) score from ({_ranked(['город', 'город', 'школа'])})")
def _(spark, d):
    return rank.scores(_index(spark, d), "город город школа").select("doc_id", F.round("score", 6).alias("score"))


@registered("posting_gaps", _WITH + "select term, doc_id, tf, doc_id - coalesce(lag(doc_id) over (partition by term order by doc_id), 0) gap from post")
def _(spark, d):
    return index.posting_gaps(index.postings(_docs(spark, d)))


def _vb(x: str) -> str:
    return f"(case when {x} < 128 then 1 when {x} < 16384 then 2 when {x} < 2097152 then 3 when {x} < 268435456 then 4 else 5 end)"


@registered(
    "compression_stats",
    _WITH + f", g as (select tf, doc_id - coalesce(lag(doc_id) over (partition by term order by doc_id), 0) gap from post) "
    f"select count(*) postings, count(*) * 8 raw_bytes, sum({_vb('gap')} + {_vb('tf')})::bigint packed_bytes, count(*) * 8 / sum({_vb('gap')} + {_vb('tf')})::double ratio from g",
)
def _(spark, d):
    return index.compression_stats(index.postings(_docs(spark, d)))


@registered("codec_round_trip", _WITH + "select term, doc_id, tf from post")
def _(spark, d):
    return codec.unpacked(codec.packed_blocks(index.postings(_docs(spark, d))))


@registered(
    "index_stats",
    _WITH + "select (select count(*) from docs) docs, (select count(*) from dict) unique_terms, count(*) tokens, avg(length(w)) avg_token_len, (select avg(strlen(term)) from dict) avg_term_len from kept",
)
def _(spark, d):
    return index.index_stats(_docs(spark, d))


_WORDS = f"""with words as (select doc_id, unnest(regexp_extract_all(translate(text, '{_FROM}‐‑‒–—', '{_TO}-----'), '([a-zа-я0-9]+(?:-[a-zа-я0-9]+)*)', 1)) term from documents where doc_id <> 0),
freqs as (select term, count(*) freq from words where length(term) >= 2 group by 1),
ranks as (select term, freq, row_number() over (order by freq desc, term) rank from freqs) """


def _freqs(spark: SparkSession, d: str) -> DataFrame:
    return lexstats.term_freq(lexstats.corpus_tokens(_docs(spark, d)))


@registered("term_freq", _WORDS + "select term, freq from freqs")
def _(spark, d):
    return _freqs(spark, d)


@registered("zipf", _WORDS + "select rank, freq, round((select max(freq) from freqs)::double / rank, 6) zipf_pred from ranks")
def _(spark, d):
    return lexstats.zipf(_freqs(spark, d))


@registered(
    "zipf_subsample",
    _WORDS + ", m as (select count(*) n from freqs), spots as (select distinct least(n, greatest(1, floor(pow(10.0, i * log10(n::double) / 1999))::bigint)) rank from range(2000) t(i), m) "
    "select term, freq, rank from ranks where (select n from m) <= 2000 or rank in (select rank from spots)",
)
def _(spark, d):
    return lexstats.log_sample(lexstats.ranked_terms(_freqs(spark, d)))


@registered("tokenizer_stats", _WORDS + "select (select count(*) from documents where doc_id <> 0 and text is not null) docs, sum(freq)::bigint tokens, count(*) unique_terms, sum(freq * length(term)) / sum(freq) avg_token_len, (select sum(strlen(text))::bigint from documents where doc_id <> 0) bytes_in from freqs")
def _(spark, d):
    return lexstats.tokenizer_stats(_docs(spark, d))


@registered("top_terms", _WORDS + "select term, freq, 100.0::double * freq / (select sum(freq) from freqs)::double share from freqs order by freq desc, term limit 20")
def _(spark, d):
    return lexstats.top_terms(_freqs(spark, d))


@registered("top_content_terms", _WORDS + f"select term, freq, 100.0::double * freq / (select sum(freq) from freqs)::double share from freqs where term not in ({_quoted(T.QUERY_STOP_WORDS)}) order by freq desc, term limit 20")
def _(spark, d):
    return lexstats.top_terms(_freqs(spark, d), keep_stop_words=False)


@registered("rare_bands", _WORDS + ", b as (select count(*) terms, sum(freq)::bigint tokens, count(*) filter (freq = 1) once, count(*) filter (freq = 2) twice, count(*) filter (freq between 3 and 5) few from freqs) select *, 100.0::double * once / terms once_pct, 100.0::double * twice / terms twice_pct, 100.0::double * few / terms few_pct from b")
def _(spark, d):
    return lexstats.rare_bands(_freqs(spark, d))


@registered("hapax_sample")
def _(spark, d):
    return lexstats.hapax_sample(_freqs(spark, d))


def _sizes(column: str, source: str) -> str:
    s = f"nullif({column}, 0)"
    return f"select count({s}) files, coalesce(sum({s}), 0)::bigint total, coalesce(floor(sum({s}) / count({s})), 0)::bigint average, coalesce(floor(quantile_cont({s}, 0.5)), 0)::bigint median, coalesce(min({s}), 0)::bigint smallest, coalesce(max({s}), 0)::bigint largest, count(*) - count({s}) missing from {source}"


@registered("corpus_text_stats", _sizes("size", "(select strlen(text)::bigint size from documents)"))
def _(spark, d):
    return corpus.size_summary(_docs(spark, d).select(F.octet_length("text").cast("long").alias("size")), "size")


@registered("corpus_raw_stats", _sizes("bytes_len", "manifest"))
def _(spark, d):
    return corpus.size_summary(table(spark, d, "manifest"), "bytes_len")


@registered("per_source_counts", "select source_id, count(*) docs from manifest where doc_id is not null group by 1")
def _(spark, d):
    return corpus.per_source(table(spark, d, "manifest"))


@registered("missing_texts", "select distinct doc_id from manifest where doc_id not in (select doc_id from documents where text <> '')")
def _(spark, d):
    return corpus.missing_files(table(spark, d, "manifest"), _docs(spark, d))


@registered("manifest_scan", "select doc_id, source_id, final_url, text_path from manifest where doc_id <> 0 and final_url <> '' and text_path <> ''")
def _(spark, d):
    return tables.indexable(table(spark, d, "manifest")).select("doc_id", "source_id", "final_url", "text_path")


@registered("manifest_paths", r"select doc_id, case when p like '/%' then p else 'data/' || p end path from (select doc_id, replace(text_path, '\', '/') p from manifest where text_path <> '')")
def _(spark, d):
    return table(spark, d, "manifest").where("text_path <> ''").select("doc_id", tables.join_path(F.lit("data/"), F.col("text_path")).alias("path"))


@registered(
    "manifest_fix",
    r"with t as (select doc_id, rtrim(text, chr(13) || chr(10)) found from documents where rtrim(text, chr(13) || chr(10)) <> ''), r as (select page_id doc_id, strlen(raw_html)::bigint raw_bytes from robot_pages) "
    r"select doc_id, source_id, case when found is not null then 'text\' || doc_id || '.txt' else text_path end text_path, case when found is not null then length(found) else coalesce(text_len, 0) end text_len, case when found is not null then sha256(found) else sha256_text end sha256_text, "
    r"case when raw_bytes > 0 then 'raw_html\' || doc_id || '.html' else raw_path end raw_path, case when raw_bytes > 0 then raw_bytes else bytes_len end bytes_len from manifest left join t using (doc_id) left join r using (doc_id)",
)
def _(spark, d):
    # Fetched pages stand in for the raw files: one for every third document or so.
    raws = table(spark, d, "robot_pages").select(F.col("page_id").alias("doc_id"), F.octet_length("raw_html").cast("long").alias("raw_bytes"))
    return corpus.repair_manifest(table(spark, d, "manifest"), _docs(spark, d), raws).select("doc_id", "source_id", "text_path", "text_len", "sha256_text", "raw_path", "bytes_len")


@registered("sha256_dedup", "select min(doc_id) doc_id, sha256(text) content_hash, count(*) copies from documents where text is not null group by 2")
def _(spark, d):
    return corpus.first_of_content(_docs(spark, d))


@registered("arrival_ids", "select url, row_number() over (order by fetch_ts, url) + 100 doc_id from documents")
def _(spark, d):
    return corpus.numbered(_docs(spark, d).select("url", "fetch_ts"), ("fetch_ts", "url"), 100).select("url", F.col("doc_id").cast("long").alias("doc_id"))


@registered("page_caps", "select doc_id, source_id from (select doc_id, source_id, row_number() over (partition by source_id order by fetch_ts, doc_id) k, max_pages // 5000 cap from (select doc_id, source source_id, fetch_ts from documents) join sources on id = source_id) where k <= cap")
def _(spark, d):
    pages = _docs(spark, d).select("doc_id", F.col("source").alias("source_id"), "fetch_ts")
    caps = table(spark, d, "sources").withColumn("max_pages", F.floor(F.col("max_pages") / 5000).cast("int"))
    return corpus.page_caps(pages, caps, ("fetch_ts", "doc_id")).select("doc_id", "source_id")


@registered("resume_max_id", "select coalesce(max(doc_id), 0) max_doc_id from manifest")
def _(spark, d):
    return tables.resume_state(table(spark, d, "manifest"))[0]


@registered("resume_counts", "select source_id, count(*) n from manifest group by 1")
def _(spark, d):
    return tables.resume_state(table(spark, d, "manifest"))[1]


_URL = "(case when regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*://') then lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || regexp_replace(substr({u}, length(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) + 1), '[?#].*$', '') else regexp_replace({u}, '[?#].*$', '') end)"
_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@registered("resume_urls", f"select distinct {_URL.format(u='u')} url from (select unnest([url, final_url]) u from manifest) where u <> ''")
def _(spark, d):
    return tables.resume_state(table(spark, d, "manifest"))[2]


@registered("resume_hashes", "select distinct trim(sha256_text) sha256_text from manifest where trim(sha256_text) <> ''")
def _(spark, d):
    return tables.resume_state(table(spark, d, "manifest"))[3]


@registered("url_normalize", f"select url, {_URL.format(u='url')} url_norm, {_HOST.format(u='url')} host from manifest where url is not null")
def _(spark, d):
    return table(spark, d, "manifest").where("url is not null").select("url", U.normal_url(F.col("url")).alias("url_norm"), U.host_of(F.col("url")).alias("host"))


_RULES = (
    f"with u as (select url_norm, url, {_HOST.format(u='url')} host from frontier), dom as (select host, arg_min(id, ord) id from (select unnest(allowed_domains) host, id, ord from sources) group by 1), "
    "m as (select u.*, s.* from u left join dom using (host) left join sources s on s.id = dom.id), "
    "j as (select url_norm, url, id matched, coalesce(len(list_filter(deny_regex, lambda p: regexp_matches(url, '^(?:' || p || ')'))) = 0 and (len(allow_regex) = 0 or len(list_filter(allow_regex, lambda p: regexp_matches(url, '^(?:' || p || ')'))) > 0), false) allowed, "
    "save_regex from m) select url_norm, url, matched, allowed, coalesce(case when len(save_regex) = 0 then allowed else len(list_filter(save_regex, lambda p: regexp_matches(url, '^(?:' || p || ')'))) > 0 end, false) savable from j"
)


@registered("url_rules", _RULES)
def _(spark, d):
    return rules.judged(table(spark, d, "frontier").select("url_norm", "url"), table(spark, d, "sources"))


@registered("unseen_urls", f"select distinct url_norm from frontier where url_norm not in (select {_URL.format(u='url')} from documents)")
def _(spark, d):
    seen = _docs(spark, d).select(U.normal_url(F.col("url")).alias("url_norm"))
    return table(spark, d, "frontier").select("url_norm").distinct().join(seen, "url_norm", "left_anti")


_PAGE_CASES = [
    ("<p>Один&nbsp;два<script>bad()</script><noscript>no</noscript><b>три</b>", "Один два три", "Один\u00a0два три"), ("<div>  a\n b </div>\n<!-- c --><style>x</style><p>d", "a b d", "a\n b d"),
    ("", "", ""), (None, None, None), ("<title>t</title>&lt;x&gt; &amp;<br>y", "t <x> & y", "t <x> & y"),
]
_PAGE_VALUES = ", ".join(f"({k}, {_value(a)}, {_value(b)})" for k, (_, a, b) in enumerate(_PAGE_CASES))


@registered("page_text_fixture", f"select * from (values {_PAGE_VALUES}) t(k, text, lines)")
def _(spark, d):
    rows = spark.createDataFrame([(k, h) for k, (h, _, _) in enumerate(_PAGE_CASES)], "k int, h string")
    return rows.select("k", U.html_text(F.col("h")).alias("text"), U.html_text(F.col("h"), collapse=False).alias("lines"))


@registered("page_text")
def _(spark, d):
    return spread(table(spark, d, "robot_pages").select("page_id", "raw_html")).select("page_id", U.html_text(F.col("raw_html")).alias("text"))


@registered("page_text_lines")
def _(spark, d):
    return spread(table(spark, d, "robot_pages").select("page_id", "raw_html")).select("page_id", U.html_text(F.col("raw_html"), collapse=False).alias("text"))


@registered("page_links", "select page_id, regexp_extract(url, '^[^:]+://[^/?#]*') || href link from (select page_id, url, unnest(regexp_extract_all(regexp_replace(raw_html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<[aA] [^>]*?href=\"([^\"]*)\"', 1)) href from robot_pages) where href <> '' and not regexp_matches(href, '^(?:mailto:|tel:|javascript:)')")
def _(spark, d):
    return spread(table(spark, d, "robot_pages").select("page_id", "raw_html", "url")).select("page_id", F.explode(U.html_links(F.col("raw_html"), F.col("url"))).alias("link"))


@registered("fetched_pages", "select page_id from robot_pages where lower(trim(split_part(content_type, ';', 1))) = 'text/html' and bytes_len <= 5000000")
def _(spark, d):
    return tables.fetched(table(spark, d, "robot_pages")).select("page_id")


@registered("charsets", "select page_id, trim(regexp_extract(lower(content_type), 'charset=([^;]+)', 1)) charset from robot_pages where content_type is not null")
def _(spark, d):
    return table(spark, d, "robot_pages").where("content_type is not null").select("page_id", U.charset_of(F.col("content_type")).alias("charset"))


@registered("decoded_pages", "select page_id, raw_html html from robot_pages")
def _(spark, d):
    # Bytes as a server would send them; where the charset lacks a character they are UTF-8 and undeclared.
    pages = spread(table(spark, d, "robot_pages").select("page_id", "raw_html", "content_type"))
    body = pages.select("page_id", "raw_html", "content_type", U.encode_text(F.col("raw_html"), F.col("content_type")).alias("body"))
    declared = F.when(F.col("body") != F.encode("raw_html", "UTF-8"), F.col("content_type"))
    return body.select("page_id", U.decode_bytes(F.col("body"), declared).alias("html"))


_ONE = """with one as (select url_norm, r.* from (select url_norm, min({'added_at': added_at, 'next_fetch_at': next_fetch_at, 'url': coalesce(url, ''), 'status': status}) r from frontier group by 1)) """
_NOW = 1_722_400_000


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    return fr.one_per_url(table(spark, d, "frontier"))


@registered("frontier_seed", f"with found as (select {_URL.format(u='u')} url_norm, min(u) url, count(*) n from (select unnest(start_urls) u, id from sources) group by 1) select url_norm, 'pending' status, {_NOW} next_fetch_at, {_NOW} added_at, 0 depth from found where url_norm not in (select url_norm from frontier)")
def _(spark, d):
    before = _frontier(spark, d)
    found = table(spark, d, "sources").select(F.explode("start_urls").alias("url"), F.col("id").alias("source_id")).select(U.normal_url(F.col("url")).alias("url_norm"), "url", "source_id", F.lit(0).alias("depth"))
    new = fr.seed(before, found, _NOW).join(before.select("url_norm"), "url_norm", "left_anti")
    return new.select("url_norm", "status", F.col("next_fetch_at").cast("int").alias("next_fetch_at"), F.col("added_at").cast("int").alias("added_at"), "depth")


@registered("frontier_reset_stuck", f"select url_norm, case when s then 'pending' else status end status, case when not s then started_at end started_at, case when not s then lease_until end lease_until from (select *, coalesce(status = 'in_progress' and started_at <= {_NOW - 900}, false) s from frontier)")
def _(spark, d):
    return fr.reset_stuck(table(spark, d, "frontier"), _NOW, 900).select("url_norm", "status", "started_at", "lease_until")


_FINISH = "select url_norm, case when h and nx is not null then 'pending' when h then 'done' else status end status, case when h and nx is not null then nx else next_fetch_at end next_fetch_at, case when h then {now} else updated_at end updated_at, case when h then er else last_error end last_error, case when not h then started_at end started_at from (select *, status = 'in_progress' h, case when depth % 3 = 0 then null else {now} + 600 end nx, case when depth % 3 = 1 then 'fetch_failed' end er from f)"


def _results(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'in_progress'").select(
        "url_norm", F.lit(_NOW).alias("now"), F.when(F.col("depth") % 3 != 0, F.lit(_NOW + 600)).alias("next_at"), F.when(F.col("depth") % 3 == 1, "fetch_failed").alias("error")
    )


# Every URL, a repeated one with the row that ``one_per_url`` keeps.
_WHOLE = "with f as (select * exclude (k) from (select *, row_number() over (partition by url_norm order by added_at nulls first, next_fetch_at nulls first, " + ", ".join(f"{c} nulls first" for c in fr.COLUMNS if c not in ("url_norm", "added_at", "next_fetch_at")) + ") k from frontier) where k = 1)"
_DUE = f"select url_norm, next_fetch_at from f where status = 'pending' and next_fetch_at <= {_NOW} order by next_fetch_at, added_at, url_norm limit 100"


@registered("frontier_due", f"{_WHOLE} {_DUE}")
def _(spark, d):
    return fr.due(_frontier(spark, d), _NOW, 100).select("url_norm", "next_fetch_at")


@registered("frontier_lease", f"{_WHOLE}, t as (select url_norm from ({_DUE})) select url_norm, case when url_norm in (from t) then 'in_progress' else status end status, case when url_norm in (from t) then {_NOW} else started_at end started_at, case when url_norm in (from t) then {_NOW + 120} else lease_until end lease_until from f")
def _(spark, d):
    return fr.lease(_frontier(spark, d), _NOW, 120, 100).select("url_norm", "status", "started_at", "lease_until")


@registered("frontier_finish", f"{_WHOLE} " + _FINISH.format(now=_NOW))
def _(spark, d):
    return fr.finish(_frontier(spark, d), _results(_frontier(spark, d))).select("url_norm", "status", "next_fetch_at", "updated_at", "last_error", "started_at")


@registered(
    "robot_outcomes",
    _RULES.replace("url_norm, url, host", "url_norm, url, host, depth", 1).replace(f"{_HOST.format(u='url')} host from frontier", f"{_HOST.format(u='url_norm')} host, depth from (select distinct url_norm, url_norm url, depth from frontier where status = 'in_progress')", 1).replace("select url_norm, url, id matched", "select url_norm, url, depth, max_depth, id matched", 1).split(") select url_norm, url, matched")[0]
    + f"), r as (select url_norm, coalesce(depth > least(10, max_depth), true) or matched is null or not allowed outside, url_norm in (select url_norm from robot_pages where raw_html <> '') got, coalesce(case when len(save_regex) = 0 then allowed else len(list_filter(save_regex, lambda p: regexp_matches(url, '^(?:' || p || ')'))) > 0 end, false) savable from j) "
    f"select url_norm, case when outside then null when not got then {_NOW + 600} when savable then {_NOW + 86400} end::bigint next_at, case when not outside and not got then 'fetch_failed' end error, not outside and got and savable save from r",
)
def _(spark, d):
    leased = table(spark, d, "frontier").where("status = 'in_progress'").select("url_norm", "depth").distinct()
    got = table(spark, d, "robot_pages").where("raw_html <> ''").select("url_norm")
    return fr.outcomes(leased, got, table(spark, d, "sources"), tables.RobotConfig(), _NOW).select("url_norm", "next_at", "error", "save")


_UPSERT = """with o as (select * from robot_pages where page_id % 2 = 0), old as (select url_norm, arg_max(struct_pack(h := content_hash, s := first_seen_at, c := crawled_at, k := checked_at), (checked_at, page_id)) o from o group by 1),
new as (select url_norm, max(struct_pack(k := checked_at, h := sha256(coalesce(raw_html, '')))) n from robot_pages where page_id % 2 = 1 group by 1)
select url_norm, case when n is not null then n.k else o.k end checked_at, case when o is not null then o.s else n.k end first_seen_at, case when n is not null and (o is null or o.h is distinct from n.h) then n.k else o.c end crawled_at, case when n is not null and (o is null or o.h is distinct from n.h) then n.h else o.h end content_hash, n is not null and (o is null or o.h is distinct from n.h) changed, n is not null and o is not null existed from old full join new using (url_norm)"""


@registered("doc_upsert", _UPSERT)
def _(spark, d):
    # Pages of even ids are the collection, those of odd ids the checks: together all rows.
    pages = table(spark, d, "robot_pages")
    old = pages.where("page_id % 2 = 0").groupBy("url_norm").agg(F.max_by(F.struct(*[c for c in fr.DOCUMENT_COLUMNS if c != "url_norm"]), F.struct("checked_at", "page_id")).alias("r")).select("url_norm", "r.*")
    return fr.upsert(old, pages.where("page_id % 2 = 1")).select("url_norm", "checked_at", "first_seen_at", "crawled_at", "content_hash", "changed", "existed")


_JUDGED = (
    "select u url_norm, id matched, coalesce(len(list_filter(deny_regex, lambda p: regexp_matches(u, '^(?:' || p || ')'))) = 0 and (len(allow_regex) = 0 or len(list_filter(allow_regex, lambda p: regexp_matches(u, '^(?:' || p || ')'))) > 0), false) allowed, max_depth "
    f"from (select u, arg_min(id, ord) id from (select u, {_HOST.format(u='u')} host from {{urls}}) join (select unnest(allowed_domains) host, id, ord from sources) using (host) group by 1) join sources using (id)"
)
_LINKS_SQL = "select url_norm f, {url} u from (select url_norm, regexp_extract(url, '^[^:]+://[^/?#]*') || href link from (select url_norm, url, unnest(regexp_extract_all(regexp_replace(raw_html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<[aA] [^>]*?href=\"([^\"]*)\"', 1)) href from robot_pages where raw_html <> '') where href <> '' and not regexp_matches(href, '^(?:mailto:|tel:|javascript:)'))"


@registered(
    "crawl_reach",
    f"with recursive start as (select distinct {_URL.format(u='u')} u from (select unnest(start_urls) u from sources) union select distinct url_norm u from frontier where depth = 0), "
    f"links as (select distinct f, u from ({_LINKS_SQL.format(url=_URL.format(u='link'))})), "
    f"good as ({_JUDGED.format(urls='(select u from links union select u from start)')}), "
    "step as (select f, u, matched, max_depth from links join good on url_norm = u where allowed), "
    "reach as (select u, 0 d from start join good on url_norm = u where allowed union select s.u, d + 1 from reach r join step s on s.f = r.u where d + 1 <= least(10, s.max_depth)) "
    "select u url_norm, matched source_id, min(d)::int depth from reach join good on url_norm = u group by 1, 2",
)
def _(spark, d):
    # Start pages and what the frontier has of depth 0, over all fetched pages, to each source's depth.
    pages = table(spark, d, "robot_pages").where("raw_html <> ''").select("url_norm", "url", "raw_html")
    start = table(spark, d, "sources").select(F.explode("start_urls").alias("url")).select(U.normal_url(F.col("url")).alias("url_norm"))
    start = start.unionByName(table(spark, d, "frontier").where("depth = 0").select("url_norm"))
    return fr.crawl(start, pages, table(spark, d, "sources"))


@registered("latest_manifest", "select doc_id, arg_max(source_id, (fetch_ts, source_id)) source_id, max(fetch_ts) fetch_ts from manifest group by 1")
def _(spark, d):
    rows = table(spark, d, "manifest").select("doc_id", "source_id", "fetch_ts")
    return corpus.latest(rows, "doc_id", "fetch_ts").select("doc_id", "source_id", "fetch_ts")


_LOG_CASES = "1.0 1.5 2.0 2.0001 3.0 4.0 4.0001 10.0 100.0 1000.0 108640.0 0.5 -1.0".split()


@registered("log_fixture", f"select x, round({_log('x')}, 6) y from (values {', '.join(f'({x}::double)' for x in _LOG_CASES)}) t(x)")
def _(spark, d):
    return spark.createDataFrame([(float(x),) for x in _LOG_CASES], "x double").select("x", F.round(T.log_series(F.col("x")), 6).alias("y"))


_STEM_CASES = {"домов": "дом", "столов": "стол", "делать": "дел", "домами": "дом", "читался": "чита", "они": "он", "ие": "ие", "я": "я", "ая": "ая", "новости": "новост", "области": "област", "hello": "hello", "hello123": "hello123"}


@registered("stem_fixture", "select * from (values " + ", ".join(f"('{w}', '{t}')" for w, t in _STEM_CASES.items()) + ") t(w, term)")
def _(spark, d):
    return spark.createDataFrame([(w,) for w in _STEM_CASES], "w string").select("w", T.stem(F.col("w")).alias("term"))


@registered("stop_words", f"select word, word in ({_SQL_STOP}) in_index, word in ({_quoted(T.QUERY_STOP_WORDS)}) in_query from common_words")
def _(spark, d):
    return table(spark, d, "common_words").select("word", T.is_index_stop(F.col("word")).alias("in_index"), T.is_query_stop(F.col("word")).alias("in_query"))


_RUNS = [(q, "ranked" if k % 3 else "boolean", int(k % 7 != 0), 100.0 + 7 * k % 60, k % 5, None if k % 5 == 0 else 0.1, None if k % 5 == 0 else 0.1 * (k % 5), 0.9) for q in ("a", "b", "c") for k in range(1, 11)]


@registered(
    "bench_summary",
    "with r as (select * from (values " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in _RUNS) + ") t(query, mode, ok, elapsed_ms, hits, score_min, score_med, score_max)), "
    "g as (select query, list_sort(list(elapsed_ms)) ms, quantile_cont(hits, 0.5)::double hits_median, quantile_cont(elapsed_ms, 0.5) ms_median, min(score_med) score_min, quantile_cont(score_med, 0.5) score_median, max(score_med) score_max from r where ok = 1 group by 1), "
    "a as (select query, count(*) runs, count(*) filter (ok = 1) good, count(*) filter (mode = 'ranked') rk from r group by 1) "
    "select query, runs, good, case when rk * 2 > runs then 'ranked' else 'boolean' end mode, hits_median, ms[1] ms_min, ms_median, ms[(floor(0.95 * (len(ms) - 1)) + 1)::int] ms_p95, ms[-1] ms_max, score_min, score_median, score_max from a left join g using (query)",
)
def _(spark, d):
    return bench.summary(spark.createDataFrame(_RUNS, bench.RUNS))


_TITLE_CASES = [
    ("  Мост\u00a0 закрыт ", "Мост закрыт"), ("Новости Спорт Меню Новости Погода", "Новости Спорт"), ("Новости Температура +5 Новости дня", "Новости"), ("Мост закрыт» — Вестник", "Мост закрыт"),
    ("Мост закрыт Размер шрифта: А", "Мост закрыт"), ("", ""), ("я" * 90, "я" * 77 + "..."), ("Погода Меню Новости", "Погода Меню Новости"),
]


@registered("clean_titles", "select * from (values " + ", ".join(f"({k}, '{want}')" for k, (_, want) in enumerate(_TITLE_CASES)) + ") t(k, title)")
def _(spark, d):
    return spark.createDataFrame([(k, t) for k, (t, _) in enumerate(_TITLE_CASES)], "k int, t string").select("k", T.clean_title(F.col("t")).alias("title"))


@registered("clean_titles_all", "select doc_id, case when length(t) > 80 then rtrim(left(t, 77)) || '...' else t end title from (select doc_id, trim(regexp_replace(regexp_replace(case when lower(s) like 'новости%' then regexp_replace(s, '(?: Температура| НУ И ПОГОДА| Меню Новости| Новости ).*$', '') else s end, '(?:»|Ковровские вести|Размер шрифта:|Межбуквенный интервал:|Мы используем cookie).*$', ''), '^$', '')) t "
 "from (select doc_id, trim(regexp_replace(" + _TITLE + ", '[\\s\\x{0b}\\x{a0}]+', ' ', 'g')) s from (select doc_id, regexp_extract(text, '^[\\r\\n\\t ]*([^\\r\\n]*)', 1) line from documents where text <> '')))")
def _(spark, d):
    return _docs(spark, d).where("text <> ''").select("doc_id", T.clean_title(T.title_of_text(F.col("text"))).alias("title"))


@registered("short_titles", "with t as (select doc_id, regexp_extract(text, '^[\\r\\n\\t ]*([^\\r\\n]*)', 1) s from documents where text <> ''), c as (select doc_id, s, left(s, 80) h from t) select doc_id, case when length(s) <= 80 then s when contains(h, ' ') and length(regexp_extract(h, '^(.*) [^ ]*$', 1)) > 30 then regexp_extract(h, '^(.*) [^ ]*$', 1) || '...' else h || '...' end title from c")
def _(spark, d):
    line = F.regexp_extract("text", "^[\\r\\n\\t ]*([^\\r\\n]*)", 1)
    return _docs(spark, d).where("text <> ''").select("doc_id", T.truncate_title(line).alias("title"))
