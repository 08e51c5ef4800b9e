import pytest
from pyspark.sql import functions as F

from wordmill.functions import urls as U
from wordmill.operators import bench, corpus, lexstats, rules
from wordmill.sources import tables


def test_csv_fields():
    assert [tables.csv_field("1,http://example.com,file.txt", k) for k in range(4)] == ["1", "http://example.com", "file.txt", None]
    assert tables.csv_field('a,"b ""c"", d",e\r\nf', 1) == 'b "c", d'
    assert [tables.csv_column("doc_id,final_url,text_path", c) for c in ("doc_id", "final_url", "text_path", "x")] == [0, 1, 2, -1]


def test_manifest_and_texts(spark, tmp_path):
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "1.txt").write_text("один\n", "utf-8")
    (tmp_path / "text" / "2.txt").write_text("", "utf-8")
    (tmp_path / "m.csv").write_text('doc_id,final_url,text_path,url\n1,http://a,text\\1.txt,"x,y"\n2,http://b,text/2.txt,\nabc,http://c,text/3.txt,\n3,,text/3.txt,\n', "utf-8")
    m = tables.read_manifest(spark, str(tmp_path / "m.csv"))
    assert m.columns == tables.MANIFEST
    assert [(r.doc_id, r.url) for r in tables.indexable(m).orderBy("doc_id").collect()] == [(1, "x,y"), (2, None)]
    texts = tables.read_texts(spark, str(tmp_path / "text")).withColumn("path", F.regexp_replace("path", "^file:", ""))
    got = tables.with_texts(m, texts, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "один\n")]
    assert tables.read_texts(spark, str(tmp_path / "text"), max_bytes=3).count() == 0


def test_term_freq_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "раз два раз"), (2, "раз, \"три\"")], "doc_id long, text string")
    freqs = lexstats.term_freq(lexstats.corpus_tokens(docs))
    lexstats.write_tables(freqs, str(tmp_path))
    back = {r.term: r.freq for r in tables.read_term_freq(spark, str(tmp_path / "term_freq")).collect()}
    assert back == {"раз": 3, "два": 1, "три": 1}
    assert [(r["rank"], r.freq, r.zipf_pred) for r in lexstats.zipf(freqs).orderBy("rank").collect()] == [(1, 3, 3.0), (2, 1, 1.5), (3, 1, 1.0)]
    assert lexstats.zipf(freqs.where("false")).count() == 0


def test_urls(spark):
    rows = [("HTTP://Ex.COM/A?b#c",), ("https://u@Host:80/p",), ("/rel?x",), (None,), ("",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "u string").select(U.normal_url(F.col("u")), U.host_of(F.col("u"))).collect()]
    assert got == [("http://ex.com/A", "ex.com"), ("https://u@host:80/p", "host"), ("/rel", ""), (None, None), ("", "")]


def test_page_text_and_links():
    html = "<html><head><style>x</style></head><body><!-- c --><p>Один&nbsp;два<script>bad()</script><noscript>no</noscript><a href=' /x '>ссылка</a><a href='mailto:a@b'>m</a><a href=''>e</a><p>три"
    assert U.page_text(html) == "Один два ссылка m e три"
    assert U.page_links(html, "https://h.example/a/b") == ["https://h.example/x"]
    assert U.page_text(None) is None and U.page_text("") == "" and U.page_links(None, None) == []


def test_decoding(spark):
    rows = [("привет".encode("cp1251"), "text/html; charset=windows-1251"), ("я".encode(), "text/html; charset=nope"), (b"\xff", "text/html"), (None, None)]
    got = [r.x for r in spark.createDataFrame(rows, "b binary, c string").select(U.decode_bytes(F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == ["привет", "я", "�", None]


def source(spark):
    return spark.createDataFrame(
        [("one", 0, ["a.example"], ["^https://a"], ["/news/"], [".*\\.jpg$"], 3, 2), ("two", 1, ["a.example", "b.example"], [], [], [], 5, 1)],
        "id string, ord int, allowed_domains array<string>, allow_regex array<string>, save_regex array<string>, deny_regex array<string>, max_depth int, max_pages int",
    )


def test_rules(spark):
    urls = [("https://a.example/x",), ("https://a.example/x.jpg",), ("http://a.example/x",), ("https://b.example/",), ("https://c.example/",)]
    got = {r.url: (r.matched, r.allowed, r.savable) for r in rules.judged(spark.createDataFrame(urls, "url string"), source(spark)).collect()}
    # Patterns are matched at the start, so ``/news/`` saves nothing here.
    assert got["https://a.example/x"] == ("one", True, False)
    assert got["https://a.example/x.jpg"] == ("one", False, False)
    assert got["http://a.example/x"] == ("one", False, False)
    assert got["https://b.example/"] == ("two", True, True)
    assert got["https://c.example/"] == (None, False, False)


def test_corpus(spark):
    sizes = corpus.size_summary(spark.createDataFrame([(1,), (4,), (0,), (None,)], "n long"), "n").first()
    assert tuple(sizes) == (2, 5, 2, 2, 1, 4, 2)
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.copies) for r in corpus.first_of_content(rows).collect()} == {(1, 2), (2, 1)}
    capped = corpus.page_caps(spark.createDataFrame([("one", k) for k in range(5)] + [("two", 9)], "source_id string, k int"), source(spark), ("k",))
    assert sorted((r.source_id, r.k) for r in capped.collect()) == [("one", 0), ("one", 1), ("two", 9)]
    ids = corpus.numbered(spark.createDataFrame([(f"u{k:02}",) for k in range(30)], "url string"), ("url",), 7)
    assert sorted((r.url, r.doc_id) for r in ids.collect()) == [(f"u{k:02}", k + 8) for k in range(30)]


def test_repair(spark):
    m = spark.createDataFrame([(1, "s", None, None, 9), (2, "s", "p", "h", None), (None, "s", "p", "h", 1)], "doc_id long, source_id string, text_path string, sha256_text string, text_len long")
    texts = spark.createDataFrame([(1, "ab\r\n"), (2, "\n")], "doc_id long, text string")
    got = {r.doc_id: (r.text_path, r.text_len) for r in corpus.repair_manifest(m, texts).collect()}
    assert got == {1: ("text\\1.txt", 2), 2: ("p", 0), None: ("p", 1)}


def test_bench_summary(spark):
    runs = [("q", "ranked", 1, float(k), 5, 0.1, 0.2, 0.3) for k in range(1, 11)] + [("q", "boolean", 0, 99.0, 0, None, None, None)]
    r = bench.summary(spark.createDataFrame(runs, bench.RUNS)).first()
    assert (r.runs, r.good, r["mode"], r.ms_min, r.ms_median, r.ms_p95, r.ms_max) == (11, 10, "ranked", 1.0, 5.5, 9.0, 10.0)


def test_line_ends_in_quotes():
    assert tables.csv_field('a,"b\nc",d', 1) == "b" and tables.csv_field('a,"b\nc",d', 2) is None


def test_detected_charsets(spark):
    text = "Вчера город открыл новый парк у реки, и жители пришли на праздник."
    for name in ("cp1251", "koi8-r", "cp866", "utf-8", "utf-16", "utf-8-sig"):
        assert text.encode(name).decode(U.detected_charset(text.encode(name))) == text, name
    assert U.detected_charset(b"") == "utf-8" and U.detected_charset("я".encode()[:1]) == "utf-8"
    rows = [(text.encode("cp1251"), "text/html"), (text.encode("koi8-r"), "text/html; charset=nope")]
    assert [r.x for r in spark.createDataFrame(rows, "b binary, c string").select(U.decode_bytes(F.col("b"), F.col("c")).alias("x")).collect()] == [text, text]


LOGIC = "concurrency: 2\n  request_delay_sec: 0.5\n  revisit_after_sec: 10\n  lease_sec: 20\n  error_backoff_sec: 30\n  reset_stuck_after_sec: 40\n  max_depth: 5\n  run_forever: false\n"


def test_configurations(spark, tmp_path):
    pytest.importorskip("yaml")
    robot = tmp_path / "robot.yaml"
    robot.write_text(f"db: {{uri: u, database: d, documents_collection: c, frontier_collection: f}}\nlogic:\n  {LOGIC}crawl_config_path: x\n")
    assert tables.load_robot(str(robot)) == tables.RobotConfig(5, 10, 30, 40, 20, 2, 0.5, False)
    robot.write_text(f"db: {{uri: u}}\nlogic:\n  {LOGIC.replace('  lease_sec: 20', '')}")
    with pytest.raises(ValueError, match="crawl_config_path.*db.database.*logic.lease_sec"):
        tables.load_robot(str(robot))
    sources = tmp_path / "sources.yaml"
    sources.write_text("sources:\n- {id: a, name: A, base_url: 'https://a', start_urls: ['https://a/'], allowed_domains: [a], crawl_policy: {max_depth: 3, max_pages: 7}}\n")
    rows = tables.sources_table(spark, tables.load_sources(str(sources))).collect()
    assert [(r.id, r.ord, r.allow_regex, r.max_depth, r.max_pages) for r in rows] == [("a", 0, [], 3, 7)]
    sources.write_text("sources:\n- {id: a, name: A}\n")
    with pytest.raises(KeyError):
        tables.load_sources(str(sources))


def test_resume_and_arrival_by_content(spark):
    m = spark.createDataFrame([(3, "s", "u1", "u1?x", " ab "), (9, "s", None, "", ""), (None, "t", "u2", None, None)], "doc_id long, source_id string, url string, final_url string, sha256_text string")
    top, counts, urls, hashes = tables.resume_state(m)
    assert top.first()[0] == 9 and {r.source_id: r.n for r in counts.collect()} == {"s": 2, "t": 1}
    assert {r.url for r in urls.collect()} == {"u1", "u2"} and [r.sha256_text for r in hashes.collect()] == ["ab"]


def test_titles_of_meta(spark):
    from wordmill.operators import index

    docs = spark.createDataFrame([(1, "Первая строка\nтекст школы"), (2, "Вторая строка"), (3, "Третья")], "doc_id long, text string")
    metas = spark.createDataFrame([(1, '{"doc_id": 1, "title": "Из меты"}'), (2, '{"url": "x"}'), (3, '{"title": " "}')], "doc_id long, meta string")
    assert {r.doc_id: r.title for r in index.index_of(tables.with_titles(docs, metas)).docs.collect()} == {1: "Из меты", 2: "Вторая строка", 3: "Третья"}


PAGES = "doc_id long, source_id string, url string, final_url string, fetch_ts timestamp, status int, content_type string, encoding string, bytes_len long, html string"


def test_storing_and_extraction(spark, tmp_path):
    import hashlib
    import json

    root = str(tmp_path / "data")
    pages = spark.createDataFrame([(1, "s", "u", "f", None, 200, "text/html", "utf-8", 9, '<p>Мост, "закрыт"'), (2, "s", "u", "f", None, 200, "text/html", None, 0, None)], PAGES)
    corpus.store(pages.where("doc_id = 1"), root)
    corpus.store(pages.where("doc_id = 2"), root)
    m = {r.doc_id: r for r in tables.read_manifest(spark, f"{root}/manifest").collect()}
    assert (m[1].raw_path, m[1].text_path, m[1].text_len, m[1].sha256_text) == ("raw_html/1.html", "text/1.txt", 14, hashlib.sha256('Мост, "закрыт"'.encode()).hexdigest())
    assert m[2].text_len == 0 and len(m) == 2
    meta = json.loads(spark.read.parquet(f"{root}/meta").where("doc_id = 2").first().meta)
    assert meta["encoding_detected"] is None and meta["raw_path"] == "raw_html/2.html" and spark.read.parquet(f"{root}/raw_html").count() == 2
    assert corpus.stored(pages, extract_text=False).where("text_path = '' and text_len = 0").count() == 2

    manifest = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,), (4,)], "doc_id long")
    raws = spark.createDataFrame([(1, "<p>a"), (3, "<p>b"), (4, "<p>c")], "doc_id long, html string")
    texts = spark.createDataFrame([(1, "old"), (4, "")], "doc_id long, text string")
    new, counts = corpus.extraction(manifest, raws, texts)
    assert sorted(map(tuple, new.collect())) == [(3, "b"), (4, "c")] and tuple(counts.first()) == (2, 2, 1)


def test_limits_of_the_corpus(spark):
    docs = spark.createDataFrame([(3, "раз два"), (1, "три " * 9), (0, "x y")], "doc_id long, text string")
    assert {r.doc_id for r in lexstats.corpus_tokens(docs, limit_docs=1).collect()} == {1}
    assert {r.doc_id for r in lexstats.corpus_tokens(docs, max_file_bytes=20).collect()} == {3}
    assert [r.hits for r in bench.score_summary(spark.createDataFrame([("q", 0.5), ("q", 0.1)], "query string, score double")).collect()] == [2]


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from wordmill.session import shared_dir

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        shared_dir(unset)
