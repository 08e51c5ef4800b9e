import pytest

from wordmill.operators import codec, index
from wordmill.plans import query, rank

LISTS = {"a": {1, 2, 3}, "b": {2, 3, 4}, "c": {3, 5}}
UNIVERSE = set(range(1, 7))
CASES = [
    ("a && b", [2, 3]), ("a b", [2, 3]), ("a & b", [2, 3]), ("(a)(b)", [2, 3]), ("a || b && c", [1, 2, 3]), ("(a || b) && c", [3]), ("!a", [4, 5, 6]),
    ("a && !b", [1]), ("a !b", [1]), ("a!b", [1]), ("!!a", [1, 2, 3]), ("!a b", [4]), ("a && и", [1, 2, 3]), ("и && a", [1, 2, 3]), ("a &&", [1, 2, 3]), ("|| a", [1, 2, 3]),
    ("a !и", [4, 5, 6]), ("!и", []), ("()", []), ("", []), ("a && (b", [2, 3]), ("a) && b", [2, 3]), ("a-b", []), ("a b || c", [2, 3, 5]),
]


@pytest.fixture(scope="module")
def small(spark):
    rows = [(t, d, 1) for t, ds in LISTS.items() for d in ds]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf long").cache()
    docs = spark.createDataFrame([(d, f"u{d}", f"t{d}", 1, 1.0) for d in UNIVERSE], "doc_id long, url string, title string, doc_len long, norm double").cache()
    return index.Index(postings, docs, len(UNIVERSE))


@pytest.mark.parametrize("text, want", CASES)
def test_program(text, want):
    got = query.evaluate(query.program(text), lambda t: LISTS.get(t, set()), lambda a, b: a & b, lambda a, b: a | b, lambda a: UNIVERSE - a)
    assert sorted(got or []) == want


@pytest.mark.parametrize("text, want", [c for c in CASES if c[0] in ("a && b", "!a", "a !и", "a b || c", "()", "a-b", "!a b")])
def test_columns_agree_with_sets(small, text, want):
    assert sorted(r.doc_id for r in query.matches(small, text).collect()) == want
    assert sorted(r.doc_id for r in query.matches_by_sets(small, text).collect()) == want


def test_mode_and_words():
    assert query.is_boolean("a && b") and query.is_boolean("!a") and not query.is_boolean("(a) b AND c")
    assert query.scoring_words("a(b и дома дома") == ["ab", "дом", "дом"]


def test_page(spark):
    rows = spark.range(100).orderBy("id")
    assert [r.id for r in query.page(rows, -5, 0).collect()] == list(range(50))
    assert [r.id for r in query.page(rows, 98, 10).collect()] == [98, 99]


def documents(spark):
    rows = [(0, "skipped words"), (1, "hello world hello"), (2, "world peace"), (3, ""), (4, None), (5, "123 !!"), (6, "hello hello hello hello")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_index(spark):
    ix = index.index_of(documents(spark))
    assert {(r.term, r.doc_id): r.tf for r in ix.postings.collect()} == {("hello", 1): 2, ("world", 1): 1, ("world", 2): 1, ("peace", 2): 1, ("hello", 6): 4}
    docs = {r.doc_id: r for r in ix.docs.collect()}
    assert sorted(docs) == [1, 2, 5, 6] and ix.n_docs == 4
    assert docs[1].doc_len == 3 and docs[5].doc_len == 0 and docs[5].norm == 0.0
    stats = index.index_stats(documents(spark)).first()
    assert (stats.docs, stats.unique_terms, stats.tokens) == (4, 3, 9)


def test_ranked(spark, tmp_path):
    index.write_index(documents(spark), str(tmp_path / "ix"))
    ix = index.read_index(spark, str(tmp_path / "ix"))
    lazy = index.index_of(documents(spark))
    got = [(r.doc_id, r.score) for r in rank.search(ix, "hello").collect()]
    assert got == [(r.doc_id, r.score) for r in rank.search(lazy, "hello").collect()]
    assert [d for d, _ in got] == [6, 1] or got[0][1] >= got[1][1]
    assert rank.search(ix, "nothing").count() == 0 and rank.search(ix, "и").count() == 0
    assert [r.doc_id for r in rank.search(ix, "world && !peace").collect()] == [1]
    # A term of every document has no weight at all.
    every = index.index_of(spark.createDataFrame([(1, "same words"), (2, "same thing")], "doc_id long, text string"))
    assert rank.search(every, "same").count() == 0


def test_empty_corpus(spark):
    ix = index.index_of(spark.createDataFrame([], "doc_id long, text string"))
    assert ix.postings.count() == 0 and ix.docs.count() == 0 and rank.search(ix, "x && y").count() == 0
    assert index.compression_stats(ix.postings).first().packed_bytes == 0


@pytest.mark.parametrize("pairs", [[(1, 2)], [(1, 1), (3, 2), (5, 1)], [], [(300, 5), (2**31, 130), (2**31 + 7, 1)]])
def test_codec(pairs):
    data = codec.encode(pairs)
    assert codec.decode(data) == pairs and (data == b"") == (not pairs)
    if pairs:
        assert data[-1] & 0x80


def test_packed_blocks(spark):
    rows = [("t", d, d % 7 + 1) for d in range(1, 200_000, 999)] + [("u", 5, 1)]
    p = spark.createDataFrame(rows, "term string, doc_id long, tf long")
    assert sorted(map(tuple, codec.unpacked(codec.packed_blocks(p)).collect())) == sorted(rows)


def test_large_dictionary_takes_the_other_way(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(["общее"] * (k % 90 + 1) + [f"слово{chr(1072 + k % 30)}", "редкое"])) for k in range(1, 200)], "doc_id long, text string")
    one = {r.doc_id: round(r.norm, 9) for r in index.index_of(docs).docs.collect()}
    monkeypatch.setattr(index, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(index, "HOT_DF", 50)
    assert one == {r.doc_id: round(r.norm, 9) for r in index.index_of(docs).docs.collect()}


def test_gaps_over_ranges(spark):
    rows = [("a", d, 1) for d in range(5, 4000, 7)] + [("b", 9, 2), ("c", 1, 1), ("c", 8, 1)]
    got = {(r.term, r.doc_id): r.gap for r in index.posting_gaps(spark.createDataFrame(rows, "term string, doc_id long, tf long").repartition(7)).collect()}
    assert got == {("a", d): 7 if d > 5 else 5 for d in range(5, 4000, 7)} | {("b", 9): 9, ("c", 1): 1, ("c", 8): 7}


def test_batch_search(spark):
    ix = index.index_of(spark.createDataFrame([(1, "школа город"), (2, "школа школа мост"), (3, "мост"), (4, "!!")], "doc_id long, text string"))
    texts = ["школа", "школа && !мост", "!школа", "мост школа", "", None, "и", "мост || город", "!и", "нет такого"]
    got = {}
    for r in rank.batch_search(ix, spark.createDataFrame(list(enumerate(texts)), "qid long, query string")).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.doc_id, r.score))
    for k, q in enumerate(texts):
        want = [(r.doc_id, getattr(r, "score", None)) for r in rank.search(ix, q or "").collect()]
        assert got.get(k, []) == want, q
    assert rank.batch_search(ix, spark.createDataFrame([], "qid long, query string")).count() == 0
    assert rank.batch_search(ix, spark.createDataFrame([(7, "!школа")], "qid long, query string"), limit=1).count() == 1


def test_codec_of_many_lists():
    import numpy as np

    lists = [[(3, 1), (300, 200)], [], [(1, 1)], [(2**40, 5), (2**40 + 1, 2**20)]]
    flat = np.array([p for x in lists for p in x], np.int64).reshape(-1, 2)
    at = np.cumsum([0, *map(len, lists)])
    data, ends = codec.encode_lists(flat[:, 0], flat[:, 1], at)
    assert [data[a:b] for a, b in zip(ends[:-1], ends[1:])] == [codec.encode(x) for x in lists]
    docs, tfs, offsets = codec.decode_lists(np.frombuffer(data, np.uint8), ends)
    assert np.column_stack([docs, tfs]).tolist() == flat.tolist() and offsets.tolist() == at.tolist()


def test_index_options(spark):
    docs = spark.createDataFrame([(1, "ёлка 123 дом7"), (2, "длинный текст " * 20)], "doc_id long, text string")
    plain = {r.term for r in index.postings(docs).collect()}
    numbers = {r.term for r in index.postings(docs, index.IndexOptions(keep_numbers=True)).collect()}
    assert "123" not in plain and {"123", "дом7"} <= numbers
    assert {r.term for r in index.postings(docs, index.IndexOptions(yo_to_e=False)).where("doc_id = 1").collect()} != {r.term for r in index.postings(docs).where("doc_id = 1").collect()}
    small = index.index_of(docs, index.IndexOptions(max_doc_bytes=100))
    assert small.n_docs == 1 and {r.doc_id for r in small.docs.collect()} == {1}
    ln = index.index_of(docs, index.IndexOptions(log_mode="ln"))
    assert ln.log_mode == "ln" and [r.doc_id for r in rank.search(ln, "текст").collect()] == [2]
