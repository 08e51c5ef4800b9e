"""Problems 1, 3 and 5 against plain Python."""

import collections
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordmill.llm import postings, salience, sitelines, termfreq

POSTINGS = "seg_id int, source_id string, term string, doc_id long, tf long, df string"
DIRTY = [(0, "s", t, d, tf, "clash") for t, d, tf in [("Дом", 1, 2), ("дом ", 1, 3), ("дом", 1, 3), ("Ёлка", 2, 4), ("елка", 2, 1), ("район", 3, 1), ("район", 3, 1), (None, 4, 9), ("", 4, 9), ("  ", 5, 9), ("x", 0, 9), ("x", 6, 0), ("x", 6, -1), ("x", 6, None), ("x", None, 3)]]


def plain(rows):
    counts = collections.Counter()
    for _, _, t, d, tf, _ in rows:
        if t and d and tf and tf > 0:
            n = unicodedata.normalize("NFC", t).strip().lower().replace("ё", "е")
            if n:
                counts[n, d] += tf
    return counts


def random_rows(seed, n=4000):
    r = random.Random(seed)
    words = ["частое"] * 60 + [f"слово{k}" for k in range(80)] + ["Й", "Й", "é", "é"]
    return [(0, "s", r.choice(words), r.randrange(0, 300), r.randrange(-1, 4), "c") for _ in range(n)]


@pytest.mark.parametrize("rows", [DIRTY, random_rows(1), []])
def test_counted_rows(spark, rows):
    got = {(r.term, r.doc_id): r.tf for r in postings.counted(spark.createDataFrame(rows, POSTINGS)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("limit", [4_000_000, 50])
@pytest.mark.parametrize("rows", [DIRTY, random_rows(2), []])
def test_term_frequencies(spark, rows, limit):
    got = {r.term: (r.occurrences, r.documents, r.mark) for r in termfreq.term_frequencies(spark.createDataFrame(rows, POSTINGS), partition_rows=limit, spill_rows=limit).collect()}
    counts = plain(rows)
    docs = len({d for _, d in counts})
    want = {}
    for t in {t for t, _ in counts}:
        each = [n for (u, _), n in counts.items() if u == t]
        want[t] = (sum(each), len(each), "rare" if len(each) < 3 else "common" if len(each) >= 0.25 * docs else None)
    assert got == want


def test_radix_splits_a_hot_term(tmp_path):
    import pyarrow as pa

    agg = termfreq.RadixAggregator(str(tmp_path), partition_rows=1000, spill_rows=2000)
    for k in range(0, 9000, 500):
        agg.add(pa.RecordBatch.from_pydict({"term": ["горячее"] * 500, "doc_id": list(range(k, k + 500)), "tf": [2] * 500}))
    total = collections.Counter()
    for b in agg.results():
        for t, o, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            total["o"] += o
            total["n"] += n
    assert agg.documents() == 9000
    agg.close()
    assert total == {"o": 18000, "n": 9000}


def test_salience_is_the_likelihood_ratio(spark):
    rows = random_rows(3)
    counts = plain(rows)
    n = sum(counts.values())
    of_term, of_doc, df = collections.Counter(), collections.Counter(), collections.Counter()
    for (t, d), tf in counts.items():
        of_term[t] += tf
        of_doc[d] += tf
        df[t] += 1
    got = salience.term_salience(spark.createDataFrame(rows, POSTINGS)).collect()
    assert len(got) == len(counts)
    for r in got:
        table = [[r.tf, of_doc[r.doc_id] - r.tf], [of_term[r.term] - r.tf, n - of_term[r.term] - of_doc[r.doc_id] + r.tf]]
        rowsum, colsum = [sum(x) for x in table], [sum(x) for x in zip(*table)]
        g2 = 2 * sum(k * math.log(k * n / (rowsum[i] * colsum[j])) for i, line in enumerate(table) for j, k in enumerate(line) if k)
        assert math.isclose(abs(r.score), max(0, g2), rel_tol=1e-6, abs_tol=1e-6) and r.df == df[r.term]
        assert (r.score >= 0) == (r.tf * n >= of_doc[r.doc_id] * of_term[r.term]) or abs(r.score) < 1e-9
    few = salience.term_salience(spark.createDataFrame(rows, POSTINGS), min_tf=2, max_df=50)
    assert few.count() == sum(1 for (t, _), tf in counts.items() if tf >= 2 and df[t] <= 50)
    # Hot terms sent to the rows: the same scores.
    key = lambda df: {(r.doc_id, r.term): round(r.score, 9) for r in df.collect()}
    df = spark.createDataFrame(rows, POSTINGS)
    assert key(salience.term_salience(df, hot_df=20)) == key(salience.term_salience(df)) and key(salience.term_salience(df, 2, 50, hot_df=20)) == key(few)
    assert salience.term_salience(spark.createDataFrame([], POSTINGS)).count() == 0


DOCS = "doc_id long, source string, text string, line_no int"


def test_site_lines(spark):
    rows = [(k, "a", f"Заголовок {k}\nПодпишитесь  на канал {k}!\n\n© 2020\n***", 1) for k in range(6)]
    rows += [(10, "a", None, 1), (11, "a", "", 1), (12, "b", "подпишитесь на канал 5", 1), (13, "b", "ПОДПИШИТЕСЬ НА КАНАЛ 7?!\nПодпишитесь на канал 1", 1)]
    rows += [(20 + k, None, "общая строка\r\nобщая строка", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.line_no) for r in sitelines.repeated_lines(docs).collect()}
    # "Заголовок 0" is one line after digits; blank and symbol lines are none; b has too few documents.
    assert got == {(k, n) for k in range(6) for n in (1, 2, 4)} | {(20 + k, n) for k in range(5) for n in (1, 2)}
    texts = {r.doc_id: (r.text, r.removed) for r in sitelines.without_repeated_lines(docs).collect()}
    assert texts[0] == ("\n***", 3) and texts[10] == (None, 0) and texts[11] == ("", 0) and texts[12][1] == 0
    assert texts[20] == ("", 2) and len(texts) == len(rows)
    # Too many frequent lines to send: the join gives the same.
    assert texts == {r.doc_id: (r.text, r.removed) for r in sitelines.without_repeated_lines(docs, most=0).collect()}
    assert sitelines.repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_site_lines_share(spark):
    rows = [(k, "a", "редкая строка" if k < 5 else f"своя {chr(1072 + k % 32)}{chr(1072 + k // 32)}", 1) for k in range(101)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sitelines.repeated_lines(docs).count() == 0  # 5 of 101 are under 5 %
    assert sitelines.repeated_lines(docs.where(F.col("doc_id") < 100)).count() == 5


def test_first_characters():
    for line in ["  Привет", "\u00a0٣٤ x", "12 августа", "İstanbul", "© 2020 x", "\tabc", "", "  "]:
        assert sitelines.first_of(line) == sitelines.normal_line(line + "x")[:1] or not line.strip(), line
