import math
import random

import pytest
from pyspark.sql import functions as F

from wordmill.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, stem", [("домов", "дом"), ("столов", "стол"), ("делать", "дел"), ("они", "он"), ("ая", "ая"), ("ия", "ия"), ("hello", "hello")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem(F.col("w")), w=word) == stem


def test_stem_of_random_words(spark):
    r = random.Random(1)
    words = ["".join(r.choice("аеиоуыюяовмхлсьтйшaz1") for _ in range(r.randrange(1, 12))) for _ in range(3000)]

    def plain(w):
        b = w.encode()
        for s in T.SUFFIXES if len(b) > 3 else ():
            if len(b) > len(s.encode()) + 2 and w.endswith(s):
                return w[: -len(s)]
        return w

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert [(x.w, x.s) for x in got if x.s != plain(x.w)] == []


@pytest.mark.parametrize("word, yo, term", [("ДОМОВ", False, "дом"), ("ёлка", True, "елк"), ("ёлка", False, "ёлк"), ("hello123", False, "hello123"), ("PYTHON", True, "python"), ("a-b", True, "ab"), ("---", True, "")])
def test_query_term(spark, word, yo, term):
    assert T.query_term_of(word, yo) == term
    assert one(spark, T.query_term(F.col("w"), yo), w=word) == term


def loop_log(x):
    if x <= 1:
        return 0.0
    k = 0
    while x > 2:
        x, k = x / 2, k + 1
    y, p, total = x - 1, x - 1, 0.0
    for n in range(1, 50):
        if p > 1e-10 and n % 2:
            total += p / n
        p *= y
    return total + k * 0.693147


def test_log_is_the_series(spark):
    xs = [0.5, -1.0, 1.0, 1.5, 2.0, 2.0001, 3.0, 4.0, 100.0, 1000.0, 108640.0]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.log_series(F.col("x")).alias("y")).collect()}
    for x in xs:
        assert math.isclose(got[x], loop_log(x), abs_tol=1e-9) and math.isclose(T.log_number(x), loop_log(x), abs_tol=1e-9)
    assert got[4.0] > got[2.0] > 0 == got[1.0] == got[0.5] == got[-1.0]


def test_stop_lists(spark):
    row = spark.createDataFrame([("и",), ("word",), ("наш",)], "w string").select("w", T.is_index_stop(F.col("w")).alias("i"), T.is_query_stop(F.col("w")).alias("q")).collect()
    assert {r.w: (r.i, r.q) for r in row} == {"и": (True, True), "word": (False, False), "наш": (True, False)}
    assert len(set(T.INDEX_STOP_WORDS)) == 64 and len(T.QUERY_STOP_WORDS) == 150


def test_words(spark):
    assert one(spark, T.index_words(F.col("t")), t="A-b Привет, мир2мир é") == ["привет", "мир", "мир"]
    assert one(spark, T.corpus_words(F.col("t")), t="Юго‑Запад 10-й a -b- ёж") == ["юго-запад", "10-й", "еж"]


def test_titles(spark):
    assert one(spark, T.title_of_text(F.col("t")), t="\r\n  Первая строка\nдальше") == "Первая строка"
    cut = one(spark, T.title_of_text(F.col("t")), t="я" * 300)
    assert cut == "я" * 100
    assert one(spark, T.title_of_json(F.col("t")), t='{"a":1,"title": "x \\"y\\"", "title":"z"}') == 'x \\"y\\"'
    assert one(spark, T.title_of_json(F.col("t")), t='{"a":1}') is None
    assert one(spark, T.truncate_title(F.col("t")), t="слово " * 20) == ("слово " * 13).strip() + "..."
    assert one(spark, T.truncate_title(F.col("t")), t="x" * 90) == "x" * 80 + "..."
    assert one(spark, T.clean_title(F.col("t")), t="Новости Заголовок » дальше Мы используем cookie") == "Новости Заголовок"


def test_long_token_is_capped(spark):
    assert one(spark, F.char_length(T.cap(F.col("t"))), t="я" * 1000) == 252
    assert one(spark, F.char_length(T.cap(F.col("t"))), t="a" * 1000) == 504
