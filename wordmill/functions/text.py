"""Text normalisation as Spark columns: letters, tokens, stems, stop words, the log approximation."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
_LOWER = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"

#: Stop words of the index.
INDEX_STOP_WORDS = (
    "и в не на с по для как из к а то что это он она оно они мы вы я его ее их наш ваш мой твой "
    "этот тот такой какой где когда почему если или но да нет ну вот здесь там тут туда сюда "
    "от до из к на под над за перед после во со про через между без для о об при по с у"
).split()

#: Stop words of queries and of the term report.
QUERY_STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да "
    "ты к у же вы за бы по ее мне было вот от меня еще нет о из "
    "ему теперь когда даже ну вдруг ли если уже или ни быть был него до "
    "вас нибудь опять уж вам ведь там потом себя ничего ей может они тут "
    "где есть надо ней для мы тебя их чем была сам чтоб без будто чего "
    "раз тоже себе под будет ж тогда кто этот того потому этого какой совсем "
    "ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех "
    "никогда можно при наконец два об другой хоть после над больше тот через "
    "эти нас про всего них какая много разве три эту моя впрочем хорошо свою "
    "этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между"
).split()

#: Suffixes of the stemmer, the first that fits is cut.
SUFFIXES = (
    "ыми ими ого его ому ему ами ями ов ев ей ой ей ою ею "
    "ах ях ам ям ом ем ым им ах ях "
    "ать ять еть оть уть ешь ишь ете ите ают яют уют ют ут "
    "лся лась лись лось "
    "ия ий ый ий ое ее ая яя "
    "а я о е ы и у ю"
).split()

#: More than two bytes of UTF-8 stay: two letters of which one is Cyrillic, or three others.
STEM_PATTERN = "^((?:[а-яё].|[a-z0-9][а-яё]|[a-z0-9]{2}.).*?)(?:" + "|".join(dict.fromkeys(SUFFIXES)) + ")$"
_STEM = re.compile(STEM_PATTERN)
TOKEN_BYTES = 504


def fold(text: Column, yo_to_e: bool = True) -> Column:
    """Lower case of Russian and English letters only, ``ё`` to ``е`` if asked for."""
    to = _LOWER[:-1] + "е" if yo_to_e else _LOWER
    return F.translate(text, _UPPER + "ё" * yo_to_e, to + "е" * yo_to_e)


def word_class(keep_numbers: bool = False, yo_to_e: bool = True) -> str:
    return "a-zа-я" + "0-9" * keep_numbers + "ё" * (not yo_to_e)


def _capped(token: Column) -> Column:
    """Characters are kept while fewer than TOKEN_BYTES bytes precede them."""
    kept = F.array_join(F.filter(F.split(token, ""), lambda c, i: F.octet_length(F.substring(token, F.lit(1), i)) < TOKEN_BYTES), "")
    return F.when(F.octet_length(token) <= TOKEN_BYTES, token).otherwise(kept)


def index_words(text: Column, keep_numbers: bool = False, yo_to_e: bool = True, min_len: int = 2) -> Column:
    """Array of the maximal runs of word characters, of at least ``min_len`` characters."""
    runs = F.split(fold(text, yo_to_e), f"[^{word_class(keep_numbers, yo_to_e)}]+")
    return F.filter(runs, lambda t: F.char_length(t) >= max(1, min_len))


def stem(token: Column) -> Column:
    """Of seven characters or more enough always stays, so only the last four are looked at."""
    ending = "(?:" + "|".join(dict.fromkeys(SUFFIXES)) + ")$"
    head = F.char_length(token) - 4
    short = F.concat(F.substring(token, F.lit(1), head), F.regexp_replace(F.substring(token, -4, 4), ending, ""))
    return F.when(F.char_length(token) >= 7, short).otherwise(F.regexp_replace(token, STEM_PATTERN, "$1"))


def cap(token: Column) -> Column:
    return _capped(token)


def corpus_words(text: Column, keep_numbers: bool = True, yo_to_e: bool = True, min_len: int = 2) -> Column:
    """Array of words with in-word hyphens (five dash characters become ``-``), without stemming or stop words."""
    chars = word_class(keep_numbers, yo_to_e)
    folded = F.translate(fold(text, yo_to_e), "‐‑‒–—", "-----")
    return F.filter(F.regexp_extract_all(folded, F.lit(f"([{chars}]+(?:-[{chars}]+)*)"), F.lit(1)), lambda t: F.char_length(t) >= min_len)


def is_index_stop(term: Column) -> Column:
    return term.isin(*sorted(set(INDEX_STOP_WORDS)))


def is_query_stop(term: Column) -> Column:
    return term.isin(*sorted(set(QUERY_STOP_WORDS)))


def query_term(word: Column, yo_to_e: bool = True) -> Column:
    """A query word: folded, everything but letters and digits deleted, stemmed."""
    return stem(F.regexp_replace(fold(word, yo_to_e), f"[^{word_class(True, yo_to_e)}]", ""))


def query_term_of(word: str, yo_to_e: bool = True) -> str:
    """The same on the driver, for query text."""
    table = str.maketrans(_UPPER + "ё" * yo_to_e, (_LOWER[:-1] + "е" if yo_to_e else _LOWER) + "е" * yo_to_e)
    kept = re.sub(f"[^{word_class(True, yo_to_e)}]", "", word.translate(table))
    return _STEM.sub(r"\1", kept)


def log_series(x: Column) -> Column:
    """The collection's logarithm: x is halved down to at most 2, adding 0.693147 each time; then the
    odd powers of x - 1 are summed with positive sign. 0 for x <= 1."""
    k = F.when(x > 2, F.ceil(F.log2(x)) - 1).otherwise(F.lit(0)).cast("double")
    y = x / F.pow(F.lit(2.0), k) - 1
    powers = F.transform(F.sequence(F.lit(1), F.lit(49), F.lit(2)), lambda n: F.struct(n.cast("double").alias("n"), F.pow(y, n).alias("p")))
    series = F.aggregate(powers, F.lit(0.0), lambda a, s: a + F.when(s["p"] > 1e-10, s["p"] / s["n"]).otherwise(0.0))
    return F.when(x > 1, k * 0.693147 + series).otherwise(F.lit(0.0))


def log_number(x: float, mode: str = "reference") -> float:
    """``log_of`` for one number on the driver."""
    if x <= 1:
        return 0.0
    if mode != "reference":
        return math.log(x)
    k = max(0, math.ceil(math.log2(x)) - 1)
    y = x / 2.0**k - 1
    return k * 0.693147 + sum(y**n / n for n in range(1, 50, 2) if y**n > 1e-10)


def log_of(x: Column, mode: str = "reference") -> Column:
    """``reference`` for the series above, ``ln`` for the natural logarithm (0 for x <= 1)."""
    if mode == "reference":
        return log_series(x)
    return F.when(x > 1, F.ln(x)).otherwise(F.lit(0.0))


#: Counts whose logarithm is looked up; others are worked out.
KNOWN_COUNTS = 64


@lru_cache
def count_sql(column: str, mode: str) -> str:
    known = ", ".join(f"{log_number(float(k), mode)!r}D" for k in range(1, KNOWN_COUNTS + 1))
    if mode == "reference":
        x = f"cast({column} as double)"
        k = f"(ceil(log2({x})) - 1)"  # more than 2 here
        y = f"({x} / power(2D, {k}) - 1)"
        other = f"{k} * 0.693147D + aggregate(sequence(1, 49, 2), 0D, (a, n) -> a + if(power({y}, n) > 1e-10D, power({y}, n) / n, 0D))"
    else:
        other = f"ln({column})"
    return f"case when {column} <= {KNOWN_COUNTS} then element_at(array({known}), int({column})) else {other} end"


def log_count(column: str, mode: str = "reference") -> Column:
    """``log_of`` for a column of counts (1 or more), as one short expression: plans of searches are made of it."""
    return F.expr(count_sql(column, mode))


def title_of_text(text: Column, max_bytes: int = 200) -> Column:
    """First line after leading white space, at most ``max_bytes`` bytes, never cutting a character."""
    line = F.regexp_extract(text, "^[\\r\\n\\t ]*([^\\r\\n]*)", 1)
    room = F.floor(F.lit(max_bytes))
    # A character has one to four bytes: keep those whose end lies within the limit.
    short = F.array_join(F.filter(F.split(F.substring(line, 1, max_bytes), ""), lambda c, i: F.octet_length(F.substring(line, F.lit(1), i + 1)) <= room), "")
    return F.when(F.octet_length(line) <= max_bytes, line).otherwise(short)


def title_of_json(meta: Column) -> Column:
    """The first ``"title"`` string as it stands, escapes not decoded; null without one."""
    found = F.regexp_extract(meta, '(?s)^.*?"title"[ \\t\\r\\n:]*"((?:\\\\.|[^"\\\\])*)"', 1)
    return F.when(meta.rlike('(?s)^(?:(?!"title").)*"title"[ \\t\\r\\n:]*"(?:\\\\.|[^"\\\\])*"'), found)


#: What a site's pages put behind a title, and where a menu that got into it ends.
TITLE_TAILS = ("Ковровские вести", "Размер шрифта:", "Межбуквенный интервал:", "Мы используем cookie")
TITLE_MENUS = {"новости": (" Температура", " НУ И ПОГОДА", " Меню Новости", " Новости ")}


def clean_title(title: Column, max_len: int = 80, tails: tuple[str, ...] = TITLE_TAILS, menus: dict[str, tuple[str, ...]] = TITLE_MENUS, close: str = "»") -> Column:
    """A title for reports: white space to one blank; of a title that begins with a menu's word only
    what stands before the first of its marks; nothing from a quotation's end or a tail's mark on; at
    most ``max_len`` characters, the last three dots where it is cut."""
    t = F.trim(F.regexp_replace(title, "[\\s\u00a0]+", " "))
    for word, marks in menus.items():
        first = F.array_min(F.array(*(F.when(F.instr(t, m) > 0, F.instr(t, m)) for m in marks)))
        t = F.when(F.lower(t).startswith(word) & first.isNotNull(), F.substring(t, F.lit(1), first - 1)).otherwise(t)
    ends = [F.when(F.instr(t, m) > 0, F.instr(t, m)) for m in (close, *tails)]
    first = F.array_min(F.array(*ends))
    t = F.trim(F.when(first.isNotNull(), F.substring(t, F.lit(1), first - 1)).otherwise(t))
    return F.when(F.char_length(t) > max_len, F.concat(F.rtrim(F.substring(t, 1, max_len - 3)), F.lit("..."))).otherwise(t)


def truncate_title(title: Column, max_len: int = 80) -> Column:
    """Cut at the last blank of the first ``max_len`` characters if it is beyond the thirtieth."""
    head = F.substring(title, 1, max_len)
    words = F.regexp_extract(head, "^(.*) [^ ]*$", 1)
    cut = F.when(head.contains(" ") & (F.char_length(words) > 30), words).otherwise(head)
    return F.when(F.char_length(title) > max_len, F.concat(cut, F.lit("..."))).otherwise(title)


def vbyte_length(x: Column) -> Column:
    """Bytes of a variable-byte code of seven bits each."""
    return F.when(x < 2**7, 1).when(x < 2**14, 2).when(x < 2**21, 3).when(x < 2**28, 4).otherwise(5)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
