"""Per-document text statistics, and which documents are not running prose.

Lines that recur within a source are set aside first. Each other line has three distributions:
character classes, word lengths, and function words against others. Their Jensen-Shannon divergence
from the prose profile of the nearest language tells lines that no reader could read (noise, code,
numbers, broken encodings). Profiles are fitted on the lines of the whole collection that end like
sentences. What is left is put together to sentences across line breaks; text that ends in no
sentence is list, heading or keywords. That gives each document a distribution of its characters over kinds
of text. Structural profiles, one for each kind, are fitted on the distributions of the whole
collection (rounds of nearest profile and mean), and a document is of the profile with the least
Jensen-Shannon divergence from its distribution: prose, or one of those that aren't.

Defined results: null, empty and blank texts have zeros, the profile ``empty`` and are no cases; a
repeated row is a document of its own; languages come from the text, not from ``lang``; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.chunks import ChunkMemo
from wordmill.llm.sitelines import repeated_lines, sent_lines
from wordmill.session import materialise, spread

#: Layout of a chunk's measures.
CHARS = ("vowel_ru", "consonant_ru", "vowel_en", "consonant_en", "letter_other", "digit", "stop", "comma", "mark", "symbol")
LENGTHS = 6
_N_CHARS, _WORDS = len(CHARS), len(CHARS) + LENGTHS
#: chars, lengths, words, common words, letters, upper case
WIDTH = _WORDS + 4
BLOCKS = ((slice(0, _N_CHARS), 0.6), (slice(_N_CHARS, _WORDS), 0.2), (slice(_WORDS + 1, _WORDS + 3), 0.2))
#: Pseudo-counts of the profile that a line's own counts are mixed with, so short lines aren't judged by chance.
PRIOR = (30.0, 6.0, 12.0)
LINE_DIVERGENCE = 0.075
#: Rounds that profiles are fitted in, and the share of other kinds that each profile keeps.
FIT_ROUNDS, SMOOTH = 2, 0.02
#: A text of so few lines and words that isn't alien is brief, not a list.
BRIEF_LINES, BRIEF_WORDS = 2, 25
#: Share of repeated runs of three words from which a text is repetition.
REPEATED_SHARE = 0.5
KINDS = ("prose", "list", "table", "numbers", "code", "garbled", "repetition")

_CLASS = {}
for _k, _chars in enumerate(("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "aeiouy", "bcdfghjklmnpqrstvwxz")):
    for _c in _chars:
        _CLASS[_c] = _CLASS[_c.upper()] = _k
for _k, _chars in ((6, ".!?…"), (7, ",;:"), (8, "«»„“”\"'’‘()—–-")):
    for _c in _chars:
        _CLASS[_c] = _k
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?…][»”“\"')\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])[»”“\"')\]]*\s+")
_FIELDS = re.compile(r"\t|;|\|| {3,}|\.{3,} *\d|…\s*\d|\s[–—-]\s.*\d+:\d+")
_CODE = re.compile(r"[{}]|;\s*$|=>|\w\(.*\)|^\s*[#.@]\w|</?\w|\w=[\w\"']")


def _class(ch: str) -> int:
    k = _CLASS.get(ch)
    if k is None:
        k = 4 if ch.isalpha() else 5 if ch.isdigit() else 9
        _CLASS[ch] = k
    return k


class Measurer:
    """Measures of chunks; a chunk is what stands between white space."""

    def __init__(self, common: frozenset[str]):
        self.common = common
        self.memo = ChunkMemo(self._measure, np.float32)

    def _measure(self, chunks: list[str]) -> list[np.ndarray]:
        out = np.zeros((len(chunks), WIDTH), np.float32)
        for row, c in zip(out, chunks):
            for ch in c:
                row[_class(ch)] += 1
            word = _STRIP.sub("", c)
            if word and any(ch.isalpha() for ch in word):
                n = len(word)
                row[_N_CHARS + (0 if n == 1 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 10 else 4 if n <= 16 else 5)] += 1
                row[_WORDS] += 1
                known = word.lower().replace("ё", "е") in self.common
                row[_WORDS + 1 + (not known)] += 1
                row[_WORDS + 3] += n
        return list(out)

    def lines(self, lines: list[str]) -> np.ndarray:
        """A row of measures for each line."""
        self.memo.trim()
        parts = [x.split() for x in lines]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        chunks = [c for p in parts for c in p]
        if not chunks:
            return np.zeros((len(lines), WIDTH))
        slots = self.memo.slots(chunks)
        table = self.memo.data.view.reshape(-1, WIDTH)
        sums = np.concatenate([np.zeros((1, WIDTH)), np.cumsum(table[slots], 0, dtype=np.float64)])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


_measurers: dict[int, Measurer] = {}


def _measurer(common: frozenset[str]) -> Measurer:
    key = hash(common)
    if key not in _measurers:
        _measurers.clear()
        _measurers[key] = Measurer(common)
    return _measurers[key]


def js_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of the rows of ``p`` from the distribution ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.maximum(0, (a + b) / 2)


def divergence(measures: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Of each row from the nearest profile."""
    best = np.full(len(measures), np.inf)
    for profile in profiles:
        total = np.zeros(len(measures))
        for (cols, weight), prior in zip(BLOCKS, PRIOR):
            q = profile[cols] / max(profile[cols].sum(), 1e-9)
            p = measures[:, cols] + prior * q
            total += weight * js_divergence(p / p.sum(-1, keepdims=True), q)
        best = np.minimum(best, total)
    return best


def _script(m: np.ndarray) -> np.ndarray:
    """0 for lines mostly in Russian letters, 1 for others."""
    return (m[:, 2] + m[:, 3] > m[:, 0] + m[:, 1]).astype(int)


def _profile_task(common: frozenset[str]):
    def run(batches):
        measure = _measurer(common)
        sums = np.zeros((2, WIDTH))
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                texts = b.column(0).slice(lo, 1024).to_pylist()
                lines = [x for t in texts if t for x in t.split("\n") if len(x) > 40 and _END.search(x.rstrip())]
                if lines:
                    m = measure.lines(lines)
                    s = _script(m)
                    for k in (0, 1):
                        sums[k] += m[s == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["script", "sums"])

    return run


def prose_profiles(documents: DataFrame, common: frozenset[str]) -> np.ndarray:
    """The summed measures of all lines that end like sentences, for each script; two rows come to the driver."""
    parts = spread(documents.select("text").where("text is not null")).mapInArrow(_profile_task(common), "script int, sums array<double>")
    total = parts.select("script", F.posexplode("sums").alias("k", "v")).groupBy("script", "k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((2, WIDTH))
    for r in total:
        out[r["script"], r["k"]] = r["v"]
    if not out.any():
        return out[:1]
    # A script that hardly occurs has no profile of its own.
    return out[out[:, _WORDS] > 0.001 * out[:, _WORDS].sum()]


def _line_kind(line: str, m: np.ndarray, alien: bool) -> str:
    n = max(1.0, m[:_N_CHARS].sum())
    if m[5] / n > 0.4:
        return "numbers"
    if alien and _CODE.search(line) and m[9] + m[8] + m[7] > 0.08 * n:
        return "code"
    if _FIELDS.search(line) and (alien or not _END.search(line)):
        return "table"
    return "garbled" if alien else "list"


def judge(lines: list[str], measures: np.ndarray, alien: np.ndarray) -> dict[str, int]:
    """Characters of a document's lines by kind; a sentence counts as prose the first time only."""
    chars = dict.fromkeys(KINDS, 0)
    seen: set[str] = set()
    held: list[int] = []  # lines of the running segment
    segment = ""

    def close() -> None:
        nonlocal segment
        if not segment:
            return
        pieces = _SENTENCE.split(segment)
        loose = 0
        for s in pieces:
            letters = next((ch for ch in s if ch.isalpha()), "")
            if _END.search(s) and letters and not letters.islower() and not s.endswith("...") or (_END.search(s) and letters and len(s) > 60 and not letters.islower()):
                key = s.lower()
                if key in seen and len(s) > 20:
                    chars["repetition"] += len(s)
                else:
                    seen.add(key)
                    chars["prose"] += len(s)
            else:
                loose += len(s)
        if loose:
            # What ends in no sentence counts for the kinds of its lines.
            total = sum(len(lines[k]) for k in held) or 1
            for k in held:
                chars[_line_kind(lines[k], measures[k], False)] += loose * len(lines[k]) // total
        segment = ""
        held.clear()

    for k, line in enumerate(lines):
        if alien[k]:
            close()
            chars[_line_kind(line, measures[k], True)] += len(line)
            continue
        first = next((ch for ch in line if ch.isalpha()), "")
        if segment and not _END.search(segment) and (first.islower() or len(lines[held[-1]]) > 55) and not _FIELDS.search(line):
            segment += " " + line
        else:
            close()
            segment = line
        held.append(k)
    close()
    return chars


def _repeated_phrases(words: list[str]) -> float:
    """Share of runs of three words that occurred before in the text."""
    runs = list(zip(words, words[1:], words[2:]))
    return 1 - len(set(runs)) / len(runs) if len(runs) > 8 else 0.0


_STATS = "doc_id long, n_chars long, n_words long, mean_word_len double, symbol_share double, end_share double, common_share double, repeated_share double, divergence double, prose_share double, brief boolean, mix array<double>"
_STAT_TYPES = [pa.int64()] * 3 + [pa.float64()] * 7 + [pa.bool_(), pa.list_(pa.float64())]
_SCHEMA = _STATS.replace("brief boolean, mix array<double>", "profile string, is_prose boolean")


def _judge_task(common: frozenset[str], profiles: np.ndarray, sent):
    """The third column is the source where frequent lines were sent, else the numbers of the lines to leave out."""

    def run(batches):
        measure = _measurer(common)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids, texts, marks = (part.column(k).to_pylist() for k in range(3))
                flat: list[str] = []
                spans = []
                for t, mark in zip(texts, marks):
                    at = len(flat)
                    if t:
                        lines = t.split("\n")
                        gone = sent.value.recurring(mark, lines) if sent is not None else set(mark or ())
                        flat += [x.strip() for k, x in enumerate(lines, 1) if k not in gone and x.strip()]
                        if len(flat) == at:  # nothing but recurring lines: judge them
                            flat += [x.strip() for x in lines if x.strip()]
                    spans.append((at, len(flat)))
                m = measure.lines(flat)
                div = divergence(m, profiles) if len(flat) and profiles.any() else np.zeros(len(flat))
                cols = list(zip(*(_row(i, flat[a:z], m[a:z], div[a:z], profiles) for i, (a, z) in zip(ids, spans))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STAT_TYPES)], [x.split()[0] for x in _STATS.split(", ")])

    return run


def _row(doc_id, lines: list[str], m: np.ndarray, div: np.ndarray, profiles: np.ndarray) -> tuple:
    if not lines:
        return (doc_id, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, None)
    total = m.sum(0)
    n_chars, n_words = total[:_N_CHARS].sum(), total[_WORDS]
    alien = div > LINE_DIVERGENCE
    chars = judge(lines, m, alien)
    repeated = _repeated_phrases(" ".join(lines).lower().split())
    if repeated > REPEATED_SHARE:
        chars["repetition"] += chars["prose"] + chars["list"]
        chars["prose"] = chars["list"] = 0
    mix = np.array([chars[k] for k in KINDS], float)
    mix /= max(1.0, mix.sum())
    brief = bool(len(lines) <= BRIEF_LINES and n_words < BRIEF_WORDS and not alien.any() and mix[1] + mix[0] > 0.9)
    whole = float(divergence(total[None], profiles)[0]) if profiles.any() else 0.0
    ends = sum(len(x) for x in lines if _END.search(x)) / max(1, sum(map(len, lines)))
    return (doc_id, int(n_chars), int(n_words), float(total[_WORDS + 3] / max(1, n_words)), float((total[5] + total[9]) / max(1, n_chars)), ends, float(total[_WORDS + 1] / max(1, n_words)), repeated, whole, float(mix[0]), brief, mix.tolist())


def nearest(mixes: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """The structural profile with the least divergence from each distribution."""
    return np.argmin(np.stack([js_divergence(mixes, q) for q in prototypes], 1), 1) if len(mixes) else np.zeros(0, int)


def _smooth(p: np.ndarray) -> np.ndarray:
    return p * (1 - SMOOTH * len(KINDS)) + SMOOTH


def _mixes(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(KINDS)) if len(column) else np.zeros((0, len(KINDS)))


def fitted_profiles(stats: DataFrame, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """A distribution over kinds for each structural profile, from all documents; one row of sums for
    each kind comes to the driver. A profile that no document is nearest to stays as it began."""
    prototypes = _smooth(np.eye(len(KINDS)))

    def sums(prototypes: np.ndarray):
        def run(batches):
            total = np.zeros((len(KINDS), len(KINDS)))
            for b in batches:
                m = _mixes(b.column(0))
                np.add.at(total, nearest(m, prototypes), m)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(KINDS), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["profile", "sums"])

        return run

    for _ in range(rounds):
        parts = stats.where("mix is not null").select("mix").mapInArrow(sums(prototypes), "profile int, sums array<double>")
        total = np.zeros((len(KINDS), len(KINDS)))
        for r in parts.select("profile", F.posexplode("sums").alias("k", "v")).groupBy("profile", "k").agg(F.sum("v").alias("v")).collect():
            total[r["profile"], r["k"]] = r["v"]
        n = total.sum(1, keepdims=True)
        prototypes = np.where(n > 0, _smooth(total / np.maximum(n, 1e-9)), prototypes)
    return prototypes


def _assign_task(prototypes: np.ndarray):
    def run(batches):
        for b in batches:
            keep = b.num_columns - 2
            mixes = b.column(keep + 1)
            at = np.flatnonzero(mixes.is_valid().to_numpy(zero_copy_only=False))
            names = np.full(b.num_rows, "empty", object)
            names[at] = np.array(KINDS, object)[nearest(_mixes(mixes.drop_null()), prototypes)]
            names[b.column(keep).to_numpy(zero_copy_only=False)] = "prose"
            prose = (names == "prose") | (names == "empty")
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(names, pa.string()), pa.array(prose)], [x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def text_quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row for each document: counts and shares over its text without recurring lines, the share
    of running sentences, the structural profile and whether it is prose.

    Frequent lines go to the tasks, so texts aren't shuffled; of too many, line numbers are joined."""
    common = frozenset(r[0].lower().replace("ё", "е") for r in common_words.select("word").where("word is not null").collect())
    profiles = prose_profiles(documents, common)
    sent = sent_lines(documents)
    if sent is not None:
        rows = spread(documents.select("doc_id", "text", "source"))
    else:
        drop = repeated_lines(documents).groupBy("doc_id").agg(F.collect_set("line_no").alias("drop"))
        rows = spread(documents.select("doc_id", "text")).join(drop, "doc_id", "left").select("doc_id", "text", "drop")
    stats = materialise(rows.mapInArrow(_judge_task(common, profiles, sent), _STATS), "quality")
    return stats.mapInArrow(_assign_task(fitted_profiles(stats)), _SCHEMA)
