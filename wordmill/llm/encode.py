"""Encoding of a corpus with a public byte-level BPE tokenizer.

A pass over all texts counts the chunks between blanks; the frequent pre-tokens of them, with the
ids that exact merging gives, are compiled into a minimal acyclic transducer (``lexicon``), which
tasks map into memory. The encoding pass looks pre-tokens up in it and merges the unseen ones
exactly. Which words are in the lexicon decides only about speed, never about ids.

Cutting before a blank is exact where it stands between two characters that aren't white space: the
pre-tokenizer always begins a pre-token there; and a line feed between two such is a pre-token of
its own. Texts with white space elsewhere are split by the pre-tokenizer's pattern as a whole.

Defined results: a null and an empty text give an empty list; strings that look like special
tokens are plain text; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.chunks import ChunkMemo
from wordmill.llm.lexicon import Lexicon
from wordmill.session import local_path, materialise, scratch, shared_dir, spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pre-tokenizer pattern of the byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the compiled lexicon, and how often a word must occur to be one.
LEXICON_WORDS = 40_000
LEXICON_MIN_COUNT = 4
_OUT_IDS = 4_000_000
#: White space beside white space or at an end may belong to one pre-token; the marks of chunks are taken.
_ODD = re.compile(r"\s\s|^\s|\s$|[\x00-\x02]").search
#: Some characters that are no letter, number or white space; any subset would do.
_CLOSING = ".,:;!?…»)\"”"


class Merger:
    """Exact byte-pair merging of single pre-tokens, and the splitting into them."""

    def __init__(self, ranks_file: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PRE_TOKEN).findall

    def merge(self, piece: str) -> list[int]:
        return self.core._encode_single_piece(piece)


_mergers: dict[str, Merger] = {}
_encoders: dict[tuple[str, int], Encoder] = {}
_lexicons: dict[str, Lexicon] = {}


def merger(path: str) -> Merger:
    """One for each worker process; reading the ranks takes a while."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encoder(path: str, lexicon: Lexicon) -> Encoder:
    """One for each worker process and lexicon: what it has worked out serves the next task."""
    key = (path, id(lexicon))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, lexicon)
    return _encoders[key]


class Encoder:
    """Texts to ids, in batches."""

    def __init__(self, ranks_file: str, lexicon: Lexicon | None = None):
        self.merger = merger(ranks_file)
        self.lexicon = lexicon
        self.memo = ChunkMemo(self._encode_chunks, np.int32)

    def _cut(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk; most are a word, or a word and closing marks.

        NUL opens the first chunk of a text, ``\\x01`` a pre-token as it is, ``\\x02`` a line; all
        other chunks follow a blank."""
        mark = chunk[0]
        if mark == "\x01":
            return [chunk[1:]]
        lead, word = ("", chunk[1:]) if mark == "\x00" or mark == "\x02" else (" ", chunk)
        core = word.rstrip(_CLOSING)
        if core.isalpha():
            pieces = [lead + core] if len(core) == len(word) else [lead + core, word[len(core) :]]
        else:
            pieces = self.merger.split(lead + word)
        return ["\n", *pieces] if mark == "\x02" else pieces

    def _encode_chunks(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each distinct chunk: look-up of its pre-tokens, exact merging of unseen ones."""
        pieces = list(map(self._cut, chunks))
        distinct = list(dict.fromkeys(p for ps in pieces for p in ps))
        merge = self.merger.merge
        if self.lexicon is None:
            ids = {p: np.array(merge(p), np.int32) for p in distinct}
        else:
            rank = self.lexicon.rank([p.encode("utf-8", "surrogatepass") for p in distinct])
            start, held = self.lexicon.start, self.lexicon.ids
            at, to = start[rank].tolist(), start[rank + 1].tolist()
            ids = {p: held[a:b] if r >= 0 else np.array(merge(p), np.int32) for p, r, a, b in zip(distinct, rank.tolist(), at, to)}
        return [ids[ps[0]] if len(ps) == 1 else np.concatenate([ids[p] for p in ps]) if ps else np.zeros(0, np.int32) for ps in pieces]

    def _chunked(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Chunks of all texts (see ``_cut``), and how many each has."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if not t:
                continue
            if _ODD(t):
                parts = ["\x01" + p for p in self.merger.split(t)]
            else:
                parts = t.replace("\n", " \x02").split(" ")
                parts[0] = "\x00" + parts[0]
            counts[k] = len(parts)
            chunks += parts
        return chunks, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text k has ids[offsets[k]:offsets[k + 1]]."""
        self.memo.trim()
        chunks, counts = self._chunked(texts)
        slots = self.memo.slots(chunks)
        per_chunk = np.concatenate([[0], np.cumsum(self.memo.lengths(slots))])
        ends = np.cumsum(counts)
        offsets = np.concatenate([[0], per_chunk[ends]]).astype(np.int64)
        return offsets, self.memo.expand(slots)

    def count(self, texts: list[str | None]) -> np.ndarray:
        self.memo.trim()
        chunks, counts = self._chunked(texts)
        per_chunk = np.concatenate([[0], np.cumsum(self.memo.lengths(self.memo.slots(chunks)))])
        ends = np.cumsum(counts)
        return per_chunk[ends] - per_chunk[ends - counts]


def _count_chunks(batches):
    import pyarrow.compute as pc

    for b in batches:
        texts = b.column(0).drop_null()
        found = pc.value_counts(pc.list_flatten(pc.split_pattern(texts, " ")))
        keep = pc.greater(found.field("counts"), 1)
        yield pa.RecordBatch.from_arrays([found.field("values").filter(keep), found.field("counts").filter(keep)], ["chunk", "n"])


def word_counts(documents: DataFrame, ranks_file: str) -> DataFrame:
    """(word, n): pre-tokens with their counts, from the chunks that a batch holds more than once."""

    def split(batches):
        cut = merger(ranks_file).split
        for b in batches:
            words: dict[str, int] = {}
            for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in cut(" " + c):
                    words[w] = words.get(w, 0) + n
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    chunks = spread(documents.select("text")).mapInArrow(_count_chunks, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return chunks.mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(documents: DataFrame, ranks_file: str, words: int = LEXICON_WORDS, min_count: int = LEXICON_MIN_COUNT) -> Lexicon:
    """The transducer of the most frequent words. A histogram of counts (a few hundred rows) gives the
    count from which there are at most ``words`` words, so only those come to the driver."""
    counts = word_counts(documents, ranks_file).where(F.col("n") >= min_count)
    counts = materialise(counts, "words")
    step = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16).cast("long") + 64)
    bars = counts.groupBy(step.alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("words")).collect()
    total, least = 0, None
    for r in sorted(bars, key=lambda r: -r["step"]):
        total += r["words"]
        if total > words:
            break
        least = r["least"]
    top = counts.where(F.col("n") >= least).collect() if least is not None else []
    merge = merger(ranks_file).merge
    return Lexicon.build({r["word"].encode(): list(merge(r["word"])) for r in top})


def _published(spark, lexicon: Lexicon):
    """A function that gives tasks the lexicon: mapped from the shared folder where it is a file
    system of all processes, broadcast (its size is bounded by the word limit) where not."""
    if local_path(shared_dir(spark)):
        import os

        path = local_path(scratch(spark, "lexicon"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        lexicon.save(path)

        def get() -> Lexicon:
            if path not in _lexicons:
                _lexicons.clear()
                _lexicons[path] = Lexicon.load(path)
            return _lexicons[path]

        return get
    held = spark.sparkContext.broadcast({f: getattr(lexicon, f) for f in Lexicon.FIELDS})

    def get() -> Lexicon:
        if "broadcast" not in _lexicons:
            _lexicons["broadcast"] = Lexicon(**held.value)
        return _lexicons["broadcast"]

    return get


def _runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges whose ids stay under the output limit."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _OUT_IDS, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def encode_corpus(documents: DataFrame, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every document."""
    ranks_file = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    lexicon = _published(documents.sparkSession, compile_lexicon(documents, ranks_file))

    def run(batches):
        enc = encoder(ranks_file, lexicon())
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                offsets, ids = enc.encode(part.column(1).to_pylist())
                for at, to in _runs(offsets):
                    o = offsets[at : to + 1]
                    lists = pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32)), pa.array(ids[o[0] : o[-1]]))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, to - at), lists], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n_tokens) of every document, by the same look-ups; 0 for null and empty texts."""
    ranks_file = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    lexicon = _published(documents.sparkSession, compile_lexicon(documents, ranks_file))

    def run(batches):
        enc = encoder(ranks_file, lexicon())
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.count(part.column(1).to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long")
