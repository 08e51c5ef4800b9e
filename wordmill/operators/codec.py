"""Delta and variable-byte coding of posting lists: seven bits a byte from the lowest, the last byte marked."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vbytes(values: np.ndarray) -> bytes:
    values = values.astype(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 10):
        n += values >= np.uint64(1) << np.uint64(7 * k) if 7 * k < 64 else 0
    out = np.zeros(int(n.sum()), np.uint8)
    ends = np.cumsum(n)
    starts = ends - n
    for k in range(int(n.max()) if len(n) else 0):
        have = n > k
        out[starts[have] + k] = (values[have] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
    out[ends - 1] |= 0x80
    return out.tobytes()


def encode(postings: Iterable[tuple[int, int]]) -> bytes:
    """Sorted (doc_id, tf) pairs to bytes: gap and count in turn."""
    rows = np.array(list(postings), np.int64).reshape(-1, 2)
    if not len(rows):
        return b""
    gaps = np.diff(rows[:, 0], prepend=0)
    return _vbytes(np.column_stack([gaps, rows[:, 1]]).reshape(-1))


def decode(data: bytes) -> list[tuple[int, int]]:
    """The pairs again; bytes after the last whole pair are ignored."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw & 0x80)
    if len(ends) < 2:
        return []
    starts = np.concatenate([[0], ends[:-1] + 1])
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max()) + 1):
        have = starts + k <= ends
        values[have] |= (raw[starts[have] + k] & 0x7F).astype(np.int64) << (7 * k)
    pairs = values[: len(values) // 2 * 2].reshape(-1, 2)
    return list(zip(np.cumsum(pairs[:, 0]).tolist(), pairs[:, 1].tolist()))


def _starts(total: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(total)])


def encode_lists(doc_ids: np.ndarray, tfs: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All lists of a batch at once: their bytes one after another, and where each list ends."""
    gaps = np.diff(doc_ids, prepend=0)
    heads = offsets[:-1][np.diff(offsets) > 0]
    gaps[heads] = doc_ids[heads]
    values = np.column_stack([gaps, tfs]).reshape(-1).astype(np.uint64)
    n = np.ones(len(values), np.int64)
    for k in range(1, 10):
        n += values >> np.uint64(7 * k) > 0
    return _vbytes(values), _starts(n)[2 * offsets]


def decode_lists(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, counts, offsets of the lists) of the lists whose bytes stand one after another."""
    ends = np.flatnonzero(data & 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        have = starts + k <= ends
        values[have] |= (data[starts[have] + k] & 0x7F).astype(np.int64) << (7 * k)
    lists = np.searchsorted(ends, offsets) // 2
    gaps, tfs = values[0::2], values[1::2]
    total = _starts(gaps)
    return total[1:] - np.repeat(total[lists[:-1]], np.diff(lists)), tfs, lists


def _pack(batches):
    for b in batches:
        lists = b.column(2)
        flat = lists.flatten()
        at = lists.offsets.to_numpy().astype(np.int64)
        data, ends = encode_lists(flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64), at - at[0])
        packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int32)), packed], ["term", "block", "df", "bytes"])


def _unpack(batches):
    for b in batches:
        packed = b.column(1).cast(pa.large_binary())
        sizes = np.array([len(x) for x in packed.to_pylist()], np.int64)
        data = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
        docs, tfs, at = decode_lists(data, _starts(sizes))
        terms = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(at))))
        yield pa.RecordBatch.from_arrays([terms, pa.array(docs), pa.array(tfs)], ["term", "doc_id", "tf"])


def packed_blocks(postings: DataFrame, block: int = 65_536) -> DataFrame:
    """(term, block, df, bytes): lists cut into blocks of doc-id ranges, so a hot term isn't one row.
    A batch of lists is coded in one pass over its values."""
    keyed = postings.withColumn("block", F.floor(F.col("doc_id") / block))
    lists = keyed.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("long"), F.col("tf").cast("long")))).alias("list"))
    return lists.select("term", "block", "list").mapInArrow(_pack, "term string, block long, df int, bytes binary")


def unpacked(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of packed blocks."""
    return blocks.select("term", "bytes").mapInArrow(_unpack, "term string, doc_id long, tf long")
