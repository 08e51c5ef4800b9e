"""Minimal acyclic transducer from words to lists of ids.

Words are added in byte order and equal suffixes are shared as soon as they are complete, so the
automaton is minimal at any time. Each transition carries the number of words that sort before
what it leads to; their sum along a word is the word's rank, which indexes the id lists. The whole
is a handful of flat arrays, written to one file that tasks map into memory; look-ups run over
many words at once, one byte a step.
"""

from __future__ import annotations

import numpy as np


class Lexicon:
    """Arrays: ``keys`` (state << 9 | byte, sorted), ``to``, ``skip``, ``final`` (a state's words of its own), ``start``/``ids``."""

    FIELDS = ("keys", "to", "skip", "final", "start", "ids")

    def __init__(self, **arrays: np.ndarray):
        for f in self.FIELDS:
            setattr(self, f, np.asarray(arrays[f]))

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        register: dict[tuple, int] = {}
        nodes: list[tuple[bool, tuple]] = []

        def freeze(final: bool, edges: list) -> int:
            key = (final, tuple(edges))
            at = register.get(key)
            if at is None:
                at = register[key] = len(nodes)
                nodes.append(key)
            return at

        # The path of the last word: [final, finished edges, byte of the open edge].
        path: list[list] = [[False, [], -1]]
        previous = b""
        for w in words:
            k, top = 0, min(len(w), len(previous))
            while k < top and w[k] == previous[k]:
                k += 1
            while len(path) - 1 > k:
                final, edges, _ = path.pop()
                path[-1][1].append((path[-1][2], freeze(final, edges)))
            for byte in w[k:]:
                path[-1][2] = byte
                path.append([False, [], -1])
            path[-1][0] = True
            previous = w
        while len(path) > 1:
            final, edges, _ = path.pop()
            path[-1][1].append((path[-1][2], freeze(final, edges)))
        root = freeze(path[0][0], path[0][1])
        # States are frozen after all they lead to, so counts are known in order.
        count = np.zeros(len(nodes), np.int64)
        keys, to, skip = [], [], []
        for s, (final, edges) in enumerate(nodes):
            n = int(final)
            for byte, t in edges:
                keys.append(s << 9 | byte)
                to.append(t)
                skip.append(n)
                n += int(count[t])
            count[s] = n
        order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else np.zeros(0, np.int64)
        start = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(entries[w]) for w in words], out=start[1:])
        return cls(
            keys=np.array(keys, np.int64)[order],
            to=np.array(to, np.int64)[order],
            skip=np.array(skip, np.int64)[order],
            final=np.concatenate([np.array([f for f, _ in nodes], np.int64), [root]]),
            start=start,
            ids=np.array([i for w in words for i in entries[w]], np.int32),
        )

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            for name in self.FIELDS:
                np.save(f, getattr(self, name))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Maps the file; no array is copied."""
        arrays = {}
        with open(path, "rb") as f:
            for name in cls.FIELDS:
                version = np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                at = f.tell()
                arrays[name] = np.asarray(np.memmap(path, dtype, "r", at, shape)) if shape[0] else np.zeros(0, dtype)
                f.seek(at + shape[0] * dtype.itemsize)
        return cls(**arrays)

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for a word that isn't in the lexicon."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        length = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        live = np.flatnonzero(length > 0)
        state = np.full(len(live), int(self.final[-1]), np.int64)
        rank = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 9 | text[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, rank = live[ok], at[ok], rank[ok]
            state = self.to[at]
            rank = rank + self.skip[at]
            step += 1
            ended = length[live] == step
            hit = ended & (self.final[state] == 1)
            out[live[hit]] = rank[hit]
            live, state, rank = live[~ended], state[~ended], rank[~ended]
        return out

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.start[rank] : self.start[rank + 1]]
