"""Per-chunk memo for work on text that is a sum over the chunks between blanks.

Natural text repeats its chunks, so the costly part (splitting a chunk, encoding it, measuring it)
is done once for each distinct chunk of a task and gathered with array operations afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def gather(start: np.ndarray, length: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Positions of the values of each slot, one after another."""
    n = length[slots]
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    shift = np.repeat(start[slots] - (ends - n), n)
    return np.arange(total, dtype=np.int64) + shift


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, width: int = 0):
        self.a = np.zeros((1024, width) if width else 1024, dtype)
        self.n = 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.a):
            bigger = np.zeros((max(need, 2 * len(self.a)), *self.a.shape[1:]), self.a.dtype)
            bigger[: self.n] = self.a[: self.n]
            self.a = bigger
        self.a[self.n : need] = values
        self.n = need

    @property
    def view(self) -> np.ndarray:
        return self.a[: self.n]


class ChunkMemo:
    """Maps distinct chunks to slots; ``values`` gives a list of values for each new chunk.

    Forgets everything once ``limit`` chunks are held, so its memory is bounded whatever the text."""

    def __init__(self, values: Callable[[list], Sequence[np.ndarray]], dtype, limit: int = 250_000):
        self.values, self.dtype, self.limit = values, dtype, limit
        self._reset()

    def _reset(self) -> None:
        self.slot: dict = {}
        self.start, self.length, self.data = Grown(np.int64), Grown(np.int64), Grown(self.dtype)

    def trim(self) -> None:
        """To be called between batches only: slots don't outlive it."""
        if len(self.slot) > self.limit:
            self._reset()

    def slots(self, chunks: list) -> np.ndarray:
        slot = self.slot
        at = list(map(slot.get, chunks))
        if None in at:
            new = list(dict.fromkeys(c for c, s in zip(chunks, at) if s is None))
            slot.update(zip(new, range(len(slot), len(slot) + len(new))))
            found = self.values(new)
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.start.extend(self.data.n + np.cumsum(n) - n)
            self.length.extend(n)
            self.data.extend(np.concatenate(found))
            at = list(map(slot.__getitem__, chunks))
        return np.array(at, np.int64)

    def lengths(self, slots: np.ndarray) -> np.ndarray:
        return self.length.view[slots]

    def expand(self, slots: np.ndarray) -> np.ndarray:
        return self.data.view[gather(self.start.view, self.length.view, slots)]
