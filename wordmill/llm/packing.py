"""Filling fixed-capacity containers: swap-based local search.

Items are put into blocks of bounded size by a hash of their id, and each block is packed on its
own: a start (best fit, or next fit), then a local search over the underfull containers that moves
an item, exchanges one for one, one for two or two for one whenever the sum of squared fills grows,
so containers empty. It ends at a local optimum: no step between any two containers of the block is
left. The emptiest containers of a block give their items back to the pool, at most an eighth of the
block's items, and the pool is packed again in fewer blocks, until one block holds it; so no
task ever holds more than about ``block_items`` items, whatever the sizes are.

An item above the capacity is cut into pieces that follow each other: full pieces have a container
of their own, the rest is an item like others.

Defined results: items of size 0 or null have no container; the sum of a container never exceeds
the capacity; repeated ids are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.session import materialise

CAPACITY = 4096
BLOCK_ITEMS = 20_000
WANTED_FILL = 0.995
#: Share of a block's items that may go round again: each round has an eighth of the last one's items at most.
AGAIN_SHARE = 0.125
#: Best fit with so many times the least number of containers is a start for the search.
NEAR = 1.02


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item indexes of each container."""
    order = np.argsort(-sizes, kind="stable")
    free: list[int] = []  # sorted free space
    bin_of: list[int] = []  # container at that place
    bins: list[list[int]] = []
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(free, s)
        if at < len(free):
            left, b = free.pop(at) - s, bin_of.pop(at)
        else:
            left, b = capacity - s, len(bins)
            bins.append([])
        bins[b].append(i)
        if left:
            at = bisect.bisect_left(free, left)
            free.insert(at, left)
            bin_of.insert(at, b)
    return bins


def next_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items in the order given, a new container whenever one doesn't fit."""
    bins: list[list[int]] = []
    room = 0
    for i, s in enumerate(sizes.tolist()):
        if s > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= s
    return bins


class LocalSearch:
    """Moves, one-for-one, one-for-two and two-for-one exchanges that raise the sum of squared fills.

    Every way a container can take something in is a key: the largest size it can take while it
    gives back nothing, one or two of its items. Keys of all containers are in one sorted list, so
    the partner that a given size fills best is found by binary search among all of them. A step from
    ``a`` to ``b`` raises the sum of squares just if ``b`` then has less room than ``a`` had, which
    bounds the keys to look at. Donors come from the emptiest on; the search ends when no donor has a step."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.size, self.cap = sizes.tolist(), capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.keys = sorted(e for b in range(len(bins)) for e in self._ways(b))

    def _ways(self, b: int):
        room, size = self.cap - self.fill[b], self.size
        if room > 0:
            v = self.version[b]
            yield room, b, v, 0, ()
            for x, i in enumerate(self.bins[b]):
                yield room + size[i], b, v, size[i], (i,)
                for j in self.bins[b][:x]:
                    yield room + size[i] + size[j], b, v, size[i] + size[j], (j, i)

    def _partner(self, a: int, s: int, back: int):
        """The way with least room left that takes ``s`` from ``a`` for something smaller, at most ``back`` items."""
        keys, least = self.keys, self.cap - self.fill[a] + s
        at = bisect.bisect_left(keys, (s,))
        while at < len(keys) and keys[at][0] < least:
            _, b, v, t, taken = keys[at]
            if self.version[b] != v:  # of before a step
                del keys[at]
            elif b != a and t < s and len(taken) <= back:
                return keys[at]
            else:
                at += 1
        return None

    def _step(self, a: int) -> bool:
        items, size = self.bins[a], self.size
        best = None
        for x, i in enumerate(items):
            for give, back in (((i,), 2), *(((j, i), 1) for j in items[:x])):
                s = sum(size[k] for k in give)
                found = self._partner(a, s, back) if s <= self.cap else None
                if found and (best is None or found[0] - s < best[0]):
                    best = found[0] - s, give, found
        if best is None:
            return False
        _, give, (_, b, _, t, taken) = best
        moved = sum(size[i] for i in give) - t
        self.bins[a] = [i for i in items if i not in give] + list(taken)
        self.bins[b] = [i for i in self.bins[b] if i not in taken] + list(give)
        self.fill[a] -= moved
        self.fill[b] += moved
        for k in (a, b):
            self.version[k] += 1
            for way in self._ways(k):
                bisect.insort(self.keys, way)
        return True

    def run(self) -> list[list[int]]:
        changed = True
        while changed:
            changed = False
            for a in sorted((k for k, b in enumerate(self.bins) if b and self.fill[k] < self.cap), key=lambda k: self.fill[k]):
                while self.bins[a] and self._step(a):
                    changed = True
        return [b for b in self.bins if b]


def pack_items(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers of one block. The search starts from best fit where that is near the sum of sizes,
    else (sizes of a third of the capacity or so, which best fit pairs badly) from next fit."""
    least = -(-int(sizes.sum()) // capacity)
    bins = best_fit(sizes, capacity)
    if len(bins) <= NEAR * least:
        return LocalSearch(sizes, bins, capacity).run()
    return min(bins, LocalSearch(sizes, next_fit(sizes, capacity), capacity).run(), key=len)


def _pack_block(capacity: int, wanted: float, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
        sizes = rows["size"].to_numpy()
        bin_, place, again = (np.zeros(len(rows), np.int64) for _ in range(3))
        # The emptiest containers go round again, as far as they hold a share of the block's items.
        pool = 0 if last else int(len(rows) * AGAIN_SHARE)
        fill = lambda b: int(sizes[b].sum())
        for k, b in enumerate(sorted(pack_items(sizes, capacity), key=fill)):
            back = fill(b) < wanted * capacity and len(b) <= pool
            pool = pool - len(b) if back else 0
            for n, i in enumerate(sorted(b)):
                bin_[i], place[i], again[i] = k, n, back
        return rows.assign(bin=bin_, place=place, again=again)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, wanted: float = WANTED_FILL) -> DataFrame:
    """``items`` is (item, size). Gives (item, piece, start, size, container, place): ``piece`` counts
    the pieces of an item from 0, ``start`` is where the piece begins in the item, ``place`` is
    its position in the container."""
    items = items.where("size > 0")
    cap = F.lit(capacity)
    full = F.floor(F.col("size") / cap).cast("int")
    long_ = items.where(F.col("size") > capacity)
    own = long_.select("item", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")).select("item", "piece", (F.col("piece").cast("long") * capacity).alias("start"), cap.cast("long").alias("size"))
    rest = long_.select("item", full.alias("piece"), (full.cast("long") * capacity).alias("start"), (F.col("size") % cap).cast("long").alias("size")).where("size > 0")
    pool = items.where(F.col("size") <= capacity).select("item", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("size")).unionByName(rest)
    schema = "item long, piece int, start long, size long, block long, bin long, place long, again long"
    done = own.select("*", F.concat_ws("-", F.lit("f"), "item", "piece").alias("container"), F.lit(0).alias("place"))
    n, level = pool.count(), 0
    while n:
        blocks = -(-n // block_items)
        salted = pool.withColumn("block", F.pmod(F.xxhash64("item", "piece", F.lit(level)), F.lit(blocks)))
        packed = materialise(salted.groupBy("block").applyInPandas(_pack_block(capacity, wanted, blocks == 1), schema), "packed")
        closed = packed.where("again = 0")
        done = done.unionByName(closed.select("item", "piece", "start", "size", F.concat_ws("-", F.lit(f"b{level}"), "block", "bin").alias("container"), F.col("place").cast("int").alias("place")))
        pool = packed.where("again = 1").select("item", "piece", "start", "size")
        n, level = (pool.count() if blocks > 1 else 0), level + 1
    return done
