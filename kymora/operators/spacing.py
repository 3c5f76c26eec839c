"""Peaks that keep a distance, by maps of blocks that are composed along a series.

Which peaks of a block stay depends on the peaks kept just outside it: at most one within the distance before the block
and one behind it.  A block is therefore a map from the peak kept before and the peak kept behind it to its own first and
last ones, and two neighbouring blocks compose to one such map.  As a peak depends on higher ones alone, exactly one state
of a border fits the blocks on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.operators.ordered import null_safe_join
from kymora.session import cut_lineage

#: Places of a block, in distances.
SPACED = 4096
#: Blocks whose maps one task composes.
CHAIN = 1024


class Block:
    """Peaks of a block and those within ``distance`` outside of it."""

    def __init__(self, place, height, number: int, width: int, distance: int):
        self.p, self.h, self.d = np.asarray(place, np.int64), np.asarray(height, float), distance
        low, high = number * width, (number + 1) * width
        own = np.flatnonzero((self.p >= low) & (self.p < high))
        self.own = range(int(own[0]), int(own[-1]) + 1)
        # the states of both borders: none, or one of the peaks on either side
        self.before = [-1, *range(self.own.start)]
        self.behind = [-1, *range(self.own.stop, len(self.p))]
        self.first = [-1, *(i for i in self.own if self.p[i] < low + distance - 1)]
        self.last = [-1, *(i for i in self.own if self.p[i] > high - distance)]
        near = np.searchsorted(self.p, self.p - distance, "right"), np.searchsorted(self.p, self.p + distance, "left")
        order = np.lexsort((-self.p, -self.h))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank.tolist()
        self.order = [i for i in order.tolist() if i in self.own]
        self.higher = {i: [q for q in range(int(near[0][i]), int(near[1][i])) if rank[q] < rank[i]] for i in self.order}
        self._settle_known()

    def _settle_known(self) -> None:
        """What is certain whatever is kept outside: 1 stays, -1 goes, 0 open; ``needs``: sides an open peak depends on."""
        state = [0] * len(self.p)
        needs = [1] * self.own.start + [0] * len(self.own) + [2] * (len(self.p) - self.own.stop)
        self.open = []
        for i in self.order:
            around = [state[q] for q in self.higher[i]]
            if 1 in around:
                state[i] = -1
            elif 0 in around:
                for q in self.higher[i]:
                    if state[q] == 0:
                        needs[i] |= needs[q]
                self.open.append(i)
            else:
                state[i] = 1
        self.state = state
        self.sides = 0
        for i in self.open:
            self.sides |= needs[i]

    def settled(self, before: int, behind: int) -> list[int]:
        """States, with the peaks kept outside (-1: none)."""
        state = self.state.copy()
        for i in (*range(self.own.start), *range(self.own.stop, len(self.p))):
            state[i] = -1
        for i in (before, behind):
            if i >= 0:
                state[i] = 1
        for i in self.open:
            state[i] = -1 if any(state[q] == 1 for q in self.higher[i]) else 1
        return state

    def map(self) -> tuple[np.ndarray, np.ndarray]:
        """For each state before and behind, the states of the block's own first and last peaks."""
        first, last = (np.zeros((len(self.before), len(self.behind)), np.int64) for _ in range(2))
        for a, before in enumerate(self.before if self.sides & 1 else [-1]):
            for b, behind in enumerate(self.behind if self.sides & 2 else [-1]):
                state = self.settled(before, behind)
                rows = slice(None) if not self.sides & 1 else a
                columns = slice(None) if not self.sides & 2 else b
                first[rows, columns] = next((k for k, i in enumerate(self.first) if i >= 0 and state[i] == 1), 0)
                last[rows, columns] = next((k for k, i in enumerate(self.last) if i >= 0 and state[i] == 1), 0)
        return first, last


Map = tuple[np.ndarray, np.ndarray]


def compose(left: Map, right: Map, touching: bool) -> Map:
    """The map of two parts: at the border the last peak kept on the left and the first on the right must agree.

    Where a block without peaks lies between, nothing is kept next to either part.
    """
    if not touching:
        left, right = (left[0][:, :1], left[1][:, :1]), (right[0][:1], right[1][:1])
        return np.broadcast_to(left[0], (left[0].shape[0], right[0].shape[1])), np.broadcast_to(right[1], (left[0].shape[0], right[0].shape[1]))
    # x: last kept on the left, y: first kept on the right, for each y that the left may meet
    x = left[1][:, :, None]
    fits = right[0][x, np.arange(right[0].shape[1])] == np.arange(left[1].shape[1])[None, :, None]
    y = fits.argmax(axis=1)
    a, b = np.arange(left[0].shape[0])[:, None], np.arange(right[0].shape[1])[None, :]
    return left[0][a, y], right[1][left[1][a, y], b]


def _read(first: bytes, last: bytes, shape) -> Map:
    return tuple(np.frombuffer(z, np.int64).reshape(tuple(shape)) for z in (first, last))


def borders(numbers: list[int], maps: list[Map], before: int, behind: int, stops: list[int] | None = None) -> list[tuple[int, int]]:
    """State before and behind each part of a chain, whose outer states are known.

    ``stops``: number of each part's last block (its own number if a part is one block).
    """
    stops = stops or numbers
    touching = [b == a + 1 for a, b in zip(stops, numbers[1:])]
    ahead: list[np.ndarray] = []
    for k, (first, last) in enumerate(maps):
        if not k:
            ahead.append(last[before])
        elif not touching[k - 1]:
            ahead.append(last[0])
        else:
            x = ahead[-1]
            y = (first[x] == np.arange(len(x))[:, None]).argmax(axis=0)
            ahead.append(last[x[y], np.arange(last.shape[1])])
    out: list[tuple[int, int]] = [(0, 0)] * len(maps)
    for k in range(len(maps) - 1, -1, -1):
        first, _ = maps[k]
        if not k:
            out[k] = (before, behind)
        elif not touching[k - 1]:
            out[k] = (0, behind)
            behind = 0
        else:
            x = ahead[k - 1]
            y = int((first[x, behind] == np.arange(len(x))).argmax())
            out[k] = (int(x[y]), behind)
            behind = y
    return out


_MAP = "struct<first: binary, last: binary, shape: array<int>>"


def spaced_peaks(peaks: DataFrame, keys: Sequence[str], index: str, distance: int, block: int = SPACED, chain: int = CHAIN) -> DataFrame:
    """Keep the highest peaks (keys, index, height) such that none lies nearer than ``distance`` to a kept one; of equal ones the later.

    Blocks of ``block`` distances are mapped apart; chains of blocks are composed, then the chains of a series, whose outer
    borders are free.  States go back from the chains to their blocks, which are settled at last.  The number of steps does
    not depend on the length of a rising stretch.
    """
    distance = max(1, distance)
    width = block * distance
    i = F.col(index).cast("long")
    home = F.floor(i / width)
    near = F.array_distinct(F.array(home, F.floor((i - (distance - 1)) / width), F.floor((i + (distance - 1)) / width)))
    row = F.struct(i.alias("i"), F.col("height").cast("double").alias("h"), (home == F.col("__b")).alias("own"))
    dealt = peaks.select(*keys, index, "height").withColumn("__b", F.explode(near)).groupBy(*keys, "__b").agg(F.array_sort(F.collect_list(row)).alias("__r"))
    dealt = dealt.filter(F.exists("__r", lambda r: r["own"]))

    @F.pandas_udf(_MAP)
    def mapped(place: pd.Series, height: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, b in zip(place, height, number):
            first, last = Block(p, h, int(b), width, distance).map()
            out.append((first.tobytes(), last.tobytes(), list(first.shape)))
        return pd.DataFrame(out, columns=["first", "last", "shape"])

    @F.pandas_udf("struct<low: long, high: long, first: binary, last: binary, shape: array<int>>")
    def chained(number: pd.Series, first: pd.Series, last: pd.Series, shape: pd.Series) -> pd.DataFrame:
        out = []
        for numbers, *parts in zip(number, first, last, shape):
            maps = [_read(*p) for p in zip(*parts)]
            whole = maps[0]
            for k, m in enumerate(maps[1:]):
                whole = compose(whole, m, numbers[k + 1] == numbers[k] + 1)
            out.append((numbers[0], numbers[-1], whole[0].tobytes(), whole[1].tobytes(), list(whole[0].shape)))
        return pd.DataFrame(out, columns=["low", "high", "first", "last", "shape"])

    @F.pandas_udf("array<struct<before: int, behind: int>>")
    def stated(low: pd.Series, high: pd.Series, first: pd.Series, last: pd.Series, shape: pd.Series, before: pd.Series, behind: pd.Series) -> pd.Series:
        out = []
        for lows, highs, f, z, s, a, b in zip(low, high, first, last, shape, before, behind):
            states = borders(list(lows), [_read(*p) for p in zip(f, z, s)], int(a), int(b), list(highs))
            out.append([{"before": x, "behind": y} for x, y in states])
        return pd.Series(out)

    @F.pandas_udf("array<boolean>")
    def kept(place: pd.Series, height: pd.Series, number: pd.Series, before: pd.Series, behind: pd.Series) -> pd.Series:
        out = []
        for p, h, n, a, b in zip(place, height, number, before, behind):
            part = Block(p, h, int(n), width, distance)
            state = part.settled(part.before[a], part.behind[b])
            out.append([s == 1 and k in part.own for k, s in enumerate(state)])
        return pd.Series(out)

    def part(source: str, *path: str):
        def pick(r):
            for name in path:
                r = r[name]
            return r

        return F.transform(source, pick)

    blocks = cut_lineage(dealt.select(*keys, "__b", "__r", mapped(part("__r", "i"), part("__r", "h"), F.col("__b")).alias("__m")))
    lines = blocks.groupBy(*keys, F.floor(F.col("__b") / chain).alias("__g")).agg(F.array_sort(F.collect_list(F.struct("__b", "__m"))).alias("__l"))
    shapes = [part("__l", "__m", c) for c in ("first", "last", "shape")]
    whole = lines.select(*keys, "__g", chained(part("__l", "__b"), *shapes).alias("__w"))
    series = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__g", "__w"))).alias("__l"))
    ends = stated(part("__l", "__w", "low"), part("__l", "__w", "high"), *[part("__l", "__w", c) for c in ("first", "last", "shape")], F.lit(0), F.lit(0))
    outer = series.select(*keys, F.inline(F.arrays_zip(part("__l", "__g").alias("__g"), ends.alias("__s"))))
    lines = null_safe_join(lines, outer, [*keys, "__g"], "inner")
    inner = stated(part("__l", "__b"), part("__l", "__b"), *shapes, F.col("__s.before"), F.col("__s.behind"))
    states = lines.select(*keys, F.inline(F.arrays_zip(part("__l", "__b").alias("__b"), inner.alias("__s"))))
    done = null_safe_join(blocks.select(*keys, "__b", "__r"), states, [*keys, "__b"], "inner")
    flags = kept(part("__r", "i"), part("__r", "h"), F.col("__b"), F.col("__s.before"), F.col("__s.behind"))
    rows = done.select(*keys, F.inline(F.arrays_zip(F.col("__r"), flags.alias("__k")))).filter("__k")
    return rows.select(*keys, F.col("__r.i").alias(index), F.col("__r.h").alias("height"))
