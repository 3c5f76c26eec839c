"""Pixel sets as 8 x 8 boards of one 64-bit word each: pixel (y, x) is bit 8 * (y % 8) + x % 8 of board (y // 8, x // 8).

Arrays hold the boards, or the pixels, of many masks end to end; ``group`` is the place of the mask, from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Boards that are worked on together; a mask is never split.
STEP_BOARDS = 1 << 15

_FIRST_COLUMN, _OTHER_COLUMNS = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE, _SEVEN, _ROW, _ROWS, _FULL = (np.uint64(v) for v in (1, 7, 8, 56, 0xFF))

Boards = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Pixels = tuple[np.ndarray, np.ndarray, np.ndarray]


def mask_steps(batches: Iterator[pa.RecordBatch], column: str, margin: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[Boards]]]:
    """Masks, as many at a time as have STEP_BOARDS boards (one at least), with the boards of each set: group, ty, tx, word.

    ``column`` lists structs of ty, tx and a word for each set; boards without a place or with a negative one are left out, empty ones too.
    ``margin`` names a column with the distance that is looked at around pixels.
    """
    for batch in batches:
        boards = batch.column(column)
        first = np.concatenate([[0], np.cumsum(boards.value_lengths().to_numpy())])
        ty, tx, *words = (v.fill_null(-1 if k < 2 else 0).to_numpy() for k, v in enumerate(boards.flatten().flatten()))
        reach = 0 if margin is None else max(0, max(batch.column(margin).to_pylist(), default=0))
        # codes of pixels, one number each for all masks of a step, stay below 2^62
        extent = (8 * int(ty.max(initial=0)) + 9 + 2 * reach) * (8 * int(tx.max(initial=0)) + 9 + 2 * reach)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(first, first[lo] + STEP_BOARDS, "right")) - 1
            hi = max(lo + 1, min(hi, lo + (1 << 62) // extent, batch.num_rows))
            part = slice(first[lo], first[hi])
            group = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
            sets = []
            for word in words:
                some = (ty[part] >= 0) & (tx[part] >= 0) & (word[part] != 0)
                sets.append((group[some], ty[part][some], tx[part][some], word[part][some].view(np.uint64)))
            yield batch.slice(lo, hi - lo), sets
            lo = hi


def edges(boards: Boards, height: np.ndarray, width: np.ndarray) -> Boards:
    """Boards of the pixels whose east, south or south-east neighbour differs; in the last row only the east one counts, in the last column the south one."""
    group, ty, tx, word = boards
    if not len(group):
        return boards
    high, wide = int(ty.max()) + 2, int(tx.max()) + 2
    code, own = np.unique((group * high + ty) * wide + tx, return_index=True)
    word = word[own]
    # a board also decides on the ones west, north and north-west of it
    at = np.unique(np.concatenate([((group * high + ty - dy) * wide + tx - dx)[(ty >= dy) & (tx >= dx)] for dy in (0, 1) for dx in (0, 1)]))

    def board(dy: int, dx: int) -> np.ndarray:
        want = at + dy * wide + dx
        place = np.minimum(np.searchsorted(code, want), len(code) - 1)
        return np.where(code[place] == want, word[place], np.uint64(0))

    def east(mine: np.ndarray, next_one: np.ndarray) -> np.ndarray:
        return ((mine >> _ONE) & _OTHER_COLUMNS) | ((next_one & _FIRST_COLUMN) << _SEVEN)

    c, below = board(0, 0), board(1, 0)
    e, e_below = east(c, board(0, 1)), east(below, board(1, 1))
    s, d = (c >> _ROW) | (below << _ROWS), (e >> _ROW) | (e_below << _ROWS)
    group, ty, tx = at // (high * wide), at // wide % high, at % wide
    row, column = height[group] - 1 - 8 * ty, width[group] - 1 - 8 * tx
    bottom = np.where((row >= 0) & (row < 8), _FULL << (8 * np.clip(row, 0, 7)).astype(np.uint64), np.uint64(0))
    right = np.where((column >= 0) & (column < 8), _FIRST_COLUMN << np.clip(column, 0, 7).astype(np.uint64), np.uint64(0))
    edge = (((c ^ e) | (c ^ s) | (c ^ d)) & ~bottom & ~right) | ((c ^ e) & bottom & ~right) | ((c ^ s) & right & ~bottom)
    some = edge != 0
    return group[some], ty[some], tx[some], edge[some]


def pixels(boards: Boards) -> Pixels:
    group, ty, tx, word = boards
    board, bit = np.nonzero(np.unpackbits(word.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return group[board], 8 * ty[board] + (bit >> 3), 8 * tx[board] + (bit & 7)


def near(mine: Pixels, theirs: Pixels, radius: np.ndarray) -> np.ndarray:
    """For each of my pixels, whether their part of its mask has one at most the mask's radius away."""
    (group, y, x), (other, oy, ox) = mine, theirs
    out = np.zeros(len(group), bool)
    if not len(group) or not len(other):
        return out
    most = max(0, int(radius.max()))
    high, wide = int(max(y.max(), oy.max())) + 2 * most + 1, int(max(x.max(), ox.max())) + 2 * most + 1
    taken = np.sort((other * high + oy + most) * wide + ox + most)
    own = (group * high + y + most) * wide + x + most
    for dy in range(-most, most + 1):
        left = np.flatnonzero(~out & (radius[group] >= abs(dy)))
        side = np.floor(np.sqrt(radius[group[left]] ** 2 - dy * dy)).astype(np.int64)
        row = own[left] + dy * wide
        out[left] = np.searchsorted(taken, row + side, "right") > np.searchsorted(taken, row - side, "left")
    return out
