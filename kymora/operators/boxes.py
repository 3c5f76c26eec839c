"""Suppression of boxes inside places: pairs come from cells held in numpy, so no pair is stored or shuffled as a row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kymora.operators.graph import SETTLED, settle

#: Boxes that a task takes up at once, and cells or pairs that it looks at together.
STEP_BOXES = 200_000
STEP_PAIRS = 2_000_000
#: Boxes that are not dealt further, however many boxes are near them.
STEP_ALONE = 500

#: What a row is in its place: a copy from elsewhere, a box of this place, one that also went elsewhere, one that an equal box beats.
COPY, OWN, SHARED, BEATEN = range(4)
CORNERS = ["x0", "y0", "x1", "y1"]


def _order(first: list[np.ndarray], score: np.ndarray, box_id: pa.Array, node: np.ndarray) -> np.ndarray:
    """Rows by ``first``, then the best score, the smallest id, the first row."""
    ids = pc.rank(box_id, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
    return np.lexsort((node, ids, -score, ~np.isnan(score), *first))


def _later_equal(places: list[np.ndarray], corners: list[np.ndarray], score: np.ndarray, box_id: pa.Array, node: np.ndarray) -> np.ndarray:
    """Whether an equal box of the same place comes before."""
    # 0.0 and -0.0 are equal
    _, at, many = np.unique(_mixed(*places, *((c + 0.0).view(np.int64) for c in corners)), return_inverse=True, return_counts=True)
    some, later = np.flatnonzero(many[at] > 1), np.zeros(len(node), bool)
    keys = [k[some] for k in (*places, *corners)]
    order = _order(keys, score[some], box_id.take(pa.array(some)), node[some])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    later[some[order[1:][same]]] = True
    return later


def beaten_in_batch(g1: pa.Array, g2: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, score: pa.Array, box_id: pa.Array, node: pa.Array) -> pa.Array:
    """Whether a better one among equal boxes stands in the same batch, so that many equal boxes do not travel to one place."""
    corners = [c.to_numpy(zero_copy_only=False) for c in (x0, y0, x1, y1)]
    return pa.array(_later_equal([g1.to_numpy(), g2.to_numpy()], corners, score.to_numpy(), box_id, node.to_numpy()))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    code = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        code = (code ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts, the item of each unit and the unit's number in its item."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _cuts(n: np.ndarray, most: int) -> list[int]:
    """Where to cut items so that a part has ``most`` units, or one item."""
    total, cuts = np.cumsum(n), [0]
    while cuts[-1] < len(n):
        before = total[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(int(np.searchsorted(total, before + most, "right")), cuts[-1] + 1))
    return cuts


class _Step:
    """Boxes of some places that are held together; ``last`` says that no more rows of the last place follow."""

    def __init__(self, rows: pa.Table, threshold: float, last: bool):
        self.rows, self.t, self.base = rows, threshold, 1.0 / threshold
        number = {c: rows.column(c).to_numpy() for c in ("p1", "p2", "kind", "node", "score", "state", *CORNERS)}
        self.block, self.kind, self.node, self.state = number["p1"], number["kind"].copy(), number["node"], number["state"].copy()
        self.x0, self.y0, self.x1, self.y1 = (number[c] for c in CORNERS)
        self.h, self.w = self.y1 - self.y0, self.x1 - self.x0
        self.cy, self.cx = (self.y0 + self.y1) / 2, (self.x0 + self.x1) / 2
        self.level = np.floor(np.log(np.maximum(self.h, self.w)) / math.log(self.base)).astype(np.int64)
        p1, p2 = number["p1"], number["p2"]
        self.place = np.concatenate([[0], np.cumsum((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))])
        ids = rows.column("id").combine_chunks()
        beaten = (self.kind == BEATEN) | _later_equal([self.place], [number[c] for c in CORNERS], number["score"], ids, self.node)
        order = _order([], number["score"], ids, self.node)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        mine = (self.kind == OWN) | (self.kind == SHARED)
        # all boxes that a box can meet are read once the way to them is passed
        way = self.h * ((1 - self.t) if self.t >= 0.5 else (self.base - 1) / 2) * 1.000001
        here, end = self.place == self.place[-1], self.cy[-1]
        ready = mine & ~beaten & (last | ~here | (self.cy + way < end))
        waits = mine & ~beaten & ~ready
        self.state[beaten] = 0
        self.told = ready | (beaten & (mine | (self.kind == BEATEN)))
        self.alive = np.flatnonzero(~beaten)
        self.todo = order[ready[order]]
        first = (self.cy - way)[waits].min(initial=end)
        self.carried = np.flatnonzero(~beaten & here & (waits | (self.cy + way >= end) | (self.cy >= first))) if not last else np.zeros(0, np.int64)
        self.waits = waits

    def side(self, level: np.ndarray) -> np.ndarray:
        return 2 * max(1 - self.t, 0.5) * self.base ** (level + 1.0)

    def cells(self, box: np.ndarray, levels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For a level beside that of each box: which boxes look at it, the level, and the first cell and the number of cells by y and x."""
        for step in (-1, 0, 1):
            at = np.flatnonzero(np.isin(self.level[box] + step, levels))
            level, some = self.level[box[at]] + step, box[at]
            side, most, spans = self.side(level), self.base ** (level + 1.0), []
            for centre, size in ((self.cy, self.h), (self.cx, self.w)):
                reach = 1.000001 * reach_of(size[some], most, self.t, np.minimum, np.where)
                low = np.floor((centre[some] - reach) / side).astype(np.int64)
                spans.append((low, np.floor((centre[some] + reach) / side).astype(np.int64) - low + 1))
            yield at, level, spans

    def open_conditions(self, box: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Settle ``box``, sorted by priority; loser, winner, flip and alone of what stays open.

        Where many boxes are near each other, the best are settled first, and the rest meet only those that may stay.
        """
        beside = self.alive[(self.state[self.alive] != 0) & (self.rank[self.alive] <= self.rank[box[-1]])]
        side = self.side(self.level[beside])
        code = _mixed(self.place[beside], self.level[beside], np.floor(self.cy[beside] / side), np.floor(self.cx[beside] / side))
        order = np.argsort(code, kind="stable")
        cell, start, many = np.unique(code[order], return_index=True, return_counts=True)
        levels, beside = np.unique(self.level[beside]), beside[order]
        looks = np.zeros(len(box), np.int64)
        for at, _, ((_, ny), (_, nx)) in self.cells(box, levels):
            looks[at] += ny * nx
        cuts, met, found_in = _cuts(looks, STEP_PAIRS), np.zeros(len(box)), []
        for lo, hi in zip(cuts, cuts[1:]):
            who, seen = [], []
            for at, level, ((y, ny), (x, nx)) in self.cells(box[lo:hi], levels):
                k, u = _spread(ny * nx)
                who.append(lo + at[k])
                seen.append(_mixed(self.place[box[lo + at]][k], level[k], y[k] + u // nx[k], x[k] + u % nx[k]))
            who, seen = np.concatenate(who), np.concatenate(seen)
            found = np.minimum(np.searchsorted(cell, seen), len(cell) - 1)
            hit = np.flatnonzero(cell[found] == seen)
            hit = hit[np.argsort(who[hit], kind="stable")]
            met += np.bincount(who[hit], weights=many[found[hit]], minlength=len(box))
            found_in.append((who[hit], found[hit]))
        pairs = int(met.sum())
        if pairs > STEP_PAIRS and len(box) > STEP_ALONE:
            for part in np.array_split(box, min(len(box), 16, 1 + pairs // STEP_PAIRS)):
                yield from self.open_conditions(part)
            return
        who, found = (np.concatenate(c) for c in zip(*found_in, strict=True))
        cuts = _cuts(met.astype(np.int64), STEP_PAIRS)
        for lo, hi in zip(cuts, cuts[1:]):
            f, t = np.searchsorted(who, [lo, hi])
            k, u = _spread(many[found[f:t]])
            yield self.settled(box[lo:hi], box[who[f:t][k]], beside[start[found[f:t][k]] + u])

    def settled(self, box: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Settle ``box`` as far as its pairs of ``a`` and a better ``b`` allow, and say what stays open."""
        better = (self.rank[b] < self.rank[a]) & (self.place[b] == self.place[a]) & (self.state[b] != 0)
        a, b = a[better], b[better]
        iw = np.maximum(np.minimum(self.x1[a], self.x1[b]) - np.maximum(self.x0[a], self.x0[b]), 0.0)
        ih = np.maximum(np.minimum(self.y1[a], self.y1[b]) - np.maximum(self.y0[a], self.y0[b]), 0.0)
        met = iw * ih > self.t * (self.w[a] * self.h[a] + self.w[b] * self.h[b] - iw * ih)
        a, b = a[met], b[met]
        before = math.inf
        while True:
            beset = np.zeros(len(self.state), bool)
            beset[a] = True
            self.state[box[~beset[box] & (self.state[box] < 0)]] = 1
            if len(a) > 0.75 * before or not len(a):
                break
            # as long as it takes away many pairs: who loses to a box that stays goes, and who goes beats nobody
            before = len(a)
            self.state[a[self.state[b] == 1]] = 0
            open_ = (self.state[a] < 0) & (self.state[b] != 0)
            a, b = a[open_], b[open_]
        if not len(a):
            return [a, b, np.zeros(0, np.int32), np.zeros(0, bool)]
        step = settle(self.block[a], a, b, np.zeros(len(a), np.int64), self.state[b].astype(np.int64))
        known = step.column("known").fill_null(-1).to_numpy()
        node, done = step.column("node").to_numpy(), known >= 0
        self.state[node[done]] = known[done]
        left = pa.table(step).filter(~done)
        return [node[~done], *(left.column(c).to_numpy() for c in ("winner", "flip", "alone"))]

    def result(self) -> pa.RecordBatch:
        with np.errstate(all="ignore"):
            opened = list(self.open_conditions(self.todo)) if len(self.todo) else []
        loser, winner, flip, alone = (np.concatenate(c) for c in zip(*opened, [np.zeros(0, kind) for kind in (np.int64, np.int64, np.int32, bool)], strict=True))
        # who stays and went nowhere else need not be told
        tell = np.flatnonzero(self.told & ((self.state == 0) | ((self.state == 1) & (self.kind == SHARED))))
        none = pa.nulls(len(tell), pa.int64())
        columns = [
            [pa.array(self.block[tell]), pa.array(self.node[tell]), pa.array(self.state[tell], pa.int32()), none, none.cast(pa.int32()), none.cast(pa.bool_())],
            [pa.array(self.block[loser]), pa.array(self.node[loser]), pa.nulls(len(loser), pa.int32()), pa.array(self.node[winner]), pa.array(flip, pa.int32()), pa.array(alone, pa.bool_())],
        ]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*columns, strict=True)], schema=SETTLED)

    def rest(self) -> pa.Table:
        """Rows that later ones of the last place can meet; those settled here come as copies, with what is known of them."""
        carried = self.carried[self.state[self.carried] != 0]
        kind = np.where(self.waits, SHARED, COPY)[carried]
        rows = self.rows.take(pa.array(carried))
        for c, values in (("kind", pa.array(kind, pa.int8())), ("state", pa.array(self.state[carried], pa.int8()))):
            k = rows.schema.get_field_index(c)
            rows = rows.set_column(k, rows.schema.field(k), values)
        return rows


def reach_of(size, most, threshold: float, least: Callable, where: Callable):
    """How far the centre of a box of a side up to ``most`` can lie from that of one of side ``size`` (columns or arrays)."""
    if threshold >= 0.5:
        return (1 - threshold) * least(size, most)
    return where(most >= size, size / 2 + (0.5 - threshold) * most, most / 2 + (0.5 - threshold) * size)


def suppressed(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Settle boxes that come sorted by place and the centre's y.

    A task holds the boxes that can meet those not read yet, so its memory depends on how dense a place is, not on how many
    boxes it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, fresh = [], 0, 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).append_column("state", pa.array(np.full(batch.num_rows, -1), pa.int8())))
            fresh += batch.num_rows
            if fresh >= max(STEP_BOXES, kept):
                step = _Step(pa.concat_tables(held), threshold, False)
                yield step.result()
                held, fresh = [step.rest()], 0
                kept = held[0].num_rows
        if kept + fresh:
            yield _Step(pa.concat_tables(held), threshold, True).result()

    return run
