"""Graph steps on edge tables: connected components and greedy selection by priority."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.session import cut_lineage


#: Edges that a task contracts at once.
PART_EDGES = 1_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One star for each component of the edges: its other nodes and its smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[low], root[high])
        moved = root.copy()
        # hook the roots of both ends to the smaller one, then halve the ways
        np.minimum.at(moved, root[low], least)
        np.minimum.at(moved, root[high], least)
        moved = moved[moved]
        if (moved == root).all():
            break
        root = moved
    leaf = np.flatnonzero(root != np.arange(len(ids)))
    return ids[leaf], ids[root[leaf]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def star() -> pa.RecordBatch:
        hi, lo = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= PART_EDGES:
            yield star()
            held = []
    if held:
        yield star()


def numbered_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all but the smallest; ``edges`` has long ends ``a`` and ``b``.

    Tasks first contract their share of the edges to stars.  Then, in a round, every node ties its larger neighbours to
    the smallest one (large star), then its smaller ones (small star); rounds go on until nothing changes, with about the
    square of the logarithm of the longest path between shares as their number.  Rounds are stored, so a lost executor does
    not replay them.
    """
    ends = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now, mark = cut_lineage(ends.repartition("lo").mapInArrow(_contracted, "hi long, lo long").distinct()), None
    while True:
        last, mark = mark, now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
        if mark == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(below, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = cut_lineage(moved.union(below.select("hi", F.col("m").alias("lo"))).distinct())


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node in the component of each node.

    ``nodes`` has ``node`` (of any orderable type), ``edges`` has ``a`` and ``b``.  Nodes are numbered, so that steps work on
    whole numbers; the label is the smallest node itself.
    """
    ids = cut_lineage(nodes.select("node").distinct().withColumn("id", F.monotonically_increasing_id()))
    named = [ids.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab"]
    linked = edges.select("a", "b").join(named[0], "a").join(named[1], "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    roots = numbered_components(linked).withColumnRenamed("node", "id")
    found = ids.join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    label = found.groupBy("root").agg(F.min("node").alias("label"))
    return found.join(label, "root").select("node", "label")


#: Conditions that are settled together in one step of a task.
STEP_ROWS = 500_000
SETTLED = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("known", pa.int32()), ("winner", pa.int64()), ("flip", pa.int32()), ("alone", pa.bool_())])


def settle(block: np.ndarray, loser: np.ndarray, winner: np.ndarray, flip: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Settle losers as far as their conditions allow.

    A loser stays if none of its conditions holds; a condition holds if its winner stays (with ``flip`` if it goes).  Where
    one open condition is left, the loser is the winner's opposite, and those who depend on it are tied to the winner.
    """
    ids, at = np.unique(np.concatenate([loser, winner]), return_inverse=True)
    home = np.zeros(len(ids), np.int64)
    low, high = at[: len(loser)], at[len(loser) :]
    home[low] = block
    state = np.full(len(ids), -1)
    state[high[known >= 0]] = known[known >= 0]
    own = np.unique(low)
    tied, opposite = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    moved = True
    while moved:
        holds = np.where(state[high] >= 0, state[high] ^ flip, -1)
        # a winner that stays and goes: one of the two conditions holds
        pairs = np.unique(np.stack([low, high, flip]), axis=1)
        twice = np.flatnonzero((pairs[0, 1:] == pairs[0, :-1]) & (pairs[1, 1:] == pairs[1, :-1]))
        out = np.zeros(len(ids), bool)
        out[low[holds == 1]] = True
        out[pairs[0, twice]] = True
        waits = np.bincount(low[holds < 0], minlength=len(ids))
        fresh = own[(state[own] < 0) & (out[own] | (waits[own] == 0))]
        state[fresh] = ~out[fresh]
        keep = (holds < 0) & (state[low] < 0)
        low, high, flip = np.unique(np.stack([low[keep], high[keep], flip[keep]]), axis=1)
        alone = np.bincount(low, minlength=len(ids))[low] == 1
        tied[low[alone]], opposite[low[alone]] = high[alone], flip[alone] ^ 1
        next_ = tied[high]
        moved = bool(len(fresh)) or bool((next_ != high).any())
        flip, high = np.where(next_ != high, flip ^ opposite[high], flip), next_
    done = own[state[own] >= 0]
    alone = np.bincount(low, minlength=len(ids))[low] == 1
    none = pa.nulls(len(done), pa.int64())
    columns = [
        [pa.array(home[done]), pa.array(ids[done]), pa.array(state[done], pa.int32()), none, none.cast(pa.int32()), none.cast(pa.bool_())],
        [pa.array(home[low]), pa.array(ids[low]), pa.nulls(len(low), pa.int32()), pa.array(ids[high]), pa.array(flip, pa.int32()), pa.array(alone)],
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*columns, strict=True)], schema=SETTLED)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle a task's conditions in steps, each of whole losers; the rows come sorted by block and loser."""
    held: list[pa.RecordBatch] = []

    def whole(rows: pa.Table) -> pa.RecordBatch:
        known = rows.column("known").fill_null(-1).to_numpy()
        return settle(*(rows.column(c).to_numpy() for c in ("block", "loser", "winner")), rows.column("flip").to_numpy().astype(np.int64), known.astype(np.int64))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= STEP_ROWS:
            rows = pa.Table.from_batches(held)
            last = rows.column("loser")[-1].as_py()
            cut = int(np.flatnonzero(rows.column("loser").to_numpy() != last)[-1]) + 1 if rows.column("loser")[0].as_py() != last else 0
            if cut:
                yield whole(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        yield whole(pa.Table.from_batches(held))


def greedy_select(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows a greedy pass in priority order would keep.

    ``nodes`` has a ``node`` (long), ``edges`` (``winner``, ``loser``, and ``block``, a place of the loser; a hash if there is
    none) says that the loser goes if the winner stays.  A round settles blocks near each other in one task.  What still
    depends on one node of another block becomes that node or its opposite, and ties are followed from round to round, so a
    chain of blocks is settled in as many rounds as the logarithm of its length.  Where nodes wait for several others, a
    round takes a block.  Rounds go on until nothing is open.
    """
    block = F.col("block") if "block" in edges.columns else F.pmod(F.xxhash64("loser"), F.lit(1024))
    named = cut_lineage(edges.select("winner", "loser", block.cast("long").alias("block")).distinct())
    losers = named.select(F.col("loser").alias("winner"), F.lit(True).alias("open")).distinct()
    now = named.join(losers, "winner", "left").select("block", "loser", "winner", F.lit(0).alias("flip"), F.when(F.col("open").isNull(), F.lit(1)).alias("known"))
    return nodes.join(gone_after(_round(now)), "node", "left_anti")


def _round(now: DataFrame) -> DataFrame:
    dealt = now.select("block", "loser", "winner", "flip", "known").repartition("block").sortWithinPartitions("block", "loser")
    return cut_lineage(dealt.mapInArrow(_settled, "block long, node long, known int, winner long, flip int, alone boolean"))


def gone_after(step: DataFrame) -> DataFrame:
    """Nodes that go, from a stored first round: what is known of nodes, and the conditions that stay open."""
    gone = []
    while True:
        gone.append(step.filter("known = 0").select("node"))
        open_ = step.filter("known IS NULL")
        if open_.isEmpty():
            return reduce(DataFrame.unionAll, gone)
        decided = step.filter("known IS NOT NULL").select(F.col("node").alias("winner"), "known")
        ties = open_.filter("alone").drop("known").join(decided, "winner", "left").select(F.col("node").alias("winner"), F.col("known").bitwiseXOR(F.col("flip")).bitwiseXOR(F.lit(1)).alias("known"), F.col("winner").alias("root"), F.col("flip").bitwiseXOR(F.lit(1)).alias("turn"))
        facts = decided.select("winner", "known", F.lit(None).cast("long").alias("root"), F.lit(None).cast("int").alias("turn")).unionAll(ties)
        joined = open_.drop("known", "alone").withColumnRenamed("node", "loser").join(facts, "winner", "left")
        follow = F.col("root").isNotNull() & F.col("known").isNull()
        now = joined.select("block", "loser", F.when(follow, F.col("root")).otherwise(F.col("winner")).alias("winner"), F.when(follow, F.col("flip").bitwiseXOR(F.col("turn"))).otherwise(F.col("flip")).alias("flip"), "known")
        step = _round(now)
