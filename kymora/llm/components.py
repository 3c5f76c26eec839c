"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import local_components, stored

#: Edges that one task contracts.
PART_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Node and component (the smallest node of it) for each node of ``edges`` (columns a and b, one orderable type).

    Edges with a null end and loops are left out, so a node with loops only has no row. In a round every
    node hands its larger neighbours to its smallest one, then its smaller neighbours to the smallest;
    rounds go on until nothing changes. Minima combine before they are shuffled, and are a table in
    the shared folder before they are joined, so a hub's edges are split by the planner's skew handling.
    """
    clean = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stored(clean.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = _state(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(below, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = stored(moved.union(below.select("hi", F.col("m").alias("lo"))).distinct())
        last, state = state, _state(now)
        if state == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def contracted_components(edges: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """As ``components``, with fewer rounds: each task first replaces its share of the edges by one star for each
    component of them. Shares have about ``part_edges`` edges; where there is one, its stars are the
    components, else rounds over the stars join those of all shares.
    """
    kind = dict(edges.dtypes)["a"]
    known = stored(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b"))
    shares = -(-known.count() // part_edges)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks()
            names = both.unique()
            names = names.take(pc.sort_indices(names))
            at = pc.index_in(both, names).to_numpy(zero_copy_only=False)
            label = local_components(len(names), at[: table.num_rows], at[table.num_rows :])
            child = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(label[child]))], names=["a", "b"])

    dealt = known.repartition(1) if shares <= 1 else known.repartition(shares, F.least("a", "b"))
    stars = stored(dealt.mapInArrow(contract, f"a {kind}, b {kind}"))
    if shares > 1:
        return components(stars)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
