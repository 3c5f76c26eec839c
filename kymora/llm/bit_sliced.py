"""Exact top-k by inner product over a bit-sliced index: bitmap sums, then selection from the highest slice down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.llm.common import stored

#: Rows of an index block, and queries that meet a copy of a block; fewer, but MIN_CHUNK at least, where tasks would be idle.
BLOCK, CHUNK, MIN_CHUNK = 50_000, 10_000, 128
#: Quantised components from which on a vector is an error.
LIMIT = 1 << 62


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and whole components floor(scale * x), x as double, of the vectors that take part, with a number for each row."""
    wide = F.raise_error(F.lit("a component is too large for scores of 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) >= LIMIT, wide).otherwise(F.floor(x.cast("double") * scale))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.transform("embedding", whole).cast("array<long>").alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of the list column, short ones filled up with zeros."""
    rows = column.combine_chunks()
    n = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), np.int64)
    first = np.cumsum(n) - n
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(first, n)] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


def sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of x - least, by component and then by bit; least and number of bits of each component.

    Row r of the matrix is bit r % 64 of word r // 64.
    """
    least = x.min(axis=0)
    over = (x - least).astype(np.uint64)
    width = np.array([int(m).bit_length() for m in over.max(axis=0)], np.int64)
    words = -(-len(x) // 64)
    maps = np.zeros((int(width.sum()), words * 8), np.uint8)
    row = 0
    for d, w in enumerate(width.tolist()):
        for b in range(w):
            packed = np.packbits(((over[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            maps[row, : len(packed)] = packed
            row += 1
    return maps.view(np.uint64), least, width


def scores(maps: np.ndarray, least: np.ndarray, width: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Inner product of ``q`` with all rows as slices, lowest first, and the constant to add.

    A set bit j of a component of q adds that component's slices j places higher. A negative component adds
    the inverted slices. Slices of equal weight are added three at a time, sum and carry.
    """
    first = np.cumsum(width) - width
    constant = int(sum(int(a) * int(b) for a, b in zip(q, least, strict=True)))
    columns: dict[int, list[tuple[int, bool]]] = {}
    for d in np.flatnonzero(q).tolist():
        size, w = abs(int(q[d])), int(width[d])
        if q[d] < 0:
            constant -= size * ((1 << w) - 1)
        for j in range(size.bit_length()):
            if size >> j & 1:
                for b in range(w):
                    columns.setdefault(j + b, []).append((int(first[d]) + b, bool(q[d] < 0)))
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    weight = 0
    top = max(columns, default=-1)
    while weight <= top or carries:
        rows = columns.get(weight, [])
        parts = []
        if rows:
            part = maps[[r for r, _ in rows]]
            part[[inverse for _, inverse in rows]] ^= np.uint64((1 << 64) - 1)
            parts.append(part)
        stack = np.concatenate([*parts, *carries]) if parts or carries else np.zeros((1, maps.shape[1]), np.uint64)
        carries = []
        while len(stack) >= 3:
            third = len(stack) // 3
            a, b, c, rest = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third], stack[3 * third :]
            either = a ^ b
            carries.append((a & b) | (c & either))
            stack = np.concatenate([either ^ c, rest])
        if len(stack) == 2:
            carries.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
        weight += 1
    return out, constant


def highest(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest sums among ``valid``, from the highest slice down; of equal ones at the border the lowest rows."""
    sure, open_rows = np.zeros_like(valid), valid
    for s in reversed(slices):
        both = sure | (open_rows & s)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            open_rows = open_rows & s
        else:
            sure, open_rows = both, open_rows & ~s
            if n == k:
                open_rows = np.zeros_like(valid)
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    border = np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little"))
    return np.append(rows, border[: max(0, k - len(rows))])


def index_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block of vectors: ids in order (null last) and their rows, bitmaps, least values and widths."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        maps, least, width = sliced(_matrix(table.column("v")))
        return pa.table(
            {"block": table.column("block")[:1], "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), "rows": pa.array([table.column("row").to_numpy()], pa.list_(pa.int64())), "maps": pa.array([maps.tobytes()], pa.binary()), "least": pa.array([least], pa.list_(pa.int64())), "width": pa.array([width], pa.list_(pa.int64()))}
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, ids array<long>, rows array<long>, maps binary, least array<long>, width array<long>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best rows for each query row: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Scores are inner products of components floor(scale * x). Every row is indexed, and every query meets every
    block of the index, so the result is exact; only k rows of each block leave it. Rows count one by one: a
    repeated vec_id is several candidates, and each of its rows asks for itself; only the asking row is left out.
    Null vectors and those with null or non-finite components take no part; a null id is found (last among ties), a
    missing component counts as zero. A component of 2 ** 62 and more after scaling, or a score that does not fit
    into 64 bits, is an error. Other columns are ignored. Fewer candidates than k give all of them, none no rows.
    """
    rows = stored(quantised(vectors, scale))
    blocks = max(1, -(-rows.count() // BLOCK))
    queries = rows.where(is_query)
    asking, tasks = queries.count(), -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks)
    chunks = max(1, -(-asking // CHUNK), min(tasks, -(-asking // MIN_CHUNK)))
    index = stored(index_blocks(rows, blocks))
    tiles = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(tile: pa.Table, asked: pa.Table) -> pa.Table:
        asker, query, found, score = [], [], [], []
        if tile.num_rows and asked.num_rows:
            ids = tile.column("ids")[0].as_py()
            at = {row: k for k, row in enumerate(tile.column("rows")[0].as_py())}
            maps = np.frombuffer(tile.column("maps")[0].as_py(), np.uint64).reshape(-1, -(-len(ids) // 64))
            least, width = (tile.column(c).combine_chunks().flatten().to_numpy() for c in ("least", "width"))
            wide = np.zeros((asked.num_rows, len(width)), np.int64)
            given = _matrix(asked.column("v"))[:, : len(width)]
            wide[:, : given.shape[1]] = given
            every = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
            every = np.append(every, np.zeros(-len(every) % 8, np.uint8)).view(np.uint64)
            for row, me, q in zip(asked.column("row").to_pylist(), asked.column("vec_id").to_pylist(), wide, strict=True):
                sums, constant = scores(maps, least, width, q)
                valid = every
                if row in at:
                    valid = every.copy()
                    valid[at[row] // 64] &= ~(np.uint64(1) << np.uint64(at[row] % 64))
                best = highest(sums, valid, k)
                word, bit = best // 64, (best % 64).astype(np.uint64)
                total = [constant] * len(best)
                for w, s in enumerate(sums):
                    total = [t + (b << w) for t, b in zip(total, ((s[word] >> bit) & np.uint64(1)).tolist(), strict=True)]
                asker += [row] * len(best)
                query += [me] * len(best)
                found += [ids[b] for b in best.tolist()]
                score += total
        return pa.table({"row": pa.array(asker, pa.int64()), "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64())})

    near = tiles.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
