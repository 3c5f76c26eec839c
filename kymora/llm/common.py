"""Helpers of the pipeline operators: words and hashes of Arrow batches, stored steps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kymora.session import own_path

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 3 << 20

#: Bytes from which on a word is hashed whole.
LONG_WORD = 64

_SEED, _FACTOR = np.uint64(0x8BB84B93962EACC9), np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = own_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_table(separators: bytes | range, *, lower: bool = True) -> np.ndarray:
    """A byte's folded form; 0 for bytes that separate words."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    table[0] = 0
    return table


#: Words are runs of 0-9, a-z and bytes of characters outside ASCII; A-Z are lower-cased.
ALNUM = fold_table([b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)])
#: Words are runs between ASCII white space, as they stand (a zero byte also separates).
RAW = fold_table(b" \t\n\r\x0b\x0c", lower=False)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or a single row."""
    for batch in batches:
        _, bounds = text_buffers(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of words, and for each document the index of its first word (and one end)."""
    folded = table[data]
    inside = folded != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data):
        # words that touch where one document ends and the next begins
        seams = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
        seams = seams[inside[seams] & inside[seams - 1]]
        edges = np.concatenate([[0] * int(inside[0]), edges, [len(data)] * int(inside[-1])]).astype(np.int64)
        if len(seams):
            edges = np.sort(np.concatenate([edges, seams, seams]))
    starts, ends = edges[0::2], edges[1::2]
    return folded, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's folded bytes, eight at a time; long words by BLAKE2."""
    sizes = ends - starts
    padded = np.append(folded, np.zeros(8, np.uint8))
    eights = np.ndarray((len(padded) - 7,), np.dtype("<u8"), buffer=padded, strides=(1,))
    out = mix(sizes.astype(np.uint64) + _SEED)
    rows, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(rows):
        left = np.minimum(sizes[rows] - at, 8)
        out[rows] = mix((out[rows] ^ (eights[starts[rows] + at] & _MASKS[left])) * _FACTOR)
        at += 8
        rows = rows[sizes[rows] > at]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(folded[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return out


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, laid end to end, and their offsets.

    A document with fewer words than ``size``, but not none, has one shingle of all its words.
    """
    n = np.diff(first)
    factor = np.uint64(0xBF58476D1CE4E5B9)
    total = hashes.copy()
    for k in range(1, size):
        total *= factor
        total[: max(0, len(hashes) - k)] += hashes[k:]
    live = np.repeat(first[1:], n) - np.arange(len(hashes)) >= size
    for d in np.flatnonzero((n > 0) & (n < size)).tolist():
        live[first[d]] = True
        whole = int(n[d])
        for h in hashes[first[d] : first[d + 1]].tolist():
            whole = (whole * int(factor) + h) % (1 << 64)
        total[first[d]] = whole
    values = mix(total[live])
    cut = np.append(0, np.cumsum(np.where(n < size, n > 0, n - size + 1)))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        values[lo:hi].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[cut[:-1][cut[:-1] < len(values)]] = True
    return values[fresh], np.append(0, np.cumsum(fresh))[cut]


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def held_out(modulus: int, rest: int):
    """Whether a document's labels may not be learned from: crc32(doc_id as text) mod ``modulus`` is ``rest``."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def hash_sample(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most ``limit`` rows in the order of their keys' hash; the rows come to one task only after a cut at twice as many."""
    from pyspark.sql import functions as F

    share = 2 * limit / max(1, df.count())
    spread = F.xxhash64(*keys)
    near = df if share >= 1 else df.where(F.pmod(spread, F.lit(1 << 20)) < max(1, round(share * (1 << 20))))
    return near.orderBy(spread, *keys).limit(limit)


def label_sample(labels: DataFrame, column: str, modulus: int, rest: int, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents that may be learned from, as doc_id and y (0 or 1), in hash order.

    Repeated labels of a document count as 1 if at least half of them are 1; null labels are left out.
    """
    from pyspark.sql import functions as F

    clean = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(modulus, rest))
    return hash_sample(clean.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y")), limit, "doc_id")


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the first row of each group (and one end), from batches sorted by ``column``."""
    kept: list[pa.RecordBatch] = []

    def cuts(values: pa.Array) -> np.ndarray:
        return np.flatnonzero(np.append(True, pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False))) if len(values) else np.zeros(0, int)

    def out(table: pa.Table):
        table = table.combine_chunks()
        return table, np.append(cuts(table.column(column).combine_chunks() if table.num_rows else table.column(column)), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        at = cuts(batch.column(batch.schema.get_field_index(column)))[-1]
        names = batch.schema.names.index(column)
        if kept and kept[-1].column(names)[-1] != batch.column(names)[0]:
            yield out(pa.Table.from_batches(kept))
            kept = []
        if at > 0:
            yield out(pa.Table.from_batches([*kept, batch.slice(0, at)]))
            kept = []
        kept.append(batch.slice(at))
    if kept:
        yield out(pa.Table.from_batches(kept))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' component, under the edges a - b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _slots(h: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two places of a hash in a filter, as word and bit."""
    return [(((h >> np.uint64(k + 6)) & np.uint64(words - 1)).astype(np.int64), (h >> np.uint64(k)) & np.uint64(63)) for k in (0, 32)]


def bit_filter(keys: DataFrame, words: int) -> np.ndarray:
    """Bit filter of the 64-bit hashes in column ``key``; ``words`` (a power of two) fixes its size, whatever the input."""
    from pyspark.sql import functions as F

    slots = [(F.shiftrightunsigned("key", k + 6).bitwiseAND(words - 1).cast("int").alias("word"), F.shiftrightunsigned("key", k).bitwiseAND(63).cast("int").alias("bit")) for k in (0, 32)]
    both = keys.select(F.explode(F.array(*[F.struct(w, b) for w, b in slots])).alias("s"))
    table = both.groupBy("s.word").agg(F.bit_or(F.expr("shiftleft(1L, s.bit)")).alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash passes the filter: all that are in it, and few others."""
    out = np.ones(len(h), bool)
    for word, bit in _slots(h, len(bits)):
        out &= ((bits[word] >> bit) & np.uint64(1)).astype(bool)
    return out
