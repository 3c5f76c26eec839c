"""Line dedup by winnowing: window minima of word hashes find repeated passages; their later copies are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import RAW, bit_filter, in_filter, mix, steps, stored, text_buffers, word_hashes, word_spans

#: Words from which on a repeated run is deleted.
RUN_WORDS = 30
#: Words whose hash is a fingerprint; every window of RUN_WORDS holds 21 of them.
GRAM = 10
#: 64-bit words of the filter of repeated fingerprints, whatever the input (8 MB).
FILTER_WORDS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Windows:
    """All windows of ``words`` words in a batch of documents, wherever they begin, and the fingerprint of each.

    A window's fingerprint is the leftmost minimum of the hashes of its GRAM-word parts, so equal
    windows have equal ones. ``begin`` is a window's first word, ``at`` the place of its fingerprint
    among ``marks``, ``doc`` its document.
    """

    def __init__(self, column: pa.Array, words: int):
        data, self.bounds = text_buffers(column)
        folded, self.starts, ends, first = word_spans(data, self.bounds, RAW)
        n, gram = len(self.starts), min(GRAM, words)
        self.words, self.owner = words, np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.up, self.down = _powers(n + 1)
        self.total = np.append(np.uint64(0), np.cumsum(word_hashes(folded, self.starts, ends) * self.up[:n], dtype=np.uint64))
        self.begin = np.flatnonzero(np.arange(n) + words <= first[1:][self.owner])
        self.marks = self.hashes(np.arange(max(0, n - gram + 1)), gram)
        self.at = _leftmost_minima(self.marks, words - gram + 1)[self.begin]

    def hashes(self, a: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Hash of the ``size`` words from each word in ``a`` on."""
        return mix((self.total[a + size] - self.total[a]) * self.down[a] + np.asarray(size).astype(np.uint64))

    def spans(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document of each window, its first byte and its end (the next word's first byte) in the document."""
        doc, after = self.owner[begin], begin + self.words
        stop = self.bounds[doc + 1].copy()
        inside = np.flatnonzero(np.append(self.owner, -1)[after] == doc)
        stop[inside] = self.starts[after[inside]]
        return doc, self.starts[begin] - self.bounds[doc], stop - self.bounds[doc]


def _leftmost_minima(rank: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of rank[i : i + width] for each i."""
    place, done = np.arange(len(rank)), 1
    while done < width:
        step = min(done, width - done)
        left, right = place[:-step], place[step:]
        place = np.where(rank[left] <= rank[right], left, right)
        done += step
    return place


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """Fingerprints of all documents, one row for each place."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = Windows(batch.column(0), words)
            yield pa.RecordBatch.from_arrays([pa.array(found.marks[np.unique(found.at)].view(np.int64))], names=["key"])

    return docs.select(F.col("text").cast("string")).mapInArrow(mark, "key long")


def _place_marks(run: np.ndarray, text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash for each place of a run, as ``_mark`` gives it."""
    return run ^ text.view(np.uint64) ^ (start.astype(np.uint64) << np.uint64(17))


def _mark() -> Column:
    return F.col("run").bitwiseXOR(F.col("print")).bitwiseXOR(F.shiftleft("start", 17))


def places_of(docs: DataFrame, passed, words: int, single: bool) -> DataFrame:
    """Places of stretches, neighbouring windows with one fingerprint (``key``), with the hash of all their words (``run``).

    Those whose fingerprint passes a filter; with ``single`` the windows, one by one, of those stretches whose mark passes it.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = Windows(batch.column(2), words)
            text = batch.column(1).to_numpy()
            # the fingerprint's place never goes back from one window to the next
            first = np.flatnonzero(np.append(np.ones(min(1, len(found.at)), bool), found.at[1:] != found.at[:-1]))
            count, key = np.diff(np.append(first, len(found.at))), found.marks[found.at[first]]

            def measured(first: np.ndarray, count: np.ndarray):
                begin = found.begin[first]
                doc, start, _ = found.spans(begin)
                return doc, start, found.spans(begin + count - 1)[2], found.hashes(begin, count + (words - 1))

            if single:
                doc, start, _, run = measured(first, count)
                keep = np.flatnonzero(in_filter(_place_marks(run, text[doc], start), passed.value))
                cut = np.append(0, np.cumsum(count[keep]))
                first = np.arange(cut[-1]) + np.repeat(first[keep] - cut[:-1], count[keep])
                key, count = np.repeat(key[keep], count[keep]), np.ones(cut[-1], np.int64)
            else:
                keep = np.flatnonzero(in_filter(key, passed.value))
                first, count, key = first[keep], count[keep], key[keep]
            doc, start, end, run = measured(first, count)
            owner = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), pa.array(start), pa.array(end)],
                names=["doc_id", "print", "key", "run", "start", "end"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), _print(docs).alias("print"), F.col("text"))
    return rows.mapInArrow(pick, "doc_id long, print long, key long, run long, start long, end long")


def _print(docs: DataFrame) -> Column:
    """Tells rows apart that differ in doc_id or text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def earliest_places(places: DataFrame) -> DataFrame:
    """Of each run its fingerprint, the number of its places, and the earliest one."""
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "print", "start")
    return places.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.min("key").alias("key"))


def later_places(places: DataFrame, earliest: DataFrame) -> DataFrame:
    """Those of ``places`` whose run stands at an earlier place too."""
    first = earliest.where("n > 1").select("run", F.col("first.print").alias("__print"), F.col("first.start").alias("__start"))
    other = (F.col("print") != F.col("__print")) | (F.col("start") != F.col("__start"))
    return places.join(first, "run").where(other).select("doc_id", "print", "start", "end")


def joined_ranges(windows: DataFrame) -> DataFrame:
    """Ranges that windows and blocks cover together; where an Arrow batch ends a range may be in two parts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            text, start, end = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            change = np.append(True, (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (text[1:] != text[:-1]))
            base = np.cumsum(change) << 40
            reach = np.maximum.accumulate(end + base) - base
            fresh = change
            fresh[1:] |= start[1:] > reach[:-1]
            a = np.flatnonzero(fresh)
            take = pa.array(a)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start[a]), pa.array(reach[np.append(a[1:], len(doc)) - 1])], names=["doc_id", "print", "start", "end"])

    near = windows.select("doc_id", "print", "start", "end").repartition("doc_id", "print").sortWithinPartitions("doc_id", "print", "start")
    return near.mapInArrow(join, "doc_id long, print long, start long, end long")


def kept_parts(ranges: DataFrame) -> DataFrame:
    """Per document the parts (first byte, number of bytes) that stay beside the deleted ranges."""

    def complement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            flat = column.flatten()
            start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            order = np.lexsort((end, start, owner))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            gone, place = [0] * batch.num_rows, [0] * batch.num_rows
            for o, a, b in zip(owner[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
                if a > place[o]:
                    out[o].append({"start": place[o], "size": a - place[o]})
                if b > place[o]:
                    gone[o] += b - max(a, place[o])
                    place[o] = b
            for o, at in enumerate(place):
                out[o].append({"start": at, "size": (1 << 31) - 1})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, parts), pa.array(gone, pa.int64())], names=["__cut_id", "__cut_print", "__parts", "__gone"])

    parts = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))
    return ranges.mapInArrow(complement, "__cut_id long, __cut_print long, __parts array<struct<start: int, size: int>>, __gone long")


def dedup_lines(docs: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with their later repeated passages deleted from ``text``; adds ``deleted_bytes``.

    Words stand between white space. A word is deleted if it lies in a window of ``words`` words that
    also stands at an earlier place: in a document with a smaller doc_id (null first, equal ones by a
    hash of id and text), or further ahead in the same one, where the two may overlap (of a phrase said
    again and again one stays). Neither lines nor sentences matter, so a passage is found wherever it
    is pasted; matches longer than a window are its neighbours, which are deleted word by word as far
    as the match goes both ways. White space behind a deleted word goes with it.

    Windows are winnowed: each has the minimum of its parts' hashes as its fingerprint, so equal windows
    share it. Fingerprints that stand at several places are joined: first the stretch of neighbouring
    windows around each, by the hash of all its words. Where a fingerprint stands in stretches that
    differ, a match of the earliest of each kind is extended as far as it goes to both sides: each of
    its windows is joined for itself (later ones are gone as a whole). What is joined has passed a filter
    of fixed size (FILTER_WORDS); if that is full, more rows are joined, with the same result. Words are
    compared by 64-bit hashes. Earliest places win. Rows equal in doc_id and text count as one document.
    Null and empty texts stay as they are, so do shorter texts; all other columns are kept (a column
    ``deleted_bytes`` is replaced). No documents give no rows.
    """
    spark = docs.sparkSession
    whole = docs.withColumn("text", F.col("text").cast("string"))
    sharing = fingerprints(whole, words).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    stretches = stored(places_of(whole, spark.sparkContext.broadcast(bit_filter(sharing, FILTER_WORDS)), words, False))
    earliest = stored(earliest_places(stretches))
    differing = earliest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    opened = earliest.join(differing, "key", "left_semi").select("run", "first.print", "first.start").select(_mark().alias("key"))
    windows = stored(places_of(whole, spark.sparkContext.broadcast(bit_filter(opened, FILTER_WORDS)), words, True))
    ranges = joined_ranges(later_places(stretches, earliest).unionAll(later_places(windows, earliest_places(windows))))
    cut = kept_parts(ranges.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    part = F.transform(cut["__parts"], lambda p: whole["text"].cast("binary").substr(p["start"] + 1, p["size"]).cast("string"))
    same = whole["doc_id"].cast("long").eqNullSafe(cut["__cut_id"]) & (_print(whole) == cut["__cut_print"])
    text = F.when(cut["__parts"].isNull(), whole["text"]).otherwise(F.array_join(part, "")).alias("text")
    return whole.join(cut, same, "left").select(
        *[text if c == "text" else whole[f"`{c}`"] for c in docs.columns if c != "deleted_bytes"],
        F.coalesce(cut["__gone"], F.lit(0).cast("long")).alias("deleted_bytes"),
    )
