"""Benchmark decontamination: prefix-filtered containment join of item windows in documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import ALNUM, bit_filter, in_filter, mix, steps, stored, text_buffers, word_hashes, word_spans

#: Words of a window, and of a shingle inside it; a shorter item is one window.
WINDOW = 13
SHINGLE = 3
#: 64-bit words of the filter that is sent to every task, whatever the size of the benchmark (1 MB).
FILTER_WORDS = 1 << 17


def grams(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they fit into the document."""
    rest = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    total = np.full(len(hashes), size, np.uint64)
    for k in range(size):
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total[: len(hashes) - k] += hashes[k:]
    return mix(total), rest >= size


def windows_of(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per window of an item: its words and, in order, the hashes of its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, bounds = text_buffers(batch.column(1))
            folded, starts, ends, first = word_spans(data, bounds, ALNUM)
            hashes = word_hashes(folded, starts, ends)
            words = [folded[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
            rows = []
            for item, lo, hi in zip(batch.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                if lo == hi:
                    continue
                size = min(window, hi - lo)
                g, _ = grams(hashes[lo:hi], np.array([0, hi - lo]), min(shingle, size))
                g = g.view(np.int64)
                for k in range(hi - lo - size + 1):
                    rows.append({"item_id": item, "words": words[lo + k : lo + k + size], "shingles": g[k : k + max(1, size - shingle + 1)].tolist(), "size": min(shingle, size)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64())), ("size", pa.int32())])
    schema = "item_id long, words array<string>, shingles array<long>, size int"
    return items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def shingle_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """How often documents hold each shingle that passes the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, bounds = text_buffers(batch.column(0))
            folded, starts, ends, first = word_spans(data, bounds, ALNUM)
            hashes = word_hashes(folded, starts, ends)
            for size in sizes:
                g, fits = grams(hashes, first, size)
                key, n = np.unique(g[fits & in_filter(g, bits.value)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, bits, sizes: list[int], window: int, shingle: int) -> DataFrame:
    """Per document its number of words and the places where a prefix shingle may stand, with the words around."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            data, bounds = text_buffers(batch.column(2))
            folded, starts, ends, first = word_spans(data, bounds, ALNUM)
            hashes = word_hashes(folded, starts, ends)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for size in sizes:
                g, fits = grams(hashes, first, size)
                at = np.flatnonzero(fits & in_filter(g, bits.value))
                doc = np.searchsorted(first, at, side="right") - 1
                around = window - shingle if size == shingle else 0
                for i, d, key in zip(at.tolist(), doc.tolist(), g[at].view(np.int64).tolist(), strict=True):
                    lo, hi = max(int(first[d]), i - around), min(int(first[d + 1]), i + size + around)
                    found[d].append({"key": key, "pos": i - int(first[d]), "left": i - lo, "around": [folded[a:b].tobytes().decode() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)]})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(found, arrow)], names=["doc_id", "print", "n_words", "found"])

    arrow = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("around", pa.list_(pa.string()))]))
    schema = "doc_id long, print long, n_words long, found array<struct<key: long, pos: long, left: int, around: array<string>>>"
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("print"), text.alias("text")).mapInArrow(find, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """Words of each document that stand inside an occurrence of an item's window.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. Containment
    is whole, so one shingle per window, the rarest over all documents, is a necessary prefix:
    only places that hold it are joined, on its hash, and then bound by the window's place in the
    document and compared word by word.

    Returns doc_id, print (a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated
    (at least one word in ``share`` is hit), one row for each row of ``docs``. Null texts have no
    words, items without words no windows; repeated items count once by item_id, repeated documents
    each for itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = stored(windows_of(items, window, shingle))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    shingles = windows.select(F.explode("shingles").alias("key")).distinct()
    rarity = shingle_counts(docs, spark.sparkContext.broadcast(bit_filter(shingles, FILTER_WORDS)), sizes)
    each = windows.select("item_id", "words", "size", F.posexplode("shingles").alias("offset", "key"))
    ranked = each.join(rarity, "key", "left").groupBy("item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset")).alias("p"))
    prefix = stored(ranked.select("item_id", "words", F.col("p.key").alias("key"), F.col("p.offset").alias("offset"), F.size("words").alias("len")))
    places = stored(candidates(docs, spark.sparkContext.broadcast(bit_filter(prefix.select("key").distinct(), FILTER_WORDS)), sizes, window, shingle))
    at = places.where(F.size("found") > 0).select("doc_id", "print", "n_words", F.explode("found").alias("f")).select("doc_id", "print", "n_words", "f.*").distinct()
    start = F.col("pos") - F.col("offset")
    held = (F.col("offset") <= F.col("left")) & (start + F.col("len") <= F.col("n_words"))
    same = F.expr("slice(around, left - offset + 1, len) = words")
    hits = at.join(prefix, "key").where(held & same)
    spans = F.array_sort(F.collect_set(F.struct(start.alias("start"), (start + F.col("len")).alias("end"))))
    joined = hits.groupBy("doc_id", "print").agg(spans.alias("spans"), F.collect_set("item_id").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
    )["n"]
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = joined.select(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("ids"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        places.select("doc_id", "print", "n_words")
        .join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("print") == F.col("hit_print")), "left")
        .select(
            "doc_id",
            "print",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; repeated rows alike, null texts stay, no items drop nothing."""
    bad = contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("print").alias("__bad_print")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__bad_print"])
    return docs.join(bad, same, "left_anti")
