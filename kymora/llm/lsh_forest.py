"""Jaccard join of word shingles by a MinHash LSH forest: sorted prefix trees find candidates, whole sets verify them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import ALNUM, local_components, mix, shingle_sets, steps, stored, text_buffers, whole_groups, word_hashes, word_spans
from kymora.llm.components import contracted_components

#: Words of a shingle, and the similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Prefix trees, the length of a tree's labels, and the share of links that must be met.
TREES, LONGEST, RECALL = 20, 6, 0.9999
#: Signatures that agree less are not near; six standard errors below SIMILARITY.
FLOOR = 0.57
#: Rows of one side of a cell; larger buckets and clusters are split into pairs of blocks.
BLOCK = 512

_RNG = np.random.default_rng(99)
_FACTORS = _RNG.integers(1, 1 << 63, TREES * LONGEST, dtype=np.uint64) | np.uint64(1)
_ADDS = _RNG.integers(1, 1 << 63, TREES * LONGEST, dtype=np.uint64)


def met(similarity: np.ndarray | float, length: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that a pair shares a prefix of ``length`` in at least one tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """Longest prefix with which pairs at the threshold itself meet with the target probability: no shorter one is needed on any data."""
    return next((k for k in range(longest, 1, -1) if met(similarity, k, trees) >= recall), 1)


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_buffers(column)
    folded, starts, ends, first = word_spans(data, bounds, ALNUM)
    return shingle_sets(word_hashes(folded, starts, ends), first, size)


def _keys(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set; zero for none."""
    out = np.zeros((len(cut) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        out[some, 0] = np.add.reduceat(mix(values), cut[some])
        out[some, 1] = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), cut[some])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a contiguous array."""
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document: key of its shingle set, one bucket (shortest prefix) for each tree, and a signature of one byte for each MinHash, tree by tree."""
    length = shortest_prefix()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            values, cut = _sets(batch.column(2), shingle)
            some = np.flatnonzero(np.diff(cut))
            low = np.zeros((batch.num_rows, TREES * LONGEST), np.uint32)
            for k in range(TREES * LONGEST) if len(some) else ():
                low[some, k] = np.minimum.reduceat(((values * _FACTORS[k] + _ADDS[k]) >> np.uint64(32)).astype(np.uint32), cut[some])
            bucket = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (batch.num_rows, TREES)).copy()
            label = low.reshape(-1, TREES, LONGEST)
            for k in range(length):
                bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + label[:, :, k])
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TREES), pa.array(bucket.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _binary(_keys(values, cut)), pa.array(np.diff(cut)), buckets, _binary((mix(low.astype(np.uint64)) & np.uint64(255)).astype(np.uint8))],
                names=["doc_id", "print", "key", "n", "buckets", "signature"],
            )

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("print"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, print long, key binary, n long, buckets array<long>, signature binary")


def cells(rows: DataFrame, group: str, size: Column) -> DataFrame:
    """Deal each row to its group's cells: one, or for a group of several blocks each pair with its own block.

    Adds ``cell``, ``side`` (0 or 1: first or second block of the cell) and ``own`` (the cell is one block).
    """
    blocks = F.ceil(size / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    return (
        rows.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("cell", F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other")))
        .withColumn("side", (F.col("mine") > F.col("other")).cast("int"))
        .withColumn("own", F.col("mine") == F.col("other"))
        .drop("mine", "other")
    )


def forest_edges(rows: DataFrame) -> DataFrame:
    """Edges a - b with the length of prefix that joins them: a spanning forest of each cell, longest prefixes first.

    A cell holds texts with one shortest prefix of one tree (``tree``), sorted by their labels there. Pairs whose signatures
    agree in less than FLOOR are left out. Taking the edges of at least a length joins the same texts of a cell
    as all its pairs with a common prefix of that length would.
    """
    least = shortest_prefix()

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, "cell"):
            n = table.num_rows
            if not n:
                continue
            sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            label = sign.reshape(n, TREES, LONGEST)[np.arange(n), table.column("tree").to_numpy()]
            group = np.repeat(np.arange(len(first) - 1), np.diff(first))
            left, right, length = [], [], []
            for lag in range(1, int(np.diff(first).max())):
                i = np.flatnonzero(group[lag:] == group[:-lag])
                for part in np.array_split(i, max(1, len(i) // 50_000)):
                    close = part[(sign[part] == sign[part + lag]).mean(axis=1) >= FLOOR]
                    left.append(close)
                    right.append(close + lag)
                    length.append(np.logical_and.accumulate(label[close] == label[close + lag], axis=1).sum(axis=1))
            if not left:
                continue
            a, b, shared = np.concatenate(left), np.concatenate(right), np.concatenate(length)
            keys, root = table.column("key").combine_chunks(), np.arange(n)
            for k in range(LONGEST, least - 1, -1):
                joined = local_components(n, a[shared >= k], b[shared >= k])
                child = np.flatnonzero((root == np.arange(n)) & (joined != np.arange(n)))
                root = joined
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(child)), keys.take(pa.array(joined[child])), pa.array(np.full(len(child), k, np.int32))], names=["a", "b", "length"])

    label = F.expr(f"substring(signature, tree * {LONGEST} + 1, {LONGEST})")
    dealt = rows.select("cell", "key", "signature", "tree").repartition("cell").sortWithinPartitions("cell", label, "key")
    return dealt.mapInArrow(span, "a binary, b binary, length int")


def _overlaps(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Number of common shingles of each pair of sets."""
    m = len(cut) - 1
    owner = np.repeat(np.arange(m), np.diff(cut))
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count >= 2
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], place[code[keep]]
    total = np.zeros((m, m), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        x = np.zeros((m, min(4096, int(shared.sum()) - lo)), np.float32)
        x[owner[a:b], code[a:b] - lo] = 1
        total += x @ x.T
    return total


def verified_links(rows: DataFrame, similarity: float, shingle: int, length: int) -> DataFrame:
    """Per text and cell: links counted on whole shingle sets, the links they stand for, and one linked text that spans the cell's links.

    A link met with probability p by prefixes of ``length`` stands for 1 / p links (in millionths, similarities rounded down to thousandths).
    """
    stands_for = np.rint(1e6 / np.maximum(met(np.arange(1001) / 1000, length), 1e-6)).astype(np.int64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_groups(batches, "cell"):
            keys, side, own = table.column("key").combine_chunks(), table.column("side").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
            links, stands, root = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64), np.arange(table.num_rows)
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                values, cut = _sets(table.column("text").slice(lo, hi - lo), shingle)
                both, n = _overlaps(values, cut), np.diff(cut)
                # 64-bit whole numbers: the comparison has no rounding at the threshold
                common, union = both.astype(np.int64), n[:, None] + n[None, :] - both.astype(np.int64)
                close = common * 1_000_000 >= round(similarity * 1_000_000) * union
                np.fill_diagonal(close, False)
                if not own[lo]:
                    close &= side[lo:hi, None] != side[None, lo:hi]
                links[lo:hi] = close.sum(axis=1)
                a, b = np.nonzero(np.triu(close))
                worth = stands_for[common[a, b] * 1000 // union[a, b]]
                stands[lo:hi] = np.bincount(a, worth, hi - lo) + np.bincount(b, worth, hi - lo)
                root[lo:hi] = lo + local_components(hi - lo, a, b)
            yield pa.RecordBatch.from_arrays([keys, pa.array(links), pa.array(stands), keys.take(pa.array(root))], names=["key", "links", "stands", "root"])

    dealt = rows.select("cell", "key", "side", "own", "text").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(verify, "key binary, links long, stands long, root binary")


def adapted_clusters(edges: DataFrame, places: DataFrame, whole: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, int]:
    """Verified links inside the clusters over the longest prefixes that meet the target recall, and their length.

    From the longest prefix on, all clusters are verified on whole sets. A link of similarity s is met with probability p(s)
    at this length, so it stands for 1 / p(s) links. Links met say nothing about one that no prefix met, so one more at the threshold,
    met with its probability, is always reckoned with: few links, or none, do not end the search. While the links met fall short of
    RECALL of that sum over all of them, and a shorter prefix joins any texts at all, the prefix is shortened. The shortest prefix meets
    links at the threshold itself with that probability, so no data need a shorter one.
    """
    shortest = shortest_prefix(similarity)
    least = edges.agg(F.min("length")).first()[0]
    for length in range(LONGEST, shortest - 1, -1):
        clusters = stored(contracted_components(edges.where(F.col("length") >= length).select("a", "b")))
        sizes = stored(clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
        members = clusters.join(sizes, "component").select(F.col("node").alias("key"), "component", "size")
        found = _texts_of(whole, members.join(places, "key"))
        dealt = cells(found.select("key", "component", "size", "text"), "component", F.col("size"))
        checked = stored(verified_links(dealt, similarity, shingle, length))
        if least is None or length <= least:
            break
        if length > shortest:
            links, stands = (n or 0 for n in checked.agg(F.sum("links"), F.sum("stands")).first())
            # both texts of a link count it
            if links + 2 * met(similarity, length) >= RECALL * (stands / 1_000_000 + 2):
                break
    return checked, length


def _texts_of(whole: DataFrame, places: DataFrame) -> DataFrame:
    """One row with its text for each key of ``places`` (low_id, low_print)."""
    return whole.join(places, F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("print") == F.col("low_print"))).dropDuplicates(["key"])


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Class of near-duplicates of each document: doc_id, print, class_id, n_links, n_copies, is_first.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle`` lower-cased words is
    at least ``similarity``; a class is a connected component of links. Texts with equal sets
    are copies: they are one text to the join, and ``n_copies`` counts them. ``n_links`` counts the
    other texts linked to this one. ``class_id`` is the smallest doc_id of the class (null only if
    all are null), ``is_first`` marks its smallest document by doc_id and print (all of its rows, if repeated).

    Texts whose labels share a prefix in one of TREES trees, and that look near by signature, are joined to clusters.
    The prefix starts at LONGEST values and is shortened until the links met, all of them counted, reach the target RECALL. Inside a
    cluster all pairs are verified on whole sets; groups and clusters of more than BLOCK texts are split
    into pairs of blocks, no pair of them is dropped.

    Texts of fewer words than a shingle, but not none, have one shingle of all words; texts without words
    (null, empty) are copies of each other. Repeated rows are copies. Other columns are ignored; no rows give no rows.
    """
    signed = stored(signatures(docs, shingle))
    texts = stored(signed.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("low"), F.count(F.lit(1)).alias("n_copies"), F.first("buckets").alias("buckets"), F.first("signature").alias("signature"), F.first("n").alias("n")))
    in_trees = texts.where("n > 0").select("key", F.posexplode("buckets").alias("tree", "bucket"))
    crowded = stored(in_trees.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met_in = in_trees.join(crowded, "bucket").groupBy("key").agg(F.collect_list(F.struct("tree", "bucket", "size")).alias("b"))
    rows = texts.select("key", "signature").join(met_in, "key").select("key", "signature", F.explode("b").alias("b")).select("key", "signature", "b.*")
    edges = stored(forest_edges(cells(rows, "bucket", F.col("size"))))
    places = texts.select("key", F.col("low.doc_id").alias("low_id"), F.col("low.print").alias("low_print"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    checked, _ = adapted_clusters(edges, places, whole, similarity, shingle)
    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    classes = contracted_components(checked.where("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = stored(
        texts.select("key", "low", "n_copies")
        .join(classes.withColumnRenamed("node", "key"), "key", "left")
        .join(links, "key", "left")
        .select("key", "low", "n_copies", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    firsts = stored(named.groupBy("component").agg(F.min("low").alias("first")))
    by_text = stored(named.join(firsts, "component").select("key", "n_copies", "n_links", "first"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print"))
    return signed.select("doc_id", "print", "key").join(by_text, "key").select("doc_id", "print", F.col("first.doc_id").alias("class_id"), "n_links", "n_copies", first.alias("is_first"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their class of near-duplicates; of repeated rows one.

    Texts without words are copies of each other, so one of them stays. No documents give no rows.
    """

    def keyed(rows: DataFrame, number: Column, text: Column, *more: Column) -> DataFrame:
        return rows.select(F.coalesce(number, F.lit(0).cast("long")).alias("number"), number.isNull().alias("none"), text.alias("print"), *more)

    found = near_duplicates(docs).where("is_first")
    first = keyed(found, F.col("doc_id"), F.col("print")).distinct()
    # a row travels as one value, so its columns' names cannot clash with others
    rows = keyed(docs, F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = ["number", "none", "print"]
    return rows.join(first, own, "left_semi").dropDuplicates(own).select("row.*")
