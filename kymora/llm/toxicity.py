"""Toxicity by multiple-instance learning: noisy-or of sentence scores, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import ALNUM, held_out, label_sample, list_column, mix, steps, stored, text_buffers, word_hashes, word_spans

#: Hashed word features.
FEATURES = 1 << 18
#: Most labelled documents to learn from, and documents that must hold a feature.
SAMPLE, SEEN = 20_000, 5
#: Standard errors by which a feature's share of toxic documents must differ.
APART = 3.5
#: Bytes of a word's stem.
STEM = 5
#: A document is toxic, and a sentence is named, from this probability on.
CUT = 0.7

_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?\n")] = True


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (two for each word: it and its stem, the first STEM bytes), where each sentence's begin
    and end, and its document, first and last byte.

    Sentences end at . ! ? or a line end; those without a word are left out.
    """
    data, bounds = text_buffers(column)
    folded, starts, ends, first = word_spans(data, bounds, ALNUM)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cuts = np.cumsum(_SENTENCE_END[data], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (cuts[1:] != cuts[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(starts))[: len(begin)]
    owner = doc[begin]
    whole, stem = word_hashes(folded, starts, ends), word_hashes(folded, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(1 << 40)
    feature = (np.stack([whole, mix(stem)], axis=1).ravel() & np.uint64(FEATURES - 1)).astype(np.int32)
    return feature, 2 * begin, 2 * end, owner, starts[begin] - bounds[owner], ends[end - 1] - bounds[owner]


def _labelled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text")


def feature_counts(docs: DataFrame, wanted: DataFrame) -> np.ndarray:
    """Number of labelled documents with label 0 and 1 (rows) that hold each feature; last column: of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            feature, begin, _, owner, _, _ = sentences(batch.column(2))
            words = np.append(begin, len(feature))[np.searchsorted(owner, np.arange(batch.num_rows + 1))]
            y = batch.column(1).to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(words))
            held = np.unique(doc * FEATURES + feature)
            code = np.append((held % FEATURES) * 2 + y[held // FEATURES], 2 * FEATURES + y)
            code, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

    summed = _labelled(docs, wanted).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * FEATURES + 2)
    out[summed.column("code").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(-1, 2).T


def training_bags(docs: DataFrame, wanted: DataFrame, usable) -> DataFrame:
    """Label and, of the sentences that hold usable features, these features and their number; number of the other sentences."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            feature, begin, end, owner, _, _ = sentences(batch.column(2))
            keep = usable.value[feature]
            kept = np.append(0, np.cumsum(keep))
            sizes = kept[end] - kept[begin]
            some = sizes > 0
            cut = np.searchsorted(owner[some], np.arange(batch.num_rows + 1))
            words = np.append(0, np.cumsum(sizes[some]))[cut]
            plain = np.bincount(owner[~some], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_column(feature[keep], words, pa.int32()), list_column(sizes[some], cut, pa.int32()), pa.array(plain)],
                names=["doc_id", "y", "words", "sizes", "plain"],
            )

    return _labelled(docs, wanted).mapInArrow(bag, "doc_id long, y int, words array<int>, sizes array<int>, plain long")


class NoisyOr:
    """A document is toxic if at least one of its sentences is; sentences are scored by a linear model of their words."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(FEATURES, np.float32), -7.0

    def sentence(self, feature: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if not len(begin):
            return np.zeros(0)
        z = self.bias + np.add.reduceat(self.weights[feature].astype(float), begin)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def document(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """log(1 - P) of each document; 0 without sentences."""
        return np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n)

    def choose(self, held: np.ndarray) -> np.ndarray:
        """Which features to use, by ``feature_counts``; their weights start at their log-odds.

        Features that fewer than SEEN documents hold, or whose share of toxic documents lies within
        APART standard errors of the whole share, stay at zero.
        """
        held, whole = held[:, :-1], held[:, -1]
        share = min(max(whole[1] / max(whole.sum(), 1), 1e-6), 1 - 1e-6)
        n = held.sum(axis=0)
        usable = (n >= SEEN) & (np.abs(held[1] - share * n) > APART * np.sqrt(share * (1 - share) * n + 1e-9))
        self.weights = np.where(usable, np.log((held[1] + 0.2) / (held[0] + 0.2) * (1 - share) / share), 0).astype(np.float32)
        return usable

    def slopes(self, part: list[tuple[int, np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
        """Slopes of the mean cross-entropy of the documents, by weight and by the bias."""
        feature, size = np.concatenate([b[1] for b in part]), np.concatenate([b[2] for b in part])
        y, plain = np.array([b[0] for b in part], float), np.array([b[3] for b in part], float)
        owner = np.repeat(np.arange(len(part)), [len(b[2]) for b in part])
        p, other = self.sentence(feature, np.cumsum(size) - size), 1 / (1 + np.exp(-self.bias))
        none = np.exp(self.document(p, owner, len(part)) + plain * np.log1p(-other))
        blame = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) / len(part)
        d = blame[owner] * p
        return np.bincount(feature, np.repeat(d, size), FEATURES), float(d.sum() + (blame * plain).sum() * other)

    def fit(self, bags: list[tuple[int, np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 100, rate: float = 0.5) -> NoisyOr:
        """Adagrad on the documents' cross-entropy: label, features and sizes of sentences, number of sentences without."""
        squares, bias_squares = np.full(FEATURES, 1e-6, np.float32), 1e-6
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(bags), batch):
                slopes, slope = self.slopes([bags[i] for i in order[lo : lo + batch]])
                g = slopes.astype(np.float32)
                squares += g * g
                self.weights -= rate * g / np.sqrt(squares)
                bias_squares += slope**2
                self.bias -= 0.3 * rate * slope / np.sqrt(bias_squares)
        return self


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Score every document: doc_id, held_out, score (probability of being toxic), predicted, offending.

    ``offending`` lists the sentences with a score of at least CUT, as first and last byte (exclusive) of
    the text in UTF-8 and score. The model learns from at most ``sample`` labelled documents outside the
    held-out fold. Texts without words (null, empty) score 0; without labels all scores stay near 0.
    Repeated documents are scored each for itself, extra columns are ignored, no documents give no rows.
    """
    spark = docs.sparkSession
    wanted = stored(label_sample(labels, "toxic", modulus, rest, sample))
    learner = NoisyOr()
    usable = spark.sparkContext.broadcast(learner.choose(feature_counts(docs, wanted)))
    rows = training_bags(docs, wanted, usable).toArrow().sort_by([("doc_id", "ascending")])
    bags = []
    for batch in rows.to_batches():
        words, sizes = batch.column(2), batch.column(3)
        w, s = words.flatten().to_numpy(), sizes.flatten().to_numpy()
        wo, so = np.append(0, np.cumsum(words.value_lengths().to_numpy())), np.append(0, np.cumsum(sizes.value_lengths().to_numpy()))
        bags += [(y, w[wo[i] : wo[i + 1]], s[so[i] : so[i + 1]], n) for i, (y, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True))]
    model = spark.sparkContext.broadcast(learner.fit(bags))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            feature, begin, _, owner, first, last = sentences(batch.column(1))
            p = model.value.sentence(feature, begin)
            total = -np.expm1(model.value.document(p, owner, batch.num_rows))
            bad = np.flatnonzero(p >= CUT)
            cut = np.searchsorted(owner[bad], np.arange(batch.num_rows + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(first[bad]), pa.array(last[bad]), pa.array(p[bad])], names=["start", "end", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.ListArray.from_arrays(pa.array(cut), spans)], names=["doc_id", "score", "offending"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")
    return scored.select("doc_id", held_out(modulus, rest).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "offending")
