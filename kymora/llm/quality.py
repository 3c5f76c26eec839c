"""Quality classifier: random-indexing word vectors, pooled, in a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import RAW, held_out, label_sample, list_column, steps, text_buffers, word_hashes, word_spans

#: Hash rows that words share, length of a word vector, and non-zero places of an index vector.
ROWS, WIDTH, PLACES = 1 << 14, 32, 4
#: Neighbours on each side that add to a word's vector.
REACH = 2
#: Bytes of text pooled at once: every word holds a whole vector.
POOL_BYTES = 1 << 19
#: Words pooled at once.
POOL_WORDS = 1 << 18
#: Most labelled documents that the network is fitted on.
SAMPLE = 20_000
#: Features of a document: three pooled vectors and its length.
FEATURES = 3 * WIDTH + 1
#: A document is good from this probability on.
CUT = 0.7


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Sparse ternary index vectors: PLACES places with signs for each row."""
    rng = np.random.default_rng(7)
    return rng.integers(0, WIDTH, (PLACES, ROWS)), rng.choice(np.array([-1.0, 1.0]), (PLACES, ROWS))


def _rows_of(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_buffers(batch_column)
    folded, starts, ends, first = word_spans(data, bounds, RAW)
    return (word_hashes(folded, starts, ends) & np.uint64(ROWS - 1)).astype(np.int64), first


def context_vectors(docs: DataFrame) -> DataFrame:
    """Per word row the sum of the index vectors of its neighbours, over all documents; whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(ROWS * WIDTH)
        for batch in steps(batches):
            row, first = _rows_of(batch.column(0))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for near in range(1, REACH + 1):
                same = np.flatnonzero(doc[near:] == doc[:-near])
                left, right = row[same], row[same + near]
                for k in range(PLACES):
                    total += np.bincount(left * WIDTH + places[k][right], signs[k][right], ROWS * WIDTH)
                    total += np.bincount(right * WIDTH + places[k][left], signs[k][left], ROWS * WIDTH)
        table = total.reshape(ROWS, WIDTH).astype(np.int64)
        live = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live), *(pa.array(table[live, j]) for j in range(WIDTH))], names=["row", *names])

    names = [f"v{j}" for j in range(WIDTH)]
    parts = docs.select(F.col("text").cast("string")).mapInArrow(add, "row long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names])


def word_table(vectors: DataFrame) -> np.ndarray:
    """Unit word vectors, ROWS x WIDTH; rows without neighbours are zero. The size does not depend on the data."""
    out = np.zeros((ROWS, WIDTH), np.float32)
    for batch in vectors.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = np.stack([batch.column(j + 1).to_numpy() for j in range(WIDTH)], axis=1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1)


def pooled(column: pa.Array, words: np.ndarray, block: int = POOL_WORDS) -> np.ndarray:
    """Features of each text: mean, mean square and mean neighbour product of its word vectors, and its length.

    Sums are carried over blocks of words, so a long text takes no more memory than its words' numbers.
    """
    row, first = _rows_of(column)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    features = np.zeros((len(n), FEATURES), np.float32)
    for lo in range(0, len(row), block):
        doc = owner[lo : lo + block]
        v = words[row[lo : lo + block]]
        beside = words[row[lo + 1 : lo + block + 1]]
        beside = v * np.concatenate([beside, np.zeros((len(v) - len(beside), WIDTH), v.dtype)])
        # the last word of a text has no neighbour in it
        beside[np.append(owner, -1)[lo + 1 : lo + len(v) + 1] != doc] = 0
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for k, part in enumerate((v, v * v, beside)):
            features[doc[begin], k * WIDTH : (k + 1) * WIDTH] += np.add.reduceat(part, begin, axis=0)
    features /= np.maximum(n, 1)[:, None]
    features[:, -1] = np.log1p(n)
    return features


def training_features(docs: DataFrame, wanted: DataFrame, words) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the wanted documents, by doc_id; of repeated ones the row with the smallest text counts."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=POOL_BYTES):
            x = pooled(batch.column(2), words.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_column(x.ravel(), np.arange(len(x) + 1) * FEATURES, pa.float32())], names=["doc_id", "y", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    table = rows.mapInArrow(pool, "doc_id long, y int, features array<float>").toArrow().sort_by("doc_id")
    x = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.array(x, dtype=float).reshape(-1, FEATURES), table.column("y").to_numpy().astype(float)


class Network:
    """Two layers: tanh, then logistic; probabilities are cooled by a temperature."""

    def __init__(self, width: int, hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shift, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh(((x - self.shift) / self.scale) @ w1 + b1) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))

    def slopes(self, x: np.ndarray, y: np.ndarray, decay: float) -> tuple[np.ndarray, ...]:
        """Slopes of the mean cross-entropy and the decay by the parameters, for scaled features."""
        w1, b1, w2, b2 = self.p
        h = np.tanh(x @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -500, 500))) - y) / len(y)
        dh = np.outer(d, w2) * (1 - h * h)
        return x.T @ dh + decay * w1, dh.sum(axis=0), h.T @ d + decay * w2, np.array([d.sum()])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """Adam on the cross-entropy; every fifth row is kept back for the temperature."""
        if not len(y):
            return self
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        back = np.arange(len(y)) % 5 == 4
        tx, ty = (x[~back] - self.shift) / self.scale, y[~back]
        rng = np.random.default_rng(3)
        m1, m2 = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(ty))
            for lo in range(0, len(ty), batch):
                t += 1
                for k, g in enumerate(self.slopes(tx[order[lo : lo + batch]], ty[order[lo : lo + batch]], decay)):
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        if back.any():
            z, yy = self.logits(x[back]), y[back]
            grid = np.exp(np.linspace(np.log(0.5), np.log(10), 60))
            loss = [np.mean(np.logaddexp(0, z / s) - yy * z / s) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def fitted(docs: DataFrame, labels: DataFrame, modulus: int, rest: int, sample: int) -> Callable[[Column], Column]:
    """Learn from ``docs`` and ``labels``; the probability of a text as a function of its column."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(word_table(context_vectors(docs)))
    x, y = training_features(docs, label_sample(labels, "quality", modulus, rest, sample), words)
    net = Network(FEATURES).fit(x, y)
    if not len(y):
        net.p[2][:] = 0

    @F.arrow_udf("double")
    def probability(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [net.probability(pooled(b.column(0), words.value).astype(float)) for b in steps(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), limit=POOL_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return probability


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Score every document: doc_id, held_out, score (probability that its quality label is 1), predicted.

    Word vectors are gathered from all documents; the network is fitted on at most ``sample`` labelled
    ones outside the held-out fold. Only the text enters a score. Null or empty texts have no words and
    are scored by their length alone; without labels every score is 0.5 by the network's zero start.
    Repeated documents are scored each for itself, extra columns are ignored, no documents give no rows.
    """
    probability = fitted(docs, labels, modulus, rest, sample)
    scored = docs.select(F.col("doc_id").cast("long"), probability(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out(modulus, rest).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted to be good; a filter, without a shuffle of texts."""
    return docs.where(fitted(docs, labels, modulus, rest, sample)(F.col("text").cast("string")) >= CUT)
