"""Hidden Markov language model: Baum-Welch over all training documents, exact likelihood by the forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import fold_table, held_out, list_column, mix, steps, stored, text_buffers, word_hashes, word_spans

#: Latent states, and rounds of Baum-Welch, each over all whole training documents.
STATES, ROUNDS = 8, 8
#: Classes of the words beyond the head, by their last two bytes; the head holds the most frequent words.
CLASSES = 128
HEAD = (1 << 16) - CLASSES - 1
#: Tokens whose state probabilities are held at once; a longer text is worked through again from the states at the borders of stretches.
SPAN = 1 << 19
#: Weight of the corpus distribution in each state's emissions, of each transition, and of each known or unknown word.
EMISSION, TRANSITION, WORD = 50.0, 1.0, 0.1

#: The key of the end token; words never have it (their hashes are cleared in the lowest bit).
END = 1
#: A-Z lower-cased, words between ASCII white space; a zero byte belongs to a word (0xFF is no byte of UTF-8).
_TABLE = fold_table(b" \t\n\r\x0b\x0c")
_TABLE[0] = 255


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and classes of all words, and the first word of each document (and one end)."""
    data, bounds = text_buffers(column)
    folded, starts, ends, first = word_spans(data, bounds, _TABLE)
    key = word_hashes(folded, starts, ends) & ~np.uint64(1)
    last = folded[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, folded[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return key, ((last * 131 + before) * 2654435761 >> 13) % CLASSES, first


def word_counts(docs: DataFrame) -> DataFrame:
    """Key, class and count of every word, and of the end token, over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            key, kind, _ = tokens(batch.column(0))
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            key, kind, n = np.append(key, np.uint64(END)), np.append(kind[at], 0), np.append(n, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(n)], names=["key", "kind", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "key long, kind int, n long")
    return parts.groupBy("key", "kind").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """Head words by key, and what the base model gives to symbols: head words, the end, then classes."""

    keys: np.ndarray
    order: np.ndarray
    counts: np.ndarray
    mass: np.ndarray
    tokens: int
    words: int

    @property
    def head(self) -> int:
        return len(self.keys)

    def of(self, key: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and whether it lies beyond the head."""
        at = np.minimum(np.searchsorted(self.keys, key), self.head - 1)
        beyond = self.keys[at] != key
        return np.where(beyond, self.head + kind, self.order[at]), beyond


def symbols(counts: DataFrame, head: int = HEAD) -> Symbols:
    """The ``head`` most frequent words go to the driver, the others stay in ``counts`` and are summed by class."""
    word, size = F.col("key") != END, F.floor(F.log2("n") * 8)
    # only words near the border and above it are sorted: their sizes are counted in bins of 9 %
    bins = sorted(((r["size"], r["count"]) for r in counts.where(word).groupBy(size.alias("size")).count().collect()), reverse=True)
    above = np.cumsum([0] + [n for _, n in bins])
    lowest = bins[min(int(np.searchsorted(above, head)), len(bins)) - 1][0] if bins else 0
    top = counts.where(word & (size >= lowest)).orderBy(F.desc("n"), "key").limit(head).select("key", "n").toArrow()
    key, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.int64)
    ends = counts.where(F.col("key") == END).agg(F.sum("n")).first()[0] or 0
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    key, n = np.append(key, np.uint64(END)), np.append(n, ends)
    least = counts.sparkSession.createDataFrame(pa.table({"key": key.view(np.int64)}))
    rest = counts.join(F.broadcast(least), "key", "left_anti").groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass = np.concatenate([n + WORD, np.full(CLASSES, WORD)])
    for r in rest:
        mass[len(key) + r["kind"]] += r["n"] + WORD * r["v"]
    by_key = np.argsort(key)
    return Symbols(key[by_key], by_key, n, mass, int(total["n"] or 0), int(total["v"] or 0))


def encoded(docs: DataFrame, model) -> DataFrame:
    """Per document its symbols (two bytes each, the end last) and the keys of its words beyond the head."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Symbols = model.value
        end = int(known.order[np.searchsorted(known.keys, np.uint64(END))])
        for batch in steps(batches):
            key, kind, first = tokens(batch.column(1))
            symbol, beyond = known.of(key, kind)
            n = np.diff(first)
            line = np.insert(symbol, first[1:], end).astype("<u2")
            bounds = (first + np.arange(len(first))) * 2
            sequence = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(line.tobytes())])
            tail = np.append(0, np.cumsum(beyond))[first]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n + 1), sequence, list_column(key[beyond].view(np.int64), tail, pa.int64())], names=["doc_id", "n_tokens", "symbols", "tail"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, symbols binary, tail array<long>").withColumn("uid", F.monotonically_increasing_id())


@dataclass
class Chain:
    """Start and transition probabilities; emissions with one row for each symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences by falling length, and how many reach each place."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    return order, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left") if len(lengths) else lengths


def forward(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole sequence, by the scaled forward recursion, many documents at a time."""
    out = np.zeros(len(sequences))
    if not sequences:
        return out
    order, active = _padded(sequences)
    flat = np.concatenate([sequences[i] for i in order])
    begin = np.cumsum([0] + [len(sequences[i]) for i in order[:-1]])
    total = np.zeros(len(order))
    state = np.broadcast_to(chain.start, (len(order), len(chain.start)))
    for t, n in enumerate(active.tolist()):
        state = (state[:n] @ chain.move if t else state[:n]) * chain.emit[flat[begin[:n] + t]]
        scale = state.sum(axis=1)
        state = state / scale[:, None]
        total[:n] += np.log10(scale)
    out[order] = total
    return out


def _spans(active: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Stretches of places in which at most ``limit`` tokens lie, or one place."""
    place, out, t = np.cumsum(np.append(0, active)), [], 0
    while t < len(active):
        stop = max(t + 1, int(np.searchsorted(place, place[t] + limit, side="right")) - 1)
        out.append((t, stop))
        t = stop
    return out


def expected_counts(chain: Chain, sequences: list[np.ndarray], limit: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, transitions and emissions of whole sequences, many of like length at a time."""
    k = len(chain.start)
    start, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(chain.emit)))
    by_length = sorted(sequences, key=len, reverse=True)
    total = np.cumsum([len(s) for s in by_length])
    lo = 0
    while lo < len(by_length):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, side="right")))
        a, b = _add_counts(chain, by_length[lo:hi], limit, emitted)
        start, moves, lo = start + a, moves + b, hi
    return start, chain.move * moves, emitted.T


def _add_counts(chain: Chain, sequences: list[np.ndarray], limit: int, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and, without the factor of the transition itself, transitions of sequences by falling length; emissions are added to ``emitted``.

    Tokens lie place by place. A first pass keeps the states at the borders of stretches of ``limit`` tokens; going back,
    each stretch is worked through again from its border, so memory does not grow with the sequences' length.
    """
    lengths = np.array([len(s) for s in sequences])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    place = np.cumsum(np.append(0, active))
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols = np.concatenate(sequences)[np.argsort(within, kind="stable")]
    k = len(chain.start)
    spans = _spans(active, limit)

    def forward_through(t0: int, t1: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled states (a row for each state) and scales of the places t0 to t1, from the states before them."""
        emit = np.take(table, symbols[place[t0] : place[t1]], axis=1)
        alpha, scale = np.empty_like(emit), np.empty(emit.shape[1])
        for lo, hi in zip((place[t0:t1] - place[t0]).tolist(), (place[t0 + 1 : t1 + 1] - place[t0]).tolist(), strict=True):
            state = (back @ state[:, : hi - lo] if lo or t0 else chain.start[:, None]) * emit[:, lo:hi]
            whole = np.add.reduce(state, axis=0, out=scale[lo:hi])
            state /= whole
            alpha[:, lo:hi] = state
        return emit, alpha, scale

    table, back = np.ascontiguousarray(chain.emit.T), np.ascontiguousarray(chain.move.T)
    entry = [np.zeros((k, 0))]
    for t0, t1 in spans[:-1]:
        entry.append(forward_through(t0, t1, entry[-1])[1][:, place[t1 - 1] - place[t0] :].copy())
    start, moves = np.zeros(k), np.zeros((k, k))
    later = np.zeros((k, 0))  # of the place behind: emission times what follows, scaled
    for (t0, t1), before in zip(reversed(spans), reversed(entry), strict=True):
        emit, alpha, scale = forward_through(t0, t1, before)
        emit /= scale
        beta = np.ones_like(emit)
        for t in range(t1 - 1, t0 - 1, -1):
            lo, hi, m = place[t] - place[t0], place[t + 1] - place[t0], later.shape[1]
            if m:
                moves += alpha[:, lo : lo + m] @ later.T
                np.matmul(chain.move, later, out=beta[:, lo : lo + m])
            later = emit[:, lo:hi] * beta[:, lo:hi]
        beta *= alpha
        if not t0:
            start = beta[:, : active[0]].sum(axis=1)
        for j in range(k):
            emitted[j] += np.bincount(symbols[place[t0] : place[t1]], beta[j], emitted.shape[1])
    return start, moves


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray], base: np.ndarray) -> Chain:
    """Model of the expected counts, smoothed by the corpus distribution ``base``."""
    start, move, emit = counts
    emit = emit + EMISSION * base[:, None]
    return Chain((start + 1) / (start + 1).sum(), (move + TRANSITION) / (move + TRANSITION).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_chain(known: Symbols, states: int) -> Chain:
    """Starting point: the corpus distribution, shaken for each state by a hash of the word, and states that last."""
    keys = np.empty(known.head + CLASSES, np.uint64)
    keys[known.order] = known.keys
    keys[known.head :] = mix(np.arange(CLASSES, dtype=np.uint64) + np.uint64(1 << 40))
    salt = mix(np.arange(1, 2 * states + 1, dtype=np.uint64)).reshape(2, 1, states)
    chance = (mix(keys[:, None] ^ salt) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-12
    emit = known.mass[:, None] * -np.log(chance).sum(axis=0) / 2
    return Chain(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(axis=0))


def baum_welch(sequences: DataFrame, known: Symbols, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Rounds of Baum-Welch over all ``sequences``: each task sums its expected counts, Spark adds the tasks' by symbol.

    Nothing depends on how the sequences lie in partitions, but for the rounding of sums.
    """
    spark = sequences.sparkSession
    base = known.mass / known.mass.sum()
    chain = first_chain(known, states)
    names = [f"e{k}" for k in range(states)]
    schema = "row int, " + ", ".join(f"{n} double" for n in names)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(chain)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            size = len(now.value.emit)
            start, move, emit = np.zeros((1, states)), np.zeros((states, states)), np.zeros((size, states))
            for batch in batches:
                lines = [np.frombuffer(b, "<u2") for b in batch.column(0).to_pylist()]
                if lines:
                    s, m, e = expected_counts(now.value, lines)
                    start, move, emit = start + s, move + m, emit + e
            table = np.concatenate([emit, move, start])
            live = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), *(pa.array(table[live, k]) for k in range(states))], names=["row", *names])

        summed = sequences.select("symbols").mapInArrow(expect, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        table = np.zeros((len(base) + states + 1, states))
        table[summed.column("row").to_numpy()] = np.stack([summed.column(n).to_numpy() for n in names], axis=1)
        chain = improved((table[-1], table[len(base) : -1], table[: len(base)]), base)
        now.unpersist()
    return chain


def hmm_scores(docs: DataFrame, modulus: int = 10, rest: int = 0, head: int = HEAD) -> DataFrame:
    """Score whole documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents with crc32(doc_id as text) mod ``modulus`` not ``rest`` (a null id is learned from).
    Tokens are lower-cased (A-Z) words between ASCII white space and one end. The base model is the
    smoothed unigram count. The hidden states emit the ``head`` most frequent words, the end, and classes of
    all others, in which words have their smoothed counts, so that counts of all words enter every score.
    Null texts are empty: an end alone. Repeated rows are scored, and learned from, each for itself; other
    columns are ignored; no documents give no rows.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs.where(~held_out(modulus, rest))))
    known = symbols(counts, head)
    sequences = stored(encoded(docs, spark.sparkContext.broadcast(known)))
    chain = baum_welch(sequences.where(~held_out(modulus, rest)), known)
    model = spark.sparkContext.broadcast((known, chain))
    whole = float(np.log10(known.tokens + WORD * (known.words + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chain = model.value
        n = known.head
        value = np.concatenate([np.log10(known.counts + WORD), np.zeros(CLASSES)])
        inside = np.concatenate([np.zeros(n), np.log10(known.mass[n:])])
        seen = np.concatenate([known.counts > 0, np.zeros(CLASSES, bool)])
        for batch in batches:
            lines = [np.frombuffer(b, "<u2") for b in batch.column(2).to_pylist()]
            cut = np.cumsum([0] + [len(s) for s in lines[:-1]])
            flat = np.concatenate(lines) if lines else np.zeros(0, "<u2")
            add = [np.add.reduceat(x[flat].astype(float), cut) if lines else np.zeros(0) for x in (value, inside, seen)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(forward(chain, lines) - add[1]), pa.array(add[0]), pa.array(add[2].astype(np.int64))], names=["uid", "doc_id", "n_tokens", "model", "head", "head_known"])

    scored = sequences.select("uid", "doc_id", "symbols", "n_tokens").mapInArrow(score, "uid long, doc_id long, n_tokens long, model double, head double, head_known long")
    count = F.coalesce("n", F.lit(0).cast("long"))
    tails = sequences.select("uid", F.explode("tail").alias("key")).join(counts.select("key", "n"), "key", "left")
    tails = tails.groupBy("uid").agg(F.sum(F.log10(count + WORD)).alias("rest"), F.sum((count > 0).cast("long")).alias("rest_known"))
    rest_sum, rest_known = F.coalesce("rest", F.lit(0.0)), F.coalesce("rest_known", F.lit(0).cast("long"))
    return scored.join(tails, "uid", "left").select(
        "doc_id",
        held_out(modulus, rest).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + rest_known).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("head") + rest_sum - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + rest_sum).alias("score"),
    )
