"""Vector bin packing: examples go under limits on tokens, segments and loss-bearing tokens by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import steps
from kymora.llm.packing import coder

#: Examples that one packing task settles.
GROUP_EXAMPLES = 8192


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and whether examples may be cut.

    ``free_sizes``: a sequence that holds a power of two tokens needs no padding, so one that cannot be filled is cut back to one.
    """

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    cut: bool = True
    free_sizes: bool = True

    def head(self, tokens: np.ndarray | int, loss: np.ndarray | int, room: int, loss_room: int):
        """Most tokens that can be cut off an example's front, whose loss-bearing tokens are its last ones."""
        return np.minimum(np.minimum(tokens, room), tokens - loss + loss_room)


class Pool:
    """Examples left to place, by kind (tokens, loss-bearing tokens)."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray):
        kinds, of = np.unique(np.stack([-tokens, -loss]), axis=1, return_inverse=True)
        self.tokens, self.loss = -kinds[0], -kinds[1]
        self.left = np.bincount(of.ravel(), minlength=len(self.tokens))
        self.members: list[list[tuple[int, int]]] = [[] for _ in self.tokens]
        for i, k in reversed(list(enumerate(of.ravel().tolist()))):
            self.members[k].append((i, 0))
        self.index = {kind: k for k, kind in enumerate(zip(self.tokens.tolist(), self.loss.tolist(), strict=True))}

    def take(self, kind: int) -> tuple[int, int]:
        self.left[kind] -= 1
        return self.members[kind].pop()

    def put(self, tokens: int, loss: int, member: tuple[int, int]) -> None:
        kind = self.index.get((tokens, loss))
        if kind is None:
            if len(self.index) == len(self.tokens):
                self._grow()
            kind = self.index[tokens, loss] = len(self.index)
            self.tokens[kind], self.loss[kind] = tokens, loss
            self.members.append([])
        self.left[kind] += 1
        self.members[kind].append(member)

    def _grow(self) -> None:
        """Forget kinds of which nothing is left, then make room for new ones."""
        keep = np.flatnonzero(self.left > 0)
        self.members = [self.members[k] for k in keep.tolist()]
        more = np.zeros(max(64, len(keep) // 2), self.tokens.dtype)
        self.tokens, self.loss, self.left = (np.append(x[keep], more) for x in (self.tokens, self.loss, self.left))
        self.index = {(int(self.tokens[k]), int(self.loss[k])): k for k in range(len(keep))}


def dot_product_packing(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, each a list of pieces (example, start, tokens), filled one after another.

    The next piece is the example left that fits and whose demand has the largest dot product with the room left, both as
    shares of the limits; among equal ones the longest. Where none fits whole, the front of one is cut off, again by the dot
    product of what the front takes, and the rest goes back. With ``free_sizes`` a sequence that stays short of the token
    limit keeps its first power of two tokens, and what is behind goes back too.
    """
    pool = Pool(np.asarray(tokens, np.int64), np.asarray(loss, np.int64))
    share_t, share_l = 1.0 / limits.tokens**2, 1.0 / max(1, limits.loss) ** 2
    while (pool.left > 0).any():
        room, segments, loss_room = limits.tokens, limits.segments, limits.loss
        pieces: list[tuple[int, int, int]] = []
        kinds: list[tuple[int, int]] = []
        while room and segments:
            score = pool.tokens * (room * share_t) + pool.loss * (loss_room * share_l)
            score[(pool.left <= 0) | (pool.tokens > room) | (pool.loss > loss_room)] = -1.0
            kind = int(score.argmax())
            if score[kind] >= 0:
                t, lost = int(pool.tokens[kind]), int(pool.loss[kind])
                example, start = pool.take(kind)
            elif limits.cut:
                front = limits.head(pool.tokens, pool.loss, room, loss_room)
                score = front * (room * share_t) + np.maximum(0, front - pool.tokens + pool.loss) * (loss_room * share_l)
                score[(pool.left <= 0) | (front <= 0)] = -1.0
                if score.max() < 0:
                    break
                best = np.flatnonzero(score == score.max())
                kind = int(best[pool.tokens[best].argmax()])
                whole, whole_loss, t = int(pool.tokens[kind]), int(pool.loss[kind]), int(front[kind])
                lost = max(0, t - whole + whole_loss)
                example, start = pool.take(kind)
                pool.put(whole - t, whole_loss - lost, (example, start + t))
            else:
                break
            pieces.append((example, start, t))
            kinds.append((t, lost))
            room, segments, loss_room = room - t, segments - 1, loss_room - lost
        if limits.free_sizes and limits.cut and room:
            spare = limits.tokens - room
            spare -= 1 << (spare.bit_length() - 1)
            while spare:
                (example, start, t), (_, lost) = pieces.pop(), kinds.pop()
                keep = max(0, t - spare)
                kept_loss = max(0, keep - t + lost)
                pool.put(t - keep, lost - kept_loss, (example, start + keep))
                if keep:
                    pieces.append((example, start, keep))
                    kinds.append((keep, kept_loss))
                spare -= t - keep
        yield pieces


def document_ids(vocabulary: str, end: int = 2):
    """Arrow step from doc_id and text to doc_id, n_tokens, n_loss and ids (little-endian unsigned 32-bit), ``end`` last.

    Every token but a document's first, which nothing precedes, bears loss. A null text counts as empty.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tail = coder(vocabulary), int(end).to_bytes(4, "little")
        for part in steps(batches, limit=1 << 20):
            ids = [x + tail for x in code.encode([t or "" for t in part.column(1).to_pylist()])]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([len(x) // 4 - 1 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "n_loss", "ids"])

    return encode


def _narrow(ids: bytes) -> bytes:
    """Ids in 16 bits where all fit, for the way to the packing task."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if len(wide) and wide.max() < 1 << 16 else ids


def _wide(ids: bytes, n: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def _portions(limits: Limits, keep_ids: bool):
    """Arrow step that cuts examples into portions under the limits; one that fills a sequence alone needs no ids any more."""

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, loss, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "n_loss", "ids")), strict=True):
                start = 0
                while start < n:
                    rest = min(loss, n - start)
                    now = int(limits.head(n - start, rest, limits.tokens, limits.loss))
                    body = ids[4 * start : 4 * (start + now)]
                    carried = _narrow(body) if keep_ids or now < limits.tokens else None
                    rows.append((doc, start, now, max(0, now - (n - start) + rest), n, zlib.crc32(body), carried))
                    start += now
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "n_loss", "doc_tokens", "ids_crc32", "ids"])

    return portions


_PORTIONS = "doc_id long, start long, length long, n_loss long, doc_tokens long, ids_crc32 long, ids binary"


def _packed(portions: DataFrame, limits: Limits, groups: int, keep_ids: bool) -> DataFrame:
    """Deal portions to groups by hash and pack each group in one task."""

    def settle(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "n_loss", "ids_crc32")}
        doc = table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((columns["ids_crc32"], columns["start"], doc, -columns["n_loss"], -columns["length"]))
        group = int(table.column("pack_group")[0].as_py()) << 32
        start, length, loss, crcs = (columns[c][order] for c in ("start", "length", "n_loss", "ids_crc32"))
        take = pa.array(order)
        docs, total, bodies = table.column("doc_id").take(take).to_pylist(), table.column("doc_tokens").take(take).to_numpy(), table.column("ids")
        rows, made = [], 0

        def add(i: int, begin: int, n: int, at: int) -> None:
            crc, body = crcs[i], None
            if keep_ids or n < length[i]:
                body = _wide(bodies[int(order[i])].as_py(), int(length[i]))[4 * begin : 4 * (begin + n)]
                crc = zlib.crc32(body)
            rows.append((docs[i], start[i] + begin, n, max(0, begin + n - max(begin, int(length[i] - loss[i]))), crc, total[i], group + made, at, body if keep_ids else None))

        for i in np.flatnonzero(length == limits.tokens).tolist():
            add(i, 0, int(length[i]), 0)
            made += 1
        left = np.flatnonzero(length < limits.tokens)
        for pieces in dot_product_packing(length[left], loss[left], limits):
            at = 0
            for k, begin, n in pieces:
                add(int(left[k]), begin, n, at)
                at += n
            made += 1
        kinds = [pa.int64()] * 8 + [pa.binary()]
        names = ["doc_id", "start", "length", "n_loss", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = portions.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = "doc_id long, start long, length long, n_loss long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return dealt.groupBy("pack_group").applyInArrow(settle, schema)


def pack_examples(examples: DataFrame, limits: Limits, groups: int | None = None) -> DataFrame:
    """Place examples (doc_id, n_tokens, n_loss, ids; other columns are ignored) in sequences under all ``limits``.

    Returns per piece doc_id, start (tokens of its example before it), length, n_loss, ids_crc32, doc_tokens, sequence_id,
    offset and ids. Sequences are gapless from 0. The last ``n_loss`` tokens of an example bear loss. Examples beyond a limit
    are cut under it first, also where ``limits.cut`` is off and all others stay whole; a portion that fills a sequence is one
    alone. The others are dealt by hash to ``groups``, each packed in one task (None: counts ``examples`` and takes
    GROUP_EXAMPLES for each). An example without tokens gives no piece; n_loss is at least 0, at most n_tokens, null as 0.
    Repeated rows are packed each for itself.
    """
    _positive(limits)
    groups = groups or max(1, round(examples.count() / GROUP_EXAMPLES))
    loss = F.greatest(F.lit(0), F.least(F.coalesce(F.col("n_loss"), F.lit(0)), "n_tokens")).cast("long")
    clean = examples.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long"), loss.alias("n_loss"), "ids")
    return _packed(clean.mapInArrow(_portions(limits, True), _PORTIONS), limits, groups, True)


def pack_documents(docs: DataFrame, vocabulary: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Pack the texts of ``docs`` (doc_id, text; other columns are ignored), each with end token 2, as ``pack_examples`` does, without ids.

    A null text counts as empty, and an empty text is its end token alone. No documents give no rows.
    """
    _positive(limits)
    encode, portions = document_ids(vocabulary), _portions(limits, False)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda batches: portions(encode(batches)), _PORTIONS)
    return _packed(rows, limits, max(1, round(docs.count() / GROUP_EXAMPLES)), False).drop("ids")


def _positive(limits: Limits) -> None:
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be positive")
