"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import stored

#: Distinct words whose ids a worker keeps; beyond it the half that came last goes (ids do not depend on it).
CACHED_WORDS = 1_000_000
#: Documents that one packing task settles.
GROUP_PIECES = 40_000

#: White space of Unicode, at which the vocabulary's pattern always cuts (str.split also cuts at \x1c-\x1f).
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Letters whose lower case stands alone, then marks: such a word has the ids of its lower case, then those of its marks.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|]*)")
_CODERS: dict[str, Coder] = {}


class Coder:
    """Ids of whole texts, each word between white space encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [_SPACE.split(t) if _ODD.search(t) else t.split() for t in texts]
        needed: set[str] = set()
        for words in split:
            needed.update(words)
        if len(self.ids) > CACHED_WORDS:
            self.ids = dict(islice(self.ids.items(), CACHED_WORDS // 2))
        new = needed.difference(self.ids)
        plain = {w: (m[1].lower(), m[2]) for w in new if (m := _PLAIN.fullmatch(w))}
        parts = plain | {w: (w, "") for w in new.difference(plain)}
        self._letters(list({body for body, _ in plain.values()}.difference(self.ids)))
        fresh = list({p for pair in parts.values() for p in pair if p}.difference(self.ids))
        for word, code in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.ids[word] = array("I", code.ids).tobytes()
        look = self.ids.__getitem__
        for word, (body, marks) in parts.items():
            self.ids[word] = look(body) + look(marks) if marks else look(body)
        return [b"".join(map(look, words)) for words in split]

    def _letters(self, words: list[str]) -> None:
        """Ids of words of letters alone, many in one text: each ends with its only token that ends a word."""
        for lo in range(0, len(words), 200):
            some = words[lo : lo + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some):
                raw = ids.tobytes()
                self.ids.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *stops], stops, strict=False))


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def pieces_of(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Cut each document's ids, with one id 0 at its end, into pieces of at most ``limit`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), code.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += b"\0\0\0\0"
                    for k in range(0, len(ids), 4 * limit):
                        body = ids[k : k + 4 * limit]
                        rows.append((doc, k // (4 * limit), k // 4, len(body) // 4, zlib.crc32(body)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order.

    ``open_bins[g]`` counts the bins with g places left. A piece goes into the open bin
    with which the sum of the squared counts becomes smallest, on ties into the smallest
    gap; a new bin is opened only where the piece fits into no open one.
    """
    open_bins = np.zeros(limit + 1, np.int64)
    members: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gain = 1 - 2 * open_bins[s:limit]
        gain[1:] += 2 * open_bins[1 : limit - s] + 1
        gain[open_bins[s:limit] == 0] = never
        best = int(gain.argmin()) if len(gain) else -1
        if best >= 0 and gain[best] < never:
            gap = s + best
            chosen = members[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, chosen = limit, made
            made += 1
        bins[i], offsets[i] = chosen, limit - gap
        if gap > s:
            members[gap - s].append(chosen)
            open_bins[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, limit: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give each piece (any rows with doc_id, piece, start, length, ids_crc32) its sequence and offset.

    Pieces are dealt by hash to groups of about ``group_pieces``, each packed in one task, longest
    first. ``pieces`` is counted first, so it should be stored.
    """
    groups = max(1, round(pieces.count() / group_pieces))

    def settle(table: pa.Table) -> pa.Table:
        doc, piece = table.column("doc_id").to_numpy(zero_copy_only=False), table.column("piece").to_numpy()
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("ids_crc32").to_numpy(), piece, np.nan_to_num(doc.astype(float), nan=-1), -length))
        bins, offsets = sum_of_squares(length[order], limit)
        table = table.take(pa.array(order))
        group = table.column("pack_group").to_numpy().astype(np.int64)
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInArrow(settle, schema)


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are ignored) into sequences of at most ``limit`` tokens.

    A null text counts as empty, and an empty text is its end token alone. Repeated rows are packed
    each for itself. Documents of up to ``limit`` tokens stay whole; longer ones are cut. No documents
    give no rows.
    """
    return pack(stored(pieces_of(docs, vocabulary, limit)), limit)
