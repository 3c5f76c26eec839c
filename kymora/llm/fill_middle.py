"""Fill-in-middle: texts cut at two places found by rank queries on a wavelet matrix over character classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymora.llm.common import text_buffers

#: Bytes of text under one wavelet matrix; longer texts reach over several.
BLOCK = 1 << 22
#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Class of a UTF-8 byte: 0 inside a character, 1 blank, 2 line feed, 3 letter, 4 digit, 5 other ASCII,
#: 6 first of a two-byte character, 7 first of a longer one.
CLASSES = np.full(256, 5, np.uint8)
CLASSES[list(b" \t\r\x0b\x0c")] = 1
CLASSES[10] = 2
CLASSES[65:91] = CLASSES[97:123] = 3
CLASSES[48:58] = 4
CLASSES[0x80:0xC0] = 0
CLASSES[0xC0:0xE0] = 6
CLASSES[0xE0:] = 7

#: Classes that bound a unit, and whether such a byte ends its unit (else it begins one).
UNITS = {"code_points": ((1, 2, 3, 4, 5, 6, 7), False), "lines": ((2,), True)}


class Bits:
    """A bit row with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.append(packed, np.zeros(16 - len(packed) % 8, np.uint8)).view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))[:-1]
        self.ones = int(np.count_nonzero(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Symbols of ``depth`` bits, one bit row for each, highest first; zeros go before ones from row to row."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.size, self.rows = len(symbols), []
        for k in reversed(range(depth)):
            bit = ((symbols >> k) & 1).astype(bool)
            self.rows.append((k, Bits(bit), len(symbols) - int(np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` symbols."""
        lo, hi = np.zeros(1, np.int64), at
        for k, bits, zeros in self.rows:
            if symbol >> k & 1:
                lo, hi = zeros + bits.rank(lo), zeros + bits.rank(hi)
            else:
                lo, hi = lo - bits.rank(lo), hi - bits.rank(hi)
        return hi - lo


class Boundaries:
    """Boundary counts of units in a run of bytes, and the places where the counts are reached."""

    def __init__(self, data: np.ndarray, unit: str):
        self.classes, self.at_end = UNITS[unit]
        self.size = len(data)
        self.blocks = [WaveletMatrix(CLASSES[data[k : k + BLOCK]], 3) for k in range(0, len(data), BLOCK)]
        totals = [int(self._within(b, np.array([b.size]))[0]) for b in self.blocks]
        self.before = np.append(0, np.cumsum(totals, dtype=np.int64))

    def _within(self, block: WaveletMatrix, at: np.ndarray) -> np.ndarray:
        return sum(block.rank(c, at) for c in self.classes)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Boundary bytes among the first ``at`` bytes."""
        out = np.empty(len(at), np.int64)
        for b, rows in _by_block(np.minimum(at // BLOCK, len(self.blocks) - 1)):
            out[rows] = self.before[b] + self._within(self.blocks[b], at[rows] - b * BLOCK) if b >= 0 else 0
        return out

    def find(self, target: np.ndarray) -> np.ndarray:
        """Fewest bytes that hold ``target`` boundary bytes (``target`` of 1 and more, up to their number): bisection on the counts."""
        out = np.empty(len(target), np.int64)
        for b, rows in _by_block(np.searchsorted(self.before, target, side="left") - 1):
            want = target[rows] - self.before[b]
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.blocks[b].size)
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                enough = self._within(self.blocks[b], mid) >= want
                hi = np.where(enough, mid, hi)
                lo = np.where(enough, lo, np.minimum(mid + 1, hi))
            out[rows] = b * BLOCK + lo
        return out


def _by_block(block: np.ndarray):
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order])) + 1
    for rows in np.split(order, edges):
        if len(rows):
            yield int(block[rows[0]]), rows


def cut_places(column: pa.Array, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """For each text: its units, the units before both cuts, and the bytes before both cuts.

    The cuts lie after ``first`` mod (units + 1) and ``second`` mod (units + 1) units, the smaller before the larger.
    """
    data, bounds = text_buffers(column)
    begin, end = bounds[:-1], bounds[1:]
    marks = Boundaries(data, unit)
    at = marks.count(bounds)
    units = np.diff(at)
    if marks.at_end:
        last = np.flatnonzero(end > begin)
        units[last] += CLASSES[data[end[last] - 1]] != marks.classes[0]
    a, b = first % (units + 1), second % (units + 1)
    counts = [np.minimum(a, b), np.maximum(a, b)]
    places = []
    for k in counts:
        place = np.where(k == 0, 0, end - begin)
        step = 0 if marks.at_end else 1
        rows = np.flatnonzero((k > 0) & (at[:-1] + k + step <= at[1:]))
        place[rows] = marks.find(at[rows] + k[rows] + step) - step - begin[rows]
        places.append(place)
    return units, *counts, *places


def _cuts(unit: str):
    @F.arrow_udf("units long, prefix long, both long, lo int, hi int")
    def cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        found = cut_places(text, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False), unit)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], names=["units", "prefix", "both", "lo", "hi"])

    return cuts


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of in ``form``; no part holds a mark, so the marks are found again."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    psm = [F.substr(F.substring_index(rest, SUFFIX, 1), F.lit(len(PREFIX) + 1)), middle, F.substring_index(rest, SUFFIX, -1)]
    spm = [F.substring_index(rest, PREFIX, -1), middle, F.substr(F.substring_index(rest, PREFIX, 1), F.lit(len(SUFFIX) + 1))]
    return F.when(form == "psm", F.concat(*psm)).when(form == "spm", F.concat(*spm)).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = "code_points", salt: str = "1:", plain: int = 10, spm: int = 20) -> DataFrame:
    """Cut each text of ``docs`` (doc_id, text; other columns are ignored) in three and bring the middle to the end.

    Returns doc_id, n (units), form, prefix_chars, middle_chars (units; null if plain), output and text.
    ``unit`` is "code_points" or "lines". Cuts and form come from the SHA-256 of ``salt`` and the id alone:
    ``plain`` of a hundred texts stay as they are, ``spm`` of a hundred others take the suffix first. A null
    text counts as empty; empty texts and those that hold a mark stay plain. A null id is hashed as an empty
    one; repeated rows are each returned. Texts of any length: memory is the Arrow batch and under one byte more for each byte of it.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[h[k].alias(f"h{k}") for k in range(4)])
    rows = rows.withColumn("cut", _cuts(unit)("text", "h0", "h1"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h2") % 100 >= 100 - plain), "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm")
    raw, lo, hi = F.col("text").cast("binary"), F.col("cut.lo"), F.col("cut.hi")
    parts = {
        PREFIX: F.substring(raw, F.lit(1), lo).cast("string"),
        SUFFIX: F.substring(raw, hi + 1, F.octet_length("text")).cast("string"),
        MIDDLE: F.substring(raw, lo + 1, hi - lo).cast("string"),
    }

    def joined(*marks: str) -> Column:
        return F.concat(*[x for m in marks for x in (F.lit(m), parts[m])])

    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id",
        F.col("cut.units").alias("n"),
        "form",
        F.when(cut, F.col("cut.prefix")).alias("prefix_chars"),
        F.when(cut, F.col("cut.both") - F.col("cut.prefix")).alias("middle_chars"),
        F.when(F.col("form") == "psm", joined(PREFIX, SUFFIX, MIDDLE)).when(F.col("form") == "spm", joined(SUFFIX, PREFIX, MIDDLE)).otherwise(F.col("text")).alias("output"),
        "text",
    )
