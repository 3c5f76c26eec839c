"""Fill-in-middle and its wavelet matrix, against plain Python."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from kymora.llm import fill_middle
from kymora.llm.fill_middle import Bits, WaveletMatrix, cut_places, fill_in_middle, restore

TEXTS = ["", None, "a", "é\n", "\U0001f600x\U0001f600", "one\ntwo\n\nthree", "\n", "<P>held", "has <M> mark", "<", "S><", "ä" * 500, "tail\r\n", "\x00\x7f"]


def plain_form(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000])
def test_ranks_of_bits_and_symbols(size):
    rng = np.random.default_rng(size)
    symbols, at = rng.integers(0, 8, size).astype(np.uint8), np.arange(size + 1)
    assert (Bits(symbols > 3).rank(at) == np.append(0, np.cumsum(symbols > 3))).all()
    matrix = WaveletMatrix(symbols, 3)
    for s in range(8):
        assert (matrix.rank(s, at) == np.append(0, np.cumsum(symbols == s))).all()


@pytest.mark.parametrize("block", [3, 64, 1 << 22])
@pytest.mark.parametrize("unit", ["code_points", "lines"])
def test_cut_places_of_units(block, unit, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = np.random.default_rng(1)
    first, second = rng.integers(0, 1 << 32, (2, len(TEXTS)))
    units, a, b, lo, hi = cut_places(pa.array(TEXTS), first, second, unit)
    for k, text in enumerate(TEXTS):
        whole = text or ""
        parts = list(whole) if unit == "code_points" else whole.replace("\n", "\n\0\0").split("\0\0")
        parts = [p for p in parts if p]
        x, y = sorted((first[k] % (len(parts) + 1), second[k] % (len(parts) + 1)))
        assert (units[k], a[k], b[k]) == (len(parts), x, y)
        assert (lo[k], hi[k]) == (len("".join(parts[:x]).encode()), len("".join(parts[:y]).encode()))


def test_forms_and_round_trip(spark):
    long = "".join(f"wörd{i % 977} \U0001f600\n" for i in range(60_000))
    rows = [(d, t, 1, "k") for d, t in enumerate([*TEXTS * 8, long])] + [(None, "no id", 1, "k"), (3, "é\n", 1, "k"), (-7, "below", 2, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    made = fill_in_middle(docs)
    got = made.withColumn("back", restore(made["output"], made["form"])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, *map(str, r[1:6])) for r in got) == sorted((d is None, d or 0, *map(str, plain_form(d, t))) for d, t, *_ in rows)
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_lines_stay_whole(spark):
    docs = spark.createDataFrame([(d, "\n".join(f"line {i}" for i in range(d % 9))) for d in range(60)], "doc_id long, text string")
    rows = fill_in_middle(docs, "lines", plain=0, spm=0).collect()
    for r in rows:
        lines = r.text.splitlines(keepends=True)
        assert r.n == len(lines) and r.form == ("psm" if lines else "plain")
        if lines:
            rest, middle = r.output[3:].split("<M>")
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            assert (rest, middle) == ("".join(lines[:a]) + "<S>" + "".join(lines[b:]), "".join(lines[a:b]))
