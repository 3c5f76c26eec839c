"""Vector bin packing: whole texts, all limits, padding, and the choice against plain Python."""

import zlib
from array import array
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from kymora.llm.queries import QUERIES, VOCABULARY
from kymora.llm.vector_packing import Limits, dot_product_packing, pack_documents, pack_examples

SF = "/root/testdata/sf0.001"


def check_whole(rows, want, limit):
    """Each document's pieces are its ids, sequences are gapless, and none is padded."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array("I", ids[at : at + r.length]).tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in places.values():
        parts.sort()
        total = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist() and total <= limit and total & (total - 1) == 0
    return places


def test_query_is_whole_and_without_padding(spark):
    coder = Tokenizer.from_file(VOCABULARY)
    texts = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {d: coder.encode(t or "", add_special_tokens=False).ids + [2] for d, t in texts}
    places = check_whole(QUERIES["op13_vector_packing"](spark, SF).collect(), want, 4096)
    assert len(places) <= sum(map(len, want.values())) // 4096 + 13 and max(map(len, places.values())) <= 256


def brute(tokens, loss, limits):
    """The rule with exact fractions over all examples left, one by one; of equal ones that which came back last."""
    left = [(i, 0, t, n) for i, (t, n) in enumerate(zip(tokens, loss, strict=True))]
    while left:
        room, segments, loss_room, pieces = limits.tokens, limits.segments, limits.loss, []

        def dot(t, n, room, loss_room):
            return Fraction(t * room, limits.tokens**2) + Fraction(n * loss_room, limits.loss**2)

        while room and segments and left:
            fits = [x for x in left if x[2] <= room and x[3] <= loss_room]
            if fits:
                best = max(reversed(fits), key=lambda x: (dot(x[2], x[3], room, loss_room), x[2]))
                front = best[2]
            elif limits.cut:
                fronts = [(x, min(x[2], room, x[2] - x[3] + loss_room)) for x in reversed(left)]
                best, front = max(fronts, key=lambda p: (p[1] > 0, dot(p[1], max(0, p[1] - p[0][2] + p[0][3]), room, loss_room), p[0][2]))
                if front <= 0:
                    break
            else:
                break
            left.remove(best)
            i, start, t, n = best
            lost = max(0, front - t + n)
            if front < t:
                left.append((i, start + front, t - front, n - lost))
            pieces.append((i, start, front, lost))
            room, segments, loss_room = room - front, segments - 1, loss_room - lost
        yield pieces


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_choice_equals_brute_force(seed, cut):
    rng = np.random.default_rng(seed)
    limits = Limits(64, 5, 32, cut, free_sizes=False)
    tokens = rng.permutation(np.arange(2, 60))[:40]
    loss = np.minimum(tokens - rng.integers(0, 2, 40), 32) // rng.integers(1, 3)
    got = [sorted((int(tokens[i]), s, n) for i, s, n in b) for b in dot_product_packing(tokens, loss, limits)]
    assert got == [sorted((int(tokens[i]), s, n) for i, s, n, _ in b) for b in brute(tokens.tolist(), loss.tolist(), limits)]


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 20), Limits(100, 2, 100, cut=False), Limits(64, 4, 64, True, False), Limits(16, 1, 1)])
def test_all_limits_hold_and_nothing_is_lost(limits):
    rng = np.random.default_rng(7)
    tokens = np.minimum(rng.geometric(0.03, 500), limits.tokens)
    loss = np.minimum(rng.integers(0, tokens + 1), limits.loss)
    seen = defaultdict(list)
    for pieces in dot_product_packing(tokens, loss, limits):
        total = sum(n for *_, n in pieces)
        lost = sum(max(0, s + n - max(s, tokens[i] - loss[i])) for i, s, n in pieces)
        assert 0 < total <= limits.tokens and len(pieces) <= limits.segments and lost <= limits.loss
        assert not (limits.cut and limits.free_sizes) or total == limits.tokens or total & (total - 1) == 0
        for i, s, n in pieces:
            seen[i].append((s, n))
    for i, t in enumerate(tokens.tolist()):
        parts = sorted(seen[i])
        assert [s for s, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist() and sum(n for _, n in parts) == t
        assert limits.cut or len(parts) == 1


def test_instruction_data_under_three_limits(spark):
    """Conversations as examples: what a user says bears no loss, the answers behind it do."""
    coder = Tokenizer.from_file(VOCABULARY)
    rows = duckdb.connect().execute(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' order by 1, 2").fetchall()
    asked = {(c, t): x for c, t, r, x in rows if r == "user"}
    examples = []
    for c, t, r, text in rows:
        if r != "user" and (c, t - 1) in asked:
            prompt, answer = (coder.encode(x or "", add_special_tokens=False).ids for x in (asked[c, t - 1], text))
            examples.append((100 * c + t, len(prompt) + len(answer) + 1, len(answer) + 1, bytearray(array("I", [*prompt, *answer, 2]).tobytes()), "x"))
    examples += [(None, 3, 9, bytearray(array("I", [5, 6, 7]).tobytes()), "x"), (-1, 0, 0, bytearray(), "x"), (-2, None, 1, None, "x"), (-3, 1, None, bytearray(4), "x"), (-3, 1, None, bytearray(4), "x")]
    frame = spark.createDataFrame(examples, "doc_id long, n_tokens long, n_loss long, ids binary, length string")
    limits = Limits(512, 6, 256, cut=False)
    got = pack_examples(frame, limits, groups=2).collect()
    whole, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for d, n, loss, ids, _ in examples:
        if not n:
            assert d not in whole
        elif d != -3:
            parts = sorted(whole[d], key=lambda r: r.start)
            assert b"".join(r.ids for r in parts) == bytes(ids) and sum(r.n_loss for r in parts) == min(n, loss)
            assert len(parts) == 1 or n > 512 or loss > 256
    assert len(whole[-3]) == 2
    for parts in places.values():
        assert sum(r.length for r in parts) <= 512 and len(parts) <= 6 and sum(r.n_loss for r in parts) <= 256
    with pytest.raises(ValueError):
        pack_examples(frame, Limits(0))


def test_odd_texts(spark):
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "", 1), (2, None, 1), (4, long, 1), (5, "\x00 é́ \U0001f600", 1), (6, " \n ", 1), (7, "x", 1)]
    docs = spark.createDataFrame([*rows, (8, "y y", 1), (None, "z", 1)], "doc_id long, text string, length int")
    coder = Tokenizer.from_file(VOCABULARY)
    want = {d: coder.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in [*rows, (8, "y y", 1), (None, "z", 1)]}
    check_whole(pack_documents(docs, VOCABULARY).collect(), want, 4096)
    assert len(pack_documents(docs.unionByName(docs), VOCABULARY).where("start = 0").collect()) == 16
    assert pack_documents(docs.limit(0), VOCABULARY).collect() == []
