"""Conversation prefix trie against a walk over plain Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from kymora.llm import prefix_trie
from kymora.llm.prefix_trie import conversation_trie, numbered_turns, with_shared_heads
from kymora.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos int, key string, depth int"


def brute_turns(rows):
    """conv_id -> its turns (role, text) in order."""
    def place(row):
        role, text = row[2] or "", row[3] or ""
        return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())

    out = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=place):
        out[row[0]].append((row[2] or "", row[3] or ""))
    return dict(out)


def brute_shared(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute_trie(turns):
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(turns):
        path = tuple(turns[c])
        ends[path].append(str(c))
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                below[path[: d - 1]].add(path[:d])
    out = set()
    for node, ids in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in inside if n)
        leaves = sum(n not in below for n in inside)
        parent = members[node[:-1]][0] if node else None
        out.add((ids[0], len(node), parent, len(ids), len(below[node]) if node in below else 0, leaves, saved, hashlib.sha256(",".join(ends.get(node, [])).encode()).hexdigest()))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    rows = duckdb.connect().execute("select conv_id, turn, role, text from '/root/testdata/sf0.01/conversations.parquet'").fetchall()
    assert rows_of(QUERIES["op12_conversation_prefix_trie"](spark, "/root/testdata/sf0.01")) == brute_trie(brute_shared(brute_turns(rows)))


@pytest.mark.parametrize("block", [2, 1024])
def test_any_blocks_and_pieces(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice("ab"), 0, "x", 1) for c in range(60) for t in range(rng.choice([1, 2, 2, 5, 11]))]
    rows += [(c, t, "user", "same", 0, "x", 1) for c in range(100, 140) for t in range(3)]
    rows += [(100, 3, "user", "on", 0, "x", 1), (139, 7, "user", "on", 0, "x", 1)]
    turns = brute_turns(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(conversation_trie(table)) == brute_trie(turns)
    assert rows_of(prefix_trie.prefix_trie(*with_shared_heads(numbered_turns(table)))) == brute_trie(brute_shared(turns))


def test_nulls_ties_repeats_and_missing_groups(spark):
    rows = [(1, None, "b", "first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "", "tie"), (1, -4, "a", ""), (None, 0, "a", "no id")]
    rows += [(205, t, "u", f"own {t}") for t in range(2)]
    # conversations without turns: their group's first one is absent, or has none to give
    gone = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows += [(gone, 0, "u", "lost"), (-5, 0, "u", "below"), (0, 0, "u", "root"), (7, 0, "u", "x" * 300_000), (7, 1, "a" * 10, "y")]
    table = spark.createDataFrame([(*r, 5, "k", 9) for r in rows], SCHEMA)
    turns = brute_turns(rows)
    assert [list(t) for t in turns[1]] == [["b", "first"], ["a", ""], *[list(x) for x in turns[1][2:]]]
    assert rows_of(conversation_trie(table)) == brute_trie(turns)
    shared, members = with_shared_heads(numbered_turns(table.where("conv_id >= 0")))
    want = brute_shared(brute_turns([r for r in rows if r[0] is None or r[0] >= 0]))
    assert want[gone] == [] and rows_of(prefix_trie.prefix_trie(shared, members)) == brute_trie(want)
    assert conversation_trie(table.limit(0)).collect() == []
