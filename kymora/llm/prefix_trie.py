"""Conversation prefix trie by whole-sequence collapse: equal conversations become one weighted sequence, then prefixes are summed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymora.llm.common import stored
from kymora.operators.ordered import with_row_index

#: Turns that one window of a long conversation holds.
BLOCK = 1024
#: Range of conversation ids that one piece of an end list covers.
PIECE = 1024

NODE = ["depth", "f1", "f2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns as conv_id, pos (from 0), key (SHA-256 of role and text) and chars (code points of the text).

    Takes conv_id, turn, role and text; other columns are ignored. Turns are in order, null first, those of one number
    in order of their keys, the SHA-256 of the role's length, a colon, role and text. Null roles and texts are empty;
    rows without a conv_id are left out. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), key.alias("key"), F.length(text).cast("long").alias("chars")
    )
    return with_row_index(stored(rows), ["conv_id"], ["turn", "key"], F.floor(F.col("turn") / BLOCK), "pos", 0).drop("turn")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Put the first turns of each group's first conversation in place of a conversation's own.

    Conversation c takes the first h = crc32(c in decimal) mod ``most`` turns of conversation c - c % ``group``, fewer if it
    has fewer, then its own after its first h. Returns the new turns and all conv_id, also of those left without a turn.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    firsts = turns.where((base == F.col("conv_id")) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "key", "chars")
    members = turns.where("pos = 0").select("conv_id", base.alias("base"), taken.alias("taken"))
    heads = members.join(firsts, "base").where("pos < taken").select("conv_id", "pos", "key", "chars")
    sizes = firsts.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    own = turns.withColumns({"base": base, "taken": taken}).where("pos >= taken").join(sizes, "base", "left")
    place = F.col("pos") - F.col("taken") + F.least("taken", F.coalesce("there", F.lit(0)))
    return heads.unionByName(own.select("conv_id", place.alias("pos"), "key", "chars")), members.select("conv_id")


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each sequence's end list; its pieces, sorted, are streamed one by one."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            *keys, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*NODE, "ids"])
            for key, text in zip(zip(*keys, strict=True), texts, strict=True):
                if key == now:
                    state.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(text.encode())
            if done:
                yield _batch(done)
        if now is not None:
            yield _batch([(*now, state.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NODE, "ends_sha256"])

    dealt = pieces.select(*NODE, "piece", F.array_join(F.transform("members", lambda c: c.cast("string")), ",").alias("ids"))
    sorted_ = dealt.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return sorted_.select(*NODE, "ids").mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def _collapsed(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Pieces of the end list of each distinct sequence: its key (length and fingerprint), ids in a range of PIECE, turns' chars."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("chars", "h1", "h2")]
    every = rows.unionByName(members.select("conv_id", F.lit(-1).cast("long").alias("pos"), *zero))
    whole = every.groupBy("conv_id").agg(
        F.sum((F.col("pos") >= 0).cast("long")).alias("depth"), F.bit_xor("h1").alias("f1"), F.bit_xor("h2").alias("f2"), F.sum("chars").alias("total")
    )
    piece = F.floor(F.col("conv_id") / PIECE).alias("piece")
    return whole.groupBy(*NODE, piece).agg(F.array_sort(F.collect_list("conv_id")).alias("members"), F.min("total").alias("total"))


def _prefixes(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """All prefixes of each sequence, the empty one too: node key, last turn's chars and hashes, chars of the path."""
    block = F.floor(F.col("pos") / BLOCK)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"b1": F.bit_xor("h1"), "b2": F.bit_xor("h2"), "b3": F.sum("chars")}
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(*[v.alias(k) for k, v in sums.items()])
    before = blocks.select("conv_id", "block", F.bit_xor("b1").over(earlier).alias("b1"), F.bit_xor("b2").over(earlier).alias("b2"), F.sum("b3").over(earlier).alias("b3")).where("block > 0")
    kept = rows.join(sequences.select(F.col("seq").alias("conv_id"), "weight", F.col("depth").alias("length"), "total"), "conv_id").withColumn("block", block)
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = kept.withColumns({"f1": F.bit_xor("h1").over(upto), "f2": F.bit_xor("h2").over(upto), "path": F.sum("chars").over(upto)})
    zero = F.lit(0).cast("long")
    carried = {k: F.coalesce(b, zero) for k, b in (("b1", F.col("b1")), ("b2", F.col("b2")), ("b3", F.col("b3")))}
    turns = inner.join(before, ["conv_id", "block"], "left").select(
        F.col("conv_id").alias("seq"), "weight", "length", "total", (F.col("pos") + 1).alias("depth"),
        F.col("f1").bitwiseXOR(carried["b1"]).alias("f1"), F.col("f2").bitwiseXOR(carried["b2"]).alias("f2"), "h1", "h2", "chars", (F.col("path") + carried["b3"]).alias("path"),
    )
    roots = sequences.select("seq", "weight", F.col("depth").alias("length"), "total", *[zero.alias(c) for c in ("depth", "f1", "f2", "h1", "h2", "chars", "path")])
    return turns.unionByName(roots)


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations' prefixes.

    ``turns`` has conv_id, pos (dense from 0), key and chars, as ``numbered_turns`` gives them; ``members`` every conv_id once,
    with turns or without. Returns per node conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, members but one times the chars of the last turn) and ends_sha256
    (of the ascending ids of members that end here, joined by commas). A node's last turn is turn depth - 1 of its conv_id.
    No conversations give no nodes.

    A prefix is known by its length and a 128-bit fingerprint, the exclusive or of its turns' hashed keys and places, so that
    long conversations are worked in blocks. Equal conversations are collapsed first; only one of them is spread into
    prefixes, with their number as weight. Sequences that are no proper prefix of another (anti join) are the leaves.
    Subtree sums need no walk: the chars of distinct nodes are those of each sequence from the node on which it owns (has
    the smallest id), as owned nodes are the end of a sequence.
    """
    hashed = [F.xxhash64(F.lit(k), "key", "pos").alias(f"h{k}") for k in (1, 2)]
    rows = stored(turns.select("conv_id", "pos", "chars", *hashed))
    pieces = stored(_collapsed(rows, members))
    sequences = pieces.groupBy(*NODE).agg(F.min(F.element_at("members", 1)).alias("seq"), F.sum(F.size("members")).alias("weight"), F.min("total").alias("total"))
    prefixes = stored(_prefixes(rows, sequences))

    distinct = stored(prefixes.groupBy(*NODE).agg(F.min("seq").alias("seq"), F.max("length").alias("longest"), F.min(F.col("path") - F.col("chars")).alias("above")))
    leaves = sequences.join(distinct.where("longest > depth").select(*NODE), NODE, "left_anti").select("seq", F.lit(1).alias("leaf"))
    owned = distinct.groupBy("seq").agg(F.min_by("above", "depth").alias("above"))
    facts = sequences.select("seq", "total").join(leaves, "seq", "left").join(owned, "seq", "left")
    facts = facts.select("seq", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce(F.col("total") - F.col("above"), F.lit(0)).alias("own"))

    below = F.col("total") - F.col("path") + F.col("chars")
    summed = prefixes.join(facts, "seq").groupBy(*NODE).agg(
        F.min("seq").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * below).alias("all_chars"),
        (F.sum("own") - F.min_by("own", "seq") + F.min_by(below, F.col("seq"))).alias("distinct_chars"),
        F.min("h1").bitwiseXOR(F.col("f1")).alias("p1"),
        F.min("h2").bitwiseXOR(F.col("f2")).alias("p2"),
    )
    nodes = stored(summed.withColumn("saved_tokens", F.col("all_chars") - F.col("distinct_chars")).drop("all_chars", "distinct_chars"))
    upper = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")]
    children = nodes.where("depth > 0").groupBy(*upper).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, ["depth", "p1", "p2"], "left").join(children, NODE, "left").join(_digests(pieces), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are, without shared heads."""
    turns = numbered_turns(conversations)
    return prefix_trie(turns, turns.where("pos = 0").select("conv_id"))
