"""Pipeline operators on the smallest tables, against plain Python or held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kymora.llm import packing, queries
from kymora.llm.bit_sliced import highest, scores, sliced
from kymora.llm.components import components, contracted_components

SF = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(sf=SF):
    return duckdb.connect().execute(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()


def run(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(FOLD))


def brute_near(rows, size=5):
    """doc_id -> (class_id, n_links, n_copies) by comparing all pairs of different shingle sets."""
    sets = {}
    for d, text in rows:
        w = words(text)
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    copies = defaultdict(list)
    for d, s in sets.items():
        copies[s].append(d)
    texts = list(copies)
    parent, links = list(range(len(texts))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            both = len(a & texts[j])
            if both and 10 * both >= 8 * (len(a) + len(texts[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, s in enumerate(texts):
        members[root(i)] += copies[s]
    return {d: (min(members[root(i)]), links[i], len(copies[s])) for i, s in enumerate(texts) for d in copies[s]}


def brute_passages(rows, least=30):
    seen, out = set(), {}
    for d, text in rows:
        body = (text or "").encode()
        spans = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c\0]+", body)]
        w = [body[a:b] for a, b in spans]
        gone = set()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            gone.update(range(i, i + least) if key in seen else ())
            seen.add(key)
        stops = [a for a, _ in spans] + [len(body)]
        out[d] = (body[: stops[0]] + b"".join(body[stops[k] : stops[k + 1]] for k in range(len(w)) if k not in gone)).decode()
    return out


def test_line_dedup_finds_passages_wherever_they_are_pasted(spark):
    from kymora.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(3)

    def say(n, dots=0.0):
        return [f"w{k}" + "." * int(rng.random() < dots) for k in rng.integers(0, 4000, n)]

    passage, phrase = say(51, 0.1), say(33)
    rows = [(0, " ".join(say(80) + passage + say(40)))]
    rows += [(d, " ".join(say(20 + d) + passage + say(d))) for d in range(1, 6)]
    rows += [(6, "glued" + " ".join(passage) + "glued " + " ".join(say(9)))]
    rows += [(7, " ".join(say(10)) + "\n" + "\n".join(passage[:25]) + " edit " + " ".join(passage[25:]))]
    rows += [(8, " ".join(say(5) + phrase * 4 + say(5))), (9, " ".join(say(30) + passage[:30] + say(2))), (10, " ".join(passage[:29]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.deleted_bytes) for r in dedup_lines(docs).collect()}
    assert {d: t for d, (t, _) in got.items()} == brute_passages(rows)
    assert all(n == len(t.encode()) - len(got[d][0].encode()) for d, t in rows for n in [got[d][1]])
    assert [len(got[d][0].split()) for d in (0, 1, 5, 6, 8, 9, 10)] == [171, 22, 30, 11, 43, 32, 29]


def test_line_dedup_equals_brute_force(spark):
    assert {r.doc_id: r.text for r in run(spark, "op5_line_dedup")} == brute_passages(documents())


def test_near_duplicates_equal_brute_force(spark):
    want = brute_near(documents())
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in run(spark, "op10_ngram_jaccard_join")} == want


def test_large_near_duplicate_group_is_split_into_blocks(spark, monkeypatch):
    from kymora.llm import lsh_forest

    monkeypatch.setattr(lsh_forest, "BLOCK", 7)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for d in range(1, 40):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 4)):
            text[at] = f"x{d}"
        rows.append((d, " ".join(text)))
    rows += [(100 + d, " ".join(f"y{d}_{k}" for k in range(50))) for d in range(20)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == brute_near(rows)


def planted_pairs(rng, low, high, pairs, words=120):
    """Texts 2k and 2k + 1 whose sets of five words have a similarity between ``low`` and ``high``."""
    rows = []
    while len(rows) < 2 * pairs:
        base = [f"w{x}" for x in rng.integers(0, 10**7, words)]
        other = list(base)
        for at in rng.choice(words, rng.integers(1, 5), replace=False):
            other[at] = f"x{rng.integers(0, 10**7)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(words - 4)} for t in (base, other))
        if low <= len(a & b) / len(a | b) < high:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize(("low", "high", "length"), [(0.8, 0.82, 4), (0.8, 0.85, 5), (0.9, 0.95, 6)])
def test_forest_shortens_prefixes_as_far_as_the_data_need(spark, low, high, length):
    from kymora.llm import lsh_forest as forest

    rows = planted_pairs(np.random.default_rng(12), low, high, 1500)
    seen = []
    adapt = forest.adapted_clusters
    forest.adapted_clusters = lambda *a: seen.append(adapt(*a)) or seen[-1]
    try:
        got = {r.doc_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        forest.adapted_clusters = adapt
    linked = [got[d].class_id == got[d + 1].class_id == d for d in range(0, len(rows), 2)]
    assert np.mean(linked) >= 0.999 and seen[0][1] == length


def test_forest_edges_join_what_common_prefixes_join(spark, monkeypatch):
    from kymora.llm import lsh_forest as forest

    monkeypatch.setattr(forest, "FLOOR", 0.0)
    rng = np.random.default_rng(13)
    n, L, T = 90, forest.LONGEST, forest.TREES
    labels = rng.integers(0, 2, (n, T, L)).astype(np.uint8)
    labels[:, :, : forest.shortest_prefix()] = labels[:, :1, :1]
    rows = [(5, bytes([k]), labels[k].tobytes(), 3) for k in range(n) if labels[k, 0, 0] == 0]
    edges = forest.forest_edges(spark.createDataFrame(rows, "cell long, key binary, signature binary, tree int")).collect()
    alive = [r[1][0] for r in rows]
    assert len(edges) == len(alive) - 1
    for length in range(forest.shortest_prefix(), L + 1):
        groups = defaultdict(set)
        for k in alive:
            groups[labels[k, 3, :length].tobytes()].add(k)
        parent = {k: k for k in alive}
        for e in edges:
            if e.length >= length:
                a, b = e.a[0], e.b[0]
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[a] = b
        found = defaultdict(set)
        for k in alive:
            r = k
            while parent[r] != r:
                r = parent[r]
            found[r].add(k)
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("find", [components, contracted_components, lambda e: contracted_components(e, 40)])
def test_components_of_a_shuffled_path(spark, find):
    n = 200
    ids = np.random.default_rng(5).permutation(n).tolist()
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7000, 7000)], "a long, b long")
    got = {r.node: r.component for r in find(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_hidden_markov_base_is_exact_and_model_beats_it(spark):
    counts, texts = Counter(), {}
    for d, text in documents():
        texts[d] = (text or "").encode().lower().split() + [b"\n"]
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(texts[d])
    total, kinds = sum(counts.values()), len(counts)
    better = 0
    for r in run(spark, "op2_hidden_markov_scores"):
        w = texts[r.doc_id]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score)
        better += r.score > r.base_score
    assert better > 0.85 * len(texts)


def test_forward_equals_sum_over_all_state_paths():
    from itertools import product

    from kymora.llm.hidden_markov import Chain, expected_counts, forward

    rng = np.random.default_rng(2)
    emit = rng.random((6, 3))
    chain = Chain(np.array([0.2, 0.5, 0.3]), rng.dirichlet(np.ones(3), 3), emit / emit.sum(axis=0))
    lines = [np.array([0, 3, 5, 1]), np.array([2]), np.array([4, 4, 0, 1, 5, 2])]
    for line, got in zip(lines, forward(chain, lines), strict=True):
        paths = 0.0
        for path in product(range(3), repeat=len(line)):
            p = chain.start[path[0]] * chain.emit[line[0], path[0]]
            for t in range(1, len(line)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[line[t], path[t]]
            paths += p
        assert got == pytest.approx(math.log10(paths))
    start, move, seen = expected_counts(chain, lines)
    assert start.sum() == pytest.approx(3) and move.sum() == pytest.approx(11 - 3) and seen.sum() == pytest.approx(11)


def test_expected_counts_equal_sums_over_all_state_paths():
    from itertools import product

    from kymora.llm.hidden_markov import Chain, expected_counts

    rng = np.random.default_rng(6)
    chain = Chain(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    lines = [np.array([0, 3, 4, 1, 1]), np.array([2]), np.array([4, 4, 0, 1, 2, 2, 3]), np.array([1, 1])]
    start, move, seen = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for line in lines:
        weights = {}
        for path in product(range(3), repeat=len(line)):
            p = chain.start[path[0]] * chain.emit[line[0], path[0]]
            for t in range(1, len(line)):
                p *= chain.move[path[t - 1], path[t]] * chain.emit[line[t], path[t]]
            weights[path] = p
        whole = sum(weights.values())
        for path, p in weights.items():
            start[path[0]] += p / whole
            for t, state in enumerate(path):
                seen[line[t], state] += p / whole
                if t:
                    move[path[t - 1], state] += p / whole
    for limit in (1, 4, 7, 1 << 18):
        got = expected_counts(chain, lines, limit)
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(got, (start, move, seen), strict=True))


def test_a_distributed_round_equals_a_plain_one(spark):
    from kymora.llm import hidden_markov as M

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = M.symbols(M.word_counts(docs), 500)
    sequences = M.encoded(docs, spark.sparkContext.broadcast(known)).cache()
    chain = M.baum_welch(sequences.repartition(5), known, 4, 1)
    lines = [np.frombuffer(r.symbols, "<u2") for r in sequences.collect()]
    want = M.improved(M.expected_counts(M.first_chain(known, 4), lines), known.mass / known.mass.sum())
    assert np.allclose(chain.emit, want.emit, rtol=1e-9) and np.allclose(chain.move, want.move, rtol=1e-9) and np.allclose(chain.start, want.start, rtol=1e-9)


def test_scores_do_not_depend_on_partitions(spark):
    from kymora.llm import hidden_markov as M

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    runs = [{r.doc_id: r.score for r in M.hmm_scores(docs.repartition(n)).collect()} for n in (1, 3, 8)]
    assert all(runs[0][d] == pytest.approx(r[d], rel=1e-6) for r in runs[1:] for d in runs[0]) and len(runs[0]) == 200


def held_out_accuracy(spark, name, label):
    labels = dict(duckdb.connect().execute(f"select doc_id, {label} from '{MEDIUM}/labels.parquet'").fetchall())
    rows = [r for r in run(spark, name, MEDIUM) if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    return np.mean([r.predicted == labels[r.doc_id] for r in rows])


def test_quality_on_the_held_out_fold(spark):
    assert held_out_accuracy(spark, "op4_quality_classifier", "quality") > 0.94


def test_toxicity_on_the_held_out_fold(spark):
    assert held_out_accuracy(spark, "op6_toxicity", "toxic") > 0.94


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.VOCABULARY)
    want = {}
    for d, text in documents():
        ids = coder.encode(text or "", add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[lo : lo + 2048], "<u4")
            want[d, k] = (lo, len(part), zlib.crc32(part.tobytes()))
    rows = run(spark, "op7_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts[:-1]]).tolist() and sum(n for _, n in parts) <= 2048
    assert len(places) <= 1.05 * sum(n for _, n, _ in want.values()) / 2048 + 1


def test_coder_equals_the_tokenizer_on_odd_texts():
    code = packing.Coder(queries.VOCABULARY)
    texts = ["", "It's A Test, isn't it?", "a\x1cb \x1fc", "x\xa0y zß", "İstanbul ΣΑΣ. éa ́b", "<|endoftext|> a<|endoftext|>b", "don't!!! 12345 ñandú's"]
    texts += [f"a{chr(c)}B{chr(c)} c" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    whole = code.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in code.encode(texts)] == [e.ids for e in whole]


def test_sum_of_squares_choice():
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 4, 4, 10, 3, 3, 3]), 10)
    assert sorted(bins.tolist()[:2]) == sorted(bins.tolist()[2:4]) == [0, 1] and bins[4] == 2 and len(set(bins[5:].tolist())) == 1 and offsets.tolist()[5:] == [0, 3, 6]


def test_new_sequence_only_where_no_open_one_fits():
    lengths = np.sort(np.random.default_rng(4).gamma(2.0, 330.0, 6000).astype(int).clip(1, 2048))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 2048)
    left = []
    for n, b in zip(lengths.tolist(), bins.tolist(), strict=True):
        if b == len(left):
            assert max(left, default=0) < n
            left.append(2048)
        left[b] -= n
    assert min(left) >= 0 and len(left) <= 1.005 * lengths.sum() / 2048 + 1


def test_rollup_equals_counting_what_is_left(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.VOCABULARY)
    rows = duckdb.connect().execute(f"select doc_id, text, source, lang from '{SF}/documents.parquet' order by 1").fetchall()
    want, seen = defaultdict(lambda: [0, 0]), set()
    for _, text, source, lang in rows:
        if text in seen:
            continue
        seen.add(text)
        for kind, n in (("white_space-1", len(text.split())), ("word_bpe_49k-1", len(coder.encode(text, add_special_tokens=False).ids) + 1)):
            want[source, lang, kind][0] += 1
            want[source, lang, kind][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in run(spark, "op8_token_count_rollup")}
    assert got == want


def test_rollup_batches_count_once(spark, tmp_path):
    from kymora.llm import rollups

    rollup = rollups.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().collect() == [] and not rollup.committed("one")
    counts = spark.createDataFrame([("a", None, "t", 5, 7), ("a", None, "t", 5, 7), (None, "en", "t", None, 1)], "source string, lang string, tokenizer string, n_tokens long, revised long")
    assert rollup.commit("one", rollups.inserts(counts)) and not rollup.commit("one", rollups.inserts(counts))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", None, "t", 2, 10), (None, "en", "t", 1, 0)}
    assert rollup.commit("two", rollups.revisions(counts.where("source = 'a'"), "revised"))
    assert ("a", None, "t", 2, 14) in {tuple(r) for r in rollup.totals().collect()}
    assert rollup.commit("three", rollups.deletes(counts.where("source is null"))) and all(rollup.committed(b) for b in ("one", "two", "three"))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", None, "t", 2, 14)]


def test_rollup_of_many_writers_and_lost_ones(spark, tmp_path):
    from kymora.llm import rollups

    one, other = (rollups.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    counts = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, n_tokens long")
    publish = other._publish
    # two batches at once: the second is written and published while the first one is between its two steps
    one._publish = lambda file, attempt: other.commit("second", rollups.inserts(counts)) and publish(file, attempt)
    assert one.commit("first", rollups.inserts(counts))
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "t", 2, 10)]
    # one batch twice at once: one of them counts
    won = []
    one._publish = lambda file, attempt: won.append(other.commit("third", rollups.inserts(counts))) or publish(file, attempt)
    assert not one.commit("third", rollups.inserts(counts)) and won == [True]
    # a writer is lost before its file, another one before its file has content
    one._publish = lambda file, attempt: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        one.commit("fourth", rollups.inserts(counts))
    (tmp_path / "r" / rollups.Rollup._file("fifth")).touch()
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "t", 3, 15)]
    assert other.commit("fourth", rollups.inserts(counts)) and other.commit("fifth", rollups.inserts(counts)) and not other.commit("fifth", rollups.inserts(counts))
    other.compact()
    assert other.commit("none", rollups.inserts(counts.limit(0))) and other.commit("sixth", rollups.deletes(counts))
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "t", 4, 20)]
    other.compact()
    other.compact()
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "t", 4, 20)] and not other.commit("second", rollups.inserts(counts))


@pytest.mark.parametrize("seed", range(4))
def test_bit_sliced_sums_and_selection(seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-9, 9, (200, 6)), rng.integers(-9, 9, 6)
    maps, least, width = sliced(x)
    sums, constant = scores(maps, least, width, q)
    bits = np.stack([np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(np.int64) << w for w, s in enumerate(sums)])
    assert (bits.sum(axis=0) + constant == x @ q).all()
    every = np.append(np.packbits(np.ones(200, np.uint8), bitorder="little"), np.zeros(7, np.uint8)).view(np.uint64)
    for k in (1, 5, 199, 300):
        assert sorted(highest(sums, every, k)) == sorted(np.lexsort((np.arange(200), -(x @ q)))[:k])


def test_pipeline_stages_follow_each_other(spark):
    """Each stage's decision on its own input, by plain Python where there is a plain form."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]

    def rows(df):
        return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]

    good = stages["quality_classifier"](spark, docs, SF).cache()
    assert good.columns == names and 0.6 < good.count() / docs.count() < 1
    lined = stages["line_dedup"](spark, good, SF).cache()
    assert lined.columns == names and dict(rows(lined)) == brute_passages(rows(good))
    single = stages["ngram_jaccard_join"](spark, lined, SF).cache()
    classes = brute_near(rows(lined))
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == sorted({c for c, _, _ in classes.values()})
    clean = stages["benchmark_decontamination"](spark, single, SF).cache()
    windows = set()
    for _, text in duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall():
        w = words(text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}

    def dirty(text):
        w = words(text)
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert clean.columns == names and rows(clean) == [(d, t) for d, t in rows(single) if not dirty(t)]
    packed = stages["best_fit_packing"](spark, clean, SF)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_decontamination_digest(spark):
    rows = run(spark, "op9_benchmark_decontamination", MEDIUM)
    assert any(r.contaminated for r in rows)
    assert all((r.n_items == 0) == (r.items_sha256 == hashlib.sha256(b"").hexdigest()) for r in rows)


def test_forest_judges_a_prefix_on_every_link(spark):
    """Each link of every cluster says how many links it stands for; no sample of clusters or texts is left."""
    from kymora.llm import lsh_forest as forest
    from pyspark.sql import functions as F

    rows = planted_pairs(np.random.default_rng(14), 0.8, 0.82, 60)
    sets = [{"key": str(d).encode(), "component": d // 2, "size": 2, "text": t} for d, t in rows]
    dealt = forest.cells(spark.createDataFrame(sets, "key binary, component long, size long, text string"), "component", F.col("size"))
    checked = forest.verified_links(dealt, 0.8, 5, 6).collect()
    assert len(checked) == 120 and all(r.links == 1 for r in checked)
    low, high = (1e6 / forest.met(s, 6) for s in (0.82, 0.8))
    assert all(low - 1 <= r.stands <= high + 1 for r in checked)
    assert not hasattr(forest, "JUDGED") and not hasattr(forest, "link_similarities")


def test_forest_finds_a_lone_link_that_longest_prefixes_miss(spark):
    """No link met at a length is no proof that there is none: the prefix is shortened until the threshold itself is met."""
    from kymora.llm import lsh_forest as forest

    rows, changed = [], (50, 54, 58)
    for k in range(2500):
        words = [f"w{k}x{i}" for i in range(121)]
        # 13 of 117 shingles differ: 104 of 130 are common, the threshold itself
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join("x" if i in changed else w for i, w in enumerate(words)))]
    signed = {r.doc_id: r for r in forest.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = []
    for d in range(0, len(rows), 2):
        a, b = (np.frombuffer(signed[d + k].signature, np.uint8).reshape(forest.TREES, forest.LONGEST) for k in (0, 1))
        together = np.array(signed[d].buckets) == np.array(signed[d + 1].buckets)
        longest = np.logical_and.accumulate(a == b, axis=1).sum(axis=1)[together].max(initial=0)
        if forest.shortest_prefix() <= longest < forest.LONGEST:
            pairs.append(rows[d : d + 2])
    assert pairs
    got = forest.near_duplicates(spark.createDataFrame(pairs[0], "doc_id long, text string")).collect()
    assert [(r.class_id, r.n_links) for r in got] == [(pairs[0][0][0], 1)] * 2
