"""Random indexing, pooling, slopes and temperature of the quality classifier, against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from kymora.llm import quality as Q

TEXTS = ["one two three two", None, "", "solo", "a b c d e f g one two", "  gaps \n and\tlines  ", "x " * 700]


def words(text):
    return re.findall(r"[^ \t\n\r\x0b\x0c]+", text or "")


def row_of(word):
    return int(Q._rows_of(pa.array([word]))[0][0])


def test_context_vectors_are_sums_of_neighbours(spark):
    places, signs = Q.index_vectors()
    want = np.zeros((Q.ROWS, Q.WIDTH))
    for text in TEXTS:
        rows = [row_of(w) for w in words(text)]
        for i, r in enumerate(rows):
            for j in range(max(0, i - Q.REACH), min(len(rows), i + Q.REACH + 1)):
                if i != j:
                    for k in range(Q.PLACES):
                        want[r, places[k][rows[j]]] += signs[k][rows[j]]
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = np.zeros((Q.ROWS, Q.WIDTH))
    for r in Q.context_vectors(docs).collect():
        got[r.row] = [r[f"v{j}"] for j in range(Q.WIDTH)]
    assert (got == want).all()
    norms = np.linalg.norm(want, axis=1)
    table = Q.word_table(Q.context_vectors(docs))
    assert np.allclose(np.linalg.norm(table[norms > 0], axis=1), 1, atol=1e-6) and not table[norms == 0].any()


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 18])
def test_pooling_in_blocks(block):
    table = np.random.default_rng(3).normal(size=(Q.ROWS, Q.WIDTH)).astype(np.float32)
    got = Q.pooled(pa.array(TEXTS), table, block)
    for text, x in zip(TEXTS, got, strict=True):
        v = [table[row_of(w)].astype(float) for w in words(text)]
        n = len(v)
        parts = [np.zeros(Q.WIDTH)] * 3 if not n else [sum(v) / n, sum(a * a for a in v) / n, sum((a * b for a, b in zip(v, v[1:])), np.zeros(Q.WIDTH)) / n]
        assert np.allclose(x, [*np.concatenate(parts), math.log1p(n)], atol=1e-4)


def test_slopes_equal_numeric_differences():
    rng = np.random.default_rng(4)
    net = Q.Network(5, hidden=3)
    x, y, decay = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float), 0.01

    def loss():
        z = net.logits(x)
        return np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * ((net.p[0] ** 2).sum() + (net.p[2] ** 2).sum())

    for p, g in zip(net.p, net.slopes(x, y, decay), strict=True):
        for at in np.ndindex(p.shape):
            keep = p[at]
            p[at] = keep + 1e-6
            up = loss()
            p[at] = keep - 1e-6
            down = loss()
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_temperature_is_the_best_of_the_grid():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + rng.normal(0, 1.5, 400) > 0).astype(float)
    net = Q.Network(4).fit(x, y)
    z, yy = net.logits(x[4::5]), y[4::5]
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - yy * z / t)
    assert 0.5 <= net.temperature <= 10.01 and all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(np.log(0.5), np.log(10), 60)))
    assert net.probability(x) == pytest.approx(1 / (1 + np.exp(-net.logits(x) / net.temperature)))
