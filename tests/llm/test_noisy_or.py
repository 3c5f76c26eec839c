"""Noisy-or of sentence scores and its slopes, against plain formulas and numeric differences."""

import math

import numpy as np
import pytest

from kymora.llm.toxicity import FEATURES, NoisyOr


@pytest.fixture
def model():
    rng = np.random.default_rng(1)
    out = NoisyOr()
    out.weights, out.bias = np.zeros(FEATURES), -1.5
    out.weights[:50] = rng.normal(0, 1, 50)
    return out


def bags(rng, n=12):
    out = []
    for k in range(n):
        sizes = rng.integers(1, 5, rng.integers(0, 4)) if k else np.zeros(0, np.int64)
        out.append((int(rng.integers(0, 2)), rng.integers(0, 50, int(sizes.sum())), sizes, int(rng.integers(0, 3))))
    return out


def loss(model, part):
    total = 0.0
    for y, feature, sizes, plain in part:
        none, at = (1 - 1 / (1 + math.exp(-model.bias))) ** plain, 0
        for size in sizes:
            none *= 1 - 1 / (1 + math.exp(-(model.bias + model.weights[feature[at : at + size]].sum())))
            at += size
        total -= math.log(max(1 - none, 1e-300) if y else none)
    return total / len(part)


def test_document_score_is_one_minus_the_product(model):
    rng = np.random.default_rng(2)
    feature, begin, owner = rng.integers(0, 50, 30), np.array([0, 4, 9, 20]), np.array([0, 0, 2, 2])
    p = model.sentence(feature, begin)
    want = [1 / (1 + math.exp(-(model.bias + model.weights[feature[a:b]].sum()))) for a, b in ((0, 4), (4, 9), (9, 20), (20, 30))]
    assert p == pytest.approx(want)
    assert -np.expm1(model.document(p, owner, 3)) == pytest.approx([1 - (1 - want[0]) * (1 - want[1]), 0, 1 - (1 - want[2]) * (1 - want[3])])


def test_slopes_equal_numeric_differences(model):
    part = [b for b in bags(np.random.default_rng(3)) if len(b[2]) or b[3] or not b[0]]
    slopes, slope = model.slopes(part)
    step = 1e-6
    for k in range(50):
        model.weights[k] += step
        up = loss(model, part)
        model.weights[k] -= 2 * step
        down = loss(model, part)
        model.weights[k] += step
        assert slopes[k] == pytest.approx((up - down) / (2 * step), abs=1e-6)
    model.bias += step
    up = loss(model, part)
    model.bias -= 2 * step
    assert slope == pytest.approx((up - loss(model, part)) / (2 * step), abs=1e-6) and not slopes[50:].any()
