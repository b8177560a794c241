"""Learned pooling: scores and pooled vectors against numpy, gradients against finite differences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import attention as A


def token_rows(d=4, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for doc in (None, 1, 2, 3, 4):
        for pos in range(5):
            mask = 0 if doc == 4 or pos == 4 else 1
            vec = None if (doc, pos) == (2, 1) else [float("nan")] * d if pos == 4 else rng.normal(size=d).tolist()
            rows.append((doc, pos, mask, vec))
    return rows


def squares(pooled, truth):
    y = np.stack(truth["y"].to_numpy()).astype(float)
    return ((pooled - y) ** 2).sum(1), 2 * (pooled - y)


def test_scores_equal_the_formula():
    s = A.Scorer.initial(3, 5)
    s.scale, s.shift = np.array([1.5, 0.5, -1.0]), np.array([0.1, -0.2, 0.3])
    x = np.random.default_rng(1).normal(size=(7, 3))
    for row, got in zip(x, s.score(x)):
        z = [sum(row[i] * s.w1[i, j] for i in range(3)) + s.b1[j] for j in range(3)]
        mean = sum(z) / 3
        sd = math.sqrt(sum((v - mean) ** 2 for v in z) / 3 + 1e-5)
        n = [(v - mean) / sd * s.scale[j] + s.shift[j] for j, v in enumerate(z)]
        assert got == pytest.approx(sum(v * 0.5 * (1 + math.erf(v / math.sqrt(2))) * s.w2[j] for j, v in enumerate(n)) + s.b2)


def pooled_by_hand(rows, scorer):
    out = {}
    for doc in {r[0] for r in rows}:
        x = np.array([v for d, _, m, v in rows if d == doc and m and v is not None])
        if len(x):
            e = np.exp(scorer.score(x))
            out[doc] = (e[:, None] * x).sum(0) / e.sum()
    return out


def test_attention_gradients_equal_finite_differences(spark):
    rows = token_rows()
    scorer = A.Scorer.initial(4, 3)
    df = spark.createDataFrame(rows, "doc int, pos int, mask int, vec array<double>").withColumn("score", F.lit("x")).repartition(3)
    want = pooled_by_hand(rows, scorer)
    got = {r.doc: r.pooled for r in A.learned_attention_pool(df, scorer).collect()}
    assert set(got) == {None, 1, 2, 3, 4} and got[4] is None
    assert all(np.allclose(got[d], want[d]) for d in want)
    truth = [(d, [0.5 * (d or 7), 1.0, -1.0, 0.25]) for d in (None, 1, 2, 4)]       # group 3 has no truth, group 4 no real row
    grad, value = A.attention_gradients(df, scorer, spark.createDataFrame(truth, "doc int, y array<double>"), squares)

    def loss(flat):
        p = pooled_by_hand(rows, scorer.like(flat))
        return sum(((p[d] - np.array(y)) ** 2).sum() for d, y in truth if d in p)

    flat = scorer.flat()
    assert value == pytest.approx(loss(flat))
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        assert grad[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, rel=1e-4, abs=1e-6)
    lower = scorer.like(flat - 0.01 * grad)
    assert loss(lower.flat()) < loss(flat)


def test_layer_gradients_equal_finite_differences(spark):
    rng = np.random.default_rng(4)
    rows = [(d, p, k, rng.normal(size=3).tolist()) for d in range(3) for p in range(2) for k in range(5) if (d, p, k) != (1, 1, 3)]
    df = spark.createDataFrame(rows, "doc int, pos int, layer int, vec array<double>").repartition(4)
    truth = spark.createDataFrame([(d, p, [0.1 * d, 1.0, -p * 1.0]) for d in range(3) for p in range(2)], "doc int, pos int, y array<double>")
    weights = np.array([1.0, 0.5, 2.0])
    grad, value = A.layer_gradients(df, weights, truth, squares, start=2)

    def loss(w):
        total = 0.0
        for d in range(3):
            for p in range(2):
                mine = [(w[k - 2], np.array(v)) for a, b, k, v in rows if (a, b) == (d, p) and k >= 2]
                mean = sum(x * v for x, v in mine) / sum(x for x, _ in mine)
                total += ((mean - np.array([0.1 * d, 1.0, -p * 1.0])) ** 2).sum()
        return total

    assert value == pytest.approx(loss(weights))
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert grad[i] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-6, rel=1e-5)
