"""Fitted stages against independent numpy: gradients, descent, Newton solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import scores as S
from foldwise.operators import fitting as N
from foldwise.operators import oof as O


def table(spark, n=240, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.array([1.0, 5.0, 0.2])[:d]
    y = np.stack([np.sin(x[:, 0]) + 0.1 * x[:, 1], x[:, 1] - x[:, 0] ** 2], 1)
    level = np.clip(np.round(4 + x[:, 0] + rng.normal(size=n)), 0, 8).astype(int)
    rows = [(i, i % 3, x[i].tolist(), float(y[i, 0]), float(y[i, 1]), int(level[i]), int((level[i] * 2 + i) % 9)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, fold int, x array<double>, a double, b double, la int, lb int").repartition(5), x, y, rows


def test_network_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    net = N.Network([4, 5, 3, 2])
    flat, x, y = net.initial(7) + 0.1 * rng.normal(size=net.size), rng.normal(size=(20, 4)), rng.normal(size=(20, 2))
    got = net.gradient(flat, x, y)
    loss = lambda p: ((net.forward(p, x) - y) ** 2).sum()
    for i in range(net.size):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert got[i] == pytest.approx((loss(up) - loss(down)) / 2e-6, rel=1e-4, abs=1e-5)
    assert got[-2] == pytest.approx(loss(flat)) and got[-1] == 40


def test_summed_gradients_leave_the_held_out_fold_out(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 7)
    df, x, y, rows = table(spark)
    net = N.Network([3, 6, 2])
    models = {f: net.initial(f) for f in range(3)}
    mean, std = x.mean(0), x.std(0, ddof=1)
    got = N.network_gradients(df, "x", ["a", "b"], net, models, mean, std)
    held = np.array([r[1] for r in rows])
    for f, flat in models.items():
        want = net.gradient(flat, ((x - mean) / std)[held != f], y[held != f])
        assert np.allclose(got[f][0], want[:-2] / want[-1]) and got[f][1] == pytest.approx(want[-2] / want[-1])
    with pytest.raises(ValueError, match="no training rows"):
        N.network_gradients(df.where("fold = 1"), "x", ["a", "b"], net, models, mean, std)


def test_network_beats_ridge_on_a_bent_target(spark):
    df, _, _, _ = table(spark)
    model = N.fit_network_folds(df, "x", ["a", "b"], 3, hidden=(16, 8), steps=120, rate=0.03)
    error = {}
    for name, m in (("network", model), ("ridge", O.fit_ridge_folds(df, "x", ["a", "b"], lam=1.0))):
        error[name] = O.predict_ridge(df, m, "id", "x").agg(F.avg(F.pow(F.col("y") - F.col("pred"), 2))).first()[0]
    assert error["network"] < 0.5 * error["ridge"]
    assert all(loss[-1] < 0.2 * loss[0] for loss in model.losses.values())


def direct_newton(x, levels, eps, steps=60):
    """Weights of one target's scorer by plain damped Newton steps, independent of the library."""
    design = np.hstack([np.ones((len(x), 1)), x])
    want = np.eye(9)[levels] * (1 - eps) + eps / 9
    w = np.zeros((9, design.shape[1]))
    for _ in range(steps):
        z = design @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = (p - want).T @ design
        hess = sum(np.kron(np.diag(q) - np.outer(q, q), np.outer(r, r)) for q, r in zip(p, design))
        w = w - 0.7 * (np.linalg.pinv(hess, rcond=1e-10) @ grad.ravel()).reshape(w.shape)
    return p


def test_class_folds_equal_direct_newton(spark):
    df, x, _, rows = table(spark, n=150, d=2)
    model = N.fit_class_folds(df, "x", ["la", "lb"], 3, eps=0.1)
    assert model.gradients[-1] <= 1e-9 and len(model.gradients) < 15
    held = np.array([r[1] for r in rows])
    for j, col in ((0, 5), (1, 6)):
        levels = np.array([r[col] for r in rows])
        own = held != 2
        z = model.logits_np(x[own], 2).reshape(-1, 9, 2)[:, :, j]
        p = np.exp(z - z.max(1, keepdims=True))
        assert np.allclose(p / p.sum(1, keepdims=True), direct_newton(x[own], levels[own], 0.1), atol=1e-6)


def test_class_logits_feed_the_score_functions(spark):
    df, x, _, rows = table(spark, n=150, d=2)
    model = N.fit_class_folds(df, "x", ["la", "lb"], 3)
    got = N.class_logits(df, model, "x", keep=["id"]).select(
        "id", "fold", "z", S.decode_level(S.top_level(S.softmax(S.target_levels("z", 0, 9, 2)))["level"]).alias("s")).collect()
    assert len(got) == 150
    for r in got:
        z = model.logits_np(x[r.id:r.id + 1], r.fold)[0]
        assert r.fold == rows[r.id][1] and np.allclose(r.z, z) and r.s == 1 + 0.5 * z[0::2].argmax()
    assert N.class_logits(df, model, "x", fold=None, keep=["id"]).count() == 450
