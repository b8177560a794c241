import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics as M
from foldwise.operators import oof as O
from foldwise.plans.q_stack import embedding_folds
from tests.conftest import SF01


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id long, fold int, g string, y double")


def test_group_mean_fallback_when_group_only_in_held_out_fold(spark):
    df = _rows(spark, [(1, 0, "a", 1.0), (2, 1, "a", 3.0), (3, 1, "b", 10.0), (4, 0, "c", 5.0)])
    out = {r["id"]: r["pred"] for r in O.oof_group_mean(df, "id", "g", ["y"]).collect()}
    assert out[1] == 3.0          # group a in fold 1
    assert out[3] == 3.0          # group b only in its own fold -> fold 0 mean (1+5)/2
    assert out[4] == pytest.approx((3.0 + 10.0) / 2)


def test_oof_no_leak(spark):
    rows = [(i, i % 3, "g%d" % (i % 4), float(i % 5)) for i in range(60)]
    a = O.oof_group_mean(_rows(spark, rows), "id", "g", ["y"])
    changed = [(i, f, g, y + 100 if f == 1 else y) for i, f, g, y in rows]
    b = O.oof_group_mean(_rows(spark, changed), "id", "g", ["y"])
    pa = {r["id"]: r["pred"] for r in a.filter("fold = 1").collect()}
    pb = {r["id"]: r["pred"] for r in b.filter("fold = 1").collect()}
    assert pa == pb


def test_mcrmse_anchor(spark):
    import __spark_entry__ as e
    from foldwise.plans.q_folds import m2_mcrmse
    r = m2_mcrmse(spark, SF01).first()
    assert (r["quality_rmse"], r["toxic_rmse"], r["mcrmse"]) == (0.353469, 0.336706, 0.345088)
    assert e.entry(spark).count() == 1


def test_rmse_rejects_missing(spark):
    df = spark.createDataFrame([("t", 1.0, float("nan"))], "target string, y double, pred double")
    with pytest.raises(Exception):
        M.rmse(df).collect()


def test_ridge_by_subtraction_equals_naive(spark):
    df = embedding_folds(spark, SF01)
    lam = 1.0
    model = O.fit_ridge_folds(df, "x", ["label"], lam)
    pdf = df.toPandas()
    X = np.stack(pdf["x"].to_numpy())
    y = pdf["label"].to_numpy()
    for f in range(5):
        tr = pdf["fold"].to_numpy() != f
        Xt, yt = X[tr], y[tr]
        m, yb = Xt.mean(0), yt.mean()
        Xc = Xt - m
        beta = np.linalg.solve(Xc.T @ Xc + lam * np.eye(X.shape[1]), Xc.T @ (yt - yb))
        naive = yb + (X[~tr] - m) @ beta
        ours = model.predict_np(X[~tr], f)[:, 0]
        assert np.max(np.abs(naive - ours)) < 1e-8


def test_oof_loop_assert_each_id_once(spark):
    df = _rows(spark, [(1, 0, "a", 1.0), (2, 1, "a", 2.0)])

    def fit(train):
        return train.agg(F.avg("y").alias("m"))

    def predict_twice(model, valid):
        v = valid.crossJoin(F.broadcast(model))
        return v.unionByName(v)

    with pytest.raises(Exception):
        O.oof(df, 2, fit, predict_twice, id_col="id").collect()


def test_ridge_moments_summed_in_pieces(spark, monkeypatch):
    df = embedding_folds(spark, SF01)
    one = O.fit_ridge_folds(df, "x", ["label"], lam=0.5)
    monkeypatch.setattr(O, "MOMENT_CHUNK", 97)   # many pieces, uneven last one
    many = O.fit_ridge_folds(df, "x", ["label"], lam=0.5)
    for f in one.models:
        np.testing.assert_allclose(one.models[f][1], many.models[f][1], rtol=1e-10, atol=1e-12)
        np.testing.assert_allclose(one.models[f][0], many.models[f][0], rtol=1e-10, atol=1e-12)


def test_ml_fits_overlap_and_keep_their_order(spark):
    """Fits run at a time, and the result is that of one after the other."""
    import threading
    from pyspark.ml.regression import LinearRegression
    rows = [(i, i % 3, [float(i), float(i * i % 7)], 2.0 * i + i * i % 7, 1.0 - i) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, fold int, x array<double>, a double, b double")
    lock, seen = threading.Lock(), set()

    def make():
        with lock:
            seen.add(threading.get_ident())
        return LinearRegression()

    got = O.oof_ml(df, "id", "x", ["a", "b"], make, 3)
    assert len(seen) > 1
    assert [(r.fold, r.target) for r in got.select("fold", "target").distinct().collect()] != []
    for r in got.collect():
        assert r.fold == r.id % 3 and abs(r.y - r.pred) < 1e-6
    assert got.count() == 120

    def broken():
        raise RuntimeError("no estimator")

    with pytest.raises(RuntimeError, match="no estimator"):
        O.oof_ml(df, "id", "x", ["a"], broken, 3)
