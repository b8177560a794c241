"""Out-of-fold prediction.

The reference trains k models, each on k-1 folds.  For statistics that merge
by addition (count, sum, Gram matrix) the training-side value for held-out
fold f is ``total - fold_f``, so one aggregation over the data replaces k
passes (O2, O3).  O1 is the general per-fold loop for arbitrary fit/predict
callables; O4 wraps ``pyspark.ml`` estimators in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.joins import union_all
from foldwise.plans.scratch import written
from foldwise.plans.sizing import join_small


def long_targets(df: DataFrame, keep: Sequence[str], targets: Sequence[str],
                 value: str = "y") -> DataFrame:
    """Wide target columns -> (keep..., target, value) rows as double."""
    return df.select(*keep, *[F.col(t).cast("double").alias(t) for t in targets]).unpivot(
        list(keep), list(targets), "target", value)


# O2
def oof_group_mean(df: DataFrame, id_col: str, group: str, targets: Sequence[str],
                   fold: str = "fold") -> DataFrame:
    """OOF prediction of each target by the mean of its group in the other folds.

    Returns long rows (id, fold, group, target, y, pred).  If the group has no
    training rows for a fold, the fold's global training mean is used.
    One shuffle aggregates (group, fold, target) sums; the rest runs on that
    small table and is joined back.
    """
    folds = [r[0] for r in df.select(fold).distinct().collect()]      # k values (null: a fold of its own)
    if len(folds) > MAX_FOLDS:
        raise ValueError(f"oof_group_mean: {len(folds)} folds; at most {MAX_FOLDS} are expected")
    rows = long_targets(df, [id_col, fold, group], targets)

    def inside(f):
        return F.col(fold).eqNullSafe(F.lit(f))

    # one row per (group, target): its whole sum and count, and those of each fold
    cell = rows.groupBy(group, "target").agg(
        F.sum("y").alias("s"), F.count("y").alias("n"),
        F.array(*[F.struct(F.lit(f).cast(df.schema[fold].dataType).alias("f"), F.coalesce(F.sum(F.when(inside(f), F.col("y"))), F.lit(0.0)).alias("s"),
                           F.count(F.when(inside(f), F.col("y"))).alias("n")) for f in folds]).alias("by_fold"))
    # k x targets rows: training mean of every fold over all groups
    flat = cell.select("target", F.explode("by_fold").alias("x")).groupBy("target", F.col("x.f").alias("f")).agg(
        F.sum("x.s").alias("s_f"), F.sum("x.n").alias("n_f"))
    both = flat.join(F.broadcast(flat.groupBy("target").agg(F.sum("s_f").alias("s_all"), F.sum("n_f").alias("n_all"))), "target")
    overall = both.select(F.col("target").alias("_t"), F.col("f").alias("_f"),
                          F.try_divide(F.col("s_all") - F.col("s_f"), F.col("n_all") - F.col("n_f")).alias("_mean"))
    held = cell.select(group, "target", "s", "n", F.explode("by_fold").alias("x"))
    stats = held.select(group, F.col("x.f").alias(fold), "target", F.try_divide(
        F.col("s") - F.col("x.s"), F.col("n") - F.col("x.n")).alias("_own"))
    stats = stats.join(F.broadcast(overall), (F.col("target") == F.col("_t")) & F.col(fold).eqNullSafe(F.col("_f")))
    stats = stats.select(group, fold, "target", F.coalesce("_own", "_mean").alias("pred"))
    return join_small(rows, stats, [group, fold, "target"], null_safe=True)


#: Most folds that a held-out statistic is expected to have.
MAX_FOLDS = 1000


def _misplaced(k: int, fold: str):
    """True for a row of an unknown fold, as an error inside the query; false else."""
    known = F.coalesce(F.col(fold).between(0, k - 1), F.lit(False))
    return F.when(known, F.lit(False)).otherwise(
        F.raise_error(F.lit(f"oof: a row's fold is null or outside 0..{k - 1}")).cast("boolean"))


def checked_folds(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """``df``, with an error inside the query for a row whose fold is null or outside [0, k)."""
    return df.filter(~_misplaced(k, fold))


# O1
def oof(df: DataFrame, k: int, fit: Callable[[DataFrame], object],
        predict: Callable[[object, DataFrame], DataFrame], fold: str = "fold",
        id_col: str | None = None) -> DataFrame:
    """General OOF: for each fold f, ``predict(fit(df[fold != f]), df[fold == f])``.

    The pieces are appended by name.  A row whose fold is null or outside [0, k)
    is an error inside the query, as it would be in no piece.  With ``id_col`` the
    result is checked to hold each id exactly once.
    """
    pieces = []
    for f in range(k):
        train, valid = df.filter(F.col(fold) != f), df.filter(F.col(fold) == f)
        pieces.append(predict(fit(train), valid))
    out = union_all(pieces)
    # one more piece without rows, whose scan of the fold column checks it
    none = df.filter(_misplaced(k, fold)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema])
    out = out.unionByName(none)
    if id_col is not None:
        w = Window.partitionBy(id_col)
        # a filter keeps the check in the plan (an unused column would be pruned)
        out = out.withColumn("_c", F.count(F.lit(1)).over(w))
        once = F.when(F.col("_c") == 1, F.lit(True)).otherwise(
            F.raise_error(F.lit("oof: id predicted more than once")).cast("boolean"))
        out = out.filter(once).drop("_c")
    return out


# O3
class RidgeFolds:
    """Per-fold ridge models fitted by subtraction; a small driver-side table
    (k x (d + 1) x t numbers)."""

    def __init__(self, mu, nu, models, targets):
        self.mu = mu            # feature centre (d,)
        self.nu = nu            # target centre (t,)
        self.models = models    # fold -> (intercept (t,), beta (d, t)) in centred units
        self.targets = list(targets)

    def predict_np(self, X: np.ndarray, fold: int) -> np.ndarray:
        b0, beta = self.models[fold]
        return self.nu + b0 + (X - self.mu) @ beta


# Elements per summed piece of a flat moment vector.
MOMENT_CHUNK = 8192


def _moments(df: DataFrame, features: str, targets: Sequence[str], fold: str, mu, nu) -> dict:
    """Per-fold centred sums [n, Sx, Sy, Gxx, Gxy] in one pass.

    Each task folds its rows into one flat partial per fold (numpy) and emits
    it in pieces of :data:`MOMENT_CHUNK` elements; Spark sums the pieces
    grouped by (fold, piece).  With d features a partial has about d * d
    numbers (360k at d = 600), so keying by piece spreads the sums over
    k * pieces reducers instead of k.  The driver receives k summed vectors, whose
    size is bounded by the model's width, not by the rows."""
    d, t = len(mu), len(nu)
    width = 1 + d + t + d * d + d * t
    cols = [fold, features, *targets]

    def partials(batches):
        acc = {}
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.stack(pdf[features].to_numpy()).astype(float) - mu
            Y = pdf[list(targets)].to_numpy(dtype=float) - nu
            for f in np.unique(pdf[fold].to_numpy()):
                sel = pdf[fold].to_numpy() == f
                x, y = X[sel], Y[sel]
                v = np.concatenate([[len(x)], x.sum(0), y.sum(0), (x.T @ x).ravel(), (x.T @ y).ravel()])
                acc[int(f)] = acc.get(int(f), 0) + v
        rows = [(f, c, v[c * MOMENT_CHUNK:(c + 1) * MOMENT_CHUNK].tolist())
                for f, v in acc.items() for c in range((width + MOMENT_CHUNK - 1) // MOMENT_CHUNK)]
        if rows:
            yield pd.DataFrame(rows, columns=["fold", "piece", "stats"])

    part = df.select(*cols).mapInPandas(partials, "fold int, piece int, stats array<double>")
    summ = Summarizer.metrics("sum")
    tot = part.groupBy("fold", "piece").agg(summ.summary(array_to_vector("stats")).alias("s"))
    rows = tot.select("fold", "piece", vector_to_array("s.sum").alias("v")).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["fold"], {})[r["piece"]] = r["v"]
    out = {}
    for f, ps in pieces.items():
        v = np.concatenate([np.asarray(ps[c], dtype=float) for c in sorted(ps)])
        assert len(v) == width
        n = v[0]
        sx, sy = v[1:1 + d], v[1 + d:1 + d + t]
        gxx = v[1 + d + t:1 + d + t + d * d].reshape(d, d)
        gxy = v[1 + d + t + d * d:].reshape(d, t)
        out[f] = (n, sx, sy, gxx, gxy)
    return out


def fit_ridge_folds(df: DataFrame, features: str, targets: Sequence[str], lam: float = 0.0,
                    fold: str = "fold") -> RidgeFolds:
    """Ridge (``lam`` > 0) or least squares per held-out fold from one data pass:
    training moments = total - fold moments, centred against cancellation."""
    targets = list(targets)
    vec = df.select(array_to_vector(F.col(features)).alias("v"), *targets)
    summ = Summarizer.metrics("mean")
    first = vec.agg(summ.summary(F.col("v")).alias("s"), *[F.avg(t).alias(t) for t in targets]).first()
    mu = np.asarray(first["s"]["mean"].toArray(), dtype=float)
    nu = np.asarray([first[t] for t in targets], dtype=float)
    per = _moments(df, features, targets, fold, mu, nu)
    total = [sum(p[i] for p in per.values()) for i in range(5)]
    models = {}
    d = len(mu)
    for f, p in per.items():
        n, sx, sy, gxx, gxy = [a - b for a, b in zip(total, p)]
        if n <= 0:
            raise ValueError(f"fit_ridge_folds: no training rows for fold {f}")
        m, ybar = sx / n, sy / n
        C = gxx - n * np.outer(m, m)
        c = gxy - n * np.outer(m, ybar)
        A = C + lam * np.eye(d)
        try:
            beta = np.linalg.solve(A, c)
        except np.linalg.LinAlgError:
            beta = np.linalg.lstsq(A, c, rcond=None)[0]
        models[f] = (ybar - m @ beta, beta)
    return RidgeFolds(mu, nu, models, targets)


def predict_ridge(df: DataFrame, model: RidgeFolds, id_col: str, features: str, fold: str | None = "fold",
                  keep_y: bool = True) -> DataFrame:
    """Long predictions (id, fold, target, [y,] pred).  With ``fold`` each row
    uses its own fold's model (out of fold); with ``fold=None`` every row is
    scored by every fold model (``fold`` in the output names the model)."""
    targets = model.targets
    ycols = [t for t in targets if keep_y and t in df.columns]
    cols = [id_col, features, *([fold] if fold else []), *ycols]
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, fold int, target string, " + ("y double, " if ycols else "") + "pred double"
    folds = sorted(model.models)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.stack(pdf[features].to_numpy()).astype(float)
            pieces = []
            for f in (np.unique(pdf[fold].to_numpy()) if fold else folds):
                sel = (pdf[fold].to_numpy() == f) if fold else np.ones(len(pdf), bool)
                P = model.predict_np(X[sel], int(f))
                for j, t in enumerate(targets):
                    part = {id_col: pdf[id_col].to_numpy()[sel], "fold": int(f), "target": t,
                            "pred": P[:, j]}
                    if ycols:
                        part["y"] = pdf[t].to_numpy(dtype=float)[sel]
                    pieces.append(pd.DataFrame(part))
            out = pd.concat(pieces, ignore_index=True)
            yield out[[id_col, "fold", "target", *(["y"] if ycols else []), "pred"]]

    return df.select(*cols).mapInPandas(run, schema)


def oof_ridge(df: DataFrame, id_col: str, features: str, targets: Sequence[str], lam: float = 0.0,
              fold: str = "fold") -> DataFrame:
    """O3: out-of-fold ridge predictions, long (id, fold, target, y, pred)."""
    model = fit_ridge_folds(df, features, targets, lam, fold)
    return predict_ridge(df, model, id_col, features, fold)


# O4
# Fits that run at a time.
FITS = 4


def oof_ml(df: DataFrame, id_col: str, features: str, targets: Sequence[str], make_estimator,
           k: int, fold: str = "fold") -> DataFrame:
    """Fit a ``pyspark.ml`` regressor per (fold, target) on the other folds and
    predict the held-out fold; long (id, fold, target, y, pred).  The assembled
    vectors are written to shared scratch storage and reread by all k x t fits, which
    run a few at a time as concurrent jobs (``make_estimator`` is called from their
    threads); the results are in the order of folds and targets.  A row whose fold is
    null or outside [0, k) is an error, and so is any failing fit."""
    base = written(checked_folds(df, k, fold).select(id_col, fold, array_to_vector(F.col(features)).alias("_features"),
                                                     *[F.col(t).cast("double").alias(t) for t in targets]))

    def fitted(unit: tuple[int, str]) -> DataFrame:
        f, t = unit
        est = make_estimator().setFeaturesCol("_features").setLabelCol(t).setPredictionCol("_pred")
        m = est.fit(base.filter(F.col(fold) != f))
        return m.transform(base.filter(F.col(fold) == f)).select(
            id_col, F.col(fold).cast("int").alias("fold"), F.lit(t).alias("target"), F.col(t).alias("y"), F.col("_pred").cast("double").alias("pred"))

    with ThreadPoolExecutor(FITS) as pool:
        return union_all(list(pool.map(inheritable_thread_target(fitted), [(f, t) for f in range(k) for t in targets])))
