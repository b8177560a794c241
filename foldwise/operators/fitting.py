"""Data-parallel fitting of the learned stages: the second-stage network and class scores.

Both follow one scheme.  The parameters of all k fold models (model f learns from the
rows of the other folds) are broadcast; their size follows the model's width, not
the rows.  Each task folds its rows into one flat sum per model with numpy, written
out in pieces of ``PIECE`` numbers, Spark adds the pieces grouped by (model, piece),
and the driver takes a step.  So k models cost one pass for each step and nothing is
cached but the driver's parameters; a lost task is simply computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.constants import SCORE_LEVELS

# Elements of a flat sum that one reducer adds.
PIECE = 8192


def summed(df: DataFrame, cols: Sequence[str], fold_sums: Callable[[pd.DataFrame], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The flat sums of all rows by model: ``fold_sums`` gives a batch's, tasks add
    their batches, Spark adds the tasks'."""

    def partials(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for f, v in fold_sums(pdf).items():
                    acc[f] = acc[f] + v if f in acc else v
        rows = [(f, i, v[i * PIECE:(i + 1) * PIECE].tolist()) for f, v in acc.items() for i in range(-(-len(v) // PIECE))]
        if rows:
            yield pd.DataFrame(rows, columns=["model", "piece", "stats"])

    part = df.select(*cols).mapInPandas(partials, "model int, piece int, stats array<double>")
    total = part.groupBy("model", "piece").agg(Summarizer.metrics("sum").summary(array_to_vector("stats")).alias("s"))
    found: dict[int, dict[int, list]] = {}
    for r in total.select("model", "piece", vector_to_array("s.sum").alias("v")).collect():
        found.setdefault(r["model"], {})[r["piece"]] = r["v"]
    return {f: np.concatenate([np.asarray(p[i], float) for i in sorted(p)]) for f, p in sorted(found.items())}


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def feature_scale(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every feature (1 for constant ones), in one pass."""
    summ = Summarizer.metrics("mean", "std")
    s = df.agg(summ.summary(array_to_vector(F.col(features))).alias("s")).first()["s"]
    mean, std = (np.asarray(x.toArray(), float) for x in (s["mean"], s["std"]))
    return mean, np.where(std > 0, std, 1.0)


# ---- second-stage network ----

class Network:
    """A multilayer regressor: linear layers with a PReLU after each but the last; the
    first hidden one's weights are normalised by row (a length times a direction).

    Parameters are one flat vector: for each layer its weights (out, in) and biases,
    the first hidden layer's lengths, and one slope for each PReLU."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        shapes = [s for i, o in zip(sizes, sizes[1:]) for s in ((o, i), (o,))] + [(sizes[1] if len(sizes) > 2 else 0,), (len(sizes) - 2,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.shapes, self.cuts, self.size = shapes, ends[:-1], int(ends[-1])

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        return [p.reshape(s) for p, s in zip(np.split(flat, self.cuts), self.shapes)]

    def initial(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of the inputs; directions keep their length; slopes are a quarter."""
        rng = np.random.default_rng(seed)
        parts = []
        for i, o in zip(self.sizes, self.sizes[1:]):
            parts += [rng.uniform(-1, 1, (o, i)) / np.sqrt(i), rng.uniform(-1, 1, o) / np.sqrt(i)]
        return np.concatenate([p.ravel() for p in (*parts, np.linalg.norm(parts[0], axis=1)[:self.shapes[-2][0]],
                                                 np.full(len(self.sizes) - 2, 0.25))])

    def layers(self, flat: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(weights, biases) of each layer as applied, and the slopes."""
        parts = self.unpack(flat)
        length, slopes = parts[-2], parts[-1]
        pairs = list(zip(parts[0:-2:2], parts[1:-2:2]))
        if len(slopes):
            v = pairs[0][0]
            pairs[0] = (v * (length / np.linalg.norm(v, axis=1))[:, None], pairs[0][1])
        return pairs, slopes

    def forward(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        pairs, slopes = self.layers(flat)
        for n, (w, b) in enumerate(pairs):
            x = x @ w.T + b
            if n < len(slopes):
                x = np.where(x > 0, x, slopes[n] * x)
        return x

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient of the rows' summed squared errors, then the sum itself and the
        number of errors."""
        pairs, slopes = self.layers(flat)
        inputs, before = [x], []
        for n, (w, b) in enumerate(pairs):
            z = inputs[-1] @ w.T + b
            before.append(z)
            inputs.append(np.where(z > 0, z, slopes[n] * z) if n < len(slopes) else z)
        error = inputs[-1] - y
        back, grads, bends = 2 * error, [], np.zeros(len(slopes))
        for n in range(len(pairs) - 1, -1, -1):
            if n < len(slopes):
                bends[n] = (back * np.where(before[n] > 0, 0, before[n])).sum()
                back = back * np.where(before[n] > 0, 1, slopes[n])
            grads[:0] = [back.T @ inputs[n], back.sum(0)]
            back = back @ pairs[n][0]
        along = np.zeros(0)
        if len(slopes):                                       # the first layer's lengths, then its directions
            parts = self.unpack(flat)
            v, norm = parts[0], np.linalg.norm(parts[0], axis=1)
            along = (grads[0] * v).sum(1) / norm
            grads[0] = (parts[-2] / norm)[:, None] * (grads[0] - (along / norm)[:, None] * v)
        return np.concatenate([*(g.ravel() for g in grads), along, bends, [(error ** 2).sum(), error.size]])


class NetworkFolds:
    """k fitted networks with the features' scale; stands where ridge models stand in
    out-of-fold prediction and stacking."""

    def __init__(self, net: Network, mean: np.ndarray, std: np.ndarray, models: dict[int, np.ndarray], targets: Sequence[str],
                 losses: dict[int, list[float]]):
        self.net, self.mean, self.std, self.models, self.targets, self.losses = net, mean, std, models, list(targets), losses

    def predict_np(self, x: np.ndarray, fold: int) -> np.ndarray:
        return self.net.forward(self.models[fold], (x - self.mean) / self.std)


def network_gradients(df: DataFrame, features: str, targets: Sequence[str], net: Network, models: dict[int, np.ndarray],
                      mean: np.ndarray, std: np.ndarray, fold: str = "fold") -> dict[int, tuple[np.ndarray, float]]:
    """Every model's gradient of the mean squared error over the rows outside its
    fold, and that error, in one pass over ``df``."""
    targets = list(targets)
    shared = df.sparkSession.sparkContext.broadcast((net, models, mean, std))

    def sums(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        net, models, mean, std = shared.value
        x, y, held = (_matrix(pdf[features]) - mean) / std, pdf[targets].to_numpy(float), pdf[fold].to_numpy()
        return {f: net.gradient(flat, x[held != f], y[held != f]) for f, flat in models.items()}

    try:
        total = summed(df, [fold, features, *targets], sums)
    finally:
        shared.unpersist()
    for f in models:
        if f not in total or total[f][-1] == 0:
            raise ValueError(f"no training rows for fold {f}")
    return {f: (v[:-2] / v[-1], v[-2] / v[-1]) for f, v in total.items()}


def fit_network_folds(df: DataFrame, features: str, targets: Sequence[str], k: int, hidden: Sequence[int] = (256, 128, 64),
                      steps: int = 100, rate: float = 0.01, decay: float = 0.01, seed: int = 42, fold: str = "fold",
                      rule: str = "adamw") -> NetworkFolds:
    """k second-stage networks, each fitted on the rows outside its fold by ``steps``
    full passes.  ``rule``: "adamw" (first and second moments of the gradient, decoupled
    decay of all weights but biases, lengths and slopes) or "descent" (the gradient itself).
    Rows with a null target or feature must be dropped before."""
    targets = list(targets)
    mean, std = feature_scale(df, features)
    net = Network([len(mean), *hidden, len(targets)])
    models = {f: net.initial(seed) for f in range(k)}
    decays = np.concatenate([np.full(int(np.prod(s)), float(len(s) == 2)) for s in net.shapes])
    first, second = ({f: np.zeros(net.size) for f in models} for _ in range(2))
    losses: dict[int, list[float]] = {f: [] for f in models}
    for t in range(1, steps + 1):
        for f, (g, loss) in network_gradients(df, features, targets, net, models, mean, std, fold).items():
            losses[f].append(loss)
            if rule == "descent":
                models[f] = models[f] - rate * g
                continue
            first[f] = 0.9 * first[f] + 0.1 * g
            second[f] = 0.999 * second[f] + 0.001 * g * g
            step = first[f] / (1 - 0.9 ** t) / (np.sqrt(second[f] / (1 - 0.999 ** t)) + 1e-8)
            models[f] = models[f] * (1 - rate * decay * decays) - rate * step
    return NetworkFolds(net, mean, std, models, targets, losses)


# ---- class scores ----

class ClassFolds:
    """k fitted linear class scorers: for each model and target the weights
    (level, 1 + feature) over centred features."""

    def __init__(self, mean: np.ndarray, models: dict[int, np.ndarray], targets: Sequence[str], gradients: list[float]):
        self.mean, self.models, self.targets, self.gradients = mean, models, list(targets), gradients

    def logits_np(self, x: np.ndarray, fold: int) -> np.ndarray:
        """Level-major logits (row, levels * targets), as the class-score functions read them."""
        return np.einsum("nd,tcd->nct", _design(x, self.mean), self.models[fold]).reshape(len(x), -1)


def _design(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x - mean], 1)


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def class_steps(df: DataFrame, features: str, targets: Sequence[str], models: dict[int, np.ndarray], mean: np.ndarray, eps: float,
                levels: int = SCORE_LEVELS, fold: str = "fold") -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For every model over the rows outside its fold: the summed gradient (target,
    level, 1 + feature) and Hessian blocks of the cross entropy with label smoothing
    ``eps``, and the entropy itself, in one pass.  ``targets`` hold level numbers."""
    targets = list(targets)
    t, d = len(targets), len(mean) + 1
    shared = df.sparkSession.sparkContext.broadcast((models, mean))

    def sums(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        models, mean = shared.value
        x, held = _design(_matrix(pdf[features]), mean), pdf[fold].to_numpy()
        truth = np.eye(levels)[pdf[targets].to_numpy(int)] * (1 - eps) + eps / levels          # (row, target, level)
        out = {}
        for f, weights in models.items():
            own = held != f
            xs, want = x[own], truth[own]
            z = np.einsum("nd,tcd->ntc", xs, weights)
            p = _probabilities(z)
            top = z.max(-1, keepdims=True)
            logs = z - top - np.log(np.exp(z - top).sum(-1, keepdims=True))
            grad = np.einsum("ntc,nd->tcd", p - want, xs)
            hess = np.empty((t, levels, d, levels, d))
            for j in range(t):
                for c in range(levels):
                    for e in range(c, levels):
                        w = p[:, j, c] * ((c == e) - p[:, j, e])
                        hess[j, c, :, e] = hess[j, e, :, c] = (xs * w[:, None]).T @ xs
            out[f] = np.concatenate([grad.ravel(), hess.ravel(), [-(want * logs).sum(), len(xs)]])
        return out

    try:
        total = summed(df, [fold, features, *targets], sums)
    finally:
        shared.unpersist()
    width = t * levels * d
    return {f: (v[:width].reshape(t, levels, d), v[width:-2].reshape(t, levels * d, levels * d), v[-2] / max(v[-1], 1) / t) for f, v in total.items()}


def fit_class_folds(df: DataFrame, features: str, targets: Sequence[str], k: int, eps: float = 0.1, levels: int = SCORE_LEVELS,
                    fold: str = "fold", tolerance: float = 1e-9, most: int = 30) -> ClassFolds:
    """k linear class scorers for each target, fitted on the rows outside each fold by
    Newton's method on the cross entropy with label smoothing (L1), until no summed
    gradient is above ``tolerance`` for a row.  Smoothing keeps the solution finite; of
    equal ones (a constant added to all levels) the shortest step is taken, and a
    step that does not lower the entropy is halved."""
    targets = list(targets)
    mean = feature_scale(df, features)[0]
    n = df.count()
    models = {f: np.zeros((len(targets), levels, len(mean) + 1)) for f in range(k)}
    held: dict[int, tuple] = {}                       # model -> (weights, entropy, step) last accepted
    seen = []
    for _ in range(most):
        worst = 0.0
        for f, (grad, hess, entropy) in class_steps(df, features, targets, models, mean, eps, levels, fold).items():
            if f in held and entropy > held[f][1] + 1e-12:
                weights, best, step = held[f]
                held[f] = weights, best, step / 2
                models[f] = weights - step / 2
                worst = np.inf
                continue
            worst = max(worst, float(np.abs(grad).max()) / max(n, 1))
            step = np.stack([np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(g.shape) for g, h in zip(grad, hess)])
            held[f] = models[f], entropy, step
            models[f] = models[f] - step
        seen.append(worst)
        if worst <= tolerance:
            break
    return ClassFolds(mean, {f: h[0] for f, h in held.items()}, targets, seen)


def class_logits(df: DataFrame, model: ClassFolds, features: str, out: str = "z", fold: str | None = "fold", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the level-major logits ``out`` of every row: by its own
    fold's model (out of fold), or, with ``fold=None``, by every model, whose number is ``fold``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    schema = df.select(*keep, F.lit(0).alias("fold"), F.array(F.lit(0.0)).alias(out)).schema
    folds = sorted(model.models)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf[features])
            for f in sorted(pdf[fold].unique()) if fold else folds:
                own = (pdf[fold] == f).to_numpy() if fold else np.ones(len(pdf), bool)
                z = shared.value.logits_np(x[own], int(f))
                yield pdf.loc[own, keep].assign(**{"fold": int(f), out: list(z)})

    return df.select(*{c: None for c in (*keep, features, *([fold] if fold else []))}).mapInPandas(run, schema)
