"""Learned attention and layer weights (V4, V5).

The scorer gives each token's attention score: linear, layer norm, GELU, linear.  It is a
projection of the vector, so it runs where the rows are.  Gradients of a loss of the
pooled vectors need two aggregations: the pooling itself (with the softmax's maximum and
sum), and, after every row has met its group's results, the sum over all rows of the
parameters' gradients, which tasks fold before they are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.fitting import summed
from foldwise.operators.pooling import _real, attention_pool, pool_layers

EPS = 1e-5                                   # of the layer norm
_erf = np.frompyfunc(math.erf, 1, 1)


class Scorer:
    """Weights of the scorer: ``w1`` (in, width), ``b1``, the norm's ``scale`` and
    ``shift``, ``w2`` (width) and ``b2``."""

    NAMES = ("w1", "b1", "scale", "shift", "w2", "b2")

    def __init__(self, w1, b1, scale, shift, w2, b2):
        self.w1, self.b1, self.scale, self.shift, self.w2 = (np.asarray(x, float) for x in (w1, b1, scale, shift, w2))
        self.b2 = float(b2)

    @classmethod
    def initial(cls, size: int, seed: int = 42) -> Scorer:
        """Uniform within one over the root of the inputs; the norm neither scales nor shifts."""
        rng, r = np.random.default_rng(seed), 1 / math.sqrt(size)
        return cls(rng.uniform(-r, r, (size, size)), rng.uniform(-r, r, size), np.ones(size), np.zeros(size), rng.uniform(-r, r, size), rng.uniform(-r, r))

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, n)) for n in self.NAMES])

    def like(self, flat: np.ndarray) -> Scorer:
        """A scorer of this shape with the parameters of ``flat``."""
        sizes = np.cumsum([np.size(getattr(self, n)) for n in self.NAMES])[:-1]
        parts = [p.reshape(np.shape(getattr(self, n))) for n, p in zip(self.NAMES, np.split(np.asarray(flat, float), sizes))]
        return Scorer(*parts)

    def _inner(self, x: np.ndarray):
        z = x @ self.w1 + self.b1
        centred = z - z.mean(1, keepdims=True)
        spread = np.sqrt((centred ** 2).mean(1, keepdims=True) + EPS)
        unit = centred / spread
        normed = unit * self.scale + self.shift
        below = 0.5 * (1 + _erf(normed / math.sqrt(2)).astype(float))        # the normal distribution
        return spread, unit, normed, below

    def score(self, x: np.ndarray) -> np.ndarray:
        _, _, normed, below = self._inner(x)
        return (normed * below) @ self.w2 + self.b2

    def gradient(self, x: np.ndarray, by_score: np.ndarray) -> np.ndarray:
        """Flat gradient of a loss summed over the rows, from its derivative by each row's score."""
        spread, unit, normed, below = self._inner(x)
        density = np.exp(-0.5 * normed ** 2) / math.sqrt(2 * math.pi)
        by_normed = by_score[:, None] * self.w2 * (below + normed * density)
        by_unit = by_normed * self.scale
        by_z = (by_unit - by_unit.mean(1, keepdims=True) - unit * (by_unit * unit).mean(1, keepdims=True)) / spread
        return np.concatenate([(x.T @ by_z).ravel(), by_z.sum(0), (by_normed * unit).sum(0), by_normed.sum(0),
                               (normed * below * by_score[:, None]).sum(0), [by_score.sum()]])


def attention_scores(df: DataFrame, scorer: Scorer, vec: str = "vec", out: str = "score") -> DataFrame:
    """``df`` with the scorer's score of every vector (null for a null vector)."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        for pdf in batches:
            have = pdf[vec].notna().to_numpy()
            score = np.full(len(pdf), np.nan)
            if have.any():
                score[have] = shared.value.score(np.stack(pdf.loc[have, vec].to_numpy()).astype(float))
            pdf[out] = pd.Series(score, index=pdf.index).where(have, None)
            yield pdf

    return base.mapInPandas(run, schema)


def learned_attention_pool(df: DataFrame, scorer: Scorer, by: Sequence[str] = ("doc",), vec: str = "vec", mask: str = "mask", out: str = "pooled") -> DataFrame:
    """Attention pooling (V4) by the scorer's own scores."""
    return attention_pool(attention_scores(df, scorer, vec, "_score"), "_score", by, vec, mask, out)


def _upstream(pooled: DataFrame, by: Sequence[str], loss: Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, np.ndarray]], truth: Sequence[str]) -> DataFrame:
    """The pooled rows with the loss (``_loss``) and its derivative by the pooled vector (``_g``)."""
    schema = T.StructType([*pooled.select(*by, "pooled").schema.fields, T.StructField("_loss", T.DoubleType()), T.StructField("_g", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["pooled"].notna()]
            if len(pdf):
                value, grad = loss(np.stack(pdf["pooled"].to_numpy()).astype(float), pdf[list(truth)])
                yield pdf[[*by, "pooled"]].assign(_loss=value, _g=list(grad))

    return pooled.mapInPandas(run, schema)


def _joined(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    on = None
    for i, c in enumerate(by):
        same = F.col(f"_r{i}").eqNullSafe(F.col(f"_b{i}"))
        on = same if on is None else on & same
    return rows.join(groups.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), *(c for c in groups.columns if c not in by)), on)


def attention_gradients(df: DataFrame, scorer: Scorer, truth: DataFrame, loss, by: Sequence[str] = ("doc",), vec: str = "vec",
                        mask: str = "mask") -> tuple[np.ndarray, float]:
    """The scorer's flat gradient of a loss summed over the groups, and that loss.

    ``truth``: the columns ``by`` and what ``loss(pooled, rows)`` reads; it gives each
    group's loss and its derivative by the pooled vector (both as arrays).  A group without
    a real position, or without truth, takes no part."""
    by, extra = list(by), [c for c in truth.columns if c not in by]
    rows = attention_scores(df.where(_real(mask, vec)), scorer, vec, "_score").select(
        *(F.col(c).alias(f"_r{i}") for i, c in enumerate(by)), F.col(vec).alias("_x"), "_score")
    named = rows.withColumnsRenamed({f"_r{i}": c for i, c in enumerate(by)}).withColumn("_one", F.lit(1))
    pooled = attention_pool(named, "_score", by, "_x", "_one", "pooled")
    top = named.groupBy(*by).agg(F.max("_score").alias("_top"))
    total = _joined(rows, top, by).groupBy(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(by))).agg(
        F.max("_top").alias("_top"), F.sum(F.exp(F.col("_score") - F.col("_top"))).alias("_sum"))
    known = _null_safe(pooled, truth, by)
    groups = _null_safe(_upstream(known, by, loss, extra), total, by)
    met = _joined(rows, groups, by).select("_x", "_score", "_top", "_sum", "_g", "pooled")
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def sums(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        x, g, p = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("_x", "_g", "pooled"))
        share = np.exp(pdf["_score"].to_numpy() - pdf["_top"].to_numpy()) / pdf["_sum"].to_numpy()
        return {0: shared.value.gradient(x, share * ((x - p) * g).sum(1))}

    found = summed(met, met.columns, sums)
    value = groups.agg(F.sum("_loss")).first()[0]
    return found.get(0, np.zeros(len(scorer.flat()))), float(value or 0.0)


def _null_safe(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    names = {c: f"_n{i}" for i, c in enumerate(by)}
    on = None
    for c, n in names.items():
        same = F.col(c).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return left.join(right.withColumnsRenamed(names), on).drop(*names.values())


def layer_gradients(df: DataFrame, weights: Sequence[float], truth: DataFrame, loss, start: int = 8, by: Sequence[str] = ("doc", "pos"),
                    layer: str = "layer", vec: str = "vec") -> tuple[np.ndarray, float]:
    """The gradient of a summed loss by the layer weights of V5, and that loss: a
    weight's derivative is the upstream one along its layer's distance from the average,
    over the sum of the group's weights."""
    by, extra = list(by), [c for c in truth.columns if c not in by]
    weights = [float(w) for w in weights]
    pooled = pool_layers(df, start, weights, by, layer, vec, "pooled")
    rows = df.where((F.col(layer) >= start) & F.col(vec).isNotNull()).select(
        *(F.col(c).alias(f"_r{i}") for i, c in enumerate(by)), (F.col(layer) - start).cast("int").alias("_l"), F.col(vec).alias("_x"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_l") + 1)
    total = rows.groupBy(*(F.col(f"_r{i}").alias(c) for i, c in enumerate(by))).agg(F.sum(weight).alias("_sum"))
    groups = _null_safe(_upstream(_null_safe(pooled, truth, by), by, loss, extra), total, by)
    met = _joined(rows, groups, by).select("_l", "_x", "_sum", "_g", "pooled")

    def sums(pdf: pd.DataFrame) -> dict[int, np.ndarray]:
        x, g, p = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("_x", "_g", "pooled"))
        each = ((x - p) * g).sum(1) / pdf["_sum"].to_numpy()
        return {0: np.bincount(pdf["_l"].to_numpy(), each, len(weights))}

    found = summed(met, met.columns, sums)
    value = groups.agg(F.sum("_loss")).first()[0]
    return found.get(0, np.zeros(len(weights))), float(value or 0.0)
