"""Losses (L1-L7) as expressions plus aggregations.

Row-level losses are Column expressions; the reductions are plain
aggregations (partial aggregation on the map side, one small shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.constants import IGNORE_INDEX
from foldwise.functions.scores import log_sum_exp


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# L1 (row level)
def cross_entropy_expr(z, y, eps: float = 0.0) -> Column:
    """``(1-eps) * nll + eps * mean_c(-log p_c)`` of one logit array and class index."""
    z, y = _c(z), _c(y)
    lse = log_sum_exp(z)
    nll = lse - F.element_at(z, y.cast("int") + 1)
    if eps == 0:
        return nll
    mean_z = F.aggregate(z, F.lit(0.0), lambda a, x: a + x) / F.size(z)
    return F.lit(1 - eps) * nll + F.lit(eps) * (lse - mean_z)


def cross_entropy(df: DataFrame, z: str = "z", y: str = "level", eps: float = 0.0) -> DataFrame:
    """Mean cross entropy over all (row, target) cells."""
    return df.agg(F.avg(cross_entropy_expr(z, y, eps)).alias("cross_entropy"))


# L2 / L3 (row level)
def squared_error(y, p) -> Column:
    return F.pow(_c(y) - _c(p), 2)


def smooth_l1_expr(y, p, beta: float = 1.0) -> Column:
    d = F.abs(_c(y) - _c(p))
    return F.when(d < beta, F.lit(0.5) * d * d / F.lit(beta)).otherwise(d - F.lit(0.5 * beta))


def mse(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    return df.agg(F.avg(squared_error(y, p)).alias("mse"))


def smooth_l1(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    return df.agg(F.avg(smooth_l1_expr(y, p)).alias("smooth_l1"))


# L4
def combined_loss(df: DataFrame, weights: Mapping[str, float], z: str = "z", level: str = "level",
                  y: str = "y", p: str = "pred", eps: float = 0.0) -> DataFrame:
    """``sum_i w_i * L_i`` over cross_entropy / mse / smooth_l1; zero weights skipped.
    Every term is a mean over the same cells, computed in one aggregation."""
    terms = {"cross_entropy": lambda: cross_entropy_expr(z, level, eps),
             "mse": lambda: squared_error(y, p),
             "smooth_l1": lambda: smooth_l1_expr(y, p)}
    unknown = set(weights) - set(terms)
    if unknown:
        raise ValueError(f"unknown loss terms {unknown}")
    used = {k: w for k, w in weights.items() if w != 0}
    if not used:
        return df.agg(F.lit(0.0).alias("loss"))
    aggs = [F.avg(terms[k]()).alias(k) for k in used]
    out = df.agg(*aggs)
    total = sum((F.lit(float(w)) * F.col(k) for k, w in used.items()), F.lit(0.0))
    return out.withColumn("loss", total)


# L5
def masked_mean(df: DataFrame, x: str = "loss", mask: str = "mask", by=()) -> DataFrame:
    """sum(x * mask) / sum(mask), per ``by`` group; null for a group whose mask sums to 0."""
    m = F.col(mask).cast("double")
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(x) * m), F.sum(m)).alias("masked_mean"))


# L6 (row level)
def token_ce_expr(z, target) -> Column:
    """Cross entropy of one token; 0 where the target is the ignore index."""
    t = _c(target)
    return F.when(t == IGNORE_INDEX, F.lit(0.0)).otherwise(cross_entropy_expr(z, t))


def token_soft_ce_expr(z, target) -> Column:
    """Cross entropy of one token with a soft target (an array of class weights):
    ``-sum_c p_c * log q_c``; 0 where the target is null or all of it is the ignore index."""
    z, t = _c(z), _c(target)
    lse = log_sum_exp(z)
    dot = F.aggregate(F.zip_with(t, z, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    mass = F.aggregate(t, F.lit(0.0), lambda a, x: a + x)
    ignored = t.isNull() | F.forall(t, lambda p: p == IGNORE_INDEX)
    return F.when(ignored, F.lit(0.0)).otherwise(mass * lse - dot)


# L7
def batch_mean_loss(df: DataFrame, batch: str = "batch", loss: str = "loss", by=()) -> DataFrame:
    """Mean of per-batch means (the reference's report) and the exact row mean."""
    per = df.groupBy(*by, batch).agg(F.avg(loss).alias("_m"), F.sum(loss).alias("_s"),
                                     F.count(loss).alias("_n"))
    return per.groupBy(*by).agg(F.avg("_m").alias("batch_mean"),
                                (F.sum("_s") / F.sum("_n")).alias("row_mean"),
                                F.count(F.lit(1)).alias("batches"))
