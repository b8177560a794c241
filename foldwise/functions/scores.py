"""Class-score arithmetic as array expressions (H1-H7).

A class-score vector holds ``levels * targets`` logits, level-major: the
logit of level c for target j is ``z[c * targets + j]``.  All functions return
``Column`` expressions built from Spark higher-order functions, so they run
inside the JVM with no Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.constants import SCORE_BASE, SCORE_LEVELS, SCORE_STEP


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# H1
def target_levels(vec, j: int | Column, levels: int = SCORE_LEVELS, targets: int = 6) -> Column:
    """The ``levels`` logits of target ``j`` from a level-major flat vector."""
    j = j if isinstance(j, Column) else F.lit(j)
    v = _c(vec)
    # strided pick by index; the lambda reads only its own variables and
    # constants, so an inlined vector expression is evaluated once
    picked = F.filter(v, lambda x, i: (i % targets == j) & (i < levels * targets))
    return picked


# H2
def softmax(z) -> Column:
    """Numerically stable softmax of an array."""
    z = _c(z)
    e = F.transform(_with(z, F.array_max(z)), lambda t: F.exp(t["x"] - t["c"]))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(_with(e, s), lambda t: t["x"] / t["c"])


def log_sum_exp(z) -> Column:
    z = _c(z)
    m = F.array_max(z)
    return m + F.log(F.aggregate(_with(z, m), F.lit(0.0), lambda acc, t: acc + F.exp(t["x"] - t["c"])))


def _with(arr: Column, c: Column) -> Column:
    """Array of struct(x, c): each element paired with the scalar ``c``.  A
    lambda that named ``c`` directly would evaluate it again per element."""
    return F.arrays_zip(arr.alias("x"), F.array_repeat(c, F.size(arr)).alias("c"))


# H3
def top_level(p) -> Column:
    """struct(level, prob): index of the largest value (first on ties) and the value."""
    p = _c(p)
    mx = F.array_max(p)
    return F.struct((F.array_position(p, mx) - 1).cast("int").alias("level"), mx.alias("prob"))


# H4
def decode_level(level) -> Column:
    """Level index -> score on the grid (``1 + 0.5 * level``)."""
    return F.lit(SCORE_BASE) + F.lit(SCORE_STEP) * _c(level).cast("double")


# H5
def encode_level(score, strict: bool = True) -> Column:
    """Score -> level index ``round((score - 1) * 2)``; off-grid scores raise when strict."""
    s = _c(score).cast("double")
    raw = (s - F.lit(SCORE_BASE)) / F.lit(SCORE_STEP)
    lvl = F.round(raw).cast("int")
    if not strict:
        return lvl
    bad = (F.abs(raw - F.round(raw)) > 1e-9) | (lvl < 0) | (lvl >= SCORE_LEVELS) | s.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("encode_level: off-grid score "),
                                              s.cast("string")))).otherwise(lvl)


# H6
def expected_score(p) -> Column:
    """sum_c p_c * (1 + 0.5 c)."""
    p = _c(p)
    return F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1),
                                  lambda x, c: x * (F.lit(SCORE_BASE) + F.lit(SCORE_STEP) * c)),
                       F.lit(0.0), lambda acc, x: acc + x)


# H7
def score(p, mode: str = "weighted_avg") -> Column:
    """Prediction from level probabilities: ``top`` level decoded, or expected score."""
    if mode == "top":
        return decode_level(top_level(p)["level"])
    if mode == "weighted_avg":
        return expected_score(p)
    raise ValueError(f"unknown mode {mode!r}")
