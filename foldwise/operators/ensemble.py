"""Merging the answers of k fold models.

Input is long: one row per (id, fold, target) with ``label`` and optionally
``prob``.  Each (id, target) group holds at most k rows, so the vote is done
inside one aggregation after a single shuffle on (id, target).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ids(id_col) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


# E1
def vote(preds: DataFrame, id_col="text_id", target: str = "target", fold: str = "fold",
         label: str = "label", prob: str = "prob") -> DataFrame:
    """Most frequent label per (id, target).  Ties go to the label first seen in
    fold order; ``prob`` is the mean probability of the winning label's votes.
    """
    keys = [*_ids(id_col), target]
    clustered = preds.repartition(*keys)   # both aggregations reuse this partitioning
    per_label = clustered.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(fold).alias("_first"), F.avg(prob).alias("_p"))
    best = per_label.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(label).alias("label"), F.col("_p").alias("prob")),
                 F.struct(F.col("_n"), -F.col("_first"))).alias("_w"))
    return best.select(*keys, F.col("_w.label").alias(label), F.col("_w.prob").alias(prob))


# E2
def mean_folds(preds: DataFrame, id_col="text_id", target: str = "target", label: str = "label",
               on_missing: str = "null") -> DataFrame:
    """Mean of the fold answers.  NaN propagates; a missing (null) answer makes
    the mean null with ``on_missing="null"`` and is skipped with ``"skip"``."""
    keys = [*_ids(id_col), target]
    agg = preds.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("_m"),
                                   F.count(F.lit(1)).alias("_n"), F.count(label).alias("_v"))
    if on_missing == "null":
        m = F.when(F.col("_v") == F.col("_n"), F.col("_m"))
    elif on_missing == "skip":
        m = F.col("_m")
    else:
        raise ValueError(on_missing)
    return agg.select(*keys, m.alias(label))


# E3
def ensemble(preds: DataFrame, direct: bool, **kw) -> DataFrame:
    """``direct`` (values only) -> :func:`mean_folds`; else :func:`vote` with probabilities."""
    return mean_folds(preds, **kw) if direct else vote(preds, **kw)


def to_target_columns(merged: DataFrame, id_col, targets: Sequence[str],
                      values: Sequence[str] = ("label", "prob"), target: str = "target") -> DataFrame:
    """Long merged answers -> one row per id with ``<target>_<value>`` columns."""
    ids = _ids(id_col)
    wide = merged.groupBy(*ids).pivot(target, list(targets)).agg(*[F.first(v).alias(v) for v in values])
    if len(values) == 1:
        wide = wide.withColumnsRenamed({t: f"{t}_{values[0]}" for t in targets})
    return wide
