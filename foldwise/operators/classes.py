"""Class-score tables (H1, H3, H7 applied to DataFrames)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.constants import SCORE_LEVELS, TARGETS
from foldwise.functions.scores import score, softmax, target_levels, top_level


# H1
def unpack_levels(df: DataFrame, vec: str = "z", keep: Sequence[str] = ("id",),
                  targets: Sequence[str] = TARGETS, levels: int = SCORE_LEVELS,
                  out: str = "z") -> DataFrame:
    """Flat level-major scores -> one row per (row, target) with ``levels`` logits."""
    t = len(targets)
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(name).alias("target"),
                               target_levels(vec, j, levels, t).alias(out))
                      for j, name in enumerate(targets)])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.j", "_c.target", f"_c.{out}")


# H2 + H3 (the reference's predict)
def predict_levels(df: DataFrame, vec: str = "z", keep: Sequence[str] = ("id",),
                   targets: Sequence[str] = TARGETS) -> DataFrame:
    """(keep..., j, target, level, prob): softmax over levels, top level and its probability."""
    cells = unpack_levels(df, vec, keep, targets)
    top = top_level(softmax("z"))
    return cells.select(*keep, "j", "target", top["level"].alias("level"), top["prob"].alias("prob"))


# H7 over a table
def predict_scores(df: DataFrame, vec: str = "z", keep: Sequence[str] = ("id",),
                   targets: Sequence[str] = TARGETS, mode: str = "weighted_avg") -> DataFrame:
    cells = unpack_levels(df, vec, keep, targets)
    return cells.select(*keep, "j", "target", score(softmax("z"), mode).alias("pred"))
