"""Metrics (M1-M3): RMSE per target and MCRMSE, overall and per fold.

Input is long (..., target, y, pred) or wide (truth and prediction columns).
NaN or null in y or pred raises, as the reference's metric rejects them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checked_sq(y: str, p: str):
    bad = F.col(y).isNull() | F.col(p).isNull() | F.isnan(y) | F.isnan(p)
    return F.when(bad, F.raise_error(F.lit("rmse: missing value"))).otherwise(
        F.pow(F.col(y) - F.col(p), 2))


def wide_to_pairs(df: DataFrame, targets: Sequence[str], pred_suffix: str = "_pred",
                  keep: Sequence[str] = ()) -> DataFrame:
    """Wide truth/prediction columns -> (keep..., target, y, pred)."""
    arr = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                             F.col(t + pred_suffix).cast("double").alias("pred")) for t in targets])
    return df.select(*keep, F.explode(arr).alias("_t")).select(*keep, "_t.*")


# M1
def rmse(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred",
         target: str = "target") -> DataFrame:
    """(by..., target, rmse, n) from long pairs."""
    return df.groupBy(*by, target).agg(F.sqrt(F.avg(_checked_sq(y, pred))).alias("rmse"),
                                       F.count(F.lit(1)).alias("n"))


# M2 / M3
def mcrmse(df: DataFrame, targets: Sequence[str], by: Sequence[str] = (), overall: bool = True,
           y: str = "y", pred: str = "pred", target: str = "target") -> DataFrame:
    """One row per ``by`` group (and one overall row with ``by`` null when
    ``overall``): ``<t>_rmse`` per target and ``mcrmse`` = their mean.

    Per-group and overall values come from one aggregation with grouping sets.
    """
    by = list(by)
    sq = df.select(*by, target, _checked_sq(y, pred).alias("_sq"))
    if by and overall:
        agg = sq.groupingSets([[*by, target], [target]], *by, target).agg(F.avg("_sq").alias("_m"))
    else:
        agg = sq.groupBy(*by, target).agg(F.avg("_sq").alias("_m"))
    cell = agg.withColumn("_r", F.sqrt("_m"))
    wide = cell.groupBy(*by).pivot(target, list(targets)).agg(F.first("_r"))
    wide = wide.withColumnsRenamed({t: f"{t}_rmse" for t in targets})
    mean = sum((F.col(f"{t}_rmse") for t in targets), F.lit(0.0)) / F.lit(float(len(targets)))
    return wide.withColumn("mcrmse", mean)


# M1-M3 kept up to date
def keep_errors(df: DataFrame, path: str, fold: str = "fold", y: str = "y", pred: str = "pred", target: str = "target") -> None:
    """The errors' sufficient statistics (rows, summed squares) of every (fold, target)
    of ``df`` put into the table at ``path``.

    A fold in ``df`` replaces its piece of the table whole, so a fold that is scored
    anew, or a job that runs again, counts once; other folds' pieces are not read."""
    stats = (df.select(fold, target, _checked_sq(y, pred).alias("_sq")).groupBy(fold, target)
             .agg(F.count(F.lit(1)).alias("n"), F.sum("_sq").alias("squares")))
    (stats.select(F.col(target).alias("target"), "n", "squares", F.col(fold).alias("fold"))
     .repartition("fold").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path))


def mcrmse_of(spark: SparkSession, path: str, targets: Sequence[str]) -> DataFrame:
    """:func:`mcrmse` by fold and overall (fold null) from the table of :func:`keep_errors`:
    a few numbers for each fold and target, without a scan of the predictions."""
    stats = spark.read.schema("target string, n long, squares double, fold int").parquet(path)
    cell = stats.groupingSets([["fold", "target"], ["target"]], "fold", "target").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("_r"))
    wide = cell.groupBy("fold").pivot("target", list(targets)).agg(F.first("_r"))
    wide = wide.withColumnsRenamed({t: f"{t}_rmse" for t in targets})
    return wide.withColumn("mcrmse", sum((F.col(f"{t}_rmse") for t in targets), F.lit(0.0)) / F.lit(float(len(targets))))
