"""Queries: fold dealing, out-of-fold group mean, metrics (the minimum slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import columns as P
from foldwise.operators import folds as K
from foldwise.operators import metrics as M
from foldwise.operators import oof as O
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.registry import register
from foldwise.plans.scratch import scratch_dir

LABEL_TARGETS = ["quality", "toxic"]


def labelled_folds(spark, sf_dir):
    """documents joined to labels, K2 folds on (quality, toxic), k=5, seed 42."""
    return K.deal_folds(T.labelled_docs(spark, sf_dir), "doc_id", LABEL_TARGETS, k=5, seed=42)


def oof_by_lang(spark, sf_dir):
    return O.oof_group_mean(labelled_folds(spark, sf_dir), "doc_id", "lang", LABEL_TARGETS)


@register("k2_deal_folds", V.with_views(V.LABELLED_FOLDS)
          + "SELECT doc_id, quality, toxic, fold FROM lf")
def k2_deal_folds(spark, sf_dir):
    return labelled_folds(spark, sf_dir).select("doc_id", "quality", "toxic", "fold")


@register("p7_split_fold", V.with_views(V.LABELLED_FOLDS)
          + "SELECT doc_id, fold, CASE WHEN fold = 2 THEN 'valid' ELSE 'train' END AS role FROM lf")
def p7_split_fold(spark, sf_dir):
    """Both sides of the split for held-out fold 2, tagged with their role."""
    from foldwise.operators import joins as J
    train, valid = P.split_fold(labelled_folds(spark, sf_dir).select("doc_id", "fold"), 2)
    return J.union_all([train.withColumn("role", F.lit("train")), valid.withColumn("role", F.lit("valid"))])


@register("k2_fold_sizes", V.with_views(V.LABELLED_FOLDS)
          + "SELECT fold, count(*) AS n FROM lf GROUP BY fold")
def k2_fold_sizes(spark, sf_dir):
    return K.fold_sizes(labelled_folds(spark, sf_dir))


_BAL_SQL = V.with_views(V.LABELLED_FOLDS) + """,
longer AS (SELECT fold, 'quality' AS target, CAST(quality AS DOUBLE) AS value FROM lf
           UNION ALL SELECT fold, 'toxic', CAST(toxic AS DOUBLE) FROM lf),
per AS (SELECT target, value, count(*) AS n, """ + ", ".join(
    f"CAST(sum(CASE WHEN fold = {i} THEN 1 ELSE 0 END) AS BIGINT) AS n_fold{i}" for i in range(5)) + """
        FROM longer GROUP BY target, value)
SELECT *, least(n_fold0, n_fold1, n_fold2, n_fold3, n_fold4) AS min_n,
       greatest(n_fold0, n_fold1, n_fold2, n_fold3, n_fold4) AS max_n,
       greatest(n_fold0, n_fold1, n_fold2, n_fold3, n_fold4)
         - least(n_fold0, n_fold1, n_fold2, n_fold3, n_fold4) AS spread
FROM per"""


@register("k3_fold_balance", _BAL_SQL)
def k3_fold_balance(spark, sf_dir):
    return K.fold_balance(labelled_folds(spark, sf_dir), LABEL_TARGETS, 5)


_OOF_ROWS = V.with_views(V.LABELLED_FOLDS) + """,
rows_ AS (SELECT doc_id, fold, lang, 'quality' AS target, CAST(quality AS DOUBLE) AS y FROM lf
          UNION ALL SELECT doc_id, fold, lang, 'toxic', CAST(toxic AS DOUBLE) FROM lf),
oof AS (SELECT r.doc_id, r.fold, r.lang, r.target, r.y,
          coalesce((SELECT avg(t.y) FROM rows_ t WHERE t.lang = r.lang AND t.target = r.target
                    AND t.fold <> r.fold),
                   (SELECT avg(t.y) FROM rows_ t WHERE t.target = r.target AND t.fold <> r.fold)) AS pred
        FROM rows_ r)
"""


@register("o2_oof_group_mean", _OOF_ROWS
          + "SELECT doc_id, fold, lang, target, y, round(pred, 6) AS pred FROM oof")
def o2_oof_group_mean(spark, sf_dir):
    return oof_by_lang(spark, sf_dir).select("doc_id", "fold", "lang", "target", "y",
                                             F.round("pred", 6).alias("pred"))


@register("m1_rmse", _OOF_ROWS
          + "SELECT target, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse, count(*) AS n "
            "FROM oof GROUP BY target")
def m1_rmse(spark, sf_dir):
    return M.rmse(oof_by_lang(spark, sf_dir)).select("target", F.round("rmse", 6).alias("rmse"), "n")


_M2_SQL = _OOF_ROWS + """,
r AS (SELECT target, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM oof GROUP BY target)
SELECT round(max(CASE WHEN target = 'quality' THEN rmse END), 6) AS quality_rmse,
       round(max(CASE WHEN target = 'toxic' THEN rmse END), 6) AS toxic_rmse,
       round(avg(rmse), 6) AS mcrmse FROM r"""


@register("m2_mcrmse", _M2_SQL)
def m2_mcrmse(spark, sf_dir):
    out = M.mcrmse(oof_by_lang(spark, sf_dir), LABEL_TARGETS)
    return out.select(*[F.round(c, 6).alias(c) for c in ["quality_rmse", "toxic_rmse", "mcrmse"]])


_M3_SQL = _OOF_ROWS + """,
r AS (SELECT fold, target, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM oof GROUP BY fold, target
      UNION ALL
      SELECT NULL, target, sqrt(avg((y - pred) * (y - pred))) FROM oof GROUP BY target)
SELECT coalesce(fold, -1) AS fold, round(max(CASE WHEN target = 'quality' THEN rmse END), 6) AS quality_rmse,
       round(max(CASE WHEN target = 'toxic' THEN rmse END), 6) AS toxic_rmse,
       round(avg(rmse), 6) AS mcrmse FROM r GROUP BY fold"""


@register("m3_mcrmse_by_fold", _M3_SQL)
def m3_mcrmse_by_fold(spark, sf_dir):
    out = M.mcrmse(oof_by_lang(spark, sf_dir), LABEL_TARGETS, by=["fold"])
    # the overall row (fold null in the grouping set) is reported as fold -1
    return out.select(F.coalesce("fold", F.lit(-1)).alias("fold"), *[F.round(c, 6).alias(c) for c in ["quality_rmse", "toxic_rmse", "mcrmse"]])


@register("m3_kept_errors", _M3_SQL)
def m3_kept_errors(spark, sf_dir):
    """The same from kept statistics: fold 2 comes in with spoiled predictions first, is
    scored anew and put in again, twice; the other folds are not read a second time."""
    path, oof = scratch_dir(spark) + "/errors", oof_by_lang(spark, sf_dir)
    M.keep_errors(oof.withColumn("pred", F.when(F.col("fold") == 2, F.col("pred") + 5).otherwise(F.col("pred"))), path)
    for _ in range(2):
        M.keep_errors(oof.where("fold = 2"), path)
    out = M.mcrmse_of(spark, path, LABEL_TARGETS)
    return out.select(F.coalesce("fold", F.lit(-1)).alias("fold"), *[F.round(c, 6).alias(c) for c in ["quality_rmse", "toxic_rmse", "mcrmse"]])


def minimum_slice(spark, sf_dir):
    """The flagship query: documents x labels -> K2 folds -> O2 by lang -> MCRMSE."""
    return m2_mcrmse(spark, sf_dir)
