"""Queries: merging fold answers (E1-E3) and the wide/long fold layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.constants import TARGETS
from foldwise.operators import columns as P
from foldwise.operators import ensemble as E
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.registry import register

_FP = V.with_views(V.TARGETS6, V.FOLDS5, V.FOLD_PREDS)

_VOTE_SQL = _FP + """,
per AS (SELECT text_id, target, label, count(*) AS n, min(fold) AS f, avg(prob) AS p
        FROM fold_preds GROUP BY text_id, target, label),
win AS (SELECT *, row_number() OVER (PARTITION BY text_id, target ORDER BY n DESC, f) AS rk FROM per)
"""


@register("e1_vote", _VOTE_SQL + "SELECT text_id, target, label, round(p, 6) AS prob FROM win WHERE rk = 1")
def e1_vote(spark, sf_dir):
    v = E.vote(T.fold_preds(spark, sf_dir))
    return v.select("text_id", "target", "label", F.round("prob", 6).alias("prob"))


@register("e2_mean_folds", _FP + """
SELECT text_id, target, round(avg(CAST(label AS DOUBLE)), 6) AS label FROM fold_preds GROUP BY text_id, target""")
def e2_mean_folds(spark, sf_dir):
    m = E.mean_folds(T.fold_preds(spark, sf_dir))
    return m.select("text_id", "target", F.round("label", 6).alias("label"))


@register("e3_ensemble_wide", _VOTE_SQL + "SELECT text_id, " + ", ".join(
    f"max(CASE WHEN target = '{t}' THEN label END) AS {t}_label, "
    f"max(CASE WHEN target = '{t}' THEN round(p, 6) END) AS {t}_prob" for t in TARGETS)
    + " FROM win WHERE rk = 1 GROUP BY text_id")
def e3_ensemble_wide(spark, sf_dir):
    v = E.ensemble(T.fold_preds(spark, sf_dir), direct=False).withColumn("prob", F.round("prob", 6))
    wide = E.to_target_columns(v, "text_id", TARGETS)
    return wide.withColumnsRenamed({f"{t}_label": f"{t}_label" for t in TARGETS})


@register("e3_ensemble_direct_wide", _FP + "SELECT text_id, " + ", ".join(
    f"round(avg(CASE WHEN target = '{t}' THEN CAST(label AS DOUBLE) END), 6) AS {t}_label" for t in TARGETS)
    + " FROM fold_preds GROUP BY text_id")
def e3_ensemble_direct_wide(spark, sf_dir):
    m = E.ensemble(T.fold_preds(spark, sf_dir), direct=True).withColumn("label", F.round("label", 6))
    return E.to_target_columns(m, "text_id", TARGETS, values=["label"])


@register("p13_wide_long_roundtrip", _FP + """
SELECT text_id, target, 'label' AS kind, fold, CAST(label AS DOUBLE) AS value FROM fold_preds
UNION ALL SELECT text_id, target, 'prob', fold, prob FROM fold_preds""")
def p13_wide_long_roundtrip(spark, sf_dir):
    fp = T.fold_preds(spark, sf_dir)
    longer = fp.select("text_id", "target", "fold", F.col("label").cast("double").alias("label"),
                       "prob").unpivot(["text_id", "target", "fold"], ["label", "prob"], "kind", "value")
    wide = P.to_wide(longer, ["text_id"], TARGETS, ["label", "prob"], range(5))
    return P.to_long(wide, ["text_id"]).select("text_id", "target", "kind", "fold", "value")
