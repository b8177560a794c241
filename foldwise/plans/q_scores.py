"""Queries: class-score arithmetic (H1-H7) and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import scores as S
from foldwise.operators import losses as L
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.registry import register

_C = V.with_views(V.LOGIT_CELLS)


def _r(c, name=None):
    return F.round(c, 6).alias(name or c)


@register("h1_unpack_levels", _C + "SELECT id, target, c AS level, round(v, 6) AS z FROM cells")
def h1_unpack_levels(spark, sf_dir):
    cells = T.logit_cells(spark, sf_dir)
    return cells.select("id", "target", F.posexplode("z").alias("level", "z")).select(
        "id", "target", F.col("level").cast("int").alias("level"), _r("z"))


@register("h2_softmax", _C + "SELECT id, target, c AS level, round(p, 6) AS p FROM probs")
def h2_softmax(spark, sf_dir):
    cells = T.logit_cells(spark, sf_dir).withColumn("p", S.softmax("z"))
    return cells.select("id", "target", F.posexplode("p").alias("level", "p")).select(
        "id", "target", F.col("level").cast("int").alias("level"), _r("p"))


_TOP = _C + """,
top AS (SELECT id, j, target, c, p, row_number() OVER (PARTITION BY id, j ORDER BY p DESC, c) AS rk
        FROM probs)
"""


@register("h3_top_level", _TOP + "SELECT id, target, c AS level, round(p, 6) AS prob FROM top WHERE rk = 1")
def h3_top_level(spark, sf_dir):
    top = S.top_level(S.softmax("z"))
    return T.logit_cells(spark, sf_dir).select("id", "target", top["level"].alias("level"),
                                               _r(top["prob"], "prob"))


@register("h4_decode_level", _TOP + "SELECT id, target, CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * c AS score "
          "FROM top WHERE rk = 1")
def h4_decode_level(spark, sf_dir):
    top = S.top_level(S.softmax("z"))
    return T.logit_cells(spark, sf_dir).select("id", "target", S.decode_level(top["level"]).alias("score"))


@register("h5_encode_level", V.with_views(V.ESSAYS, V.TNAMES0) + """,
longer AS (UNPIVOT essays ON cohesion, syntax, vocabulary, phraseology, grammar, conventions
           INTO NAME target VALUE score)
SELECT text_id, target, score, CAST(round((score - 1) * 2) AS INTEGER) AS level FROM longer""")
def h5_encode_level(spark, sf_dir):
    from foldwise.constants import TARGETS
    e = T.essays(spark, sf_dir).select("text_id", *TARGETS).unpivot(["text_id"], TARGETS, "target", "score")
    return e.select("text_id", "target", "score", S.encode_level("score").alias("level"))


_EXP = _C + """,
ex AS (SELECT id, j, target, max(level) AS level, sum(p * (CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * c)) AS pred
       FROM probs GROUP BY id, j, target)
"""


@register("h6_expected_score", _EXP + "SELECT id, target, round(pred, 6) AS pred FROM ex")
def h6_expected_score(spark, sf_dir):
    return T.logit_cells(spark, sf_dir).select("id", "target",
                                               _r(S.expected_score(S.softmax("z")), "pred"))


@register("h7_score_modes", _TOP + """,
ex AS (SELECT id, j, sum(p * (CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * c)) AS pred FROM probs GROUP BY id, j)
SELECT t.id, t.target, CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * t.c AS top_score,
       round(ex.pred, 6) AS avg_score
FROM top t JOIN ex ON t.id = ex.id AND t.j = ex.j WHERE t.rk = 1""")
def h7_score_modes(spark, sf_dir):
    p = S.softmax("z")
    return T.logit_cells(spark, sf_dir).select("id", "target", S.score(p, "top").alias("top_score"),
                                               _r(S.score(p, "weighted_avg"), "avg_score"))


_CE = _C + """,
ce AS (SELECT id, j, max(lse) - max(CASE WHEN c = level THEN v END) AS nll, max(lse) - avg(v) AS smooth
       FROM probs GROUP BY id, j)
"""


@register("l1_cross_entropy", _CE + """
SELECT round(avg(nll), 6) AS ce, round(avg(CAST(0.9 AS DOUBLE) * nll + CAST(0.1 AS DOUBLE) * smooth), 6)
       AS ce_smooth FROM ce""")
def l1_cross_entropy(spark, sf_dir):
    cells = T.logit_cells(spark, sf_dir)
    return cells.agg(_r(F.avg(L.cross_entropy_expr("z", "level")), "ce"),
                     _r(F.avg(L.cross_entropy_expr("z", "level", eps=0.1)), "ce_smooth"))


_PRED = _EXP + """,
yp AS (SELECT id, j, CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * level AS y, pred FROM ex)
"""


def _pred_cells(spark, sf_dir):
    return T.logit_cells(spark, sf_dir).withColumn("pred", S.expected_score(S.softmax("z")))


@register("l2_mse", _PRED + "SELECT round(avg((y - pred) * (y - pred)), 6) AS mse FROM yp")
def l2_mse(spark, sf_dir):
    return L.mse(_pred_cells(spark, sf_dir)).select(_r("mse"))


@register("l3_smooth_l1", _PRED + """
SELECT round(avg(CASE WHEN abs(y - pred) < 1 THEN 0.5 * (y - pred) * (y - pred)
                      ELSE abs(y - pred) - 0.5 END), 6) AS smooth_l1 FROM yp""")
def l3_smooth_l1(spark, sf_dir):
    return L.smooth_l1(_pred_cells(spark, sf_dir)).select(_r("smooth_l1"))


@register("l4_combined_loss", _CE + """,
ex AS (SELECT id, j, max(level) AS level, sum(p * (CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * c)) AS pred
       FROM probs GROUP BY id, j),
yp AS (SELECT ex.id, ex.j, CAST(1 AS DOUBLE) + CAST(0.5 AS DOUBLE) * level AS y, pred, ce.nll
       FROM ex JOIN ce ON ex.id = ce.id AND ex.j = ce.j)
SELECT round(avg(nll), 6) AS cross_entropy, round(avg((y - pred) * (y - pred)), 6) AS mse,
       round(avg(nll) + 0.5 * avg((y - pred) * (y - pred)), 6) AS loss FROM yp""")
def l4_combined_loss(spark, sf_dir):
    out = L.combined_loss(_pred_cells(spark, sf_dir), {"cross_entropy": 1.0, "mse": 0.5, "smooth_l1": 0.0})
    return out.select(_r("cross_entropy"), _r("mse"), _r("loss"))


@register("l7_batch_mean_loss", V.with_views(V.LOSS_LOG) + """,
b AS (SELECT run, floor(step / 64) AS batch, avg(loss) AS m FROM loss_log GROUP BY run, floor(step / 64))
SELECT b.run, round(avg(m), 6) AS batch_mean, round(max(r.row_mean), 6) AS row_mean, count(*) AS batches
FROM b JOIN (SELECT run, avg(loss) AS row_mean FROM loss_log GROUP BY run) r ON b.run = r.run
GROUP BY b.run""")
def l7_batch_mean_loss(spark, sf_dir):
    log = T.loss_log(spark, sf_dir).withColumn("batch", F.floor(F.col("step") / 64))
    return L.batch_mean_loss(log, by=["run"]).select("run", _r("batch_mean"), _r("row_mean"), "batches")


def token_logits(spark, sf_dir):
    """Token rows of all layers: 64 class logits, a target class or -100 on masked
    positions, and the mask; every third document is masked throughout."""
    h = T.hidden(spark, sf_dir).withColumn("mask", F.when(F.col("doc") % 3 == 2, F.lit(0)).otherwise(F.col("mask")))
    tgt = F.when(F.col("mask") == 1, ((F.col("doc") + F.col("pos")) % 64).cast("int")).otherwise(F.lit(-100))
    return h.select("doc", "layer", "pos", "mask", F.col("vec").alias("z"), tgt.alias("target"))


_TOK = V.with_views(V.HIDDEN_DIMS) + """,
tk AS (SELECT doc, layer, pos, dim, v, CASE WHEN doc % 3 = 2 THEN 0 ELSE mask END AS mask FROM hd),
tt AS (SELECT *, CASE WHEN mask = 1 THEN CAST((doc + pos) % 64 AS INTEGER) ELSE -100 END AS target FROM tk),
mx AS (SELECT *, max(v) OVER (PARTITION BY doc, layer, pos) AS m FROM tt),
ce AS (SELECT doc, layer, pos, max(mask) AS mask, max(target) AS target,
              CASE WHEN max(target) = -100 THEN CAST(0 AS DOUBLE)
                   ELSE max(m) + ln(sum(exp(v - m))) - max(CASE WHEN dim = target THEN v END) END AS loss
       FROM mx GROUP BY doc, layer, pos)
"""


@register("l6_token_ce", _TOK + "SELECT doc, layer, pos, round(loss, 6) AS loss FROM ce")
def l6_token_ce(spark, sf_dir):
    t = token_logits(spark, sf_dir)
    return t.select("doc", "layer", "pos", _r(L.token_ce_expr("z", "target"), "loss"))


@register("l5_masked_mean", _TOK + """
SELECT doc, layer, round(sum(loss * mask) / nullif(sum(mask), 0), 6) AS masked_mean FROM ce GROUP BY doc, layer""")
def l5_masked_mean(spark, sf_dir):
    t = token_logits(spark, sf_dir).withColumn("loss", L.token_ce_expr("z", "target"))
    return L.masked_mean(t, "loss", "mask", by=["doc", "layer"]).select("doc", "layer", _r("masked_mean"))


@register("l6_soft", _TOK + """,
sc AS (SELECT doc, layer, pos, max(mask) AS mask, max(m) + ln(sum(exp(v - m))) AS lse,
              0.75 * max(CASE WHEN dim = (doc + pos) % 64 THEN v END) + 0.25 * max(CASE WHEN dim = (doc + pos + 1) % 64 THEN v END) AS hit
       FROM mx GROUP BY doc, layer, pos)
SELECT doc, layer, pos, round(CASE WHEN mask = 1 THEN lse - hit ELSE 0 END, 6) AS loss FROM sc""")
def l6_soft(spark, sf_dir):
    """Soft targets (T12's soft form): 0.75 on the class, 0.25 on the next; all -100 where masked."""
    from foldwise.operators.spans import scatter_target
    t = token_logits(spark, sf_dir)
    soft = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: F.lit(0.0))
    soft = F.transform(F.arrays_zip(F.sequence(F.lit(0), F.lit(63)).alias("c"), soft.alias("p")), lambda e: F.when(
        e["c"] == (F.col("doc") + F.col("pos")) % 64, F.lit(0.75)).when(e["c"] == (F.col("doc") + F.col("pos") + 1) % 64, F.lit(0.25)).otherwise(e["p"]))
    rows = t.select("doc", "layer", "pos", "z", F.array((F.col("mask") == 1)).alias("flag"), F.array(soft).alias("label"))
    rows = scatter_target(rows, soft=True, width=64)
    return rows.select("doc", "layer", "pos", _r(L.token_soft_ce_expr("z", F.col("target")[0]), "loss"))
