"""Queries: stacking (G1, G2), joins and unions (J1-J6, U1), column shaping
(P1-P12), general / ridge / ML out-of-fold fits (O1, O3, O4), scoring (B1, B2)
and multilabel quota folds (K1)."""

from __future__ import annotations



import numpy as np
from pyspark.sql import functions as F

from foldwise.constants import TARGETS
from foldwise.functions import scores as S
from foldwise.operators import columns as P
from foldwise.operators import ensemble as E
from foldwise.operators import fitting as N
from foldwise.operators import folds as K
from foldwise.operators import joins as J
from foldwise.operators import oof as O
from foldwise.operators import scoring as B
from foldwise.operators import stacking as G
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.q_folds import LABEL_TARGETS, labelled_folds
from foldwise.plans.registry import register
from foldwise.plans.scratch import written

N_SRC = 4
INPUTS = [f"p_{t}" for t in TARGETS]


def _r(c, name=None):
    return F.round(c, 6).alias(name or c)


def first_stage_long(spark, sf_dir):
    """First-stage outputs with prediction columns named p_<target>."""
    return T.first_stage(spark, sf_dir).withColumnsRenamed({t: f"p_{t}" for t in TARGETS})


def truth(spark, sf_dir):
    return T.essays(spark, sf_dir).select("text_id", *TARGETS)


def source_table(spark, sf_dir, s):
    """One first-stage output file in the reference's shape: id, six true
    scores, six predictions."""
    fs = first_stage_long(spark, sf_dir).filter(F.col("src") == s).drop("src")
    return fs.join(truth(spark, sf_dir), "text_id")


_FS = V.with_views(V.ESSAYS, V.FIRST_STAGE)

_WIDE_SQL = _FS + "SELECT e.text_id, " + ", ".join(f"e.{t}" for t in TARGETS) + ", " + ", ".join(
    f"s{s}.{t} AS p_{t}_label_{s}" for s in range(N_SRC) for t in TARGETS) + " FROM essays e " + " ".join(
    f"JOIN first_stage s{s} ON s{s}.text_id = e.text_id AND s{s}.src = {s}" for s in range(N_SRC))


@register("g1_stack_table", _FS + """,
longer AS (UNPIVOT first_stage ON """ + ", ".join(TARGETS) + """ INTO NAME target VALUE value),
t AS (SELECT 0 AS j, 'cohesion' AS target UNION ALL SELECT 1, 'syntax' UNION ALL SELECT 2, 'vocabulary'
      UNION ALL SELECT 3, 'phraseology' UNION ALL SELECT 4, 'grammar' UNION ALL SELECT 5, 'conventions')
SELECT l.text_id, CAST(l.src * 6 + t.j AS INTEGER) AS k, round(l.value, 6) AS value
FROM longer l JOIN t ON l.target = t.target""")
def g1_stack_table(spark, sf_dir):
    tab = G.stack_table(first_stage_long(spark, sf_dir), "text_id", INPUTS, N_SRC)
    x = tab.select("text_id", F.posexplode("features").alias("k", "value"))
    return x.select("text_id", F.col("k").cast("int").alias("k"), _r("value"))


def _rounded(df):
    return df.select(*[_r(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_WIDE_ROUND_SQL = "SELECT text_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in TARGETS + [
    f"p_{t}_label_{s}" for s in range(N_SRC) for t in TARGETS]) + " FROM (" + _WIDE_SQL + ")"


@register("g1_stack_wide", _WIDE_ROUND_SQL)
def g1_stack_wide(spark, sf_dir):
    tab = G.stack_table(first_stage_long(spark, sf_dir), "text_id", INPUTS, N_SRC, truth=truth(spark, sf_dir))
    return _rounded(G.stack_wide(tab, INPUTS, N_SRC))


@register("j2_join_chain", _WIDE_ROUND_SQL)
def j2_join_chain(spark, sf_dir):
    tables = [P.rename(source_table(spark, sf_dir, s), {c: f"{c}_label_{s}" for c in INPUTS})
              for s in range(N_SRC)]
    return _rounded(J.join_all(tables, ["text_id"], drop_right=TARGETS))


def _pair_sql(n_src: int) -> str:
    """The first two-way chain without the right side's targets (J3), rounded."""
    cols = TARGETS + [f"p_{t}_label_{s}" for s in range(n_src) for t in TARGETS]
    body = _FS + "SELECT e.text_id, " + ", ".join(f"e.{t}" for t in TARGETS) + ", " + ", ".join(
        f"s{s}.{t} AS p_{t}_label_{s}" for s in range(n_src) for t in TARGETS) + " FROM essays e " + " ".join(
        f"JOIN first_stage s{s} ON s{s}.text_id = e.text_id AND s{s}.src = {s}" for s in range(n_src))
    return "SELECT text_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + " FROM (" + body + ")"


@register("j3_drop_right", _pair_sql(N_SRC))
def j3_drop_right(spark, sf_dir):
    """The output files joined one by one, each after dropping its target columns."""
    first, *rest = [P.rename(source_table(spark, sf_dir, s), {c: f"{c}_label_{s}" for c in INPUTS}) for s in range(N_SRC)]
    for right in rest:
        first = J.join_all([first, right], ["text_id"], drop_right=TARGETS)
    return _rounded(first)


@register("p2_features_of", "SELECT * EXCLUDE (" + ", ".join(TARGETS) + ") FROM (" + _WIDE_ROUND_SQL + ")")
def p2_features_of(spark, sf_dir):
    tab = G.stack_table(first_stage_long(spark, sf_dir), "text_id", INPUTS, N_SRC, truth=truth(spark, sf_dir))
    wide = K.deal_folds(G.stack_wide(tab, INPUTS, N_SRC), "text_id", [], k=5)
    return _rounded(P.select_features(wide, ["text_id"], TARGETS))


@register("j4_join_suffixed", _FS + """
SELECT a.text_id, a.src, """ + ", ".join(f"round(a.{t}, 6) AS {t}, round(b.{t}, 6) AS {t}_y" for t in TARGETS) + """
FROM first_stage a JOIN first_stage b ON a.text_id = b.text_id AND b.src = a.src + 1""")
def j4_join_suffixed(spark, sf_dir):
    """Every source beside the next one."""
    fs = T.first_stage(spark, sf_dir)
    return _rounded(J.join_suffixed(fs, fs.withColumn("src", F.col("src") - 1), ["text_id", "src"]))


@register("j1_join_outputs", V.with_views(V.ESSAYS, V.TARGETS6, V.FOLDS5, V.FOLD_PREDS) + """,
per AS (SELECT text_id, target, label, count(*) AS n, min(fold) AS f FROM fold_preds GROUP BY text_id, target, label),
win AS (SELECT *, row_number() OVER (PARTITION BY text_id, target ORDER BY n DESC, f) AS rk FROM per)
SELECT e.text_id, """ + ", ".join(f"any_value(e.{t}) AS {t}, max(CASE WHEN w.target = '{t}' THEN w.label END) AS {t}_label" for t in TARGETS) + """
FROM essays e JOIN win w ON w.text_id = e.text_id AND w.rk = 1 GROUP BY e.text_id""")
def j1_join_outputs(spark, sf_dir):
    """The voted labels of all targets joined to the true scores."""
    v = E.vote(T.fold_preds(spark, sf_dir)).groupBy("text_id").pivot("target", TARGETS).agg(F.first("label"))
    v = v.withColumnsRenamed({t: f"{t}_label" for t in TARGETS})
    return J.join_outputs(truth(spark, sf_dir), v, ["text_id"], null_safe=True)


@register("j5_attach", V.with_views(V.LABELLED_FOLDS) + """,
oof AS (SELECT r.doc_id, """ + ", ".join(f"""coalesce((SELECT avg(CAST(t.{y} AS DOUBLE)) FROM lf t WHERE t.lang = r.lang AND t.fold <> r.fold),
                                  (SELECT avg(CAST(t.{y} AS DOUBLE)) FROM lf t WHERE t.fold <> r.fold)) AS {y}""" for y in LABEL_TARGETS) + """ FROM lf r)
SELECT d.doc_id, d.lang, """ + ", ".join(f"round(o.{y}, 6) AS {y}_pred" for y in LABEL_TARGETS) + """ FROM documents d LEFT JOIN oof o ON d.doc_id = o.doc_id""")
def j5_attach(spark, sf_dir):
    """Out-of-fold predictions of both labels attached to all documents."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    preds = O.oof_group_mean(labelled_folds(spark, sf_dir), "doc_id", "lang", LABEL_TARGETS)
    for t in LABEL_TARGETS:
        rows = J.attach(rows, preds.filter(F.col("target") == t).select("doc_id", _r("pred", f"{t}_pred")), "doc_id", how="left")
    return rows


@register("j6_duplicate_keys", _FS + "SELECT text_id, count(*) AS count FROM first_stage GROUP BY text_id "
          "HAVING count(*) > 1")
def j6_duplicate_keys(spark, sf_dir):
    return J.duplicate_keys(T.first_stage(spark, sf_dir), ["text_id"])


@register("u1_union_all", V.with_views(V.TARGETS6, V.FOLDS5, V.FOLD_PREDS) + """
SELECT text_id, fold, target, label, CAST(NULL AS DOUBLE) AS prob FROM fold_preds WHERE fold % 2 = 0
UNION ALL SELECT text_id, fold, target, CAST(NULL AS INTEGER), prob FROM fold_preds WHERE fold % 2 = 1""")
def u1_union_all(spark, sf_dir):
    fp = T.fold_preds(spark, sf_dir)
    pieces = [P.split_fold(fp, f)[1].drop("prob" if f % 2 == 0 else "label") for f in range(5)]
    return J.union_all(pieces)


@register("p1_select", V.with_views(V.ESSAYS) + "SELECT text_id, cohesion, syntax FROM essays")
def p1_select(spark, sf_dir):
    return P.select_columns(T.essays(spark, sf_dir), ["text_id", "cohesion", "syntax"])


@register("p3_p4_p6_shape", _FS + "SELECT text_id, src, " + ", ".join(
    f"round({t}, 6) AS {'grammar_score' if t == 'grammar' else t}_fold0" for t in TARGETS if t != "syntax") + " FROM first_stage")
def p3_p4_p6_shape(spark, sf_dir):
    """All sources: one target dropped, one renamed (an absent name changes nothing), the rest suffixed."""
    fs = P.drop_columns(T.first_stage(spark, sf_dir), ["syntax", "not_a_column"])
    fs = P.rename(fs, {"grammar": "grammar_score", "not_a_column": "ignored"})
    return _rounded(P.suffix_columns(fs, "_fold0", keep=["text_id", "src"]))


@register("p5_ordinal_by_group", """
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS ordinal
FROM documents""")
def p5_ordinal_by_group(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return P.with_ordinal(d, [("n_chars", "desc"), "doc_id"], by=["lang"]).select("doc_id", "lang", "ordinal")


@register("p5_global_ordinal", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def p5_global_ordinal(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", "ts")
    return P.with_ordinal(e, ["ts", "event_id"]).select("event_id", "ordinal")


@register("p8_fold_roles", V.with_views(V.LABELLED_FOLDS) + """
SELECT doc_id, CAST(h.range AS INTEGER) AS held_out, CASE WHEN fold = h.range THEN 'valid' ELSE 'train' END AS role
FROM lf CROSS JOIN range(5) h""")
def p8_fold_roles(spark, sf_dir):
    r = P.fold_roles(labelled_folds(spark, sf_dir), 5)
    return r.select("doc_id", F.col("held_out").cast("int"), "role")


@register("p9_assign_where", V.with_views(V.LABELLED_FOLDS)
          + "SELECT doc_id, CASE WHEN fold = 2 THEN 'valid' ELSE 'train' END AS split FROM lf")
def p9_assign_where(spark, sf_dir):
    d = labelled_folds(spark, sf_dir)
    d = P.assign_where(d, F.col("fold") == 2, "split", "valid")
    d = P.assign_where(d, F.col("fold") != 2, "split", "train")
    return d.select("doc_id", "split")


@register("p10_cast_cols", V.with_views(V.ESSAYS) + "SELECT text_id, " + ", ".join(
    f"CAST(trunc({t} * 1.5) AS INTEGER) AS {t}" for t in TARGETS) + " FROM essays")
def p10_cast_cols(spark, sf_dir):
    e = T.essays(spark, sf_dir).select("text_id", *[(F.col(t) * 1.5).alias(t) for t in TARGETS])
    return P.cast_cols(e, {t: "int" for t in TARGETS})


@register("p11_p12_assemble", V.with_views(V.ESSAYS) + "SELECT text_id, " + ", ".join(
    f"{t} AS {t}_copy" for t in TARGETS) + ", " + " + ".join(TARGETS) + " AS total FROM essays")
def p11_p12_assemble(spark, sf_dir):
    e = P.assemble(T.essays(spark, sf_dir), TARGETS, "vec")
    e = e.withColumn("total", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))
    return P.disassemble(e.select("text_id", "vec", "total"), "vec", [f"{t}_copy" for t in TARGETS])


def _fit_group_mean(train):
    return (train.groupBy("lang").agg(F.avg("y").alias("g")),
            train.agg(F.avg("y").alias("m")))


def _predict_group_mean(model, valid):
    g, m = model
    return (valid.join(g, "lang", "left").crossJoin(F.broadcast(m))   # m: one row
                 .select("doc_id", "fold", "lang", "target", "y",
                         F.coalesce("g", "m").alias("pred")))


@register("o1_oof_loop", V.with_views(V.LABELLED_FOLDS) + """,
rows_ AS (""" + " UNION ALL ".join(f"SELECT doc_id, fold, lang, '{t}' AS target, CAST({t} AS DOUBLE) AS y FROM lf" for t in LABEL_TARGETS) + """)
SELECT r.doc_id, r.fold, r.lang, r.target, r.y,
       round(coalesce((SELECT avg(t.y) FROM rows_ t WHERE t.lang = r.lang AND t.target = r.target AND t.fold <> r.fold),
                      (SELECT avg(t.y) FROM rows_ t WHERE t.target = r.target AND t.fold <> r.fold)), 6) AS pred FROM rows_ r""")
def o1_oof_loop(spark, sf_dir):
    """Both labels, each by its own loop over the folds."""
    d = labelled_folds(spark, sf_dir)
    found = [O.oof(d.select("doc_id", "fold", "lang", F.lit(t).alias("target"), F.col(t).cast("double").alias("y")), 5,
                   _fit_group_mean, _predict_group_mean, id_col="doc_id") for t in LABEL_TARGETS]
    return J.union_all(found).select("doc_id", "fold", "lang", "target", "y", _r("pred"))


_OLS_SQL = V.with_views(V.LABELLED_FOLDS) + """,
rows_ AS (SELECT doc_id, fold, CAST(n_chars AS DOUBLE) AS x, 'quality' AS target, CAST(quality AS DOUBLE) AS y FROM lf
          UNION ALL SELECT doc_id, fold, CAST(n_chars AS DOUBLE), 'toxic', CAST(toxic AS DOUBLE) FROM lf),
fits AS (SELECT h.range AS held, r.target, regr_slope(r.y, r.x) AS b, regr_intercept(r.y, r.x) AS a
         FROM range(5) h JOIN rows_ r ON r.fold <> h.range GROUP BY h.range, r.target)
SELECT r.doc_id, r.fold, r.target, r.y, round(f.a + f.b * r.x, 6) AS pred
FROM rows_ r JOIN fits f ON f.held = r.fold AND f.target = r.target"""


def _ols_rows(spark, sf_dir):
    d = labelled_folds(spark, sf_dir)
    return d.select("doc_id", "fold", F.array(F.col("n_chars").cast("double")).alias("x"),
                    *[F.col(t).cast("double").alias(t) for t in LABEL_TARGETS])


@register("o3_oof_linear_1d", _OLS_SQL)
def o3_oof_linear_1d(spark, sf_dir):
    p = O.oof_ridge(_ols_rows(spark, sf_dir), "doc_id", "x", LABEL_TARGETS, lam=0.0)
    return p.select("doc_id", "fold", "target", "y", _r("pred"))


@register("o4_oof_ml_linear", _OLS_SQL)
def o4_oof_ml_linear(spark, sf_dir):
    from pyspark.ml.regression import LinearRegression
    p = O.oof_ml(_ols_rows(spark, sf_dir), "doc_id", "x", LABEL_TARGETS,
                 lambda: LinearRegression(solver="normal", regParam=0.0), k=5)
    return p.select("doc_id", "fold", "target", "y", _r("pred"))


def embedding_folds(spark, sf_dir):
    e = T.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label"))
    return K.deal_folds(e, "vec_id", ["label"], k=5, seed=7)


@register("o3_oof_ridge_64", """
SELECT CAST(f.range AS INTEGER) AS fold, count(*) AS n, CAST(0 AS DOUBLE) AS residual
FROM embeddings CROSS JOIN range(5) f GROUP BY f.range""")
def o3_oof_ridge_64(spark, sf_dir):
    """Per fold model: rows that it scores, and the largest residual of its normal
    equations, sum over training rows of (x - mean)(y - prediction) - lam * beta,
    relative to the rows (0 for an exact fit)."""
    d = embedding_folds(spark, sf_dir)
    return normal_equations(spark, d, O.fit_ridge_folds(d, "x", ["label"], lam=1.0), "vec_id", "x", 1.0)


def normal_equations(spark, d, model, id_col, features, lam):
    """(fold, n, residual) of every fold model, over the rows it was fitted on."""
    scored = O.predict_ridge(d.drop("fold"), model, id_col, features, fold=None).withColumnRenamed("fold", "model")
    err = scored.join(d.select(id_col, "fold", F.posexplode(features).alias("i", "x")), id_col)
    err = err.where("fold <> model").groupBy("model", "target", "i").agg(
        F.sum((F.col("x")) * (F.col("y") - F.col("pred"))).alias("r"), F.sum(F.col("y") - F.col("pred")).alias("r0"),
        F.avg("x").alias("m"), F.count(F.lit(1)).alias("rows"))
    beta = spark.createDataFrame([(f, t, i, float(b[i, j])) for f, (_, b) in model.models.items() for i in range(b.shape[0])
                                  for j, t in enumerate(model.targets)], "model int, target string, i int, beta double")   # folds x width x targets
    out = err.join(F.broadcast(beta), ["model", "target", "i"]).groupBy("model").agg(F.max(F.greatest(
        F.abs(F.col("r") - F.col("m") * F.col("r0") - lam * F.col("beta")), F.abs("r0")) / F.col("rows")).alias("worst"))
    n = scored.groupBy("model").agg(F.countDistinct(id_col).alias("n"))
    # adding 0.0 turns a negative zero into zero
    return out.join(n, "model").select(F.col("model").alias("fold"), "n", (F.round("worst", 6) + F.lit(0.0)).alias("residual"))


def _ridge2_sql(rows: str, lam: float, prediction: str) -> str:
    """Closed-form ridge on two features for every held-out fold and target of
    ``rows`` (id, fold, target, x1, x2, y), then ``prediction`` over rows r and fits f."""
    return f"""{rows},
mom AS (SELECT CAST(h.range AS INTEGER) AS held, r.target, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2,
               covar_pop(x1, x1) * count(*) + {lam} AS a, covar_pop(x1, x2) * count(*) AS b, covar_pop(x2, x2) * count(*) + {lam} AS c,
               covar_pop(x1, y) * count(*) AS p, covar_pop(x2, y) * count(*) AS q
        FROM range(5) h JOIN rows_ r ON r.fold <> h.range GROUP BY h.range, r.target),
beta AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM mom),
fits AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM beta)
{prediction}"""


_TWO = V.with_views(V.LABELLED_FOLDS) + """,
rows_ AS (SELECT doc_id, fold, CAST(n_chars AS DOUBLE) / 1000 AS x1, CAST(length(source) AS DOUBLE) AS x2, 'quality' AS target, CAST(quality AS DOUBLE) AS y FROM lf
          UNION ALL SELECT doc_id, fold, CAST(n_chars AS DOUBLE) / 1000, CAST(length(source) AS DOUBLE), 'toxic', CAST(toxic AS DOUBLE) FROM lf)"""


def _two_features(spark, sf_dir):
    d = labelled_folds(spark, sf_dir)
    return d.select("doc_id", "fold", F.array(F.col("n_chars").cast("double") / 1000, F.length("source").cast("double")).alias("x"),
                    *[F.col(t).cast("double").alias(t) for t in LABEL_TARGETS])


@register("o3_oof_ridge_2", _ridge2_sql(_TWO, 3.0, """
SELECT r.doc_id, r.fold, r.target, r.y, round(b0 + b1 * x1 + b2 * x2, 6) AS pred
FROM rows_ r JOIN fits f ON f.held = r.fold AND f.target = r.target"""))
def o3_oof_ridge_2(spark, sf_dir):
    p = O.oof_ridge(_two_features(spark, sf_dir), "doc_id", "x", LABEL_TARGETS, lam=3.0)
    return p.select("doc_id", "fold", "target", "y", _r("pred"))


@register("g2_stack_predict_2", _ridge2_sql(_TWO, 3.0, """
SELECT r.doc_id, r.target, round(avg(b0 + b1 * x1 + b2 * x2), 6) AS pred
FROM rows_ r JOIN fits f ON f.target = r.target GROUP BY r.doc_id, r.target"""))
def g2_stack_predict_2(spark, sf_dir):
    """Every row scored by all fold models, averaged."""
    d = _two_features(spark, sf_dir)
    return G.stack_predict(d, O.fit_ridge_folds(d, "x", LABEL_TARGETS, lam=3.0), "doc_id", features="x").select("doc_id", "target", _r("pred"))


@register("g2_stack_predict", """
SELECT CAST(doc_id AS VARCHAR) AS text_id, 6 AS targets, true AS near FROM documents""")
def g2_stack_predict(spark, sf_dir):
    """The whole second stage on 24 features: per text, the targets scored, and
    whether the mean of the fold models is within 0.01 of all its true scores (the
    first stage's errors are a function of the features' differences, so least
    squares finds the scores; :func:`g2_stack_predict_2` has exact values)."""
    tab = G.stack_table(first_stage_long(spark, sf_dir), "text_id", INPUTS, N_SRC, truth=truth(spark, sf_dir))
    tab = K.deal_folds(tab, "text_id", [], k=5, seed=42)
    model = O.fit_ridge_folds(tab, "features", TARGETS, lam=1.0)
    pred = G.stack_predict(tab, model, "text_id")
    true = O.long_targets(truth(spark, sf_dir), ["text_id"], TARGETS, "y")
    both = pred.join(true, ["text_id", "target"])
    return both.groupBy("text_id").agg(F.count(F.lit(1)).cast("int").alias("targets"), F.min(F.abs(F.col("pred") - F.col("y")) <= 0.01).alias("near"))


_STEPS, _RATE = 25, 0.2
_SCALED = _TWO + """,
scaled AS (SELECT doc_id, fold, target, y, (x1 - avg(x1) OVER (PARTITION BY target)) / stddev_samp(x1) OVER (PARTITION BY target) AS x1,
                  (x2 - avg(x2) OVER (PARTITION BY target)) / stddev_samp(x2) OVER (PARTITION BY target) AS x2 FROM rows_),
mom AS (SELECT h.range AS held, r.target, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22,
               sum(y) AS sy, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y
        FROM range(5) h JOIN scaled r ON r.fold <> h.range GROUP BY ALL)"""


@register("g3_second_stage_descent", _SCALED.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
fit AS (
  SELECT held, target, 0 AS step, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM mom
  UNION ALL
  SELECT f.held, f.target, step + 1, b0 - {_RATE} * (n * b0 + s1 * b1 + s2 * b2 - sy) / n, b1 - {_RATE} * (s1 * b0 + s11 * b1 + s12 * b2 - s1y) / n,
         b2 - {_RATE} * (s2 * b0 + s12 * b1 + s22 * b2 - s2y) / n
  FROM fit f JOIN mom m ON m.held = f.held AND m.target = f.target WHERE step < {_STEPS})
SELECT r.doc_id, r.fold, r.target, r.y, round(b0 + b1 * x1 + b2 * x2, 6) AS pred
FROM scaled r JOIN fit f ON f.held = r.fold AND f.target = r.target AND f.step = {_STEPS}""")
def g3_second_stage_descent(spark, sf_dir):
    """The data-parallel fit without hidden layers, by plain descent from zero: the
    summed gradients of every step decide the out-of-fold predictions."""
    d = _two_features(spark, sf_dir)
    mean, std = N.feature_scale(d, "x")
    net = N.Network([2, 2])
    models = {f: np.zeros(net.size) for f in range(5)}
    for _ in range(_STEPS):
        for f, (g, _) in N.network_gradients(d, "x", LABEL_TARGETS, net, models, mean, std).items():
            models[f] = models[f] - _RATE * g
    p = O.predict_ridge(d, N.NetworkFolds(net, mean, std, models, LABEL_TARGETS, {}), "doc_id", "x")
    return p.select("doc_id", "fold", "target", "y", _r("pred"))


@register("g3_second_stage_network", """
SELECT CAST(doc_id AS VARCHAR) AS text_id, 6 AS targets, true AS near FROM documents""")
def g3_second_stage_network(spark, sf_dir):
    """The second-stage network (two hidden layers here) fitted on 24 stacked features, out of
    fold: per text, the targets scored, and whether all are within 1.5 of the truth."""
    tab = G.stack_table(first_stage_long(spark, sf_dir), "text_id", INPUTS, N_SRC, truth=truth(spark, sf_dir))
    tab = written(K.deal_folds(tab, "text_id", [], k=5, seed=42))
    model = N.fit_network_folds(tab, "features", TARGETS, 5, hidden=(32, 16), steps=60, rate=0.02)
    pred = O.predict_ridge(tab, model, "text_id", "features")
    return pred.groupBy("text_id").agg(F.count(F.lit(1)).cast("int").alias("targets"), F.min(F.abs(F.col("pred") - F.col("y")) <= 1.5).alias("near"))


_SMOOTH = 0.1


@register("l1_fitted_class_moments", _TWO + f""",
levels AS (SELECT range AS level FROM range(9)),
marked AS (SELECT doc_id, fold, target, x1, x2, CAST(y * 3 + (doc_id % 4) AS BIGINT) AS y FROM rows_)
SELECT CAST(h.range AS INTEGER) AS fold, target, CAST(level AS INTEGER) AS level, round(sum(w), 4) AS s0, round(sum(w * x1), 4) AS s1, round(sum(w * x2), 4) AS s2
FROM (SELECT m.*, level, {1 - _SMOOTH} * CAST(level = y AS INT) + {_SMOOTH} / CAST(9 AS DOUBLE) AS w FROM marked m CROSS JOIN levels) r JOIN range(5) h ON r.fold <> h.range
GROUP BY ALL""")
def l1_fitted_class_moments(spark, sf_dir):
    """Class scorers fitted by Newton's method: at the solution the probabilities of
    every level add up, over a model's training rows, to the smoothed labels, and so
    do their products with each feature (the gradient is zero).  The query sums
    the fitted probabilities; its SQL sums the labels."""
    d = _two_features(spark, sf_dir)
    d = written(d.select("doc_id", "fold", "x", *[(F.col(t) * 3 + F.col("doc_id") % 4).cast("int").alias(t) for t in LABEL_TARGETS]))
    model = N.fit_class_folds(d, "x", LABEL_TARGETS, 5, eps=_SMOOTH)
    z = N.class_logits(d.withColumn("own", F.col("fold")), model, "x", fold=None, keep=["own", "x"]).where("own != fold")
    cells = z.select("fold", "x", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), S.softmax(S.target_levels("z", j, 9, 2)).alias("p"))
                                                      for j, t in enumerate(LABEL_TARGETS)])).alias("c"))
    p = cells.select("fold", "x", "c.target", F.posexplode("c.p").alias("level", "p"))
    return p.groupBy("fold", "target", "level").agg(*[F.round(F.sum(F.col("p") * f), 4).alias(n) for n, f in (
        ("s0", F.lit(1.0)), ("s1", F.get("x", F.lit(0))), ("s2", F.get("x", F.lit(1))))])


@register("o1_incomplete_folds", V.with_views(V.LABELLED_FOLDS) + """,
cases AS (SELECT 'null fold' AS kind, CASE WHEN doc_id % 2 = 0 THEN fold END AS fold FROM lf
          UNION ALL SELECT 'foreign fold', fold * 2 FROM lf UNION ALL SELECT 'complete', fold FROM lf)
SELECT kind, count(*) FILTER (fold IS NULL OR fold NOT BETWEEN 0 AND 4) AS misplaced,
       CASE WHEN count(*) FILTER (fold IS NULL OR fold NOT BETWEEN 0 AND 4) = 0 THEN count(*) END AS predicted FROM cases GROUP BY kind""")
def o1_incomplete_folds(spark, sf_dir):
    """Out-of-fold prediction must not lose rows: a null fold and a fold outside
    [0, k) end the query (nothing is predicted), the table as dealt does not."""
    d = labelled_folds(spark, sf_dir).select("doc_id", "fold", "lang", F.lit("quality").alias("target"), F.col("quality").cast("double").alias("y"))
    cases = [("null fold", F.when(F.col("doc_id") % 2 == 0, F.col("fold"))), ("foreign fold", F.col("fold") * 2), ("complete", F.col("fold"))]
    found = []
    for kind, fold in cases:
        dealt = d.withColumn("fold", fold)
        misplaced = dealt.where(F.col("fold").isNull() | ~F.col("fold").between(0, 4)).count()
        try:
            found.append((kind, misplaced, O.oof(dealt, 5, _fit_group_mean, _predict_group_mean, id_col="doc_id").count()))
        except Exception as e:
            if "fold is null or outside" not in str(e):
                raise
            found.append((kind, misplaced, None))
    return spark.createDataFrame(found, "kind string, misplaced long, predicted long")


def fold_heads(k: int = 5, d: int = 64, o: int = 6):
    """k small fixed linear heads: W_f[i, j] = ((7 i + 3 j + f) % 11 - 5) / 10, b_f[j] = (j + f) / 10."""
    i = np.arange(d)[:, None]
    j = np.arange(o)[None, :]
    return [(((7 * i + 3 * j + f) % 11 - 5) / 10.0, (np.arange(o) + f) / 10.0) for f in range(k)]


def _heads_sql(k: int) -> str:
    return f"""
SELECT vec_id, CAST(f.f AS INTEGER) AS fold, t.target,
       round(sum(CAST(embedding[i.i + 1] AS DOUBLE) * ((7 * i.i + 3 * t.j + f.f) % 11 - 5) / 10)
             + (t.j + f.f) / 10, 6) AS pred
FROM embeddings CROSS JOIN range(64) i(i) CROSS JOIN range({k}) f(f) CROSS JOIN (
  SELECT 0 AS j, 'cohesion' AS target UNION ALL SELECT 1, 'syntax' UNION ALL SELECT 2, 'vocabulary'
  UNION ALL SELECT 3, 'phraseology' UNION ALL SELECT 4, 'grammar' UNION ALL SELECT 5, 'conventions') t
GROUP BY vec_id, f.f, t.j, t.target"""


def _emb(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@register("b1_score", _heads_sql(1))
def b1_score(spark, sf_dir):
    s = B.score(_emb(spark, sf_dir), fold_heads(1)[0], B.linear_model, "vec_id", "x", TARGETS)
    return s.select("vec_id", "fold", "target", _r("pred"))


@register("b2_score_folds", _heads_sql(5))
def b2_score_folds(spark, sf_dir):
    s = B.score_folds(_emb(spark, sf_dir), fold_heads(5), B.linear_model, "vec_id", "x", TARGETS)
    return s.select("vec_id", "fold", "target", _r("pred"))


@register("k1_quota_folds", """
SELECT CAST(doc_id AS VARCHAR) AS text_id, true AS once, true AS in_range, true AS even FROM documents""")
def k1_quota_folds(spark, sf_dir):
    """Every text: whether it has one fold, in 0..4, of sizes that differ by at most 2."""
    e = K.stratified_folds(T.essays(spark, sf_dir).select("text_id", *TARGETS), "text_id", TARGETS, k=5, seed=42).select("text_id", "fold")
    sizes = K.fold_sizes(e).agg((F.max("n") - F.min("n") <= 2).alias("even"))
    per = e.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    return per.crossJoin(F.broadcast(sizes)).select("text_id", (F.col("n") == 1).alias("once"), ((F.col("lo") >= 0) & (F.col("hi") <= 4)).alias("in_range"), "even")


def _balance_sql(view: str, targets) -> str:
    return V.with_views(view) + " UNION ALL ".join(
        f"SELECT '{t}' AS target, CAST({t} AS VARCHAR) AS value, count(*) AS n, true AS level FROM essays GROUP BY {t}" for t in targets)


def _balance(folds, targets):
    """Per (target, value): its rows, and whether their folds differ by at most 5."""
    # the dealt rows are read once: combinations are counted, then taken apart into cells
    cells = F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("value")) for t in targets))
    per = folds.groupBy(*targets, "fold").count().select("fold", "count", F.explode(cells).alias("cell"))
    per = per.groupBy("cell.target", "cell.value", "fold").agg(F.sum("count").alias("count"))
    per = per.groupBy("target", "value").agg(F.sum("count").alias("n"), F.min("count").alias("lo"), F.max("count").alias("hi"), F.count(F.lit(1)).alias("folds"))
    return per.select("target", "value", "n", (F.col("hi") - F.when(F.col("folds") == 5, F.col("lo")).otherwise(0) <= 5).alias("level"))


@register("k1_quota_balance", _balance_sql(V.ESSAYS, TARGETS))
def k1_quota_balance(spark, sf_dir):
    return _balance(K.stratified_folds(T.essays(spark, sf_dir).select("text_id", *TARGETS), "text_id", TARGETS, k=5, seed=42), TARGETS)


_WIDE_TARGETS = ["n_chars", "lang", "source"]


@register("k1_quota_wide", _balance_sql("essays AS (SELECT * FROM documents)", _WIDE_TARGETS))
def k1_quota_wide(spark, sf_dir):
    """Quota folds where one target has about as many values as there are rows."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", *_WIDE_TARGETS)
    return _balance(K.stratified_folds(d, "doc_id", _WIDE_TARGETS, k=5, seed=42), _WIDE_TARGETS)


_MANY_TARGETS = {"part": "l_partkey % 9", "supplier": "l_suppkey % 9", "ordered": "l_orderkey % 9", "line": "l_linenumber",
                 "quantity": "CAST(l_quantity AS BIGINT) % 9"}


@register("k1_quota_many", "WITH essays AS (SELECT " + ", ".join(f"{e} AS {t}" for t, e in _MANY_TARGETS.items()) + " FROM lineitem) "
          + " UNION ALL ".join(f"SELECT '{t}' AS target, CAST({t} AS VARCHAR) AS value, count(*) AS n, true AS level FROM essays GROUP BY {t}"
                               for t in _MANY_TARGETS))
def k1_quota_many(spark, sf_dir):
    """Quota folds over five targets whose values form tens of thousands of combinations."""
    d = T.table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"),
                                                 *[F.expr(e).alias(t) for t, e in _MANY_TARGETS.items()])
    return _balance(K.stratified_folds(d.withColumn("id", F.concat_ws(":", "id.*")), "id", list(_MANY_TARGETS), k=5, seed=42), list(_MANY_TARGETS))
