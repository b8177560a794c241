"""Queries: file sources and sinks (S1-S8) and the fold layout.

Each query writes what it needs under a fresh folder of the session's shared
scratch location (checkpoint directory, else warehouse), then reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.constants import TARGETS
from foldwise.operators import columns as P
from foldwise.operators import monitor as R
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.q_folds import labelled_folds
from foldwise.plans.registry import register
from foldwise.sources import files as S


def _essay_frame(spark, sf_dir):
    return T.essays(spark, sf_dir).select("text_id", "full_text", *TARGETS)


@register("s1_csv_roundtrip", V.with_views(V.ESSAYS) + "SELECT text_id, full_text, " + ", ".join(TARGETS)
          + " FROM essays")
def s1_csv_roundtrip(spark, sf_dir):
    path = S.scratch_dir(spark) + "/essays.csv"
    S.write_table(_essay_frame(spark, sf_dir), path, fmt="csv")
    return S.read_essays(spark, path)


@register("s2_read_parquet", "SELECT doc_id, lang, source, n_chars FROM documents")
def s2_read_parquet(spark, sf_dir):
    return S.read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@register("s3_dispatch", "SELECT 'csv' AS fmt, doc_id, quality, toxic FROM labels "
          "UNION ALL SELECT 'parquet', doc_id, quality, toxic FROM labels")
def s3_dispatch(spark, sf_dir):
    base = S.scratch_dir(spark)
    labels = S.read_table(spark, f"{sf_dir}/labels.parquet")
    S.write_table(labels, f"{base}/labels.csv", fmt="csv")
    S.write_table(labels, f"{base}/labels.pq")
    schema = labels.schema
    a = S.read_table(spark, f"{base}/labels.csv", schema=schema).withColumn("fmt", F.lit("csv"))
    b = S.read_table(spark, f"{base}/labels.pq").withColumn("fmt", F.lit("parquet"))
    return a.unionByName(b).select("fmt", "doc_id", "quality", "toxic")


@register("s4_read_tagged", V.with_views(V.ESSAYS, V.FIRST_STAGE) + "SELECT text_id, src, " + ", ".join(
    f"round({t}, 6) AS {t}" for t in TARGETS) + " FROM first_stage")
def s4_read_tagged(spark, sf_dir):
    base = S.scratch_dir(spark)
    fs = T.first_stage(spark, sf_dir)
    paths = []
    for s in range(4):   # one CSV per first-stage model, as the reference stores them
        p = f"{base}/first_stage_{s}.csv"
        S.write_table(fs.filter(F.col("src") == s).drop("src"), p, fmt="csv")
        paths.append(p)
    schema = fs.drop("src").schema
    out = S.read_tagged(spark, paths, schema=schema)
    return out.select("text_id", F.col("src").cast("int").alias("src"), *[F.round(t, 6).alias(t) for t in TARGETS])


@register("s5_write_csv", V.with_views(V.LABELLED_FOLDS) + "SELECT doc_id, quality, toxic, fold FROM lf")
def s5_write_csv(spark, sf_dir):
    path = S.scratch_dir(spark) + "/folds.csv"
    folds = labelled_folds(spark, sf_dir).select("doc_id", "quality", "toxic", "fold")
    S.write_table(folds, path, fmt="csv")
    return S.read_table(spark, path, schema=folds.schema)


@register("s6_csv_with_ordinal", V.with_views(V.ESSAYS)
          + "SELECT CAST(row_number() OVER (ORDER BY text_id) - 1 AS BIGINT) AS ordinal, text_id, cohesion FROM essays")
def s6_csv_with_ordinal(spark, sf_dir):
    path = S.scratch_dir(spark) + "/ordinal.csv"
    S.write_table(T.essays(spark, sf_dir).select("text_id", "cohesion"), path, fmt="csv",
                  with_ordinal=True, order_by=["text_id"])
    back = spark.read.options(**S.CSV_OPTIONS).schema("ordinal bigint, text_id string, cohesion double").csv(path)
    return back


@register("s7_fold_layout", V.with_views(V.LABELLED_FOLDS) + "SELECT doc_id, lang, quality, toxic FROM lf WHERE fold = 2")
def s7_fold_layout(spark, sf_dir):
    path = S.scratch_dir(spark) + "/folds"
    S.write_folds(labelled_folds(spark, sf_dir).select("doc_id", "lang", "quality", "toxic", "fold"), path)
    _, valid = P.split_fold(S.read_folds(spark, path), 2)
    return valid.select("doc_id", "lang", "quality", "toxic")


@register("s8_run_missing", V.with_views(V.LOSS_LOG) + """,
best AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS rk FROM loss_log)
SELECT run, step AS best_step, loss AS best_loss FROM best WHERE rk = 1""")
def s8_run_missing(spark, sf_dir):
    path = S.scratch_dir(spark) + "/best"
    log = T.loss_log(spark, sf_dir)
    keys = log.select("run").distinct()

    def work(missing):
        return R.best_epoch(log.join(missing, "run", "left_semi")).select(
            F.col("best_step").cast("int"), "best_loss", "run")

    # an earlier, interrupted job finished two runs; the resumed job does the rest
    S.run_missing(spark, keys.filter(F.col("run").isin("click", "view")), path, work, ["run"])
    S.run_missing(spark, keys, path, work, ["run"])
    return spark.read.parquet(path).select("run", "best_step", "best_loss")


@register("s4_path_with_space", "SELECT src, count(*) AS n FROM range(2) s(src) CROSS JOIN labels GROUP BY src")
def s4_path_with_space(spark, sf_dir):
    """Tagged files whose paths hold a space, a plus and a percent sign."""
    base = S.scratch_dir(spark)
    paths = [f"{base}/first stage+1%20.pq", f"{base}/first stage.pq"]
    for p in paths:
        S.write_table(T.table(spark, sf_dir, "labels"), p)
    return S.read_tagged(spark, paths, fmt="parquet").groupBy(F.col("src").cast("bigint").alias("src")).count().withColumnRenamed("count", "n")


@register("s8_string_keys", """
WITH units AS (SELECT CAST(doc_id % 12 AS VARCHAR) AS unit FROM documents UNION ALL SELECT '0' || (doc_id % 12) FROM documents)
SELECT unit, count(*) AS n, CASE WHEN unit = '1' THEN 1 ELSE 2 END AS ran FROM units GROUP BY unit""")
def s8_string_keys(spark, sf_dir):
    """Units named "1" and "01" are two units: the first call runs "1" alone, the
    second one all others, over the documents of each unit."""
    out = S.scratch_dir(spark) + "/units"
    part = F.col("doc_id") % 12
    docs = T.table(spark, sf_dir, "documents").select(F.explode(F.array(part.cast("string"), F.concat(F.lit("0"), part.cast("string")))).alias("unit"))
    keys = docs.distinct()
    ran = [S.run_missing(spark, k, out, lambda missing: docs.join(missing, "unit").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).select("n", "unit"),
                         ["unit"]).withColumn("ran", F.lit(i)) for i, k in ((1, keys.filter(F.col("unit") == "1")), (2, keys))]
    done = spark.read.schema("n long, unit string").parquet(out)
    return done.join(ran[0].unionByName(ran[1]), "unit").select("unit", "n", "ran")
