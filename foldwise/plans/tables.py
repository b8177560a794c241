"""Driver tables and the derived fixture views (FIXTURES.md part C).

Each view is derived by Spark from the driver tables, so its size grows with
them.  The oracle side writes the same views as SQL in
:mod:`foldwise.plans.oracle_views`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.constants import TARGETS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, doc_id, full_text and six scores on the 1.0-5.0 grid."""
    d = table(spark, sf_dir, "documents")
    scores = {t: F.lit(1.0).cast("double") + F.lit(0.5).cast("double")
              * ((F.col("n_chars") + F.lit(j) * F.col("doc_id")) % 9)
              for j, t in enumerate(TARGETS, start=1)}
    return d.select(F.col("doc_id").cast("string").alias("text_id"), "doc_id",
                    F.col("text").alias("full_text"), *[v.alias(k) for k, v in scores.items()])


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined to labels: doc_id, lang, source, n_chars, quality, toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


def fold_preds(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Long per-fold predictions (text_id, fold, target, label, prob); has vote ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    tj = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(t).alias("target"))
                   for j, t in enumerate(TARGETS, start=1)])
    x = (d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
          .withColumn("t", F.explode(tj)))
    return x.select(
        F.col("doc_id").cast("string").alias("text_id"),
        F.col("fold").cast("int").alias("fold"),
        F.col("t.target").alias("target"),
        ((F.col("n_chars") + F.col("doc_id") * F.col("fold") + F.col("t.j")) % 3).cast("int").alias("label"),
        (((F.col("doc_id") * (F.col("fold") + 1) + F.col("t.j")) % 100).cast("double") / 100).alias("prob"),
    )


def first_stage(spark: SparkSession, sf_dir: str, n_src: int = 4) -> DataFrame:
    """First-stage outputs of ``n_src`` models: text_id, src, six predictions."""
    e = essays(spark, sf_dir).drop("full_text")
    x = e.withColumn("src", F.explode(F.sequence(F.lit(0), F.lit(n_src - 1))))
    return x.select(
        "text_id", F.col("src").cast("int").alias("src"),
        *[(F.col(t) + F.lit(0.1).cast("double")
           * ((F.col("doc_id") + F.col("src") + F.lit(j)) % 5 - 2)).alias(t)
          for j, t in enumerate(TARGETS, start=1)])


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as training-loss log: run, step (0-based, by ts then event_id), loss."""
    from foldwise.operators.columns import with_ordinal
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), "ts", "event_id",
                                                F.col("value").alias("loss"))
    out = with_ordinal(ev, ["ts", "event_id"], by=["run"], name="step")
    return out.select("run", F.col("step").cast("int").alias("step"), "loss")


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token hidden states: doc, layer, pos, mask (with holes), vec array<double>."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 40).cast("long").alias("doc"),
        (F.floor(F.col("vec_id") / 10) % 4).cast("int").alias("layer"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.when(F.col("vec_id") % 10 < F.col("label") % 8 + 3, 1).otherwise(0).cast("int").alias("mask"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def class_head(d: int = 64, o: int = 54):
    """A fixed head from the whole vector to 54 logits: W[i, k] = ((7 i + 3 k) % 11 - 5) / 10."""
    i, k = np.arange(d)[:, None], np.arange(o)[None, :]
    return ((7 * i + 3 * k) % 11 - 5) / 10.0


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores: id, label and 54 logits (level-major 9 x 6) of the whole vector through a head (V9)."""
    from foldwise.operators.pooling import project
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    return project(e, class_head(), out="z").drop("vec")


def word_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document with position and class length(word) % 8 (7 = ignore)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = d.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return w.select("doc_id", F.col("pos").cast("int").alias("pos"), "word",
                    (F.length("word") % 8).cast("int").alias("label"))


def logit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, j, target, z array<double>(9), level, y): logits of each target with a
    true level ``(label + j) % 9`` and its score ``1 + 0.5 * level``."""
    from foldwise.operators.classes import unpack_levels
    cells = unpack_levels(logits(spark, sf_dir), "z", keep=["id", "label"])
    lvl = ((F.col("label") + F.col("j")) % 9).cast("int")
    return cells.select("id", "j", "target", "z", lvl.alias("level"),
                        (F.lit(1.0) + F.lit(0.5) * lvl).alias("y"))
