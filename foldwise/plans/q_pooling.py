"""Queries: pooling token vectors (V1-V9) on the hidden-state fixture."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators import attention as A
from foldwise.operators import pooling as V
from foldwise.plans import oracle_views as OV
from foldwise.plans import tables as T
from foldwise.plans.registry import register

_H = OV.with_views(OV.HIDDEN_DIMS)


def _long(df, keys, vec="pooled"):
    """array column -> (keys..., dim, value) rounded, for comparison."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "value")).select(
        *keys, F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@register("v1_mean_pool", _H + """
SELECT doc, layer, dim, round(sum(v * mask) / greatest(sum(mask), 1e-9), 6) AS value
FROM hd GROUP BY doc, layer, dim""")
def v1_mean_pool(spark, sf_dir):
    return _long(V.mean_pool(T.hidden(spark, sf_dir), by=["doc", "layer"]), ["doc", "layer"])


@register("v2_max_pool", _H + """
SELECT doc, layer, dim, round(coalesce(max(CASE WHEN mask = 1 THEN v END), -10000.0), 6) AS value
FROM hd GROUP BY doc, layer, dim""")
def v2_max_pool(spark, sf_dir):
    return _long(V.max_pool(T.hidden(spark, sf_dir), by=["doc", "layer"]), ["doc", "layer"])


@register("v3_min_pool", _H + """
SELECT doc, layer, dim, round(min(CASE WHEN mask = 1 THEN v END), 6) AS value
FROM hd GROUP BY doc, layer, dim""")
def v3_min_pool(spark, sf_dir):
    return _long(V.min_pool(T.hidden(spark, sf_dir), by=["doc", "layer"]), ["doc", "layer"])


@register("v4_attention_pool", _H + """,
m AS (SELECT doc, layer, max(score) AS mx FROM hd WHERE mask = 1 GROUP BY doc, layer),
w AS (SELECT hd.*, exp(hd.score - m.mx) AS e FROM hd JOIN m ON hd.doc = m.doc AND hd.layer = m.layer
      WHERE hd.mask = 1)
SELECT doc, layer, dim, round(sum(e * v) / sum(e), 6) AS value FROM w GROUP BY doc, layer, dim""")
def v4_attention_pool(spark, sf_dir):
    h = T.hidden(spark, sf_dir).withColumn("score", F.col("vec")[0])
    return _long(V.attention_pool(h, "score", by=["doc", "layer"]), ["doc", "layer"])


@register("v5_pool_layers", _H + """
SELECT doc, pos, dim, round(sum(CASE WHEN layer = 2 THEN 1 ELSE 3 END * v)
                            / sum(CASE WHEN layer = 2 THEN 1 ELSE 3 END), 6) AS value
FROM hd WHERE layer >= 2 GROUP BY doc, pos, dim""")
def v5_pool_layers(spark, sf_dir):
    p = V.pool_layers(T.hidden(spark, sf_dir), start=2, weights=[1.0, 3.0])
    return _long(p, ["doc", "pos"])


@register("v6_last_layers", _H + """
SELECT doc, CAST(layer - 2 AS INTEGER) AS slot, dim,
       round(sum(v * mask) / greatest(sum(mask), 1e-9), 6) AS value
FROM hd WHERE layer >= 2 GROUP BY doc, layer, dim""")
def v6_last_layers(spark, sf_dir):
    p = V.pool_last_layers(T.hidden(spark, sf_dir), n=2)
    stacked = V.stack_slots(p, ["doc"])
    # unstack in the comparison shape: slot = position // 64, dim = position % 64
    x = stacked.select("doc", F.posexplode("stacked").alias("i", "value"))
    return x.select("doc", (F.col("i") / 64).cast("int").alias("slot"), (F.col("i") % 64).cast("int").alias("dim"),
                    F.round("value", 6).alias("value"))


@register("v7_softmax_over", _H + """,
p AS (SELECT doc, layer, dim, sum(v * mask) / greatest(sum(mask), 1e-9) AS value FROM hd GROUP BY doc, layer, dim),
q AS (SELECT *, CAST(floor(doc / 4) AS BIGINT) AS batch,
             max(value) OVER (PARTITION BY CAST(floor(doc / 4) AS BIGINT), layer, dim) AS mx FROM p)
SELECT doc, layer, dim, round(exp(value - mx) / sum(exp(value - mx)) OVER (PARTITION BY batch, layer, dim), 6)
       AS softmax FROM q""")
def v7_softmax_over(spark, sf_dir):
    raw = V.mean_pool(T.hidden(spark, sf_dir), by=["doc", "layer"]).select(
        "doc", "layer", F.posexplode("pooled").alias("dim", "value"))
    raw = raw.withColumn("batch", F.floor(F.col("doc") / 4).cast("long")).withColumn("dim", F.col("dim").cast("int"))
    sm = V.softmax_over(raw, ["batch", "layer", "dim"])
    return sm.select("doc", "layer", "dim", F.round("softmax", 6).alias("softmax"))


@register("v8_word_mean", _H + """,
t AS (SELECT *, CASE WHEN pos = 0 THEN -1 ELSE CAST(floor((pos - 1) / 3) AS BIGINT) END AS word_id
      FROM hd)
SELECT doc, layer, pos, dim, round(CASE WHEN word_id >= 0 THEN avg(v) OVER (PARTITION BY doc, layer, word_id, dim)
                                 ELSE v END, 6) AS value FROM t""")
def v8_word_mean(spark, sf_dir):
    h = T.hidden(spark, sf_dir)
    h = h.withColumn("word_id", F.when(F.col("pos") == 0, F.lit(-1))
                     .otherwise(F.floor((F.col("pos") - 1) / 3)).cast("long"))
    return _long(V.word_mean(h, by=["doc", "layer"]), ["doc", "layer", "pos"], vec="vec")


#: Times that a 64-wide vector is laid end to end for the wide queries (768).
WIDE = 12


def wide_hidden(spark, sf_dir):
    """The whole hidden table with 768-wide vectors: copy c of the vector is scaled
    by 1 + c / 8; documents divisible by 5 are masked throughout, and position 9
    (hidden everywhere by its mask of 0) holds NaN."""
    h = T.hidden(spark, sf_dir)
    nan = F.transform("vec", lambda x: F.lit(float("nan")))

    def scaled(c):
        return F.transform("vec", lambda x: x * (1 + c / 8))

    vec = F.flatten(F.array(*[scaled(c) for c in range(WIDE)]))
    mask = F.when((F.col("doc") % 5 == 0) | (F.col("pos") == 9), F.lit(0)).otherwise(F.col("mask"))
    h = h.withColumn("score", F.col("vec")[0]).withColumn("mask", mask)
    h = h.withColumn("vec", F.when(F.col("pos") == 9, nan).otherwise(F.col("vec")))
    return h.withColumn("vec", vec)


_WIDE = OV.with_views(OV.HIDDEN_DIMS) + """,
wd AS (SELECT doc, layer, pos, CAST(c.c * 64 + dim AS INTEGER) AS dim, score,
              CASE WHEN pos = 9 THEN CAST('nan' AS DOUBLE) ELSE v * (1 + c.c / 8) END AS v,
              CASE WHEN doc % 5 = 0 OR pos = 9 THEN 0 ELSE mask END AS mask
       FROM hd CROSS JOIN range(12) c(c))
"""


def _sums(df, keys, vec="pooled"):
    """Per vector: its width, its NaN elements, and two weighted sums of the others that depend on every element's place."""
    i = F.sequence(F.lit(1), F.size(vec))
    dot = lambda k: F.aggregate(F.transform(F.arrays_zip(i.alias("i"), F.col(vec).alias("x")), lambda e: F.when(F.isnan(e["x"]), 0.0).otherwise(e["x"]) * (e["i"] % k)),
                                F.lit(0.0), lambda a, x: a + x)
    nans = F.coalesce(F.size(F.filter(vec, F.isnan)), F.lit(0)).alias("nans")
    return df.select(*keys, F.coalesce(F.size(vec), F.lit(0)).alias("width"), nans, F.round(dot(7), 5).alias("a"), F.round(dot(11), 5).alias("b"))


def _sums_sql(inner: str, keys: str) -> str:
    return f"""
SELECT {keys}, CAST(count(value) AS INTEGER) AS width, CAST(count(CASE WHEN isnan(value) THEN 1 END) AS INTEGER) AS nans,
       round(sum(CASE WHEN isnan(value) THEN 0 ELSE value END * ((dim + 1) % 7)), 5) AS a,
       round(sum(CASE WHEN isnan(value) THEN 0 ELSE value END * ((dim + 1) % 11)), 5) AS b
FROM ({inner}) GROUP BY {keys}"""


@register("v1_mean_pool_768", _WIDE + _sums_sql(
    "SELECT doc, layer, dim, sum(CASE WHEN mask <> 0 THEN v * mask ELSE 0 END) / greatest(sum(mask), 1e-9) AS value FROM wd GROUP BY doc, layer, dim", "doc, layer"))
def v1_mean_pool_768(spark, sf_dir):
    return _sums(V.mean_pool(wide_hidden(spark, sf_dir), by=["doc", "layer"]), ["doc", "layer"])


@register("v2_max_pool_768", _WIDE + _sums_sql(
    "SELECT doc, layer, dim, coalesce(max(CASE WHEN mask <> 0 THEN v END), -10000.0) AS value FROM wd GROUP BY doc, layer, dim", "doc, layer"))
def v2_max_pool_768(spark, sf_dir):
    return _sums(V.max_pool(wide_hidden(spark, sf_dir), by=["doc", "layer"]), ["doc", "layer"])


@register("v3_min_pool_768", _WIDE + _sums_sql(
    "SELECT doc, layer, dim, min(CASE WHEN mask <> 0 THEN v END) AS value FROM wd GROUP BY doc, layer, dim", "doc, layer"))
def v3_min_pool_768(spark, sf_dir):
    return _sums(V.min_pool(wide_hidden(spark, sf_dir), by=["doc", "layer"]), ["doc", "layer"])


@register("v4_attention_pool_768", _WIDE + """,
m AS (SELECT doc, layer, max(CASE WHEN mask <> 0 THEN score END) AS mx FROM wd GROUP BY doc, layer),
w AS (SELECT wd.*, CASE WHEN mask <> 0 THEN exp(score - mx) END AS e FROM wd JOIN m USING (doc, layer))
""" + _sums_sql("SELECT doc, layer, dim, sum(CASE WHEN mask <> 0 THEN e * v END) / sum(e) AS value FROM w GROUP BY doc, layer, dim", "doc, layer"))
def v4_attention_pool_768(spark, sf_dir):
    return _sums(V.attention_pool(wide_hidden(spark, sf_dir), "score", by=["doc", "layer"]), ["doc", "layer"])


@register("v5_pool_layers_768", _WIDE + _sums_sql(
    """SELECT doc, pos, dim, sum(v * CASE layer WHEN 2 THEN -1 ELSE 3 END) / sum(CASE layer WHEN 2 THEN -1 ELSE 3 END) AS value
       FROM wd WHERE layer >= 2 GROUP BY doc, pos, dim""", "doc, pos"))
def v5_pool_layers_768(spark, sf_dir):
    """Layer weights are free: one is negative.  Position 9 is NaN throughout, and so is its average."""
    return _sums(V.pool_layers(wide_hidden(spark, sf_dir), start=2, weights=[-1.0, 3.0]), ["doc", "pos"])


@register("v6_last_layers_768", _WIDE + _sums_sql(
    """SELECT doc, CAST(layer - 2 AS INTEGER) AS slot, dim, sum(CASE WHEN mask <> 0 THEN v * mask ELSE 0 END) / greatest(sum(mask), 1e-9) AS value
       FROM wd WHERE layer >= 2 GROUP BY doc, layer, dim""", "doc, slot"))
def v6_last_layers_768(spark, sf_dir):
    return _sums(V.pool_last_layers(wide_hidden(spark, sf_dir), n=2), ["doc", "slot"])


@register("v8_word_mean_768", _WIDE + """,
t AS (SELECT *, CASE WHEN pos = 0 THEN -1 ELSE CAST(floor((pos - 1) / 3) AS BIGINT) END AS word_id FROM wd)
""" + _sums_sql("SELECT doc, layer, pos, dim, CASE WHEN word_id >= 0 THEN avg(v) OVER (PARTITION BY doc, layer, word_id, dim) ELSE v END AS value FROM t", "doc, layer, pos"))
def v8_word_mean_768(spark, sf_dir):
    """The last word's tokens include the NaN of position 9, so its mean is NaN."""
    h = wide_hidden(spark, sf_dir)
    h = h.withColumn("word_id", F.when(F.col("pos") == 0, F.lit(-1)).otherwise(F.floor((F.col("pos") - 1) / 3)).cast("long"))
    return _sums(V.word_mean(h, by=["doc", "layer"]), ["doc", "layer", "pos"], vec="vec")


@register("v6_v7_v9_regression_head", _H + """,
p AS (SELECT doc, layer, dim, sum(v * mask) / greatest(sum(mask), 1e-9) AS value FROM hd GROUP BY doc, layer, dim),
s AS (SELECT doc, layer, dim, exp(value - max(value) OVER w) / sum(exp(value)) OVER w * exp(max(value) OVER w) AS sm
      FROM p WINDOW w AS (PARTITION BY CAST(floor(doc / 4) AS BIGINT), layer, dim)),
c AS (SELECT doc, dim, sum(sm * (layer + 1) / 10) + 0.5 AS x FROM s GROUP BY doc, dim)
SELECT doc, CAST(k.k AS INTEGER) AS k, round(sum(x * ((7 * dim + 3 * k.k) % 11 - 5) / 10) + k.k / 10, 6) AS value
FROM c CROSS JOIN range(6) k(k) GROUP BY doc, k.k""")
def v6_v7_v9_regression_head(spark, sf_dir):
    """The regression head as one flow: the last four layers pooled, softmax over the
    batch, the layers contracted 4 to 1, then six outputs."""
    p = V.pool_last_layers(T.hidden(spark, sf_dir), n=4)
    x = p.select("doc", "slot", F.posexplode("pooled").alias("dim", "value")).withColumn("batch", F.floor(F.col("doc") / 4))
    sm = V.softmax_over(x, ["batch", "slot", "dim"], out="sm")
    per_dim = sm.groupBy("doc", "dim").agg(F.sort_array(F.collect_list(F.struct("slot", "sm"))).alias("l"))   # four layers
    
    def at(slot):
        return F.coalesce(F.get(F.filter("l", lambda e: e["slot"] == slot), F.lit(0))["sm"], F.lit(0.0))

    slots = [at(slot) for slot in range(4)]
    per_dim = per_dim.select("doc", "dim", F.array(*slots).alias("vec"))         # a layer that a document lacks counts 0
    one = V.project(per_dim, np.array([[0.1], [0.2], [0.3], [0.4]]), [0.5]).select("doc", "dim", F.col("proj")[0].alias("x"))
    docs = one.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("l"))               # 64 elements
    docs = docs.select("doc", F.transform("l", lambda e: e["x"]).alias("vec"))
    out = V.project(docs, *head_weights()).select("doc", F.posexplode("proj").alias("k", "value"))
    return out.select("doc", F.col("k").cast("int").alias("k"), F.round("value", 6).alias("value"))


def head_weights(d: int = 64, o: int = 6):
    """A fixed small head: W[i, k] = ((7 i + 3 k) % 11 - 5) / 10, b[k] = k / 10."""
    i = np.arange(d)[:, None]
    k = np.arange(o)[None, :]
    return ((7 * i + 3 * k) % 11 - 5) / 10.0, np.arange(o) / 10.0


_V9 = """
SELECT vec_id, CAST(k.k AS INTEGER) AS k,
       round(sum(CAST(embedding[i.i + 1] AS DOUBLE) * ((7 * i.i + 3 * k.k) % 11 - 5) / 10) + k.k / 10, 6) AS value
FROM embeddings CROSS JOIN range(64) i(i) CROSS JOIN range(6) k(k) GROUP BY vec_id, k.k"""


def _v9(spark, sf_dir, method):
    W, b = head_weights()
    e = T.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    p = V.project(e, W, b, method=method)
    x = p.select("vec_id", F.posexplode("proj").alias("k", "value"))
    return x.select("vec_id", F.col("k").cast("int").alias("k"), F.round("value", 6).alias("value"))


@register("v9_project", _V9)
def v9_project(spark, sf_dir):
    return _v9(spark, sf_dir, "expr")


@register("v9_project_arrow", _V9)
def v9_project_arrow(spark, sf_dir):
    return _v9(spark, sf_dir, "pandas")


def scorer_weights(d: int = 64) -> A.Scorer:
    """A fixed scorer: w1[i, j] = ((7 i + 3 j) % 11 - 5) / 50, b1[j] = (j % 5) / 10, scale[j] = 1 + (j % 3) / 10,
    shift[j] = (j % 4) / 10, w2[j] = ((5 j) % 7 - 3) / 10, b2 = 0.1."""
    i, j = np.arange(d)[:, None], np.arange(d)
    return A.Scorer(((7 * i + 3 * j) % 11 - 5) / 50, j % 5 / 10, 1 + j % 3 / 10, j % 4 / 10, (5 * j % 7 - 3) / 10, 0.1)


#: The error function of ``u``: a series of positive terms, as the engine has none of its own.
_ERF = ("sign(u) * CASE WHEN abs(u) > 5.9 THEN 1 ELSE 2 / sqrt(pi()) * exp(-u * u) * list_sum(list_transform(range(0, 200), "
        "lambda n: exp(n * ln(2) + (2 * n + 1) * ln(greatest(abs(u), 1e-300)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1))))) END")


@register("v4_learned_attention", _H + f""",
z AS (SELECT doc, layer, pos, mask, CAST(j.j AS INTEGER) AS j, sum(v * ((7 * dim + 3 * j.j) % 11 - 5) / 50) + (j.j % 5) / 10 AS z
      FROM hd CROSS JOIN range(64) j(j) GROUP BY doc, layer, pos, mask, j.j),
n AS (SELECT *, (z - avg(z) OVER w) / sqrt(var_pop(z) OVER w + 1e-5) * (1 + (j % 3) / 10) + (j % 4) / 10 AS x FROM z WINDOW w AS (PARTITION BY doc, layer, pos)),
u AS (SELECT *, x / sqrt(2) AS u FROM n),
s AS (SELECT doc, layer, pos, mask, sum(x * (1 + {_ERF}) / 2 * ((5 * j) % 7 - 3) / 10) + 0.1 AS score FROM u GROUP BY doc, layer, pos, mask),
e AS (SELECT doc, layer, pos, exp(score - max(score) OVER (PARTITION BY doc, layer)) AS e FROM s WHERE mask <> 0)
SELECT doc, layer, dim, round(sum(e * v) / sum(e), 6) AS value FROM hd JOIN e USING (doc, layer, pos) GROUP BY doc, layer, dim""")
def v4_learned_attention(spark, sf_dir):
    """Attention pooling by the learned scorer's own scores."""
    p = A.learned_attention_pool(T.hidden(spark, sf_dir), scorer_weights(), by=["doc", "layer"])
    return _long(p, ["doc", "layer"])
