"""Queries: tokens, padding, vocabularies, label codes (T1-T8, T13) and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import spans as S
from foldwise.operators import subwords as W
from foldwise.operators import tokens as K
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.registry import register



def _docs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", "text")


@register("t1_tokenize_ws", V.with_views(V.WORD_LABELS) + "SELECT doc_id, pos, word AS token FROM word_labels")
def t1_tokenize_ws(spark, sf_dir):
    d = K.tokenize(_docs(spark, sf_dir), "text", "ws")
    return d.select("doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("int"))


@register("t1_tokenize_modes", """
SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_ws,
       CAST(len(regexp_extract_all(text, '\\w+')) AS INTEGER) AS n_words,
       CAST(length(text) AS INTEGER) AS n_char,
       CAST((SELECT sum(greatest(1, ceil(length(w) / 4))) FROM unnest(string_split(text, ' ')) t(w)) AS INTEGER)
         AS n_pieces
FROM documents""")
def t1_tokenize_modes(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", *[F.size(K.tokens_of("text", m)).cast("int").alias(f"n_{m}")
                                for m in ["ws", "words", "char", "pieces"]])


# The reference's essay sequence length (truncation to it is the T2 feature).
SEQ_LEN = 512

_PAD_BASE = "d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)\n"


@register("t2_pad", "WITH " + _PAD_BASE + """
SELECT doc_id, CAST(r.i AS INTEGER) AS pos, CASE WHEN r.i < len(w) THEN w[r.i + 1] ELSE '<pad>' END AS token,
       CASE WHEN r.i < len(w) THEN 1 ELSE 0 END AS mask FROM d CROSS JOIN range(512) r(i)""")
def t2_pad(spark, sf_dir):
    d = K.pad(K.tokenize(_docs(spark, sf_dir), "text"), "tokens", SEQ_LEN)
    return d.select("doc_id", F.posexplode(F.arrays_zip(F.col("tokens").alias("t"),
                                                        F.col("attention_mask").alias("m"))).alias("pos", "z")) \
            .select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("z.t").alias("token"),
                    F.col("z.m").alias("mask"))


@register("t3_specials", "WITH " + _PAD_BASE + """,
e AS (SELECT doc_id, w, least(len(w), 510) AS b FROM d)
SELECT doc_id, CAST(r.i AS INTEGER) AS pos,
       CASE WHEN r.i = 0 THEN '<s>' WHEN r.i <= b THEN w[r.i] WHEN r.i = b + 1 THEN '</s>' ELSE '<pad>' END AS token,
       CASE WHEN r.i <= b + 1 THEN 1 ELSE 0 END AS mask FROM e CROSS JOIN range(512) r(i)""")
def t3_specials(spark, sf_dir):
    d = K.pad(K.tokenize(_docs(spark, sf_dir), "text"), "tokens", SEQ_LEN, specials=("<s>", "</s>"))
    return d.select("doc_id", F.posexplode(F.arrays_zip(F.col("tokens").alias("t"),
                                                        F.col("attention_mask").alias("m"))).alias("pos", "z")) \
            .select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("z.t").alias("token"),
                    F.col("z.m").alias("mask"))


@register("t4_prefix_type", V.with_views(V.WORD_LABELS) + """
SELECT doc_id, pos, CASE WHEN pos = 0 THEN word || '[SEP]' ELSE word END AS token FROM word_labels""")
def t4_prefix_type(spark, sf_dir):
    d = K.prefix_type(K.tokenize(_docs(spark, sf_dir), "text"), "tokens", "[SEP]")
    return d.select("doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("int"))


_VOCAB = V.with_views(V.WORD_LABELS) + """,
voc AS (SELECT word AS token, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS id, count AS count
        FROM (SELECT word, count(*) AS count FROM word_labels GROUP BY word))
"""


@register("t5_fit_vocab", _VOCAB + "SELECT token, id, count FROM voc")
def t5_fit_vocab(spark, sf_dir):
    return K.fit_vocab(K.tokenize(_docs(spark, sf_dir), "text"), "tokens")


@register("t5_encode", _VOCAB + "SELECT w.doc_id, w.pos, v.id FROM word_labels w JOIN voc v ON w.word = v.token")
def t5_encode(spark, sf_dir):
    d = K.tokenize(_docs(spark, sf_dir), "text")
    vocab = K.fit_vocab(d, "tokens")
    return K.encode(d, "tokens", vocab, ["doc_id"], out="id")


def _masked(spark, sf_dir):
    """Whole ws token arrays in batches of 8 documents, padded to the longest
    document of their batch (dynamic padding), with a mask that has holes
    (words of class 7 are not real).  A batch is a bounded group of 8 rows."""
    from pyspark.sql import Window
    d = K.tokenize(_docs(spark, sf_dir), "text").withColumn("batch", F.floor(F.col("doc_id") / 8))
    d = d.withColumn("_len", F.max(F.size("tokens")).over(Window.partitionBy("batch")))
    real = F.transform("tokens", lambda x: F.when(F.length(x) % 8 != 7, F.lit(1)).otherwise(F.lit(0)))
    mask = F.concat(real, F.array_repeat(F.lit(0), F.col("_len") - F.size("tokens")))
    padded, _ = K.pad_expr("tokens", F.col("_len"), "<pad>")
    d = d.withColumn("attention_mask", mask).withColumn("tokens", padded)
    return d.select("doc_id", "tokens", "attention_mask", "batch", F.col("_len").alias("padded_len"))


_TRIM = """WITH w AS (SELECT doc_id, CAST(floor(doc_id / 8) AS BIGINT) AS batch, pos, word FROM ({wl})),
m AS (SELECT d.doc_id, CAST(floor(d.doc_id / 8) AS BIGINT) AS batch, count(w.pos) AS nw,
             coalesce(sum(CASE WHEN length(w.word) % 8 <> 7 THEN 1 ELSE 0 END), 0) AS s,
             coalesce(max(CASE WHEN length(w.word) % 8 <> 7 THEN w.pos END), -1) + 1 AS last
      FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id),
b AS (SELECT doc_id, batch, max(nw) OVER (PARTITION BY batch) AS blen,
             max(s) OVER (PARTITION BY batch) AS ls, max(last) OVER (PARTITION BY batch) AS ll FROM m)
""".format(wl=V.WORD_LABELS[len("word_labels AS ("):-1])


@register("t6_trim_sum", _TRIM + "SELECT doc_id, CAST(ls AS INTEGER) AS length FROM b")
def t6_trim_sum(spark, sf_dir):
    t = K.trim_to_batch(_masked(spark, sf_dir), "batch", ["tokens"], how="sum")
    return t.select("doc_id", F.size("tokens").cast("int").alias("length"))


@register("t7_trim_last", _TRIM + "SELECT doc_id, CAST(ll AS INTEGER) AS length FROM b")
def t7_trim_last(spark, sf_dir):
    t = K.trim_to_batch(_masked(spark, sf_dir), "batch", ["tokens"], how="last")
    return t.select("doc_id", F.size("tokens").cast("int").alias("length"))


@register("t8_pad_scores", _TRIM + """,
g AS (SELECT doc_id, ll, CAST(unnest(range(blen)) AS INTEGER) AS pos FROM b),
mk AS (SELECT g.doc_id, g.pos, g.ll, CASE WHEN w.word IS NOT NULL AND length(w.word) % 8 <> 7 THEN 1 ELSE 0 END AS mv
       FROM g LEFT JOIN w ON w.doc_id = g.doc_id AND w.pos = g.pos)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n, md5(string_agg(CASE WHEN pos < ll THEN mv ELSE 0 END, ',' ORDER BY pos)) AS scores_md5
FROM mk GROUP BY doc_id""")
def t8_pad_scores(spark, sf_dir):
    """Scores (here the mask) of the trimmed batch padded back to the padded length."""
    t = K.trim_to_batch(_masked(spark, sf_dir), "batch", ["tokens"], how="last")
    s = t.withColumn("scores", F.col("attention_mask").cast("array<double>"))
    p = K.pad_scores(s, "scores", F.col("padded_len"))
    return p.select("doc_id", F.size("scores").alias("n"), _digest("scores", 1).alias("scores_md5"))


def _digest(values: str, scale: int):
    """md5 of an array's values (times ``scale``, as integers) in order."""
    return F.md5(F.array_join(F.transform(values, lambda x: F.round(x * scale).cast("bigint").cast("string")), ","))


def span_rows(spark, sf_dir):
    """doc_id, word_ids (start special, every word piece of the whole text,
    end special; specials as -1), labels (class of every word, 7 = ignore)."""
    d = _docs(spark, sf_dir)
    wids = K.piece_word_ids("text")
    none = F.array(F.lit(None).cast("int"))
    labels = F.transform(F.split("text", " "), lambda w: (F.length(w) % 8).cast("int"))
    out = d.select("doc_id", F.concat(none, wids, none).alias("word_ids"), labels.alias("labels"))
    return S.word_ids(out)


_SPAN = V.with_views(V.WORD_LABELS) + """,
ws AS (SELECT doc_id, pos AS w, label, greatest(1, ceil(length(word) / 4)) AS np FROM word_labels),
offs AS (SELECT *, coalesce(sum(np) OVER (PARTITION BY doc_id ORDER BY w
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ws),
toks AS (SELECT doc_id, w, CAST(before + unnest(range(CAST(np AS BIGINT))) + 1 AS INTEGER) AS pos FROM offs),
ntok AS (SELECT doc_id, CAST(sum(np) AS INTEGER) AS n FROM ws GROUP BY doc_id),
grid AS (SELECT doc_id, pos, CAST(w AS INTEGER) AS word_id FROM toks
         UNION ALL SELECT doc_id, 0, -1 FROM ntok
         UNION ALL SELECT doc_id, n + 1, -1 FROM ntok),
st AS (SELECT *, word_id > -1 AND (pos = 0 OR lag(word_id) OVER (PARTITION BY doc_id ORDER BY pos) <> word_id)
                 AS word_start FROM grid),
cur AS (SELECT *, sum(CASE WHEN word_start THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS c FROM st),
al AS (SELECT cur.doc_id, cur.pos, cur.word_id, cur.word_start, ws.label,
              coalesce(cur.word_start AND ws.label <> 7, false) AS flag
       FROM cur LEFT JOIN ws ON ws.doc_id = cur.doc_id AND ws.w = cur.c AND cur.word_start)
"""


@register("t9_t10_word_starts", _SPAN + "SELECT doc_id, pos, word_id, word_start FROM st")
def t9_t10_word_starts(spark, sf_dir):
    d = S.word_starts(span_rows(spark, sf_dir))
    return S.positions(d, ["doc_id"], ["word_ids", "word_start"]).withColumnRenamed("word_ids", "word_id")


@register("t11_align_labels", _SPAN + "SELECT doc_id, pos, word_id, word_start, label, flag FROM al")
def t11_align_labels(spark, sf_dir):
    a = S.align_labels(span_rows(spark, sf_dir))
    return S.positions(a, ["doc_id"], ["word_ids", "word_start", "label", "flag"]) \
            .withColumnRenamed("word_ids", "word_id")


@register("t12_scatter_target", _SPAN
          + "SELECT doc_id, pos, CAST(CASE WHEN flag THEN label ELSE -100 END AS INTEGER) AS target FROM al")
def t12_scatter_target(spark, sf_dir):
    t = S.scatter_target(S.align_labels(span_rows(spark, sf_dir)))
    return S.positions(t, ["doc_id"], ["target"]).withColumn("target", F.col("target").cast("int"))


@register("t13_label_codes", """
SELECT conv_id, turn, CAST(dense_rank() OVER (ORDER BY role) - 1 AS INTEGER) AS code FROM conversations""")
def t13_label_codes(spark, sf_dir):
    """Scalar labels: the role of every turn, coded in sorted order."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    codes = K.fit_labels(c, "role")
    return K.encode_labels(c, "role", codes, out="code").select("conv_id", "turn", F.col("code").cast("int"))


@register("t13_list_codes", V.with_views(V.WORD_LABELS) + """
SELECT doc_id, pos, CAST(dense_rank() OVER (ORDER BY 'L' || label) - 1 AS INTEGER) AS code FROM word_labels""")
def t13_list_codes(spark, sf_dir):
    """List labels: one class name per word of the whole text, coded element-wise."""
    d = _docs(spark, sf_dir).select(
        "doc_id", F.transform(F.split("text", " "), lambda w: F.concat(F.lit("L"), (F.length(w) % 8).cast("string")))
        .alias("labels"))
    codes = K.fit_labels(d, "labels")
    enc = K.encode_labels(d, "labels", codes, keys=["doc_id"])
    return S.positions(enc, ["doc_id"], ["labels"]).select("doc_id", "pos", F.col("labels").cast("int").alias("code"))


def soft_span_rows(spark, sf_dir):
    """span_rows with soft labels: per word [ (len % 5 - 1) / 4, 0.5, 0.25 ];
    words whose first probability is not above 0 are not flagged."""
    d = _docs(spark, sf_dir)
    soft = F.transform(F.split("text", " "), lambda w: F.array(
        ((F.length(w) % 5 - 1) / 4.0).cast("double"), F.lit(0.5), F.lit(0.25)))
    none = F.array(F.lit(None).cast("int"))
    out = d.select("doc_id", F.concat(none, K.piece_word_ids("text"), none).alias("word_ids"),
                   soft.alias("labels"))
    return S.word_ids(out)


@register("t11_t12_soft_target", _SPAN + """,
wl AS (SELECT doc_id, pos AS w, (length(word) % 5 - 1) * 250 AS p0 FROM word_labels),
soft AS (SELECT cur.doc_id, cur.pos, coalesce(wl.p0 > 0, false) AS flag, wl.p0
         FROM cur LEFT JOIN wl ON wl.doc_id = cur.doc_id AND wl.w = cur.c AND cur.word_start)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n,
       md5(string_agg(CASE WHEN flag THEN p0 || ',500,250' ELSE '-100000,-100000,-100000' END, ',' ORDER BY pos)) AS target_md5
FROM soft GROUP BY doc_id""")
def t11_t12_soft_target(spark, sf_dir):
    """The whole soft target of every document (times 1000, as a digest)."""
    a = S.align_labels(soft_span_rows(spark, sf_dir), soft=True)
    t = S.scatter_target(a, soft=True, width=3)
    flat = t.select("doc_id", F.size("target").alias("n"), F.flatten("target").alias("flat"))
    return flat.select("doc_id", "n", _digest("flat", 1000).alias("target_md5"))


def vocabulary_file() -> str:
    """Where the public byte-level tokenizer's file is installed."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("t1_subword_spans", """
SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda w, i: w <> '' OR i > 1)) AS INTEGER) AS words,
       CAST(length(coalesce(text, '')) AS INTEGER) AS chars, true AS tiled FROM documents""")
def t1_subword_spans(spark, sf_dir):
    """Sub-word tokens of every document: its words that have tokens, the end of the
    last span, and whether the spans follow one another without gap or overlap."""
    d = W.subword_tokens(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary_file())
    n = F.size("ids")
    follows = (F.slice("starts", 2, F.greatest(n - 1, F.lit(0))) == F.slice("ends", 1, F.greatest(n - 1, F.lit(0)))) & (
        (n == 0) | (F.get("starts", F.lit(0)) == 0)) & (F.size("starts") == n) & (F.size("ends") == n) & (F.size("word_ids") == n)
    return d.select("doc_id", F.size(F.array_distinct("word_ids")).alias("words"), F.coalesce(F.get("ends", n - 1), F.lit(0)).alias("chars"),
                    follows.alias("tiled"))


@register("t9_t12_subwords", """
WITH w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)),
l AS (SELECT doc_id, length(word) % 8 AS label FROM w WHERE word <> '' OR i > 1)
SELECT d.doc_id, CAST(count(label) AS BIGINT) AS starts, CAST(count(CASE WHEN label <> 7 THEN 1 END) AS BIGINT) AS flagged,
       CAST(coalesce(sum(CASE WHEN label <> 7 THEN label END), 0) AS BIGINT) AS labels
FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""")
def t9_t12_subwords(spark, sf_dir):
    """Word labels aligned to sub-word tokens and scattered: every word's first token
    carries its label, all other tokens are ignored."""
    d = W.subword_tokens(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", vocabulary_file())
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w, i: (w != "") | (i > 0))
    d = d.select("doc_id", "word_ids", F.transform(words, lambda w: F.length(w) % 8).alias("labels"))
    t = S.scatter_target(S.align_labels(d))
    real = F.filter("target", lambda x: x != -100)
    return t.select("doc_id", F.size(F.filter("word_start", lambda x: x)).cast("bigint").alias("starts"),
                    F.size(F.filter("flag", lambda x: x)).cast("bigint").alias("flagged"),
                    F.aggregate(real, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("labels"))
