"""Text -> token arrays, padding, vocabularies and label codes.

Everything works per row on arrays with Spark higher-order functions, so a
document never leaves its row and no shuffle is needed, except for fitting a
vocabulary or a label code table (a distinct over tokens).

Pretrained sub-word vocabularies are not available; ``mode="pieces"`` cuts
each word into fixed-width pieces, which gives the same token -> word
structure (several tokens per word) for the span operators.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foldwise.operators.columns import with_ordinal
from foldwise.operators.spans import slices
from foldwise.plans.scratch import written
from foldwise.plans.sizing import join_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# T1
def tokens_of(text, mode: str = "ws", piece: int = 4) -> Column:
    """Token array of a text column.

    ``ws``: split on single spaces; ``words``: runs of ``\\w``; ``char``:
    characters; ``pieces``: words cut into ``piece``-character pieces.  An
    array input is passed through (already split into words)."""
    t = _c(text)
    if mode == "ws":
        return F.split(t, " ")
    if mode == "words":
        return F.regexp_extract_all(t, F.lit(r"\w+"), 0)
    if mode == "char":
        return F.split(t, "")
    if mode == "pieces":
        words = F.split(t, " ")
        return F.flatten(F.transform(words, lambda w: F.transform(
            F.sequence(F.lit(0), _n_pieces(w, piece) - 1),
            lambda k: F.substring(w, k * piece + 1, piece))))
    if mode == "split":
        return t
    raise ValueError(f"unknown mode {mode!r}")


def _n_pieces(w: Column, piece: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(w) / piece)).cast("int")


def piece_word_ids(text, piece: int = 4) -> Column:
    """Word index of every token of :func:`tokens_of` ``mode="pieces"``."""
    words = F.split(_c(text), " ")
    return F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, _n_pieces(w, piece))))


def tokenize(df: DataFrame, text: str, mode: str = "ws", out: str = "tokens", piece: int = 4,
             word_ids: str | None = None) -> DataFrame:
    d = df.withColumn(out, tokens_of(text, mode, piece))
    if word_ids and mode == "pieces":
        d = d.withColumn(word_ids, piece_word_ids(text, piece))
    return d


# T2 / T3
def pad_expr(tokens, max_length: int, pad, specials: tuple | None = None) -> tuple[Column, Column]:
    """(padded, mask): truncate to ``max_length`` (room kept for specials),
    right-pad with ``pad``; mask is 1 on real (and special) tokens."""
    t = _c(tokens)
    if specials is not None:
        b, e = specials
        body = F.slice(t, 1, max_length - 2)
        t = F.concat(F.array(F.lit(b) if not isinstance(b, Column) else b), body,
                     F.array(F.lit(e) if not isinstance(e, Column) else e))
    padv = pad if isinstance(pad, Column) else F.lit(pad)
    real = F.least(F.size(t), F.lit(max_length))
    padded = F.slice(F.concat(t, F.array_repeat(padv, max_length)), 1, max_length)
    # no lambda: an outer expression inside one is re-evaluated per element
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(max_length) - real))
    return padded, mask


def pad(df: DataFrame, tokens: str, max_length: int, pad_value="<pad>", specials=None,
        out: str | None = None, mask: str = "attention_mask") -> DataFrame:
    padded, m = pad_expr(tokens, max_length, pad_value, specials)
    # mask first: a lambda referring to ``tokens`` must not share a projection
    # with a new column of the same name
    return df.withColumn(mask, m).withColumn(out or tokens, padded)


# T4
def prefix_type(df: DataFrame, words: str, sep: str, out: str | None = None) -> DataFrame:
    """Append ``sep`` to the first word (typed input)."""
    expr = F.transform(words, lambda x, i: F.when(i == 0, F.concat(x, F.lit(sep))).otherwise(x))
    return df.withColumn(out or words, expr)


# T5
# Tokens that hold at least one in so many of all occurrences are coded where the rows
# are, if they have at most so many characters: their table is bounded by both.
HEAVY, HEAVY_CHARS = 4096, 64


def fit_vocab(df: DataFrame, tokens: str, min_count: int = 1) -> DataFrame:
    """(token, id, count): distinct tokens numbered in token order, written to shared
    scratch storage, as encoding reads it more than once."""
    counts = (df.select(F.explode(tokens).alias("token")).groupBy("token")
                .agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count))
    return written(with_ordinal(written(counts), ["token"], name="id").select("token", F.col("id").cast("int"), "count"))


def encode(df: DataFrame, tokens: str, vocab: DataFrame, keys: Sequence[str], unknown: int = -1,
           out: str = "ids") -> DataFrame:
    """Token ids per row, long form (keys..., pos, id); unknown tokens get ``unknown``.

    The heavy hitters of the vocabulary (by its ``count``, if it has one) are coded in
    each task from their bounded table, so the rows of a frequent token are neither
    shuffled nor met in one task; the rest joins plainly (null-safe)."""
    longer = df.select(*keys, F.posexplode(tokens).alias("pos", "token"))
    ids = vocab.select("token", "id")

    def shaped(rows: DataFrame, id_col) -> DataFrame:
        return rows.select(*keys, F.col("pos").cast("int").alias("pos"), F.coalesce(id_col, F.lit(unknown)).alias(out))

    if "count" not in vocab.columns:
        return shaped(join_small(longer, ids, ["token"], how="left", null_safe=True), F.col("id"))
    least = (vocab.agg(F.sum("count")).first()[0] or 0) / HEAVY
    heavy = (F.col("count") >= least) & (F.coalesce(F.length("token"), F.lit(0)) <= HEAVY_CHARS)
    told = join_small(longer, vocab.where(heavy).select("token", F.col("id").alias("_id"), F.lit(True).alias("_told")), ["token"],
                      how="left", null_safe=True, bound=HEAVY)
    rest = join_small(told.where(F.col("_told").isNull()).drop("_id", "_told"), vocab.where(~heavy).select("token", "id"), ["token"],
                      how="left", null_safe=True)
    return shaped(told.where("_told"), F.col("_id")).unionByName(shaped(rest, F.col("id")))


# T6 / T7
def trim_to_batch(df: DataFrame, batch: str, cols: Sequence[str], mask: str = "attention_mask",
                  how: str = "sum") -> DataFrame:
    """Cut array columns to the batch's longest real length.

    ``sum``: the largest mask sum in the batch; ``last``: the largest
    (last real position + 1), which differs when masks have holes.
    Batches are bounded groups (the batch size)."""
    from pyspark.sql import Window
    m = F.col(mask)
    if how == "sum":
        per = F.aggregate(m, F.lit(0), lambda a, x: a + x)
    elif how == "last":
        per = F.coalesce(F.array_max(F.transform(m, lambda x, i: F.when(x == 1, i).otherwise(F.lit(-1)))),
                         F.lit(-1)) + 1
    else:
        raise ValueError(how)
    L = F.max(per).over(Window.partitionBy(batch))
    d = df.withColumn("_L", L)
    return d.withColumns({c: F.slice(F.col(c), 1, F.col("_L")) for c in [*cols, mask]}).drop("_L")


# T8
def pad_scores(df: DataFrame, col: str, n: int, value: float = 0.0, out: str | None = None) -> DataFrame:
    x = F.col(col)
    return df.withColumn(out or col, F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.lit(0), n - F.size(x)))))


# T13
def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """(label, code): distinct labels of a list (or scalar) column, codes in sorted order."""
    c = F.col(col)
    is_list = isinstance(df.schema[col].dataType, T.ArrayType)
    vals = written(df.select((F.explode(c) if is_list else c).alias("label")).distinct())
    return written(with_ordinal(vals, ["label"], name="code").select("label", F.col("code").cast("int")))


def _coded_in_rows(df: DataFrame, col: str, out: str, table: list) -> DataFrame:
    """The list column coded inside its rows, by a table of few labels."""
    at = pa.array([r["label"] for r in table], to_arrow_type(df.schema[col].dataType.elementType))
    code = pa.array([r["code"] for r in table], pa.int32())
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, [col])):
            given = b.column(col)
            flat = given.flatten()
            found = pc.index_in(flat.cast(at.type), value_set=at)
            if found.null_count:
                raise ValueError("unseen label")
            offsets = given.offsets.to_numpy()
            new = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), code.take(found), mask=given.is_null())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), new], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_labels(df: DataFrame, col: str, codes: DataFrame, out: str | None = None,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Replace a label (scalar column) or every label of a list column by its
    code; an unseen label raises, a null label is a label like any other (it has
    a code if the table was fitted on nulls).

    Scalars take a null-safe join, whose smaller side adaptive execution broadcasts by
    measured bytes.  Lists of strings or integers are coded inside their rows where
    the table holds at most HEAVY labels of HEAVY_CHARS characters.  Any other list
    column needs ``keys``, the columns that identify a
    row: its (row, position) pairs are joined and regrouped (a group is one
    row's list)."""
    out = out or col
    seen = lambda c: F.when(c.isNull(), F.raise_error(F.lit("unseen label")).cast("int")).otherwise(c)
    cd = codes.select(F.col("label").alias("_lab"), F.col("code").alias("_code"))
    if not isinstance(df.schema[col].dataType, T.ArrayType):
        j = df.join(cd, df[col].eqNullSafe(cd["_lab"]), "left")
        return j.withColumn(out, seen(F.col("_code"))).drop("_lab", "_code")
    keys = list(keys)
    if not keys:
        raise ValueError("encode_labels: a list column needs the row's key columns")
    kind = df.schema[col].dataType.elementType
    if isinstance(kind, (T.StringType, T.IntegralType)) and codes.schema["label"].dataType == kind:
        size = codes.agg(F.count(F.lit(1)).alias("n"), F.max(F.length(F.col("label").cast("string"))).alias("chars")).first()
        if size["n"] <= HEAVY and (size["chars"] or 0) <= HEAVY_CHARS:
            return _coded_in_rows(df, col, out, codes.select("label", "code").collect())
    longer = df.select(*keys, F.posexplode(col).alias("_p", "_l"))
    coded = longer.join(cd, longer["_l"].eqNullSafe(cd["_lab"]), "left").select(*keys, "_p", seen(F.col("_code")).alias("_code"))
    back = coded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_code"))).alias("_l"))
    back = back.select(*keys, F.transform("_l", lambda x: x["_code"]).alias("_enc"))
    j = join_small(df, back, keys, how="left", null_safe=True)
    none = F.when(F.col(col).isNotNull(), F.array().cast("array<int>"))
    return j.withColumn(out, F.coalesce(F.col("_enc"), none)).drop("_enc")
