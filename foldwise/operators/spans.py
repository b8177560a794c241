"""Token -> word alignment and span labels.

Everything happens inside the row of its document: no explode, no window and
no regrouping, so there is no shuffle and a long text costs time linear in its
token count.  Word ids and starts are array expressions; labels are aligned and
scattered in Arrow batches, where the running count of word starts indexes the
labels (the n-th word start takes the n-th label).
:func:`positions` turns the arrays into long rows at the edge.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.constants import IGNORE_INDEX, SOFT_LABEL_THRESHOLD, SPECIAL_WORD_ID


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# T9
def word_ids_expr(ids) -> Column:
    """Token -> word index with null (special/pad tokens) -> -1."""
    return F.transform(_c(ids), lambda x: F.coalesce(x, F.lit(SPECIAL_WORD_ID)))


def word_ids(df: DataFrame, col: str = "word_ids") -> DataFrame:
    return df.withColumn(col, word_ids_expr(col))


# Lambdas below only read their own variables: an outer array expression
# named inside a lambda would be evaluated again for every element.  Inputs
# are zipped once instead, which keeps each row linear in its length.


def _previous(arr: Column) -> Column:
    """``arr`` shifted right by one (null first)."""
    return F.slice(F.concat(F.array(F.lit(None).cast("int")), arr), 1, F.size(arr))


# T10
def word_starts_expr(ids) -> Column:
    """True where a real word starts: id > -1 and (first position or id changes)."""
    w = _c(ids)
    z = F.arrays_zip(w.alias("x"), _previous(w).alias("p"))
    return F.transform(z, lambda e, i: (e["x"] > -1) & F.when(i == 0, F.lit(True)).otherwise(e["p"] != e["x"]))


def word_starts(df: DataFrame, ids: str = "word_ids", out: str = "word_start") -> DataFrame:
    return df.withColumn(out, word_starts_expr(ids))


# Tokens and labels that a pass holds at a time.
ELEMENTS = 1 << 18


def slices(batch: pa.RecordBatch, lists: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ELEMENTS elements of its ``lists`` columns, or one row."""
    held = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
    total = np.concatenate([[0], np.cumsum(held)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] + ELEMENTS, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


# T11
def _aligned(ids: pa.Array, labels: pa.Array, soft: bool, ignore_class: int, threshold: float):
    """ids (nulls as -1), word_start, label and flag of a batch, over flattened
    values: the running count of word starts in a document indexes its labels."""
    ids = ids.cast(pa.list_(pa.int32()))
    at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    word = pc.fill_null(ids.flatten(), SPECIAL_WORD_ID)
    w = word.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    first = np.zeros(len(w), bool)
    first[at[:-1][size > 0]] = True
    start = (w > -1) & (first | np.concatenate([[True], w[1:] != w[:-1]])[:len(w)])
    count = np.concatenate([[0], np.cumsum(start)])
    cursor = count[1:] - 1 - np.repeat(count[at[:-1]], size)
    have = pc.fill_null(pc.list_value_length(labels), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(have) - have
    known = start & (cursor < np.repeat(have, size))
    index = pa.array(np.where(known, cursor + np.repeat(begin, size), 0), mask=~known)
    flat = labels.flatten()
    label = flat.take(index) if len(flat) else pa.nulls(len(w), flat.type)
    score = label if not soft else pc.list_element(pc.if_else(pc.greater(pc.fill_null(pc.list_value_length(label), 0), 0), label, None), 0)
    keep = pc.greater(score, threshold) if soft else pc.not_equal(score, pa.scalar(ignore_class, score.type))
    flag = pc.and_(pa.array(start), pc.fill_null(keep, False))
    offsets = pa.array(at.astype(np.int32))
    null = ids.is_null()
    return [pa.ListArray.from_arrays(offsets, x, mask=null) for x in (word, pa.array(start), label, flag)]


def align_labels(df: DataFrame, ids: str = "word_ids", labels: str = "labels",
                 soft: bool = False, ignore_class: int = 7,
                 threshold: float = SOFT_LABEL_THRESHOLD) -> DataFrame:
    """Adds arrays ``word_start``, ``label`` and ``flag`` (one entry per token)
    and turns ``ids`` nulls into -1; drops ``labels``.

    The n-th word start takes the n-th label (the cursor counts every word
    start, also those whose label is ignored).  ``flag``: word start and label
    not the ignore class (hard) or first probability above ``threshold`` (soft).
    One Arrow pass, vectorised across the documents of a batch; no shuffle.
    """
    elem = df.schema[labels].dataType.elementType
    keep = [c for c in df.columns if c not in (ids, labels, "word_start", "label", "flag")]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(ids, T.ArrayType(T.IntegerType())),
                           T.StructField("word_start", T.ArrayType(T.BooleanType())), T.StructField("label", T.ArrayType(elem)),
                           T.StructField("flag", T.ArrayType(T.BooleanType()))])

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, [ids, labels])):
            new = _aligned(b.column(ids), b.column(labels), soft, ignore_class, threshold)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=schema.names)

    return df.mapInArrow(run, schema)


# T12
def scatter_target(aligned: DataFrame, soft: bool = False, width: int | None = None,
                   out: str = "target") -> DataFrame:
    """Per token: its label where flagged, -100 elsewhere (soft: a width-C
    row of -100)."""
    if soft:
        fill = F.array_repeat(F.lit(float(IGNORE_INDEX)), width)
        return aligned.withColumn(out, F.zip_with("flag", "label", lambda f, lab: F.when(f, lab).otherwise(fill)))
    keep = [c for c in aligned.columns if c != out]
    schema = T.StructType([*[aligned.schema[c] for c in keep], T.StructField(out, aligned.schema["label"].dataType)])

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, ["label"])):
            flag, label = b.column("flag"), b.column("label")
            flat = label.flatten()
            values = pc.if_else(pc.fill_null(flag.flatten(), False), flat, pa.scalar(IGNORE_INDEX, flat.type))
            at = label.offsets.to_numpy()
            target = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), values, mask=label.is_null())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), target], names=schema.names)

    return aligned.mapInArrow(run, schema)


def positions(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = "pos") -> DataFrame:
    """Equal-length array columns -> one row per position (keys..., pos, cols...)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    z = F.arrays_zip(*[F.col(c).alias(c) for c in cols])
    x = df.select(*keys, F.posexplode(z).alias(pos, "_z"))
    return x.select(*keys, F.col(pos).cast("int").alias(pos), *[F.col(f"_z.{c}").alias(c) for c in cols])
