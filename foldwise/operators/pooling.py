"""Pooling token vectors into document vectors (V1-V9).

Input rows: (group keys, e.g. doc and layer; pos; mask; vec array<double>).  No
group is collected into one task.  One formula at all widths: every task folds its
rows into one partial vector per group with numpy over Arrow batches, so one row per
(task, group) is shuffled, and partials are folded in the same way.  The softmax is
folded with its running maximum, so it needs no pass of its own.

Rules, the same at all widths:
* a row whose mask is 0 or null is hidden and never read, so a NaN there does
  no harm; every other mask value is real (a weight for the mean);
* a row with a null vector is hidden; a group without a vector gives null;
* NaN in a real row follows Spark's order (above every number): the mean and the
  maximum become NaN, the minimum only where all are;
* layer weights may be negative or zero; weights that sum to 0 give null;
* vectors of one group must have one width (an error inside the query).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.constants import MASKED_MAX_FILL, MEAN_POOL_EPS
from foldwise.plans.sizing import join_small

# Bytes of partial vectors that a task holds before it folds them.
HELD = 32 << 20
# Columns of a partial: weight (for a softmax the largest score), sum of the softmax
# terms, whether a real row was met, the vectors' width (null without any) and the vector.
PARTIAL = ("_m", "_s", "_real", "_w", "_v")


def _groups(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by group, where each group begins there, and a row of each group."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        d = pc.dictionary_encode(batch.column(i), null_encoding="encode")
        code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]        # dense again, so no product overflows
    order = np.argsort(code, kind="stable")
    begin = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, begin, order[begin]


def _folded(batch: pa.RecordBatch, keys: int, how: str) -> pa.RecordBatch:
    """One partial per group of a batch of partials."""
    order, begin, first = _groups(batch, keys)
    m, s, real, w, v = (batch.column(keys + i) for i in range(5))
    m, s = (x.fill_null(0.0).to_numpy(zero_copy_only=False)[order] for x in (m, s))
    real = real.to_numpy(zero_copy_only=False)[order].astype(bool)
    lo = np.minimum.reduceat(np.where((n := w.fill_null(-1).to_numpy(zero_copy_only=False)[order]) < 0, np.iinfo(np.int32).max, n), begin)
    hi = np.maximum.reduceat(n, begin)
    if (bad := (hi >= 0) & (lo != hi)).any():
        raise ValueError(f"pooling: vectors of one group differ in width ({lo[bad][0]} and {hi[bad][0]})")
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    if how == "softmax":
        top = np.full(len(begin), -np.inf)
        np.maximum.at(top, group[real], m[real])
        with np.errstate(invalid="ignore"):
            scale = np.where(real, np.where(m == top[group], 1.0, np.exp(m - top[group])), 0.0)
        total, m = np.add.reduceat(s * scale, begin), top
    else:
        scale, total, m = None, np.add.reduceat(s, begin), np.add.reduceat(m, begin)
    any_real = np.logical_or.reduceat(real, begin)
    # vectors, one width at a time
    offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    pieces: list[np.ndarray] = [np.zeros(0)] * len(begin)
    for d in np.unique(hi[hi > 0]):
        mine = np.flatnonzero(real & (hi[group] == d))
        held = np.flatnonzero(hi == d)
        out = np.full((len(begin), d), {"max": -np.inf, "min": np.inf}.get(how, 0.0))
        if len(mine):
            x = flat[offsets[order[mine]][:, None] + np.arange(d)]
            if scale is not None:
                x = x * scale[mine][:, None]
            at = np.flatnonzero(np.diff(group[mine], prepend=-1))
            fold = {"max": np.maximum, "min": np.fmin}.get(how, np.add)
            out[group[mine][at]] = fold.reduceat(x, at, axis=0)
        for g in held:
            pieces[g] = out[g]
    sizes = np.array([len(p) for p in pieces])
    vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*pieces, np.zeros(0)])))
    width = pa.array(hi.astype(np.int32), mask=hi < 0)
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(first)) for i in range(keys)), pa.array(m), pa.array(total),
                                       pa.array(any_real), width, vectors], names=batch.schema.names)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _fold_task(keys: int, how: str, is_sorted: bool):
    """Folds a task's partials: into one per group as far as HELD bytes reach, or, if
    groups come one after the other, into exactly one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(_folded(b, keys, how))
            if sum(x.nbytes for x in held) > HELD:
                one = _folded(_joined(held), keys, how)
                if is_sorted:                                    # all but the last group are complete
                    last = _last(one, b, keys)
                    yield one.filter(pa.array(~last))
                    held = [one.filter(pa.array(last))]
                elif one.nbytes > HELD // 2:
                    yield one
                    held = []
                else:
                    held = [one]
        if held:
            yield _folded(_joined(held), keys, how)

    return run


def _last(folded: pa.RecordBatch, batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Which groups of ``folded`` the last row of ``batch`` is in."""
    same = np.ones(folded.num_rows, bool)
    for i in range(keys):
        x, y = folded.column(i), batch.column(i)[-1]
        equal = pc.is_null(x) if not y.is_valid else pc.fill_null(pc.equal(x, y), False)
        same &= equal.to_numpy(zero_copy_only=False)
    return same


def _pooled(df: DataFrame, by: Sequence[str], vec: str, how: str, real: Column, weight: Column | None, out: str, finish) -> DataFrame:
    """(by..., out): the real rows' vectors folded by ``how`` (sum of vectors times
    ``weight``, max, min, or softmax with ``weight`` as score); ``finish(array)`` makes
    the result from it and the partial's columns."""
    by = list(by)
    keys, v = [f"_k{i}" for i in range(len(by))], F.col(vec).cast("array<double>")
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    hidden = F.array().cast("array<double>")
    shown = F.transform(v, lambda x: x * weight) if how == "sum" else v
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.when(real, weight).alias("_m"), F.when(real, F.lit(1.0)).otherwise(F.lit(0.0)).alias("_s"),
                     F.coalesce(real, F.lit(False)).alias("_real"), F.when(v.isNotNull(), F.size(v)).alias("_w"), F.when(real, shown).otherwise(hidden).alias("_v"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keys), *(T.StructField(n, t) for n, t in zip(PARTIAL, (
        T.DoubleType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.ArrayType(T.DoubleType()))))])
    part = rows.mapInArrow(_fold_task(len(by), how, False), schema)
    part = part.repartition(*keys).sortWithinPartitions(*keys) if keys else part.repartition(1)
    whole = part.mapInArrow(_fold_task(len(by), how, True), schema)
    return whole.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), F.when(F.col("_w").isNotNull(), finish(F.col("_v"))).alias(out))


def _real(mask: str, vec: str) -> Column:
    return F.col(vec).isNotNull() & F.col(mask).isNotNull() & (F.col(mask) != 0)


def _divided(arr: Column, by: Column) -> Column:
    """Elements over ``by``; null where ``by`` is 0."""
    return F.when(by != 0, F.transform(arr, lambda x: x / by))


# V1
def mean_pool(df: DataFrame, by: Sequence[str] = ("doc",), vec: str = "vec", mask: str = "mask",
              out: str = "pooled") -> DataFrame:
    """sum(v * mask) / max(sum(mask), 1e-9); a group with no real token pools to zeros."""
    den = F.greatest(F.col("_m"), F.lit(MEAN_POOL_EPS))
    return _pooled(df, by, vec, "sum", _real(mask, vec), F.col(mask), out, lambda arr: _divided(arr, den))


# V2 / V3
def max_pool(df: DataFrame, by: Sequence[str] = ("doc",), vec: str = "vec", mask: str = "mask",
             out: str = "pooled", fill: float | None = MASKED_MAX_FILL) -> DataFrame:
    """Element-wise max over real positions.  A group with no real token gets
    ``fill`` in every element (the reference's -1e4) or null with ``fill=None``."""
    return _extreme(df, by, vec, mask, out, "max", fill)


def min_pool(df: DataFrame, by: Sequence[str] = ("doc",), vec: str = "vec", mask: str = "mask",
             out: str = "pooled", fill: float | None = None) -> DataFrame:
    """Element-wise min over real positions (the true masked min; the
    reference fills hidden positions with +1e-4, see SURVEY D9).  A group
    with no real token gets ``fill`` (null by default)."""
    return _extreme(df, by, vec, mask, out, "min", fill)


def _extreme(df, by, vec, mask, out, how, fill):
    def finish(arr):
        filled = F.lit(None).cast("array<double>") if fill is None else F.array_repeat(F.lit(float(fill)), F.col("_w"))
        return F.when(F.col("_real"), arr).otherwise(filled)

    return _pooled(df, by, vec, how, _real(mask, vec), None, out, finish)


def pool(df: DataFrame, how: str = "mean", **kw) -> DataFrame:
    """Dispatch: mean, max, min, softmax (attention; needs ``score=``)."""
    return {"mean": mean_pool, "max": max_pool, "min": min_pool, "softmax": attention_pool}[how](df, **kw)


# V4
def attention_pool(df: DataFrame, score: str, by: Sequence[str] = ("doc",), vec: str = "vec",
                   mask: str = "mask", out: str = "pooled") -> DataFrame:
    """Softmax(score) over the real positions of each group, then sum(w * v).
    A group with no real position gives null (the reference's softmax gives NaN)."""
    return _pooled(df, by, vec, "softmax", _real(mask, vec) & F.col(score).isNotNull(), F.col(score), out,
                   lambda arr: F.when(F.col("_real"), _divided(arr, F.col("_s"))))


# V5
def pool_layers(df: DataFrame, start: int = 8, weights: Sequence[float] | None = None,
                by: Sequence[str] = ("doc", "pos"), layer: str = "layer", vec: str = "vec",
                out: str = "pooled") -> DataFrame:
    """Weighted average of layers ``start..`` (weights default to 1) per token.
    Weights are free parameters: negative ones are taken as they are."""
    d = df.filter((F.col(layer) >= start) & F.col(vec).isNotNull())
    w = F.lit(1.0)
    if weights is not None:
        wmap = F.create_map(*[x for i, wt in enumerate(weights) for x in (F.lit(start + i), F.lit(float(wt)))])
        w = F.coalesce(F.try_element_at(wmap, F.col(layer)), F.raise_error(F.lit("pool_layers: no weight")))
    return _pooled(d, by, vec, "sum", F.col(vec).isNotNull(), w, out, lambda arr: _divided(arr, F.col("_m")))


# V6
def pool_last_layers(df: DataFrame, n: int = 4, by: Sequence[str] = ("doc",), layer: str = "layer",
                     vec: str = "vec", mask: str = "mask", out: str = "pooled") -> DataFrame:
    """Mean-pool (V1) each of the last ``n`` layers; returns (by..., slot, layer, pooled)
    with slot 0 for the earliest of the kept layers, and the concatenation is
    :func:`stack_slots`."""
    by = list(by)
    layers = df.select(layer).distinct()
    top = layers.withColumn("_rk", F.row_number().over(Window.orderBy(F.col(layer).desc())))
    top = top.filter(F.col("_rk") <= n).withColumn("slot", (F.lit(n) - F.col("_rk")).cast("int")).drop("_rk")
    kept = join_small(df, top, [layer], bound=n)      # top holds at most n layers
    pooled = mean_pool(kept, [*by, layer], vec, mask, out)
    return join_small(pooled, top, [layer], bound=n)


def stack_slots(df: DataFrame, by: Sequence[str], slot: str = "slot", vec: str = "pooled",
                out: str = "stacked") -> DataFrame:
    """Concatenate per-slot vectors of each group in slot order (at most n slots)."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(slot), F.col(vec)))).alias("_l"))
    return g.select(*by, F.flatten(F.transform("_l", lambda x: x[vec])).alias(out))


# V7
def softmax_over(df: DataFrame, partition: Sequence[str], value: str = "value",
                 out: str = "softmax") -> DataFrame:
    """Softmax of ``value`` across the rows of each partition (e.g. batch, dim,
    layer).  The partition must be bounded (a batch), see SURVEY D10."""
    w = Window.partitionBy(*partition)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn(out, e / F.sum(e).over(w))


# V8
def word_mean(df: DataFrame, by: Sequence[str] = ("doc",), word: str = "word_id", vec: str = "vec",
              out: str = "vec") -> DataFrame:
    """Each token of a word gets the mean vector of the word's tokens; tokens with
    word id -1 (or null) keep their vector."""
    by = list(by)
    words = df.filter(F.col(word) >= 0).withColumn("_one", F.lit(1))
    means = mean_pool(words, [*by, word], vec, "_one", "_wm")
    j = join_small(df, means, [*by, word], how="left", null_safe=True)
    return j.withColumn(out, F.when(F.col(word) >= 0, F.col("_wm")).otherwise(F.col(vec))).drop("_wm")


# V9
def project(df: DataFrame, W, b=None, vec: str = "vec", out: str = "proj",
            method: str = "auto") -> DataFrame:
    """``x @ W + b`` for a supplied weight matrix W (d x o) and bias (o).

    ``expr``: one dot product per output with JVM array functions
    (``zip_with`` + ``aggregate``); for small heads.  ``pandas``: Arrow
    batches multiplied with numpy, W shipped once per task; for wide heads.
    ``auto`` picks ``expr`` up to d * o = 4096.  Measured at 1M rows x 64 dims
    x 6 outputs: 2.3 s (expr), 1.8 s (pandas); a flat sum of d * o scalar
    terms does not compile to generated code and took 16 s."""
    W = np.asarray(W, dtype=float)
    d, o = W.shape
    b = np.zeros(o) if b is None else np.asarray(b, dtype=float)
    if method == "auto":
        method = "expr" if d * o <= 4096 else "pandas"
    if method == "expr":
        v = F.col(vec)
        cols = []
        for k in range(o):
            wk = F.array(*[F.lit(float(x)) for x in W[:, k]])
            dot = F.aggregate(F.zip_with(v, wk, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            cols.append(dot + F.lit(float(b[k])))
        width_ok = F.size(v) == d
        arr = F.when(width_ok, F.array(*cols)).otherwise(
            F.raise_error(F.lit(f"project: vectors are not of width {d}")))
        return df.withColumn(out, arr)
    if method != "pandas":
        raise ValueError(method)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf[vec].to_numpy()) if len(pdf) else np.zeros((0, d))
            y = x @ W + b
            pdf[out] = list(y)
            yield pdf

    return df.mapInPandas(run, schema)
