"""Training-log monitoring.

A log has one row per step: group columns (e.g. run, fold), a dense step
ordinal starting at 0, and a loss.  All scans use :mod:`foldwise.plans.scan`
and early stopping with ``delta`` uses bucketed improvement chains, so that
one long run is processed by many tasks.

Semantics held from the reference:
* running best (R2) improves only on a *strict* decrease, so the best step is
  the first minimum;
* early stopping (R4) counts an *equal* loss as an improvement (it resets the
  patience counter); with ``delta`` an improvement needs
  ``loss <= best - delta``;
* NaN or null losses are never an improvement (the reference's NaN handling
  forgets the true best; see SURVEY 2.9.6).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.plans.scan import DEFAULT_BUCKET_ROWS, prefix, trailing
from foldwise.plans.sizing import join_small


def _clean(loss: str):
    return F.when(F.isnan(loss), F.lit(None)).otherwise(F.col(loss))


# R1
def rolling_mean(log: DataFrame, window: int = 10, by: Sequence[str] = ("run",), step: str = "step",
                 loss: str = "loss", out: str = "rolling_mean",
                 bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Mean of the last ``window`` losses (fewer at the start of a run)."""
    return trailing(log, list(by), step, F.col(loss), window, "avg", out, bucket_rows)


# R2
def running_best(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step", loss: str = "loss",
                 bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Adds ``best_before`` (min loss of earlier steps), ``best`` (min up to the
    step) and ``improved`` (strictly below every earlier loss)."""
    out = prefix(log, list(by), step, _clean(loss), "min", "best_before", False, bucket_rows)
    lc = _clean(loss)
    return (out.withColumn("best", F.least(F.col("best_before"), lc))
               .withColumn("improved", lc.isNotNull() & (F.col("best_before").isNull()
                                                         | (lc < F.col("best_before")))))


# R3
def best_epoch(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step",
               loss: str = "loss") -> DataFrame:
    """(by..., best_step, best_loss): first step with the minimum loss (NaN ignored)."""
    lc = _clean(loss)
    key = F.struct(lc.alias("l"), F.col(step).alias("s"))
    clean = log.filter(lc.isNotNull())
    return clean.groupBy(*by).agg(F.min_by(F.col(step), key).alias("best_step"),
                                  F.min(lc).alias("best_loss"))


# R4
def improvements(log: DataFrame, by: Sequence[str] = ("run",), step: str = "step", loss: str = "loss",
                 bucket_rows: int = DEFAULT_BUCKET_ROWS, keep_keys: bool = False) -> DataFrame:
    """Per step: ``improved`` (loss <= best so far, equal counts) and
    ``counter`` (steps since the last improvement).  ``keep_keys`` is that of
    :func:`prefix`."""
    by = list(by)
    lc = _clean(loss)
    d = prefix(log, by, step, lc, "min", "_prev", False, bucket_rows, keep_keys=True)
    d = d.withColumn("improved", lc.isNotNull() & (F.col("_prev").isNull() | (lc <= F.col("_prev"))))
    d = prefix(d, by, step, F.when(F.col("improved"), F.col(step)), "max", "_last", True, bucket_rows, keep_keys=keep_keys)
    return (d.withColumn("counter", (F.col(step) - F.coalesce(F.col("_last"), F.lit(-1))).cast("int"))
             .drop("_prev", "_last"))


def early_stop(log: DataFrame, patience: int, delta: float = 0.0, by: Sequence[str] = ("run",),
               step: str = "step", loss: str = "loss",
               bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """(by..., stop_at): first step whose counter reaches ``patience`` (null if never).

    ``delta == 0`` runs as parallel prefix scans.  ``delta > 0`` moves the best
    only on a jump of ``delta``, so the best depends on the path; it runs as
    the improvement chain of :func:`_early_stop_chain`, also split over buckets.
    """
    by = list(by)
    if patience < 1:
        raise ValueError("early_stop: patience must be at least 1")
    if delta == 0:
        # one aggregation over the scanned rows gives the groups without a stop too
        imp = improvements(log, by, step, loss, bucket_rows)
        return imp.groupBy(*by).agg(F.min(F.when(F.col("counter") >= patience, F.col(step))).alias("stop_at"))
    return _early_stop_chain(log, patience, delta, by, step, loss, bucket_rows)


# Outcome kinds of a chain followed through a bucket.
_EXIT, _STOP, _NONE = 0, 1, 2
# Buckets composed per group at each level of the chain reduction.
CHAIN_FANOUT = 64


def _early_stop_chain(log: DataFrame, patience: int, delta: float, by: list[str], step: str,
                      loss: str, bucket_rows: int) -> DataFrame:
    """Early stopping with ``delta`` as an improvement chain.

    After an improvement at step i (best = loss_i) the next one is
    J(i) = the first step in (i, i + patience] with loss <= loss_i - delta; if
    there is none the run stops at i + patience.  The chain starts at the first
    non-null loss (or the run stops at patience - 1 if that comes too late).

    Steps are cut into buckets of B >= patience steps.  A task per (group,
    bucket) sees its rows plus the first ``patience`` rows of the next bucket,
    finds J for every row (numpy, ``patience`` vector passes) and follows the
    chain inside the bucket by pointer jumping.  Since a jump is at most
    ``patience`` steps, a chain enters a bucket at one of its first
    ``patience`` steps: the bucket is summarised by that many (entry ->
    outcome) rows, where the outcome is "exit into the next bucket at step s"
    or "stop at step s".  Summaries compose associatively; they are merged
    ``CHAIN_FANOUT`` buckets per task, level by level, until each group has
    one.  No task holds more than B + patience rows or
    ``CHAIN_FANOUT * patience`` summary rows.
    """
    p = int(patience)
    B = max(int(bucket_rows), p)
    keys = [F.col(c) for c in by]
    d = log.select(*keys, F.col(step).cast("long").alias("_s"), _clean(loss).cast("double").alias("_x"))
    d = d.withColumn("_bk", F.floor(F.col("_s") / B).cast("long"))
    halo = (d.filter((F.col("_s") % B < p) & (F.col("_bk") > 0))
              .withColumn("_bk", F.col("_bk") - 1))
    key_fields = [f"`{c}` {log.schema[c].dataType.simpleString()}" for c in by]
    map_schema = ", ".join(key_fields + ["_bk long", "_e long", "_k int", "_v long"])

    def bucket_map(pdf: pd.DataFrame) -> pd.DataFrame:
        bk = int(pdf["_bk"].iloc[0])
        start = bk * B
        steps = pdf["_s"].to_numpy(dtype=np.int64) - start
        n_all = int(steps.max()) + 1
        x = np.full(n_all + p, np.nan)
        x[steps] = pdf["_x"].to_numpy(dtype=float)
        n = min(B, n_all)                   # the bucket's own steps
        idx = np.arange(n)
        J = np.full(n, -1, dtype=np.int64)
        thr = x[:n] - delta
        for off in range(1, p + 1):
            hit = (J < 0) & (x[off:off + n] <= thr)
            J[hit] = idx[hit] + off
        kind = np.where(np.isnan(x[:n]), _NONE, np.where(J < 0, _STOP, _EXIT))
        val = np.where(J < 0, idx + p, J) + start
        inside = (J >= 0) & (J < n)
        nxt = np.where(inside, J, idx)
        for _ in range(int(np.ceil(np.log2(max(n, 2)))) + 1):
            nxt = nxt[nxt]
        e = np.arange(min(p, n))
        out = pd.DataFrame({"_bk": bk, "_e": e + start, "_k": kind[nxt[e]].astype(np.int32),
                            "_v": val[nxt[e]]})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    maps = d.unionByName(halo).groupBy(*keys, "_bk").applyInPandas(bucket_map, map_schema)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_bk", "_e"])
        comp: dict[int, tuple[int, int]] = {}
        first = None
        for bk, g in reversed(list(pdf.groupby("_bk", sort=True))):
            cur = {}
            for e, k, v in zip(g["_e"].to_numpy(), g["_k"].to_numpy(), g["_v"].to_numpy()):
                if k == _EXIT and int(v) in comp:
                    k, v = comp[int(v)]
                cur[int(e)] = (int(k), int(v))
            comp, first = cur, bk
        out = pd.DataFrame({"_bk": int(first) // CHAIN_FANOUT, "_e": list(comp),
                            "_k": [k for k, _ in comp.values()], "_v": [v for _, v in comp.values()]})
        out["_k"] = out["_k"].astype(np.int32)
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out

    max_step = log.agg(F.max(step)).first()[0]
    n_buckets = 0 if max_step is None else int(max_step) // B + 1
    while n_buckets > 1:
        maps = (maps.withColumn("_g", F.floor(F.col("_bk") / CHAIN_FANOUT))
                    .groupBy(*keys, "_g").applyInPandas(compose, map_schema))
        n_buckets = (n_buckets + CHAIN_FANOUT - 1) // CHAIN_FANOUT

    facts = log.groupBy(*keys).agg(
        F.min(F.when(_clean(loss).isNotNull(), F.col(step))).cast("long").alias("_c0"),
        F.max(step).cast("long").alias("_last"))
    top = maps.select(*keys, F.col("_e").alias("_c0"), "_k", "_v")
    j = join_small(facts, top, [*by, "_c0"], how="left", null_safe=True)
    late = F.col("_c0").isNull() | (F.col("_c0") >= p)
    stop = F.when(late, F.when(F.col("_last") >= p - 1, F.lit(p - 1))) \
            .otherwise(F.when((F.col("_k") == _STOP) & (F.col("_v") <= F.col("_last")), F.col("_v")))
    return j.select(*keys, stop.cast("int").alias("stop_at"))


# R5
def effective_log(log: DataFrame, patience: int, delta: float = 0.0, by: Sequence[str] = ("run",),
                  step: str = "step", loss: str = "loss",
                  bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """The log cut at the stop step (steps after it never ran).

    Without ``delta`` a third scan over the same (group, bucket) partitioning asks
    each row whether a stop came before it: no group's rows are gathered."""
    if patience < 1:
        raise ValueError("effective_log: patience must be at least 1")
    if delta == 0:
        imp = improvements(log, by, step, loss, bucket_rows, keep_keys=True)
        hit = F.when(F.col("counter") >= patience, F.col(step))
        return prefix(imp, list(by), step, hit, "min", "_hit", False, bucket_rows).filter("_hit is null").select(*log.columns)
    stops = early_stop(log, patience, delta, by, step, loss, bucket_rows)
    j = join_small(log, stops, list(by), how="left", null_safe=True)
    return j.filter(F.col("stop_at").isNull() | (F.col(step) <= F.col("stop_at"))).drop("stop_at")


# R6
def run_summary(log: DataFrame, patience: int, batch_size: int | None = None,
                by: Sequence[str] = ("run",), step: str = "step", loss: str = "loss",
                bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """Per group: best loss and step, stop step, stopped flag, mean loss, rows,
    and batch count (``ceil(rows / batch_size)``) when a batch size is given."""
    by = list(by)
    base = log.groupBy(*by).agg(F.avg(_clean(loss)).alias("mean_loss"), F.count(F.lit(1)).alias("rows"))
    if batch_size:
        base = base.withColumn("batches", F.ceil(F.col("rows") / batch_size).cast("long"))
    out = join_small(base, best_epoch(log, by, step, loss), by, how="left", null_safe=True)
    out = join_small(out, early_stop(log, patience, 0.0, by, step, loss, bucket_rows), by,
                     how="left", null_safe=True)
    return out.withColumn("stopped", F.col("stop_at").isNotNull())
