"""Seeded shuffles and fixed-size batches (K4-K6).

The shuffle order is ``md5(seed+epoch ':' id)``: reproducible across
partitionings and engines.  Batches number rows by a global (or per-group)
ordinal computed without a single-partition window.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.hashing import seeded_key
from foldwise.operators.columns import with_hashed_ordinal, with_ordinal
from foldwise.plans.sizing import join_small


# K4
def shuffle_key(id_col: str, seed: int, epoch: int = 0):
    """Order key of a seeded shuffle, re-seeded per epoch (``seed + epoch``)."""
    return seeded_key(seed + epoch, id_col)


def shuffle(df: DataFrame, id_col: str, seed: int, epoch: int = 0, by: Sequence[str] = (),
            out: str = "ordinal") -> DataFrame:
    """Rows numbered in seeded random order (per ``by`` group).  A negative seed
    draws one at random, as the reference does."""
    if seed < 0:
        seed = random.randrange(0, 2**31)
    keyed = df.withColumn("_sk", shuffle_key(id_col, seed, epoch))
    return with_hashed_ordinal(keyed, "_sk", [id_col], by=list(by), name=out).drop("_sk")


# K5
def batches(df: DataFrame, size: int, order: Sequence[str], drop_last: bool = False,
            by: Sequence[str] = (), ordinal: str | None = None, out: str = "batch") -> DataFrame:
    """Assign ``batch = floor(ordinal / size)`` in ``order`` (per ``by`` group);
    with ``drop_last`` the rows of a short last batch are removed."""
    by = list(by)
    if ordinal is None:
        df = with_ordinal(df, list(order), by=by, name="_ord")
        ordinal = "_ord"
    d = df.withColumn(out, F.floor(F.col(ordinal) / size).cast("long"))
    if drop_last:
        if by:
            counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
            d = join_small(d, counts, by, null_safe=True)
        else:
            d = d.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row
        d = d.filter(F.col(ordinal) < F.floor(F.col("_n") / size) * size).drop("_n")
    return d.drop("_ord") if ordinal == "_ord" else d


# K6
def batch_counts(df: DataFrame, size: int, drop_last: bool, by: Sequence[str] = ()) -> DataFrame:
    """Rows and batches per group: ``floor`` with drop_last, ``ceil`` without."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    f = F.floor if drop_last else F.ceil
    return c.withColumn("batches", f(F.col("rows") / size).cast("long"))
