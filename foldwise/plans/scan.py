"""Ordered scans over groups that may be huge, without a whole-group window.

Rows carry a dense ordinal inside their group (see ``with_ordinal``).  Each
group is cut into buckets of ``bucket_rows`` consecutive ordinals; windows run
per (group, bucket) and a per-bucket summary table (one row per bucket)
carries the prefix from earlier buckets.  A group with a third of all rows is
therefore spread over ``rows / bucket_rows`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.plans.sizing import join_small

DEFAULT_BUCKET_ROWS = 1 << 20

_AGG = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, None)}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    f = _AGG[kind][1]
    # least/greatest skip nulls
    return f(a, b)


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for the group columns (value as string + null flag),
    so windows, aggregations and the carry join share one hash partitioning
    (a null-safe join would re-key and reshuffle the rows)."""
    keys = []
    for i, c in enumerate(by):
        if f"_gk{i}" not in df.columns:      # reuse the keys of a previous scan
            df = (df.withColumn(f"_gk{i}", F.coalesce(F.col(c).cast("string"), F.lit("")))
                    .withColumn(f"_gn{i}", F.col(c).isNull()))
        keys += [f"_gk{i}", f"_gn{i}"]
    return df, keys


def prefix(df: DataFrame, by, ordinal: str, value: Column, kind: str, out: str,
           inclusive: bool = False, bucket_rows: int = DEFAULT_BUCKET_ROWS,
           keep_keys: bool = False) -> DataFrame:
    """Add ``out`` = ``kind``(value) over earlier rows of the group (and the row
    itself when ``inclusive``).  ``kind`` is min, max or sum; nulls are skipped
    and an empty prefix gives null (0 for sum).  ``keep_keys`` leaves the
    bucket and group key columns in place so a following scan over the same
    groups reuses the partitioning (no second shuffle)."""
    by = [by] if isinstance(by, str) else list(by)
    agg = _AGG[kind][0]
    d = df if "_bk" in df.columns else df.withColumn("_bk", F.floor(F.col(ordinal) / bucket_rows))
    d = d.withColumn("_v", value)
    d, keys = _keyed(d, by)
    per = d.groupBy(*keys, "_bk").agg(agg("_v").alias("_bv"))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.withColumn("_carry", agg("_bv").over(wb)).drop("_bv")
    wi = Window.partitionBy(*keys, "_bk").orderBy(ordinal).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    within = d.withColumn("_in", agg("_v").over(wi))
    joined = join_small(within, carry, [*keys, "_bk"])
    res = joined.withColumn(out, _combine(kind, F.col("_carry"), F.col("_in"))).drop("_v", "_carry", "_in")
    return res if keep_keys else res.drop("_bk", *keys)


def trailing(df: DataFrame, by, ordinal: str, value: Column, width: int, kind: str, out: str,
             bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """``out`` = ``kind``(value) over the last ``width`` rows up to the row.

    The last ``width - 1`` rows of each bucket are copied into the next bucket
    as context (a halo), so each (group, bucket) window is complete.
    """
    by = [by] if isinstance(by, str) else list(by)
    if width - 1 > bucket_rows:
        raise ValueError("trailing: width larger than a bucket")
    fn = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[kind]
    d = df.withColumn("_bk", F.floor(F.col(ordinal) / bucket_rows)).withColumn("_v", value) \
          .withColumn("_halo", F.lit(False))
    d, keys = _keyed(d, by)
    halo = (d.filter(F.col(ordinal) % bucket_rows >= bucket_rows - (width - 1))
              .withColumn("_bk", F.col("_bk") + 1).withColumn("_halo", F.lit(True)))
    w = Window.partitionBy(*keys, "_bk").orderBy(ordinal).rowsBetween(-(width - 1), 0)
    both = d.unionByName(halo).withColumn(out, fn("_v").over(w))
    return both.filter(~F.col("_halo")).drop("_bk", "_v", "_halo", *keys)
