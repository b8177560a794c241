"""Projections, column shaping and row ordinals.

All functions are thin compositions of DataFrame calls except the row
ordinals, which number rows without a single-partition window: keys are range
partitioned (or bucketed by a hash), numbered inside each part, and shifted by
prefix counts computed on a table with one row per (part, group) pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.plans.scratch import written
from foldwise.plans.sizing import default_partitions, join_small


def _cols(cols) -> list:
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


# P1
def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column subset by name list (order kept)."""
    return df.select(*cols)


# P2
def features_of(df: DataFrame, ids: Iterable[str], targets: Iterable[str],
                also_drop: Iterable[str] = ("fold",)) -> list[str]:
    """All columns except ids, targets and ``also_drop`` (fold by default)."""
    skip = set(ids) | set(targets) | set(also_drop)
    return [c for c in df.columns if c not in skip]


def select_features(df: DataFrame, ids, targets, also_drop=("fold",), keep_ids=True) -> DataFrame:
    feats = features_of(df, ids, targets, also_drop)
    return df.select(*((list(ids) if keep_ids else []) + feats))


# P3
def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


# P4
def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by mapping; keys that are not columns are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


# P6
def suffix_columns(df: DataFrame, suffix: str, keep: Iterable[str] = ()) -> DataFrame:
    keep = set(keep)
    return rename(df, {c: c + suffix for c in df.columns if c not in keep})


# P9
def assign_where(df: DataFrame, cond: Column, col: str, value) -> DataFrame:
    """Set ``col`` to ``value`` on rows matching ``cond``; others keep their value
    (or null when the column does not exist yet)."""
    value = value if isinstance(value, Column) else F.lit(value)
    other = F.col(col) if col in df.columns else F.lit(None)
    return df.withColumn(col, F.when(cond, value).otherwise(other))


# P10
def cast_cols(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Cast columns; casting a double to an integer type truncates toward zero."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in mapping.items()})


# P11
def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             keep: bool = True, dtype: str = "double") -> DataFrame:
    """Columns -> one ``array<dtype>`` per row; a null cell is an error."""
    arr = F.array(*[F.col(c).cast(dtype) for c in cols])
    checked = F.when(F.exists(arr, lambda x: x.isNull()),
                     F.raise_error(F.lit(f"assemble: null value in {out}"))).otherwise(arr)
    out_df = df.withColumn(out, checked)
    return out_df if keep else out_df.drop(*[c for c in cols if c != out])


# P12
def disassemble(df: DataFrame, vec: str, names: Sequence[str], drop: bool = True) -> DataFrame:
    """``array`` column -> one named column per element."""
    out = df.withColumns({n: F.col(vec)[i] for i, n in enumerate(names)})
    return out.drop(vec) if drop else out


# P13
_WIDE = re.compile(r"^(.+)_(label|prob)_fold(\d+)$")


def to_long(df: DataFrame, ids: Sequence[str], value: str = "value") -> DataFrame:
    """Wide ``<target>_<kind>_fold{i}`` columns -> rows (ids, target, kind, fold, value)."""
    wide = [c for c in df.columns if _WIDE.match(c)]
    if not wide:
        raise ValueError("to_long: no <target>_<kind>_fold<i> columns")
    longer = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in wide]).unpivot(
        list(ids), wide, "_name", value)
    pat = _WIDE.pattern
    return longer.select(
        *ids,
        F.regexp_extract("_name", pat, 1).alias("target"),
        F.regexp_extract("_name", pat, 2).alias("kind"),
        F.regexp_extract("_name", pat, 3).cast("int").alias("fold"),
        F.col(value),
    )


def to_wide(df: DataFrame, ids: Sequence[str], targets: Sequence[str], kinds: Sequence[str],
            folds: Sequence[int], value: str = "value") -> DataFrame:
    """Inverse of :func:`to_long`; the cells are explicit so no extra job runs.  Of
    several values for a cell the largest stays."""
    names = [f"{t}_{k}_fold{f}" for t in targets for k in kinds for f in folds]
    place = F.lit(0)
    for col, known in (("target", targets), ("kind", kinds), ("fold", folds)):
        at = F.array_position(F.array(*(F.lit(str(x)) for x in known)), F.col(col).cast("string")) - 1
        place = place * len(known) + F.when(at >= 0, at)            # null where a part is not listed
    # a group is one row of cells from the first aggregation on: no group per cell comes before
    return df.withColumn("_at", place).groupBy(*ids).agg(*(
        F.max(F.when(F.col("_at") == i, F.col(value))).alias(n) for i, n in enumerate(names)))


# P8
def fold_roles(df: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Every (row, held-out fold) pair with role 'valid' or 'train'.

    Rows grow k-fold; prefer the subtraction rewrites of :mod:`oof` for
    statistics.  Generated by ``explode`` (no join)."""
    return (df.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
              .withColumn("role", F.when(F.col(fold) == F.col("held_out"), F.lit("valid"))
                          .otherwise(F.lit("train"))))


# P7
def split_fold(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid) for held-out fold ``k``; prunes partitions on a fold layout."""
    return df.filter(F.col(fold) != k), df.filter(F.col(fold) == k)


# P5
def _sort_columns(order_by) -> tuple[list[str], list[Column]]:
    """Names and sort orders of ``order_by``: names, or (name, "desc") pairs."""
    items = [order_by] if isinstance(order_by, str) else list(order_by)
    names = [c if isinstance(c, str) else c[0] for c in items]
    return names, [F.col(c) if isinstance(c, str) else F.col(c[0]).desc() if c[1] == "desc" else F.col(c[0]) for c in items]


def running_before(table: DataFrame, order_by, by=(), value: str = "_n", name: str = "_before",
                   num_partitions: int | None = None) -> DataFrame:
    """``table`` with the sum of ``value`` over the rows that come before in
    ``order_by`` order, per ``by`` group.  The keys must be unique.

    No window spans a whole group: the rows are range partitioned (a hot group
    is split over many partitions) and written to shared scratch storage with
    their partition number, so both uses below see the same cut.  Sums run
    inside (partition, group), and the totals of earlier partitions are added."""
    by = list(by)
    names, order = _sort_columns(order_by)
    n = num_partitions or default_partitions(table)
    cut = written(table.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by) if by else Window
    totals = cut.groupBy("_pid", *by).agg(F.sum(value).alias("_sum"))
    shift = totals.select("_pid", *by, F.coalesce(F.sum("_sum").over(
        earlier.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    rows = cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = join_small(rows, shift, ["_pid", *by], null_safe=True, bound=None if by else n)
    return joined.withColumn(name, (F.col("_inside") + F.col("_shift")).cast("long")).drop("_pid", "_inside", "_shift")


def with_ordinal(df: DataFrame, order_by, by=(), name: str = "ordinal", start: int = 0,
                 num_partitions: int | None = None) -> DataFrame:
    """Dense row ordinal in ``order_by`` order (names, or (name, "desc")),
    restarting per ``by`` group.

    The distinct keys (``by`` and ``order_by`` columns only) get their place by
    :func:`running_before`; the rows then join on their keys, so wide columns are
    shuffled once and nothing is cached.  Ties in ``order_by`` get distinct,
    arbitrary ordinals; add a unique column for a total order."""
    by = _cols(by)
    if not all(isinstance(b, str) for b in by):
        raise TypeError("with_ordinal: 'by' must be column names")
    names, _ = _sort_columns(order_by)
    key = list(dict.fromkeys([*by, *names]))
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    placed = written(running_before(counts, order_by, by, "_n", "_o_at", num_partitions))
    ties = placed.filter("_n > 1").select("_n").first() is not None
    at = F.col("_o_at") + F.lit(start)
    if ties:
        at = at + F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1
    joined = join_small(df, placed.drop("_n"), key, null_safe=True)
    return joined.withColumn(name, at.cast("long")).drop("_o_at")


#: Leading hex digits of a hashed key that cut a group into buckets, and rows of a
#: bucket that fewer digits may leave where the largest group is known.
KEY_DIGITS, BUCKET_ROWS = 3, 1 << 16


def with_hashed_ordinal(df: DataFrame, key: str, tie: Sequence[str], by: Sequence[str] = (), name: str = "ordinal",
                        start: int = 0, across: bool = False, largest: int | None = None) -> DataFrame:
    """:func:`with_ordinal` for a hex key that is spread evenly (md5).

    Rows are numbered inside (group, leading digits) and shifted by the counts of
    smaller digits: no sampling, one shuffle of the rows, the same numbers on
    every run, and a group of any size spreads over 16 ** KEY_DIGITS buckets.
    With ``across`` the numbering goes on from group to group in ``by`` order.
    ``largest``, the rows of the largest group, saves digits: groups of at most
    BUCKET_ROWS rows are numbered whole, without counts and their join."""
    by = list(by)
    digits = KEY_DIGITS if largest is None else next((d for d in range(KEY_DIGITS) if largest <= BUCKET_ROWS * 16 ** d), KEY_DIGITS)
    if digits == 0 and by and not across:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(key, *tie)) + F.lit(start - 1)).cast("long"))
    rows = df.withColumn("_o_hx", F.substring(key, 1, max(digits, 1)))
    counts = rows.groupBy(*by, "_o_hx").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_o_hx").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_o_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    if across and by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_n"))
        shift = join_small(shift, running_before(totals, by).drop("_n"), by, null_safe=True)
        shift = shift.withColumn("_o_at", F.col("_o_at") + F.col("_before")).drop("_before")
    order = Window.partitionBy(*by, "_o_hx").orderBy(key, *tie)
    numbered = rows.withColumn("_o_rn", F.row_number().over(order))
    joined = join_small(numbered, shift, [*by, "_o_hx"], null_safe=True)
    return joined.withColumn(name, (F.col("_o_at") + F.col("_o_rn") - 1 + F.lit(start)).cast("long")).drop("_o_hx", "_o_rn", "_o_at")
