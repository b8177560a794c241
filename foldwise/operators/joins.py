"""Joins and unions.

Identity is always a key column; positional pairing of tables is never
reproduced.  Wide N-way merges are better written as one long union plus a
grouped array (see :mod:`foldwise.operators.stacking`); ``join_all`` keeps
the left-deep chain for callers that need the wide shape.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _on(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


# J1
def join_outputs(a: DataFrame, b: DataFrame, on, how: str = "inner",
                 null_safe: bool = False) -> DataFrame:
    """Equi-join on ``on``; ``null_safe`` matches null keys to null keys."""
    on = _on(on)
    if not null_safe:
        return a.join(b, on, how)
    ren = {c: f"_rk_{c}" for c in on}
    r = b.withColumnsRenamed(ren)
    cond = reduce(lambda x, y: x & y, [a[c].eqNullSafe(r[ren[c]]) for c in on])
    out = a.join(r, cond, how)
    if how in ("right", "right_outer", "full", "full_outer", "outer"):
        out = out.withColumns({c: F.coalesce(a[c], r[ren[c]]) for c in on})
    return out.drop(*ren.values())


# J3 / J2
def join_all(dfs: Sequence[DataFrame], on, drop_right: Sequence[str] = (),
             how: str = "inner") -> DataFrame:
    """Left-deep chain of :func:`join_outputs`; ``drop_right`` columns are removed
    from every input after the first before its join (collision policy J3)."""
    dfs = list(dfs)
    out = dfs[0]
    for d in dfs[1:]:
        out = join_outputs(out, d.drop(*drop_right), on, how)
    return out


# J4
def join_suffixed(a: DataFrame, b: DataFrame, on, suffixes=("_x", "_y"),
                  restore_left: bool = True) -> DataFrame:
    """Join with overlapping non-key columns renamed ``c_x`` / ``c_y``;
    with ``restore_left`` the ``_x`` names go back to the base name.
    Raises if a produced name already exists."""
    on = _on(on)
    overlap = [c for c in a.columns if c in b.columns and c not in on]
    sx, sy = suffixes
    la = {c: c + sx for c in overlap}
    rb = {c: c + sy for c in overlap}
    for new in list(la.values()) + list(rb.values()):
        if new in a.columns or new in b.columns:
            raise ValueError(f"join_suffixed: column {new!r} already exists")
    out = a.withColumnsRenamed(la).join(b.withColumnsRenamed(rb), on, "inner")
    if restore_left and overlap:
        out = out.withColumnsRenamed({c + sx: c for c in overlap})
    return out


# J5
def attach(rows: DataFrame, preds: DataFrame, on, how: str = "left",
           check_counts: bool = False) -> DataFrame:
    """Pair rows with their predictions by key (never by position)."""
    out = rows.join(preds, _on(on), how)
    if check_counts:
        n_rows, n_preds = rows.count(), preds.count()
        if n_rows != n_preds:
            raise ValueError(f"attach: {n_rows} rows but {n_preds} predictions")
    return out


# J6
def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys occurring more than once, with their count."""
    return df.groupBy(*_on(keys)).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def assert_unique(df: DataFrame, keys) -> DataFrame:
    """Raise (eagerly) if ``keys`` are not unique; returns ``df`` unchanged."""
    dup = duplicate_keys(df, keys).limit(1).collect()
    if dup:
        raise ValueError(f"assert_unique: duplicate key {dup[0].asDict()}")
    return df


# U1
def union_all(dfs: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    """Bag union by column name; missing columns become null."""
    dfs = list(dfs)
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=allow_missing), dfs)
