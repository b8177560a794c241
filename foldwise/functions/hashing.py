"""Deterministic, engine-independent pseudo-random keys.

``md5(seed ':' id)`` gives the same hex string in Spark and in DuckDB and does
not depend on partitioning, unlike ``rand(seed)`` or
``monotonically_increasing_id``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int, *cols) -> Column:
    """``md5(concat_ws(':', seed, c1, c2, ...))`` as a 32-char hex string."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def seeded_bucket(seed: int, n_hex: int, *cols) -> Column:
    """Leading ``n_hex`` hex digits of :func:`seeded_key` as an integer.

    Ordering by (bucket, key) equals ordering by key, so the bucket can split a
    hot group without changing its order.
    """
    return F.conv(F.substring(seeded_key(seed, *cols), 1, n_hex), 16, 10).cast("int")
