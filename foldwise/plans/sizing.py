"""Partition counts and small-side joins.

Broadcast is only forced when the caller passes a proven row bound (for
example ``k`` folds or a weight matrix of known shape).  Tables whose size
follows the data (statistics per group, per partition) are joined plainly and
left to adaptive execution, which measures their real size at run time and
broadcasts them only below ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest row bound for which a hinted broadcast is accepted.
MAX_BROADCAST_ROWS = 1_000_000


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               null_safe: bool = False, bound: int | None = None) -> DataFrame:
    """Join ``big`` to a statistics table ``small`` on column names ``on``.

    ``bound``: a proven upper bound of ``small``'s row count; below
    :data:`MAX_BROADCAST_ROWS` the small side is broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    if bound is not None and bound <= MAX_BROADCAST_ROWS:
        small = F.broadcast(small)
    if not null_safe:
        return big.join(small, on, how)
    ren = {c: f"_r_{c}" for c in on}
    right = small.withColumnsRenamed(ren)
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(ren[c])) for c in on])
    return big.join(right, cond, how).drop(*ren.values())
