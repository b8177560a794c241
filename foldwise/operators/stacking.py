"""Stacking tables and second-stage prediction.

The reference joins ten first-stage outputs left-deep on (text_id, full_text)
and renames columns by file position.  Here the outputs stay long with a
source number; one shuffle on the id groups each row's (source, values)
structs (at most one per file) and flattens them in source order into one
``features`` array.  Named wide columns are produced only at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ensemble import mean_folds
from foldwise.operators.oof import RidgeFolds, predict_ridge



# G1
def stack_table(outputs: DataFrame, id_col: str, inputs: Sequence[str], n_src: int,
                src: str = "src", truth: DataFrame | None = None, out: str = "features") -> DataFrame:
    """(id, features array<double>[, truth columns]): features ordered by
    (source, input).  Every id must have all ``n_src`` sources (the reference's
    inner join); ids missing a source are dropped and a duplicate source raises."""
    inputs = list(inputs)
    packed = outputs.select(id_col, F.col(src).cast("int").alias("_s"),
                            F.array(*[F.col(c).cast("double") for c in inputs]).alias("_v"))
    g = packed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_s", "_v"))).alias("_l"))
    srcs = F.transform("_l", lambda x: x["_s"])
    g = g.filter(F.size(F.array_distinct(srcs)) == n_src)
    feats = F.flatten(F.transform("_l", lambda x: x["_v"]))
    want = len(inputs) * n_src
    checked = F.when(F.size(feats) == want, feats).otherwise(
        F.raise_error(F.lit(f"stack_table: feature width is not {want} (duplicate source?)")))
    table = g.select(id_col, checked.alias(out))
    if truth is not None:
        table = table.join(truth, id_col)
    return table


def feature_names(inputs: Sequence[str], n_src: int, pattern: str = "{input}_label_{src}") -> list[str]:
    """Names of the flattened features in order, e.g. ``cohesion_label_3``."""
    return [pattern.format(input=c, src=s) for s in range(n_src) for c in inputs]


def stack_wide(table: DataFrame, inputs: Sequence[str], n_src: int, features: str = "features") -> DataFrame:
    """The reference's wide stacking table: one named column per feature."""
    names = feature_names(inputs, n_src)
    return table.select(*[c for c in table.columns if c != features],
                        *[F.col(features)[i].alias(n) for i, n in enumerate(names)])


# G2
def stack_predict(table: DataFrame, model: RidgeFolds, id_col: str, features: str = "features",
                  on_missing: str = "null") -> DataFrame:
    """Score every row with all k fold models in one pass and average them:
    long (id, target, pred)."""
    scored = predict_ridge(table, model, id_col, features, fold=None, keep_y=False)
    return mean_folds(scored, id_col, "target", "pred", on_missing=on_missing)



