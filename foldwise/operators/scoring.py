"""Batch scoring with supplied models (B1, B2).

``model_fn(payload)`` turns a model payload (weights, a serialised model)
into a function ``predict(X: ndarray) -> ndarray (n x outputs)``.  The payload
is broadcast once; each task builds the predictor once and streams Arrow
batches through it.  B2 applies all k fold models in the same pass, where the
reference scans the data k times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _score(df: DataFrame, payloads: Sequence, model_fn: Callable, id_col: str, features: str,
           outputs: Sequence[str], fold_numbers: Sequence[int]) -> DataFrame:
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(list(payloads))
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, fold int, target string, pred double"
    outs = list(outputs)
    nums = list(fold_numbers)

    def run(batches):
        models = [model_fn(p) for p in bc.value]        # once per task
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.stack(pdf[features].to_numpy()).astype(float)
            ids = pdf[id_col].to_numpy()
            pieces = []
            for f, m in zip(nums, models):
                P = np.asarray(m(X), dtype=float).reshape(len(X), len(outs))
                for j, t in enumerate(outs):
                    pieces.append(pd.DataFrame({id_col: ids, "fold": f, "target": t, "pred": P[:, j]}))
            yield pd.concat(pieces, ignore_index=True)

    return df.select(id_col, features).mapInPandas(run, schema)


# B1
def score(df: DataFrame, payload, model_fn: Callable, id_col: str, features: str,
          outputs: Sequence[str]) -> DataFrame:
    """One model: long (id, fold=0, target, pred)."""
    return _score(df, [payload], model_fn, id_col, features, outputs, [0])


# B2
def score_folds(df: DataFrame, payloads: Sequence, model_fn: Callable, id_col: str, features: str,
                outputs: Sequence[str]) -> DataFrame:
    """k fold models over the same rows in one pass: long (id, fold, target, pred)."""
    return _score(df, payloads, model_fn, id_col, features, outputs, range(len(payloads)))


def linear_model(payload):
    """Model builder for a supplied linear head: payload = (W (d x o), b (o))."""
    W, b = (np.asarray(x, dtype=float) for x in payload)
    return lambda X: X @ W + b
