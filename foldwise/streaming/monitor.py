"""Early stopping over a loss stream (R4 as Structured Streaming).

The reference's stopper is called once per epoch as losses arrive.  Here the
losses of many runs arrive as a stream of (run, step, loss) rows; a stateful
``applyInPandasWithState`` keeps, per run, the best loss, the patience
counter and the stop step.  Steps may arrive out of order: steps ahead of
the next expected one wait in the state until the gap is filled, so the
result equals the batch operator on the same log.

Waiting steps and their losses are two binary fields (8 bytes a value, in step
order), which numpy reads in place and merges with the new rows: a micro-batch
makes no Python object per waiting step, only per step that it walks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import (BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

STATE = StructType([
    StructField("next_step", LongType()),
    StructField("best", DoubleType()),
    StructField("counter", IntegerType()),
    StructField("stop_at", LongType()),
    StructField("pending_steps", BinaryType()),
    StructField("pending_losses", BinaryType()),
])


def output_schema(run_type=StringType()) -> StructType:
    return StructType([
        StructField("run", run_type),
        StructField("next_step", LongType()),
        StructField("best", DoubleType()),
        StructField("counter", IntegerType()),
        StructField("stop_at", LongType()),
        StructField("stopped", BooleanType()),
    ])


# Losses walked at a time.
WALK = 1 << 16


def _merged(steps: list[np.ndarray], losses: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Steps in order with their losses; of a step that came more than once, the last."""
    s, x = np.concatenate(steps), np.concatenate(losses)
    order = np.argsort(s, kind="stable")
    s, x = s[order], x[order]
    last = np.append(s[1:] != s[:-1], True)[:len(s)]
    return s[last], x[last]


def _stepper(patience: int, delta: float):
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            nxt, best, counter, stop_at, ps, pl = state.get
        else:
            nxt, best, counter, stop_at, ps, pl = 0, None, 0, None, b"", b""
        steps, losses = [np.frombuffer(ps, np.int64)], [np.frombuffer(pl, float)]
        for pdf in pdfs:
            if stop_at is None:             # after a stop later epochs never ran
                s, x = pdf["step"].to_numpy(dtype=np.int64), pdf["loss"].to_numpy(dtype=float)
                steps.append(s[s >= nxt])
                losses.append(x[s >= nxt])
        s, x = _merged(steps, losses)
        gap = np.flatnonzero(s != nxt + np.arange(len(s)))
        ready = int(gap[0]) if len(gap) else len(s)
        for i in range(0, ready, WALK):
            for v in x[i:min(i + WALK, ready)].tolist():
                if v == v and (best is None or v <= best - delta):
                    best, counter = v, 0
                else:
                    counter += 1
                if counter >= patience:
                    stop_at = nxt
                nxt += 1
                if stop_at is not None:
                    break
            if stop_at is not None:
                ready = len(s)
                break
        state.update((nxt, best, counter, stop_at, s[ready:].tobytes(), x[ready:].tobytes()))
        yield pd.DataFrame([{"run": key[0], "next_step": nxt, "best": best, "counter": counter,
                             "stop_at": stop_at, "stopped": stop_at is not None}])
    return step


def early_stop_stream(stream: DataFrame, patience: int, delta: float = 0.0, run: str = "run",
                      step: str = "step", loss: str = "loss") -> DataFrame:
    """Streaming DataFrame of per-run stopper states (update mode)."""
    src = stream.select(stream[run].alias("run"), stream[step].cast("long").alias("step"),
                        stream[loss].cast("double").alias("loss"))
    return src.groupBy("run").applyInPandasWithState(
        _stepper(patience, delta), output_schema(stream.schema[run].dataType), STATE, "update",
        GroupStateTimeout.NoTimeout)


def run_to_table(states: DataFrame, out_path: str, checkpoint: str, trigger_available_now: bool = True):
    """Run the stopper stream to the end of the available input, writing every
    micro-batch's state rows to a Parquet table partitioned by ``batch_id``;
    returns the finished query.  A micro-batch replayed after a failure
    overwrites its own partition, so the table holds it once."""
    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (states.writeStream.outputMode("update").foreachBatch(sink)
               .option("checkpointLocation", checkpoint)
               .trigger(availableNow=trigger_available_now).start())
    q.awaitTermination()
    return q
