import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.operators import monitor as R
from foldwise.plans import tables as T
from tests.conftest import SF01


def _log(spark, losses, run="r"):
    return spark.createDataFrame([(run, i, float(x)) for i, x in enumerate(losses)], "run string, step int, loss double")


def python_stop(losses, patience, delta=0.0):
    """Sequential reference semantics (NaN never improves)."""
    best, counter = None, 0
    for i, x in enumerate(losses):
        if math.isnan(x):
            counter += 1
        elif best is None or x <= best - delta:
            best, counter = x, 0
        else:
            counter += 1
        if counter >= patience:
            return i
    return None


CASES = [
    [5, 4, 4, 4, 4, 4, 3],            # equal losses reset the counter
    [5, 6, 7, 8, 9],                  # stops at 4 with patience 4
    [3, 2, 1],                        # never stops
    [5, float("nan"), float("nan"), 6, 7, 4],
    [float("nan"), 5, 6, 6, 6, 6],
    [1.0, 0.5, 0.45, 0.40, 0.39, 0.2, 0.25],
]


@pytest.mark.parametrize("losses", CASES)
@pytest.mark.parametrize("delta", [0.0, 0.05])
def test_early_stop_matches_sequential(spark, losses, delta):
    got = R.early_stop(_log(spark, losses), 4, delta=delta, bucket_rows=2).first()["stop_at"]
    assert got == python_stop(losses, 4, delta)


def test_improvement_exactly_delta(spark):
    losses = [1.0, 0.5, 0.75, 0.75, 0.75]
    assert R.early_stop(_log(spark, losses), 3, delta=0.25).first()["stop_at"] == 4
    assert python_stop(losses, 3, 0.25) == 4


def test_scans_with_small_buckets_equal_windows(spark):
    log = T.loss_log(spark, SF01)
    w = Window.partitionBy("run").orderBy("step")
    plain = log.select("run", "step",
                       F.avg("loss").over(w.rowsBetween(-9, 0)).alias("rm"),
                       F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("bb"))
    ours = R.running_best(R.rolling_mean(log, 10, bucket_rows=37), bucket_rows=53)
    j = plain.join(ours, ["run", "step"])
    bad = j.filter((F.abs(F.col("rm") - F.col("rolling_mean")) > 1e-9)
                   | ~F.col("bb").eqNullSafe(F.col("best_before"))).count()
    assert bad == 0 and j.count() == log.count()


def test_early_stop_buckets_agree(spark):
    log = T.loss_log(spark, SF01)
    for p in (4, 25):
        a = {r["run"]: r["stop_at"] for r in R.early_stop(log, p, bucket_rows=7).collect()}
        b = {r["run"]: r["stop_at"] for r in R.early_stop(log, p).collect()}
        assert a == b


def test_running_best_strict(spark):
    r = R.running_best(_log(spark, [3, 3, 2, 2])).orderBy("step").collect()
    assert [x["improved"] for x in r] == [True, False, True, False]
    assert R.best_epoch(_log(spark, [3, 2, 5, 2])).first()["best_step"] == 1


def test_effective_log_and_summary(spark):
    log = _log(spark, [5, 6, 7, 8, 9, 1])
    assert R.effective_log(log, 2).count() == 3
    s = R.run_summary(log, 2, batch_size=4).first()
    assert s["stop_at"] == 2 and s["stopped"] and s["rows"] == 6 and s["batches"] == 2 and s["best_step"] == 5


def test_stream_matches_batch(spark, tmp_path):
    from foldwise.streaming.monitor import early_stop_stream, run_to_table
    log = T.loss_log(spark, SF01)
    for b in (2, 0, 1):
        log.filter(F.floor(F.col("step") / 700) == b).write.parquet(str(tmp_path / f"in/b={b}"))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
                   .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    run_to_table(early_stop_stream(stream, 25, delta=0.5), str(tmp_path / "out"), str(tmp_path / "chk"))
    st = spark.read.parquet(str(tmp_path / "out"))
    last = st.withColumn("rk", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("batch_id"))))
    got = {r["run"]: r["stop_at"] for r in last.filter("rk = 1").collect()}
    want = {r["run"]: r["stop_at"] for r in R.early_stop(log, 25, delta=0.5).collect()}
    assert got == want


@pytest.mark.parametrize("bucket_rows,fanout", [(3, 2), (5, 3), (1 << 20, 64)])
def test_delta_chain_matches_sequential_on_random_logs(spark, monkeypatch, bucket_rows, fanout):
    import random
    monkeypatch.setattr(R, "CHAIN_FANOUT", fanout)
    rnd = random.Random(7)
    runs = {}
    for r in range(12):
        n = rnd.randint(1, 60)
        xs, level = [], 1.0
        for _ in range(n):
            level += rnd.uniform(-0.12, 0.08)
            xs.append(float("nan") if rnd.random() < 0.1 else round(level, 2))
        runs[f"r{r}"] = xs
    rows = [(k, i, x) for k, xs in runs.items() for i, x in enumerate(xs)]
    log = spark.createDataFrame(rows, "run string, step int, loss double")
    for patience in (1, 3, 6):
        for delta in (0.02, 0.1):
            got = {r["run"]: r["stop_at"] for r in
                   R.early_stop(log, patience, delta=delta, bucket_rows=bucket_rows).collect()}
            want = {k: python_stop(xs, patience, delta) for k, xs in runs.items()}
            assert got == want, (patience, delta)


def test_stream_keeps_waiting_steps_without_an_object_each():
    import numpy as np
    import pandas as pd

    from foldwise.streaming.monitor import _stepper

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def feed(state, steps, losses):
        pdfs = [pd.DataFrame({"step": steps, "loss": np.array(losses, float)})]
        return next(iter(_stepper(2, 0.0)(("r",), iter(pdfs), state))).iloc[0]

    state = State()
    n = 1000
    assert feed(state, range(n, 0, -1), range(n, 0, -1))["next_step"] == 0
    waiting = state.get[4], state.get[5]
    assert all(isinstance(w, bytes) and len(w) == 8 * n for w in waiting)
    assert feed(state, [3, 1], [2.0, float("nan")])["next_step"] == 0      # the last of a step counts
    assert len(state.get[4]) == 8 * n
    last = feed(state, [0], [2.0])                                      # 2, nan, 2, 2, 4, 5
    assert (last["next_step"], last["best"], last["stop_at"], bool(last["stopped"])) == (6, 2.0, 5, True)
    assert state.get[4] == b"" and feed(state, [7], [0.0])["stop_at"] == 5
