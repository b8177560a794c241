"""Queries: training-log monitoring (R1-R6) and batching (K4-K6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import batching as B
from foldwise.operators import monitor as R
from foldwise.plans import oracle_views as V
from foldwise.plans import tables as T
from foldwise.plans.registry import register

_LOG = V.with_views(V.LOSS_LOG)
PATIENCE = 4
# Rows of a file of the replayed loss stream.
FILE_ROWS = 1 << 20


def _r(c, name=None):
    return F.round(c, 6).alias(name or c)


@register("r1_rolling_mean", _LOG + """
SELECT run, step, round(avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
       6) AS rolling_mean FROM loss_log""")
def r1_rolling_mean(spark, sf_dir):
    return R.rolling_mean(T.loss_log(spark, sf_dir), 10).select("run", "step", _r("rolling_mean"))


@register("r2_running_best", _LOG + """,
b AS (SELECT run, step, loss, min(loss) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM loss_log)
SELECT run, step, best_before, CASE WHEN best_before IS NULL OR loss < best_before THEN loss
       ELSE best_before END AS best, best_before IS NULL OR loss < best_before AS improved FROM b""")
def r2_running_best(spark, sf_dir):
    return R.running_best(T.loss_log(spark, sf_dir)).select("run", "step", "best_before", "best", "improved")


@register("r3_best_epoch", _LOG + """,
r AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS rk FROM loss_log)
SELECT run, step AS best_step, loss AS best_loss FROM r WHERE rk = 1""")
def r3_best_epoch(spark, sf_dir):
    return R.best_epoch(T.loss_log(spark, sf_dir)).select("run", F.col("best_step").cast("int"), "best_loss")


def _recursive_stop(patience: int, delta: float = 0.0) -> str:
    """Sequential early stopping as a recursive query (independent of the scans
    and of the improvement chain used with ``delta``)."""
    bar = "es.best" if delta == 0 else f"es.best - CAST({delta!r} AS DOUBLE)"
    return f"""WITH RECURSIVE {V.LOSS_LOG},
es(run, step, best, counter) AS (
  SELECT run, step, loss, 0 FROM loss_log WHERE step = 0
  UNION ALL
  SELECT l.run, l.step,
         CASE WHEN l.loss <= {bar} THEN l.loss ELSE es.best END,
         CASE WHEN l.loss <= {bar} THEN 0 ELSE es.counter + 1 END
  FROM es JOIN loss_log l ON l.run = es.run AND l.step = es.step + 1
  WHERE es.counter < {patience}),
stops AS (SELECT run, CAST(min(CASE WHEN counter >= {patience} THEN step END) AS INTEGER) AS stop_at
          FROM es GROUP BY run)
"""


@register("r4_early_stop", _recursive_stop(PATIENCE) + "SELECT run, stop_at FROM stops")
def r4_early_stop(spark, sf_dir):
    return R.early_stop(T.loss_log(spark, sf_dir), PATIENCE).select("run", F.col("stop_at").cast("int"))


@register("r4_early_stop_p25", _recursive_stop(25) + "SELECT run, stop_at FROM stops")
def r4_early_stop_p25(spark, sf_dir):
    return R.early_stop(T.loss_log(spark, sf_dir), 25).select("run", F.col("stop_at").cast("int"))


@register("r4_early_stop_delta", _recursive_stop(25, 0.5) + "SELECT run, stop_at FROM stops")
def r4_early_stop_delta(spark, sf_dir):
    """An improvement must beat the best by 0.5 (the path-dependent case)."""
    return R.early_stop(T.loss_log(spark, sf_dir), 25, delta=0.5).select("run", F.col("stop_at").cast("int"))


@register("r5_effective_log", _recursive_stop(PATIENCE) + """
SELECT l.run, l.step, l.loss FROM loss_log l JOIN stops s ON l.run = s.run
WHERE s.stop_at IS NULL OR l.step <= s.stop_at""")
def r5_effective_log(spark, sf_dir):
    return R.effective_log(T.loss_log(spark, sf_dir), PATIENCE).select("run", "step", "loss")


@register("r6_run_summary", _recursive_stop(PATIENCE) + """,
best AS (SELECT run, step, loss, row_number() OVER (PARTITION BY run ORDER BY loss, step) AS rk FROM loss_log),
agg AS (SELECT run, avg(loss) AS mean_loss, count(*) AS rows FROM loss_log GROUP BY run)
SELECT a.run, round(a.mean_loss, 6) AS mean_loss, a.rows, CAST(ceil(a.rows / 64) AS BIGINT) AS batches,
       b.step AS best_step, b.loss AS best_loss, s.stop_at, s.stop_at IS NOT NULL AS stopped
FROM agg a JOIN best b ON a.run = b.run AND b.rk = 1 JOIN stops s ON a.run = s.run""")
def r6_run_summary(spark, sf_dir):
    s = R.run_summary(T.loss_log(spark, sf_dir), PATIENCE, batch_size=64)
    return s.select("run", _r("mean_loss"), "rows", "batches", F.col("best_step").cast("int"), "best_loss",
                    F.col("stop_at").cast("int"), "stopped")


@register("k4_shuffle_order", """
SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '43', doc_id)), doc_id) - 1 AS ordinal
FROM documents""")
def k4_shuffle_order(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id")
    return B.shuffle(d, "doc_id", seed=42, epoch=1)


_BATCH_SQL = V.with_views(V.ESSAYS) + """,
o AS (SELECT text_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', text_id)), text_id) - 1 AS ordinal,
      count(*) OVER () AS n FROM essays)
"""


@register("k5_batches", _BATCH_SQL + "SELECT text_id, CAST(floor(ordinal / 8) AS BIGINT) AS batch FROM o")
def k5_batches(spark, sf_dir):
    e = B.shuffle(T.essays(spark, sf_dir).select("text_id"), "text_id", seed=42)
    return B.batches(e, 8, [], ordinal="ordinal").select("text_id", "batch")


@register("k5_batches_drop_last", _BATCH_SQL
          + "SELECT text_id, CAST(floor(ordinal / 24) AS BIGINT) AS batch FROM o "
            "WHERE ordinal < floor(n / 24) * 24")
def k5_batches_drop_last(spark, sf_dir):
    e = B.shuffle(T.essays(spark, sf_dir).select("text_id"), "text_id", seed=42)
    return B.batches(e, 24, [], drop_last=True, ordinal="ordinal").select("text_id", "batch")


@register("k5_batches_by_run", _LOG + """
SELECT run, step, CAST(floor(step / 64) AS BIGINT) AS batch FROM (
  SELECT *, count(*) OVER (PARTITION BY run) AS n FROM loss_log) WHERE step < floor(n / 64) * 64""")
def k5_batches_by_run(spark, sf_dir):
    log = T.loss_log(spark, sf_dir)
    return B.batches(log, 64, ["step"], drop_last=True, by=["run"]).select("run", "step", "batch")


@register("k6_batch_counts", _LOG + """
SELECT run, count(*) AS rows, CAST(floor(count(*) / 64) AS BIGINT) AS batches_drop,
       CAST(ceil(count(*) / 64) AS BIGINT) AS batches_keep FROM loss_log GROUP BY run""")
def k6_batch_counts(spark, sf_dir):
    log = T.loss_log(spark, sf_dir)
    a = B.batch_counts(log, 64, True, ["run"]).withColumnRenamed("batches", "batches_drop")
    b = B.batch_counts(log, 64, False, ["run"]).select("run", F.col("batches").alias("batches_keep"))
    return a.join(b, "run")


@register("r4_early_stop_stream", _recursive_stop(PATIENCE) + "SELECT run, stop_at FROM stops")
def r4_early_stop_stream(spark, sf_dir):
    """The loss log replayed as a file stream (one file per step block, blocks
    written newest first so steps arrive out of order) through the stateful
    streaming stopper; the last state of every run gives its stop step."""
    from pyspark.sql import Window

    from foldwise.plans.scratch import scratch_dir, written
    from foldwise.streaming.monitor import early_stop_stream, run_to_table
    base = scratch_dir(spark)
    log = written(T.loss_log(spark, sf_dir))        # the blocks read it once each
    blocks = 4
    files = -(-log.count() // (blocks * FILE_ROWS)) or 1    # by rows, so that micro-batches do not follow the cores
    for b in reversed(range(blocks)):
        (log.filter(F.floor(F.col("step") / 500) % blocks == b).coalesce(files).write.mode("overwrite")
            .parquet(f"{base}/in/block={b}"))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2)
                   .option("recursiveFileLookup", "true").parquet(f"{base}/in"))
    run_to_table(early_stop_stream(stream, PATIENCE), f"{base}/out", f"{base}/chk")
    states = spark.read.parquet(f"{base}/out")
    last = states.withColumn("_rk", F.row_number().over(
        Window.partitionBy("run").orderBy(F.col("batch_id").desc())))
    return last.filter("_rk = 1").select("run", F.col("stop_at").cast("int").alias("stop_at"))
