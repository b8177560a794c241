"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that the text contracts delete or split at (fixed values).
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string")) % n


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: cuts lineage,
    and a lost executor costs only a reread."""
    from foldwise.sources.files import scratch_dir
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_shuffles_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark deletes the shuffle files of plans that nothing
    refers to any more, such as those of tables that were ``saved``, only when it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch where rows hold whole texts.
WIDE_ROWS = 1000


def wide_rows(spark: SparkSession) -> None:
    """Arrow batches of few rows for this session: Spark's default of 10,000 is meant for
    narrow rows, and the buffers of batches of documents stand beside the executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > WIDE_ROWS:
        spark.conf.set(name, WIDE_ROWS)


def columns_of(batch: pa.RecordBatch, *names: str) -> tuple[list, ...]:
    return tuple(batch.column(n).to_pylist() for n in names)


def rows_out(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
                                       for c, f in zip(cols, schema)], schema=schema)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``; one row
    is the least, so one very long text makes a batch of its own."""
    for b in batches:
        col = b.column(column)
        n, size = b.num_rows, col.nbytes
        step = max(1, n * most_bytes // max(size, 1)) if size > most_bytes else max(n, 1)
        for i in range(0, n, step):
            yield b.slice(i, min(step, n - i))


_CACHES: list = []


def let_go(keep: str = "") -> None:
    """Empties the worker's caches of all modules but ``keep``: Python workers serve
    the stages of a job one after the other, and hold the caches of one operator only."""
    filled = [c for c in _CACHES if c.__wrapped__.__module__ != keep and c.cache_info().currsize]
    for c in filled:
        c.cache_clear()
    if filled:
        pa.default_memory_pool().release_unused()


def worker_cache(fn: Callable) -> Callable:
    """``fn`` with its last result kept in the worker until another module's cache is used."""
    cached = lru_cache(1)(fn)
    _CACHES.append(cached)

    @wraps(fn)
    def call(*args):
        let_go(fn.__module__)
        return cached(*args)

    return call
