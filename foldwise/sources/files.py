"""File sources and sinks.

CSV files carry quoted multi-line text: read and write with ``multiLine`` and
``escape='"'`` or a text with a newline comes back as several rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.constants import TARGETS
from foldwise.operators.columns import with_ordinal as _number_rows
from foldwise.plans.scratch import scratch_dir, written
from foldwise.sources.split_csv import read_csv

# white space at the ends of a text stays (Spark's writer drops it unless told so)
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def essay_schema(targets: Sequence[str] = TARGETS, with_fold: bool = False) -> T.StructType:
    fields = [T.StructField("text_id", T.StringType()), T.StructField("full_text", T.StringType())]
    fields += [T.StructField(t, T.DoubleType()) for t in targets]
    if with_fold:
        fields.append(T.StructField("fold", T.IntegerType()))
    return T.StructType(fields)


# S1
def read_essays(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header and quoted multi-line text, typed by ``schema`` (no inference).
    A file is read by byte ranges, so one large file spreads over many tasks."""
    return read_csv(spark, path, schema or essay_schema(), CSV_OPTIONS)


# S2 / S3
def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Parquet for ``.pq`` / ``.parquet`` (or ``fmt='parquet'``), else CSV."""
    if fmt is None:
        fmt = "parquet" if path.rstrip("/").endswith((".pq", ".parquet")) else "csv"
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = spark.read.options(**CSV_OPTIONS)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path)


# S4
def read_tagged(spark: SparkSession, paths: Sequence[str], fmt: str | None = None,
                schema: T.StructType | None = None, tag: str = "src") -> DataFrame:
    """One scan over several files; each row is tagged with the position of its
    file in ``paths`` (the reference encodes it as a column suffix).  The tag
    comes from the scan's file path (``_metadata.file_path``) matched against
    the path list: a file path itself, or a folder followed by ``/``; the
    longest matching entry wins (``out/a`` does not claim ``out/ab``)."""
    paths = list(paths)
    fmt = fmt or ("parquet" if paths[0].rstrip("/").endswith((".pq", ".parquet")) else "csv")
    reader = spark.read.options(**CSV_OPTIONS) if fmt == "csv" else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    df = reader.format(fmt).load(paths)
    # both sides as plain paths: no scheme or authority, %xx escapes decoded
    found = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    idx = F.lit(None).cast("int")
    cleaned = [(i, re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", p).rstrip("/")) for i, p in enumerate(paths)]
    for i, c in sorted(cleaned, key=lambda ic: len(ic[1])):     # longer paths checked last win
        if c.startswith("/"):
            hit = (found == c) | F.startswith(found, F.lit(c + "/"))
        else:                                                   # relative: below the working directory
            hit = F.endswith(found, F.lit("/" + c)) | (F.instr(found, F.lit("/" + c + "/")) > 0)
        idx = F.when(hit, F.lit(i)).otherwise(idx)
    return df.withColumn(tag, F.coalesce(idx, F.raise_error(F.lit("read_tagged: unknown file")).cast("int")))


# S5 / S6
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                with_ordinal: bool = False, order_by: Sequence[str] = (),
                partition_by: Sequence[str] = ()) -> None:
    """Write Parquet (default) or CSV with header and no index.  With
    ``with_ordinal`` a leading unnamed column holds the 0-based row ordinal in
    ``order_by`` order (the reference's CSV index column)."""
    out = df
    if with_ordinal:
        if not order_by:
            raise ValueError("write_table: with_ordinal needs order_by")
        out = _number_rows(df, list(order_by), name="_c0")
        out = out.select("_c0", *df.columns).withColumnRenamed("_c0", "")
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.parquet(path)


# S7
def write_folds(df: DataFrame, path: str, fold: str = "fold") -> None:
    """Persist a fold assignment laid out by fold, so later ``fold`` filters
    prune whole directories (``PartitionFilters`` in the scan)."""
    df.write.mode("overwrite").partitionBy(fold).parquet(path)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


# S8
def run_missing(spark: SparkSession, keys: DataFrame, out_path: str,
                fn: Callable[[DataFrame], DataFrame], key_cols: Sequence[str]) -> DataFrame:
    """Resume: process only the keys with no result in ``out_path``.

    ``keys``: wanted work units.  Finished units are read from the output's
    partition columns; the rest go through ``fn(missing_keys)``, whose result
    is appended partitioned by the key columns (dynamic partition overwrite,
    so a unit is replaced whole).  Returns the missing keys that were run."""
    key_cols = list(key_cols)
    # the keys' own types, not inferred ones: "1" and "01" are two units
    schema = T.StructType([T.StructField(c, keys.schema[c].dataType) for c in key_cols])
    missing = keys
    if _exists(spark, out_path):
        done = spark.read.schema(schema).parquet(out_path).select(*key_cols).distinct()
        missing = keys.join(done, key_cols, "left_anti")
    # The output is read (finished keys) and then overwritten: the missing
    # keys are written to shared scratch storage first, which cuts their
    # lineage to the output (nothing passes through the driver).
    missing = written(missing)
    if missing.isEmpty():
        return missing
    result = fn(missing)
    (result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(*key_cols).parquet(out_path))
    return missing
