"""Quoted CSV by byte ranges equals the single-task read."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.plans.scratch import scratch_dir
from foldwise.sources import files as S
from foldwise.sources import split_csv as C

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())])


def field(rng):
    t = "".join(rng.choices(["x", ",", '""', "\n", "é", " ", "\r\n", "long words "], k=rng.randint(0, 9)))
    return f'"{t}"' if any(c in t for c in ',"\n\r') or rng.random() < 0.3 else t


def written_file(folder, name, seed, end="\n", last=True, rows=60):
    rng = random.Random(seed)
    lines = ['a,"b",c', *(f"{i}{field(rng)[:0]},{field(rng)},{rng.randint(0, 99) / 4}" for i in range(rows))]
    lines.insert(3, "")
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(end.join(lines) + (end if last else ""))
    return path


@pytest.mark.parametrize("size", [16, 23, 64, 257, 1 << 20])
def test_ranges_equal_the_single_task_read(spark, tmp_path, size):
    paths = [written_file(tmp_path, f"f{s}.csv", s, end, last) for s, (end, last) in enumerate([("\n", True), ("\n", False), ("\r\n", True)])]
    paths.append(str(tmp_path / "quotes.csv"))
    with open(paths[-1], "w", newline="") as f:                     # records far longer than a range, and a header in quotes
        f.write('"a\nA","b ""B""",c\n1,"' + '""\n,' * 200 + '",2\n2,"\n\n\n",3\n3,"""",4')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    single = spark.read.schema(SCHEMA).options(**S.CSV_OPTIONS).csv(paths)
    def shown(df):                                 # Spark's reader makes CRLF to LF within quotes where lines end in CRLF
        return sorted(repr(r).replace("\\r\\n", "\\n") for r in df.collect())

    want = shown(single)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = C.read_csv(spark, paths, SCHEMA, S.CSV_OPTIONS)
        rows = shown(got)
        if size < 300:
            assert spark.read.text(paths).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == len(want) and rows == want


def test_essays_round_trip_in_ranges(spark):
    rows = [(str(i), ('He said "no",\nthen left.\n\n' * (i % 5)) or None, *[1.0 + i % 3] * 6) for i in range(300)]
    df = spark.createDataFrame(rows, S.essay_schema())
    path = scratch_dir(spark) + "/essays.csv"
    S.write_table(df.repartition(2), path, fmt="csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
        got = S.read_essays(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)
    empty = scratch_dir(spark) + "/none.csv"
    S.write_table(df.limit(0), empty, fmt="csv")
    assert S.read_essays(spark, empty).count() == 0
