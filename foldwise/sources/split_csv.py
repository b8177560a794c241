"""CSV with quoted multi-line text read by byte ranges.

Spark splits a text file into byte ranges at line feeds; whether a line feed ends a
record depends on the quotes before it.  A first scan gives for every range the parity
of its quotes, and under either parity at its start the piece of a record that it begins
with and the one it leaves open.  The running parity of the ranges before tells which holds.
A second scan, with the parity known, puts the records together that lie within a range;
the pieces of the others meet by file and record.  Records are parsed by Spark's own CSV
parser.  So one large file is read by as many tasks as it has ranges.

Defined results: those of ``spark.read`` with ``multiLine`` and ``escape='"'`` for files
whose quotes stand around fields, doubled inside them; empty lines are no records; the
first record of each file is its header.  Line ends within quotes stay as they are (Spark's
reader makes CRLF to LF there in files whose lines end in CRLF).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("parity", pa.int32()), ("begun", pa.string()), ("ended", pa.bool_()),
                   ("open0", pa.string()), ("open1", pa.string()), ("whole", pa.bool_())])
RANGE_SQL = "file string, block long, parity int, begun string, ended boolean, open0 string, open1 string, whole boolean"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of a batch by (file, block), which change seldom."""
    n = batch.num_rows
    if not n:
        return
    file, block = batch.column("file"), batch.column("block")
    code = pc.dictionary_encode(file).indices.to_numpy()
    at = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block.to_numpy(), prepend=-1) != 0))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), n]):
        yield file[a].as_py(), block[a].as_py(), batch.slice(a, b - a)


def _odd(lines: pa.Array) -> np.ndarray:
    """Whether each line has an odd number of quotes."""
    return pc.count_substring(lines, '"').to_numpy() & 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: its parity; up to its first record end under parity 1
    (``begun``, and whether there is an end); what it leaves open under parity 0
    and 1; whether that under 0 is its first record."""
    now, rows = None, []
    parity, begun, ended, left = 0, [], False, ([], [])
    whole = True

    def row() -> tuple:
        return (*now, parity, "\n".join(begun), ended, *("\n".join(x) for x in left), whole)

    for b in batches:
        for file, block, part in _runs(b):
            if (file, block) != now:
                if now is not None:
                    rows.append(row())
                now = file, block
                parity, begun, ended, left, whole = 0, [], False, ([], []), True
            lines = part.column("value").to_pylist()
            after = (parity + np.cumsum(_odd(part.column("value")))) & 1
            if not ended:
                first = np.flatnonzero(after == 1)
                ended = bool(len(first))
                begun.extend(lines[:first[0] + 1] if ended else lines)
            for h in (0, 1):
                ends = np.flatnonzero(after == h)
                if len(ends):
                    left[h].clear()
                    whole = whole and h == 1
                    left[h].extend(lines[ends[-1] + 1:])
                else:
                    left[h].extend(lines)
            parity = int(after[-1])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RANGE)], schema=RANGE)
            rows = []
    if now is not None:
        rows.append(row())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RANGE)], schema=RANGE)


def _inner_records(header: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records that begin and end in a range."""
        now, parity, waiting, skipping, first = None, 0, [], False, False
        for b in batches:
            out: list[str] = []
            for file, block, part in _runs(b):
                if (file, block) != now:
                    now, parity, waiting = (file, block), part.column("before")[0].as_py(), []
                    skipping, first = parity == 1, header and block == 0
                lines = part.column("value").to_pylist()
                after = (parity + np.cumsum(_odd(part.column("value")))) & 1
                at = 0
                for e in np.flatnonzero(after == 0).tolist():
                    record = lines[at] if at == e and not waiting else "\n".join([*waiting, *lines[at:e + 1]])
                    waiting, at = [], e + 1
                    if skipping:                     # the end of a record that began before the range
                        skipping = False
                    elif record.rstrip("\r"):
                        if first:
                            first = False
                        else:
                            out.append(record)
                waiting += lines[at:]
                parity = int(after[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])
    return run


def records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """The records of CSV files, as text (``record``), without their headers."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ranges = lines.mapInArrow(_summaries, RANGE_SQL)
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("parity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    ranges = ranges.withColumn("before", before.cast("int"))

    # pieces of records that cross ranges: (place 0) what a range begins with, (1) what it leaves open
    middle = (F.col("before") == 1) & ~F.col("ended")
    leaves = ((F.col("before") + F.col("parity")) % 2 == 1) & ~middle
    pieces = ranges.select("file", "block", F.explode(F.array(
        F.struct(F.lit(0).alias("place"), (F.col("before") == 1).alias("real"), F.lit(0).alias("opens"), F.col("begun").alias("text"), F.lit(False).alias("heads")),
        F.struct(F.lit(1).alias("place"), leaves.alias("real"), F.lit(1).alias("opens"),
                 F.when(F.col("before") == 0, F.col("open0")).otherwise(F.col("open1")).alias("text"),
                 ((F.col("block") == 0) & F.col("whole")).alias("heads")))).alias("p")).select("file", "block", "p.*").where("real")
    number = F.sum("opens").over(Window.partitionBy("file").orderBy("block", "place"))
    crossing = (pieces.withColumn("number", number).groupBy("file", "number")
                .agg(F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("l"), F.max("heads").alias("heads")))
    crossing = crossing.where(~F.col("heads")) if header else crossing
    crossing = crossing.select(F.concat_ws("\n", F.col("l.text")).alias("record"))

    # the range's parity meets its lines; the sort keeps their order whichever join Spark takes
    known = ranges.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "before")
    told = (lines.withColumn("seq", F.monotonically_increasing_id())
            .join(known, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
            .select("file", "block", "seq", "value", "before").sortWithinPartitions("file", "block", "seq"))
    return told.mapInArrow(_inner_records(header), "record string").unionByName(crossing)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict[str, str], header: bool = True) -> DataFrame:
    """The files' rows, typed by ``schema`` (columns by position)."""
    text = F.regexp_replace("record", "\r\\z", "")
    parsed = records(spark, path, header).select(F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), options).alias("r"))
    return parsed.select(*(F.col("r").getField(f.name).alias(f.name) for f in schema.fields))
