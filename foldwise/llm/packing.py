"""Operator 11: packing of documents into sequences by bulk-synchronous best-fit.

Documents are encoded, ended by one id and cut into pieces of at most
``capacity`` tokens.  Pieces of one length are interchangeable, so they move as
runs (a length, the first rank in it, how many), and so do the gaps that
sequences have left (a size, the first sequence, how many).

A round sorts items and gaps by size into ranges and sweeps each range from large
to small: an item run takes its successors, the smallest gaps that hold it, as
many pieces to a gap as fit.  Where several runs want a gap, the one of higher
rank (longer, then of smaller first rank) has it, and each gap takes pieces of one
length in a round.  Item runs that found no gap in their range meet the gaps left
over in the ranges above in a second sweep.  Then the gaps are updated and the
next round begins.

Lengths come in classes that halve, so long pieces settle first.  When no gap
holds a run, as many sequences are opened as its tokens need at least (one for
each piece above half the capacity).  The rounds' tables hold runs, not
documents: their size follows the number of different lengths, which the capacity
bounds, at any number of documents.  Documents meet the runs once at the end, by
length and rank.

Defined results: a null text is an empty one (the end id alone); a null id is kept
and ordered first; rows that share an id are documents of their own; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from foldwise.llm import bpe
from foldwise.llm.common import columns_of, partitions, rows_out, saved, small_batches, worker_cache
from foldwise.plans.scratch import scratch_dir

#: Tokens of a sequence, and the id that ends a document, unless a caller says otherwise.
CAPACITY, END = 2048, 0
#: Lengths above these shares of the capacity settle before shorter ones.
CLASSES = (1 / 2, 1 / 4, 1 / 8, 0)
#: Runs that one task sweeps, ranges whose leftovers meet in one task.
RUNS, FAN = 1024, 8
#: Pieces of a run that are written out at a time.
CHUNK = 1 << 14

GAP, ITEM, PLACED, UPDATED = range(4)
STATE = "kind int, size long, first long, n long, bin long, per long, at long, part int"
_STATE = pa.schema([("kind", pa.int32()), ("size", pa.int64()), ("first", pa.int64()), ("n", pa.int64()),
                    ("bin", pa.int64()), ("per", pa.int64()), ("at", pa.int64()), ("part", pa.int32())])
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- pieces ----

@worker_cache
def _encode(vocabulary_file: str):
    """Text -> ids as a numpy array.  The vocabulary's merges are made in the order
    of their ids, so a rank-based encoder gives the same ids several times faster."""
    import tiktoken
    v = bpe.Vocabulary(SparkFiles.get(vocabulary_file))
    ranks = {b: i for i, b in v.bytes_of.items() if i not in v.added.values()}
    made = [i for _, i in sorted(v.merges.values())]
    if made != sorted(made):
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(SparkFiles.get(vocabulary_file))
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    fast = tiktoken.Encoding(vocabulary_file, pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens=v.added)
    return lambda text: fast.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end: int = END, with_ids: bool = False) -> DataFrame:
    """Every document's pieces: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, if asked for, ``ids``.  All but the first are full."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encode(name)
        for b in small_batches(batches, "text", 4 << 20):
            out: tuple[list, ...] = tuple([] for _ in schema)
            for doc, t in zip(*columns_of(b, "doc_id", "text")):
                ids = np.append(encode(t or ""), end).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    row = (doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), ids[i:j].astype(np.int32))
                    for col, x in zip(out, row):
                        col.append(x)
            yield rows_out(schema, *out)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


# ---- rounds ----

def sweep(rows: list[tuple], capacity: int) -> Iterator[tuple]:
    """One sweep over gaps and items in descending size, gaps first: (kind, size,
    first, n, bin, per, at) of the placed runs, the updated gaps and what is left over.

    The gaps that hold the next item stand on a stack, the smallest on top."""
    open_gaps: list[list[int]] = []
    for kind, size, first, n in rows:
        if kind == GAP:
            open_gaps.append([size, first, n])
            continue
        while n and open_gaps:
            gap, bin_, m = open_gaps[-1]
            per = min(gap // size, n)
            bins = min(m, n // per)
            yield PLACED, size, first, bins * per, bin_, per, capacity - gap
            if gap > per * size:
                yield UPDATED, gap - per * size, bin_, bins, 0, 0, 0
            first, n = first + bins * per, n - bins * per
            if bins == m:
                open_gaps.pop()
            else:
                open_gaps[-1][1:] = [bin_ + bins, m - bins]
        if n:
            yield ITEM, size, first, n, 0, 0, 0
    for size, first, n in open_gaps:
        yield GAP, size, first, n, 0, 0, 0


def _by_range(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = [r for b in batches for r in zip(*columns_of(b, "kind", "size", "first", "n"))]
        out = [(*r, part) for r in sweep(rows, capacity)]
        if out:
            yield rows_out(_STATE, *zip(*out))
    return run


def round_of(state: DataFrame, runs: int, capacity: int) -> DataFrame:
    """One round over gap and item runs: sweeps by ranges of size, then the
    leftovers of the ranges, a fan of them at a time."""
    order = [F.desc("size"), "kind", "first"]
    ranges = -(-runs // RUNS)
    # a single range needs no shuffle; its task reads the few files of the last round
    dealt = state.repartitionByRange(ranges, *order) if ranges > 1 else state.coalesce(1)
    out = dealt.sortWithinPartitions(*order).mapInArrow(_by_range(capacity), STATE)
    left = F.col("kind").isin(GAP, ITEM)
    while ranges > 1:
        if ranges > FAN:                                 # leftovers go by their fan of ranges, settled runs pass through
            ranges = -(-ranges // FAN)
            out = (out.withColumn("part", F.when(left, F.floor(F.col("part") / FAN).cast("int")).otherwise(F.col("part")))
                   .repartition(ranges, F.when(left, F.col("part")).otherwise(0)))
        else:
            ranges = 1
            out = out.withColumn("part", F.lit(0)).repartition(1)
        out = out.sortWithinPartitions("part", *order).mapInArrow(_by_fan(capacity), STATE)
    return out


def _by_fan(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fans: dict[int, list[tuple]] = {}
        out = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] in (GAP, ITEM):
                    fans.setdefault(r[-1], []).append(r[:4])
                else:
                    out.append(r)
        for fan, rows in fans.items():
            out += [(*r, fan) for r in sweep(rows, capacity)]
        if out:
            yield rows_out(_STATE, *zip(*out))
    return run


def fitted(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places of all pieces from the number of pieces ``n`` of each ``length``
    (all below the capacity), as runs: piece ``first + i`` of length ``size``, for i
    below ``n``, is number i % ``per`` in sequence ``bin + i // per``, from ``at`` on."""
    spark = lengths.sparkSession

    def runs_of(df: DataFrame, kind: int, size, first, n) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return df.select(F.lit(kind).alias("kind"), size.alias("size"), first.alias("first"), n.alias("n"),
                         zero.alias("bin"), zero.alias("per"), zero.alias("at"), F.lit(0).alias("part"))

    items = saved(runs_of(lengths, ITEM, F.col("length"), F.lit(0).cast("bigint"), F.col("n")))
    folder, paths = scratch_dir(spark), []
    gaps, n_gaps, widest, opened, high = None, 0, 0, 0, capacity
    is_gap = F.col("kind").isin(GAP, UPDATED)
    for share in CLASSES:
        low = int(capacity * share)
        left = items.where((F.col("size") > low) & (F.col("size") <= high))
        high = low
        while True:
            stuck = F.col("size") > widest                   # no gap holds these
            need = left.agg(F.count("*").alias("runs"), F.sum(F.when(stuck, F.col("n"))).alias("pieces"),
                            F.sum(F.when(stuck, F.col("size") * F.col("n"))).alias("tokens")).first()
            if not need.runs:
                break
            state = left if gaps is None else left.unionByName(gaps)
            if need.pieces:
                more = need.pieces if 2 * low >= capacity else -(-need.tokens // capacity)
                state = state.unionByName(runs_of(spark.range(1), GAP, *(F.lit(x).cast("bigint") for x in (capacity, opened, more))))
                opened, n_gaps = opened + more, n_gaps + 1
            seen, path = Observation(), f"{folder}/{len(paths)}"
            (round_of(state, need.runs + n_gaps, capacity)
             .observe(seen, F.max(F.when(is_gap, F.col("size"))).alias("widest"), F.count(F.when(is_gap, 1)).alias("gaps"))
             .write.parquet(path))
            paths.append(path)
            widest, n_gaps = seen.get["widest"] or 0, seen.get["gaps"]
            done = spark.read.schema(STATE).parquet(path)
            left, gaps = done.where(F.col("kind") == ITEM), done.where(is_gap).withColumn("kind", F.lit(GAP))
    placed = spark.read.schema(STATE).parquet(*paths) if paths else items
    return placed.where(F.col("kind") == PLACED).select("size", "first", "n", "bin", "per", "at")


# ---- documents ----

def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs``, each with its sequence (``sequence_id``) and place
    there (``offset``); full pieces are sequences of their own, numbered below zero."""
    cut = saved(pieces(docs, vocabulary, id_col, text, capacity, end, with_ids))
    deal = 2 * partitions(docs.sparkSession)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)).cast("int")
    rows = cut.withColumn("_bucket", bucket)
    totals = rows.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("length").alias("_length"), F.col("_bucket").alias("_of"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (rows.withColumn("_rank", F.row_number().over(inside) - 1)
              .join(base, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_of")))
              .withColumn("_rank", F.col("_rank") + F.col("_base")).drop("_bucket", "_length", "_of", "_base"))
    placed = fitted(totals.where(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")), capacity)
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("k")
    each = (placed.select("*", chunk)
            .select("*", F.explode(F.sequence(F.col("k") * CHUNK, F.least(F.col("n"), (F.col("k") + 1) * CHUNK) - 1)).alias("i"))
            .select(F.col("size").alias("_size"), (F.col("first") + F.col("i")).alias("_place"),
                    (F.col("bin") + F.floor(F.col("i") / F.col("per"))).cast("bigint").alias("sequence_id"),
                    (F.col("at") + F.col("i") % F.col("per") * F.col("size")).alias("offset")))
    short = ranked.where(F.col("length") < capacity).join(each, (F.col("length") == F.col("_size")) & (F.col("_rank") == F.col("_place")))
    full = ranked.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("_rank"), "offset": F.lit(0).cast("bigint")})
    return short.drop("_rank", "_size", "_place").unionByName(full.drop("_rank"))


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from :func:`pack` ``(with_ids=True)``: at most
    ``capacity`` ids and the places where documents begin (``starts``)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("starts"), F.col("p.doc_id").alias("doc_ids")))
