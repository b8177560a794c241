r"""Operator 13: fill-in-middle transformation by in-place block rotation.

A text is cut at line ends into prefix, middle and suffix.  All work happens in one
bytearray: the cuts are found by a scan for line feeds, the sentinels are inserted,
which gives ``<P>`` prefix ``<M>`` middle ``<S>`` suffix, and neighbouring blocks
change places by three reversals (each block, then both together):

* psm: the middle and suffix blocks: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: then the prefix and suffix blocks: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

A rotation is undone by the rotation with exchanged lengths, so output and form
alone give back the exact text.  UTF-8 bytes are moved, so texts stay whole.

The cuts follow from a hash of ``seed:doc_id``: its first four groups of eight hex
digits give the two cuts (modulo the number of lines plus one), whether the text is
transformed (percent) and the form.

Defined results: a null text is an empty one; an empty text, one that holds a
sentinel, or one left out by ``rate`` is plain: it stays as it is, with null lengths;
a null id hashes as empty text; repeated rows are transformed each, in the same way; an
empty table gives an empty table; other columns are kept by :func:`transform`, which
replaces those named like its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import columns_of, rows_out, small_batches

#: Sentinels of prefix, middle and suffix (fixed values).
PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
#: Seed of the cuts; share of the texts that are transformed, and of these in spm form (percent).
SEED, RATE, SPM = 7, 100, 50
#: Bytes of text that are transformed at a time.
TEXTS = 4 << 20


class Cut(NamedTuple):
    """Form, number of lines and the two cuts, in bytes."""

    form: str
    lines: int
    first: int
    second: int


def line_ends(data: bytes | bytearray) -> np.ndarray:
    """Where each line ends, its line feed included; a last line may have none."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not len(data) or len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def cut_of(data: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> Cut:
    ends = line_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or any(s in data for s in (PREFIX, MIDDLE, SUFFIX)) or h3 % 100 >= rate:
        return Cut("plain", n, 0, 0)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = np.concatenate([[0], ends])
    return Cut("spm" if h4 % 100 < spm else "psm", n, int(at[low]), int(at[high]))


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the blocks [start, middle) and [middle, end) in place by three reversals."""
    view = np.frombuffer(data, np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        view[a:b] = view[a:b][::-1].copy()


def apply(data: bytes, cut: Cut) -> bytearray:
    """The transformed text."""
    out = bytearray(data)
    if cut.form == "plain":
        return out
    out[cut.second:cut.second] = SUFFIX
    out[cut.first:cut.first] = MIDDLE
    out[0:0] = PREFIX
    middle = cut.first + len(PREFIX)
    suffix = cut.second + len(PREFIX) + len(MIDDLE)
    rotate(out, middle, suffix, len(out))
    if cut.form == "spm":
        rotate(out, 0, middle, middle + len(out) - suffix)
    return out


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of: the rotations inverted, the sentinels taken out."""
    out = bytearray(output)
    if form == "plain":
        return bytes(out)
    if form == "spm":
        prefix, middle = out.index(PREFIX), out.index(MIDDLE)
        rotate(out, 0, prefix, middle)
    suffix, middle = out.index(SUFFIX), out.index(MIDDLE)
    rotate(out, suffix, middle, len(out))
    middle, suffix = out.index(MIDDLE), out.index(SUFFIX)
    del out[suffix:suffix + len(SUFFIX)]
    del out[middle:middle + len(MIDDLE)]
    del out[0:len(PREFIX)]
    return bytes(out)


def code_points(data: bytes | bytearray) -> int:
    """Characters of UTF-8 text: its bytes that don't continue one."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "fim", seed: int = SEED,
              rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with the transformed text (``out``), ``form``, ``n`` (lines) and the
    lengths ``prefix_chars`` and ``middle_chars``, in one pass without a shuffle."""
    made = [(out, T.StringType()), ("form", T.StringType()), ("n", T.LongType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    keep = [c for c in docs.columns if c not in {x for x, _ in made}]
    slots = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*keep).toDF(*slots)
    row_id, row_text = (F.col(slots[keep.index(c)]) for c in (id_col, text))
    rows = rows.withColumns({"_doc": row_id.cast("bigint"), "_data": F.coalesce(row_text.cast("binary"), F.lit(b""))})
    schema = T.StructType([*rows.schema.fields[:-2], *(T.StructField(f"_{k}", t) for k, (_, t) in enumerate(made))])
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "_data", TEXTS):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, data in zip(*columns_of(b, "_doc", "_data")):
                cut = cut_of(data, doc, seed, rate, spm)
                plain = cut.form == "plain"
                row = (bytes(apply(data, cut)), cut.form, cut.lines, None if plain else code_points(data[:cut.first]),
                       None if plain else code_points(data[cut.first:cut.second]))
                for col, x in zip(cols, row):
                    col.append(x)
            arrays = [pa.array(cols[0], pa.binary()).cast(pa.string()), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *arrays], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*keep, *(x for x, _ in made))


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The lengths, form and digests of :func:`transform` and of the text restored
    from its output, without writing the outputs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                        ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    made = transform(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    rows = made.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.col("fim").cast("binary").alias("fim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "fim", TEXTS):
            outputs = b.column("fim").to_pylist()
            restored = [restore(o, f) for o, f in zip(outputs, b.column("form").to_pylist())]
            yield rows_out(schema, *b.columns[:5], [hashlib.sha256(o).hexdigest() for o in outputs], [hashlib.sha256(r).hexdigest() for r in restored])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                                "output_sha256 string, restored_sha256 string")
