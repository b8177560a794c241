r"""Operator 9: chat formatting by token-level assembly.

Each turn's text is escaped and encoded on its own; reserved ids above the
vocabulary mark roles and turn ends and are spliced in between, so no text can
ever produce them.  A token's place in its conversation and the loss spans come
from prefix sums of the segments' lengths.  The sums run over buckets of turns
and then over the buckets' totals, so a conversation of any length spreads over
tasks.

Escaping: ``\`` becomes ``\\``, and a control string gets a ``\`` after its first
character, so the formatted text holds control strings at markers only.
Dropping one ``\`` of each pair undoes it.

Defined results: null role or text counts as empty; rows go by turn (null
first), ties by role and text; repeated rows are turns of their own; a role
without a marker is written out behind the marker for other roles; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm import bpe
from foldwise.llm.common import columns_of, rows_out, saved, small_batches

#: Markers of roles, in the order of their reserved ids (fixed by this template).
MARKERS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:", "tool": "### Tool:"}
OTHER, SEPARATOR, END = "### Other:", "<sep>", "</turn>"
CONTROL = [*MARKERS.values(), OTHER, SEPARATOR, END]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
#: Turns of one conversation that are summed together.
BUCKET = 1024


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Template:
    """Reserved ids follow the vocabulary's largest id."""

    def __init__(self, encoder: bpe.Encoder):
        self.encoder = encoder
        base = max(encoder.v.bytes_of) + 1
        self.id_of = {c: base + i for i, c in enumerate(CONTROL)}
        self.text_of = {i: c for c, i in self.id_of.items()}
        self.role_of = {self.id_of[m]: r for r, m in MARKERS.items()}

    def segments(self, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each turn, and how many stand before its text."""
        flat, at = self.encoder.flat_ids([escape(t) for t in texts])
        odd = sorted({r for r in roles if r not in MARKERS})
        written = dict(zip(odd, self.encoder.ids([escape(r) for r in odd])))
        heads = {r: [self.id_of[MARKERS[r]]] if r in MARKERS else [self.id_of[OTHER], *written[r], self.id_of[SEPARATOR]]
                 for r in set(roles)}
        end = [self.id_of[END]]
        out = [np.concatenate([heads[r], flat[a:b], end]).astype(np.int32) for r, a, b in zip(roles, at, at[1:])]
        return out, [len(heads[r]) for r in roles]

    def read(self, ids: list[int], mask: list[bool] | None = None) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn of a token sequence."""
        role, part, lost = "", [], []
        for k, i in enumerate(ids):
            c = self.text_of.get(i)
            if c is None:
                part.append(i)
                if mask is not None and mask[k]:
                    lost.append(i)
            elif c == END:
                yield role, unescape(self.encoder.decode(part)), unescape(self.encoder.decode(lost))
                part, lost = [], []
            elif c == SEPARATOR:
                role, part = unescape(self.encoder.decode(part)), []
            else:
                role, part, lost = self.role_of.get(i, ""), [], []

    def shown(self, ids: list[int]) -> str:
        """The formatted text."""
        out, part = [], []
        for i in ids:
            if (c := self.text_of.get(i)) is None:
                part.append(i)
            else:
                out += [self.encoder.decode(part), c]
                part = []
        return "".join([*out, self.encoder.decode(part)])


def format_turns(turns: DataFrame, vocabulary: str, lexicon: str | None = None) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text): ``ids`` is its
    part of the conversation's token sequence, which begins at ``start``;
    ``loss_from``/``loss_to`` bound the tokens of the sequence under the loss mask
    (an assistant's text; null for other turns); ``bucket``, ``place`` order the
    turns."""
    docs = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    files = os.path.basename(vocabulary), lexicon or bpe.fit_lexicon(docs, vocabulary)
    docs.sparkSession.sparkContext.addFile(vocabulary)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("tie", pa.string()),
                        ("ids", pa.list_(pa.int32())), ("head", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(bpe._encoder(*files))
        for b in small_batches(batches, "text", 2 << 20):
            conv, turn, role, text = columns_of(b, "conv_id", "turn", "role", "text")
            ids, head = template.segments(role, text)
            tie = [hashlib.sha256(t.encode()).hexdigest() for t in text]
            yield rows_out(schema, conv, turn, role, tie, ids, head)

    # written out: the totals and the rows both read the ids, which are encoded once
    cut = saved(docs.mapInArrow(run, "conv_id bigint, turn bigint, role string, tie string, ids array<int>, head int"))
    cut = cut.withColumn("bucket", F.floor(F.col("turn") / BUCKET).cast("bigint")).withColumn("n", F.size("ids"))
    order = Window.partitionBy("conv_id", "bucket").orderBy("turn", "role", "tie")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = (cut.withColumn("place", F.row_number().over(order).cast("bigint"))
           .withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))))
    totals = cut.groupBy("conv_id", "bucket").agg(F.sum("n").alias("all"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"),
                          F.coalesce(F.sum("all").over(before), F.lit(0)).alias("shift"))
    out = cut.join(shift, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")))
    start = F.col("within") + F.col("shift")
    loss = F.col("role") == "assistant"
    return out.select("conv_id", "turn", "role", "bucket", "place", "ids", start.alias("start"),
                      F.when(loss, start + F.col("head")).alias("loss_from"),
                      F.when(loss, start + F.col("n") - 1).alias("loss_to"))


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of every conversation as read back from its tokens and loss mask.

    A conversation's digest needs its turns one after the other: they stream in
    order through one task, which holds one batch and the running digests."""
    formatted.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(bpe._encoder(name, None))
        done: list[tuple] = []
        now = None
        for b in small_batches(batches, "ids", 2 << 20):
            for conv, ids, start, lo, hi in zip(*columns_of(b, "conv_id", "ids", "start", "loss_from", "loss_to")):
                if now is None or conv != now[0]:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                mask = None if lo is None else [lo <= k < hi for k in range(start, start + len(ids))]
                for role, text, lost in template.read(ids, mask):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                    now[3] += len(lost)
                    now[4].update(lost.encode())
                now[5] += len(template.shown(ids))
                now[6] += len(ids)
            if done:
                yield rows_out(schema, *zip(*((x.hexdigest() if hasattr(x, "hexdigest") else x for x in r) for r in done)))
                done = []
        if now is not None:
            yield rows_out(schema, *zip(*((x.hexdigest() if hasattr(x, "hexdigest") else x for x in r) for r in [now])))

    return (formatted.select("conv_id", "bucket", "place", "ids", "start", "loss_from", "loss_to")
            .repartition("conv_id").sortWithinPartitions("conv_id", "bucket", "place")
            .mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                             "formatted_chars bigint, n_tokens bigint"))
