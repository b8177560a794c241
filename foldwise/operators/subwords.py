"""Sub-word tokens with word index and character spans.

A text is cut into words at single spaces; every word but the first keeps the space
before it.  A word's tokens are the longest pieces of a given vocabulary, taken from
left to right over its UTF-8 bytes by a trie.  Tokens carry their id, the index of
their word and their span of characters, so the span operators (T9-T12) run on them and
the spans of a document put its text together again.

The vocabulary is a file of a public byte-level tokenizer (never trained here); it holds
every single byte, so no text has unknown parts.  It is handed to the executors with
``addFile``; a worker keeps its trie and a bounded memo of words.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a worker remembers, their longest, and bytes of text that are cut at a time.
MEMO, MEMO_CHARS, TEXTS = 100_000, 64, 1 << 20


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token -> id of a byte-level vocabulary file: printable Latin-1 bytes stand for
    themselves there, the others for the code points from 256 on, in order."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t)}


class LongestMatch:
    """A trie over the vocabulary: node -> byte -> node, and the id that ends at a node."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.id: list[int] = [-1]
        for token, i in vocabulary.items():
            node = 0
            for b in token:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.id.append(-1)
                node = self.next[node][b]
            self.id[node] = i
        if lacking := [b for b in range(256) if b not in self.next[0] or self.id[self.next[0][b]] < 0]:
            raise ValueError(f"the vocabulary lacks {len(lacking)} single bytes")
        self.memo: dict[str, tuple[list[int], list[int]]] = {}

    def cut(self, word: bytes) -> tuple[list[int], list[int]]:
        """Ids of a word's tokens, and the byte at which each ends."""
        ids, ends, at = [], [], 0
        while at < len(word):
            node, best, end = 0, -1, at
            for k in range(at, len(word)):
                node = self.next[node].get(word[k], -1)
                if node < 0:
                    break
                if self.id[node] >= 0:
                    best, end = self.id[node], k + 1
            ids.append(best)
            ends.append(end)
            at = end
        return ids, ends

    def word(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a word's tokens, and the character at which each ends: a character
        that several tokens share belongs to the first of them."""
        found = self.memo.get(word)
        if found is None:
            data = word.encode()
            ids, ends = self.cut(data)
            if len(data) != len(word):
                begun = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
                ends = begun[np.array(ends) - 1].tolist()
            found = ids, ends
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def texts(self, texts: pa.Array) -> list[pa.ListArray]:
        """(ids, word ids, starts, ends) of texts without nulls; an empty one has no
        tokens.  Each different word is cut once; its tokens are then gathered at
        all its places."""
        words = pc.split_pattern(texts, " ")
        at = words.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        n = np.diff(at)
        flat = words.flatten().dictionary_encode()
        code = flat.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(code), bool)
        first[at[:-1]] = True
        # a word's key tells whether the space before it belongs to it
        key = 2 * code + first
        here = np.zeros(2 * len(flat.dictionary), bool)
        here[key] = True
        which = (np.cumsum(here) - 1)[key]
        names = flat.dictionary.to_pylist()
        found = [self.word(names[u >> 1] if u & 1 else " " + names[u >> 1]) for u in np.flatnonzero(here).tolist()]
        count = np.fromiter((len(i) for i, _ in found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(i for i, _ in found), np.int32)
        ends = np.fromiter(chain.from_iterable(e for _, e in found), np.int32)
        begin = np.cumsum(count) - count
        times = count[which]
        token = np.concatenate([[0], np.cumsum(times)])
        take = np.arange(token[-1]) - np.repeat(token[:-1] - begin[which], times)
        chars = pc.utf8_length(flat.dictionary).to_numpy().astype(np.int64)[code] + ~first
        left = np.cumsum(chars) - chars
        left -= np.repeat(left[at[:-1]], n)
        ends = ends[take] + np.repeat(left, times).astype(np.int32)
        number = np.repeat(np.arange(len(code)) - np.repeat(at[:-1], n), times).astype(np.int32)
        cut = token[at]
        starts = np.concatenate([[0], ends])[:len(ends)].astype(np.int32)
        starts[cut[:-1][np.diff(cut) > 0]] = 0
        offsets = pa.array(cut.astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[take], number, starts, ends)]

    def text(self, text: str) -> tuple[list[int], list[int], list[int], list[int]]:
        """:meth:`texts` of one text."""
        return tuple(x[0].as_py() for x in self.texts(pa.array([text])))


@lru_cache(1)
def _matcher(name: str) -> LongestMatch:
    return LongestMatch(read_vocabulary(SparkFiles.get(name)))


def subword_tokens(df: DataFrame, text: str, vocabulary: str, ids: str = "ids", words: str = "word_ids",
                   starts: str = "starts", ends: str = "ends") -> DataFrame:
    """``df`` with the token ids of ``text``, their word index and their character
    spans [start, end), as arrays of one length; a null text has none.  Columns of
    these names are replaced."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    made = [ids, words, starts, ends]
    kept = [f for f in df.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in made)])
    # a text that stays is sent once
    given = text if text not in made and isinstance(df.schema[text].dataType, T.StringType) else "_text"
    base = df.select(*(f.name for f in kept), *([] if given == text else [F.col(text).cast("string").alias(given)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(name)
        for b in batches:
            step = max(1, b.num_rows * TEXTS // max(b.column(given).nbytes, 1))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *match.texts(pc.fill_null(part.column(given), ""))], names=schema.names)

    return base.mapInArrow(run, schema)
