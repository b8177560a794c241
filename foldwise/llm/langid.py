"""Operator 8: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the
substrings of that text.  A document is parsed into the longest matches of each
automaton; the language that needs the fewest phrases, normalised to bits for a
character (phrases * log2(training length) / characters), wins.

Texts are lower-cased, letters are coded, everything else becomes one space.  A
document is parsed in windows of ``WINDOW`` coded characters, all windows of a
batch in step, so a very long text costs no more memory than short ones.

Learning takes whole texts of a bounded sample of the labelled rows: of each
language the different texts with the smallest md5, at most ``SAMPLE_DOCS`` and
while they fit into ``TRAIN_CHARS`` characters (of a first text beyond that, the
part that fits).  All letters of the sample make the alphabet, and transitions stand
in a hash table, so many scripts cost no more than one.  Every fourth sampled text is
held out: it gives the bits for a character that unseen text of its language needs.
Prediction covers every whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any labelled row all documents are; ties go to the smaller name; a language
with fewer than four sampled texts has no limit in :func:`accepted`;
repeated rows are scored each; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.common import columns_of, let_go, rows_out, small_batches

#: Sampled texts of a language, and their characters, that teach.
SAMPLE_DOCS, TRAIN_CHARS = 96, 60_000
#: Different texts of a language among which the sample is chosen (an expected number).
CANDIDATES = 1024
WINDOW = 256
#: Codes: 0 is a space, 1 a letter outside the alphabet, then the letters.
SPACE, OTHER, FIRST = 0, 1, 2
#: Bits for a character are weighted by this much in the score.
SHARPNESS = 4.0
#: Texts with more than this share of letters outside the learned alphabet are rejected.
FOREIGN = 0.5
#: Texts that need more than this many times the bits of held-out text, and more than
#: so many phrases beyond that, are in no learned language.
EXCESS, SLACK = 2.4, 3


@lru_cache(2)
def codes(alphabet: str) -> np.ndarray:
    """Code point -> code."""
    lut = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.int32, 0x110000)
    for i, c in enumerate(alphabet):
        lut[ord(c)] = i + FIRST
    return lut


def coded(texts: list[str | None], alphabet: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' codes end to end, and where each begins and ends: runs of
    non-letters are one space, none at either end."""
    low = [(t or "").lower() for t in texts]
    flat = codes(alphabet)[np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)]
    at = np.cumsum([0, *map(len, low)])
    space = flat == 0
    after = np.ones(len(flat) + 1, bool)               # a space or a text's start comes before
    after[1:] = space
    after[at] = True
    ends = np.zeros(len(flat) + 1, bool)
    ends[at] = True
    keep = ~(space & after[:-1])
    last = np.flatnonzero(space & keep)                # one space is left of each run: is it the text's last?
    if len(last):
        runs_end = np.flatnonzero(space & np.append(~space[1:], True) | space & ends[1:])
        which = np.searchsorted(runs_end, last)
        keep[last[ends[runs_end[which] + 1]]] = False
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[at]


class SuffixAutomaton:
    """States and transitions over codes; state 1 is the root, 0 is dead."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}, {}]
        self.link, self.length, self.last = [0, 0], [-1, 0], 1

    def extend(self, c: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        link.append(1)
        length.append(length[self.last] + 1)
        p = self.last
        while p and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur


class Transitions:
    """An automaton's transitions in an open-addressing hash table, looked up by arrays."""

    def __init__(self, states: list[dict[int, int]], width: int):
        self.width = width
        key = np.array([s * width + c for s, arcs in enumerate(states) for c in arcs], np.int64)
        value = np.array([t for arcs in states for t in arcs.values()], np.int32)
        bits = max(4, (2 * len(key)).bit_length())           # at most half full
        small = len(states) * width < 1 << 31
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int32 if small else np.int64), np.zeros(1 << bits, np.int32)
        self.root = np.zeros(width, np.int32)
        for c, t in states[1].items():
            self.root[c] = t
        slot, self.probes = self._slot(key), 0
        while len(key):                                   # all that find a free slot settle, the rest go one on
            self.probes += 1
            free = self.keys[slot] < 0
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], slot[~put]
            slot = np.where(self.keys[slot] < 0, slot, slot + 1 & self.mask)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The state after each code, 0 where there is none."""
        key = state * self.width + code
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], 0)
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            slot[on] = slot[on] + 1 & self.mask
            found = self.keys[slot[on]]
            hit = found == key[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (found >= 0)]
        return out


class Model:
    """The languages' automata, training lengths and bits for a character of held-out
    text (infinite where there is none), over one alphabet."""

    def __init__(self, alphabet: str, langs: list[str], tables: list[Transitions], lengths: list[int], usual: list[float]):
        self.alphabet, self.langs, self.tables, self.lengths, self.usual = alphabet, langs, tables, lengths, usual

    @classmethod
    def fit(cls, samples: dict[str, list[str]], chars: int = TRAIN_CHARS) -> Model:
        alphabet = "".join(sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()}))
        langs, tables, lengths = sorted(samples), [], []
        for lang in langs:
            auto, n = SuffixAutomaton(), 0
            flat, at = coded([t for i, t in enumerate(samples[lang]) if i % 4 != 3], alphabet)
            for a, b in zip(at, at[1:]):
                if n and n + b - a >= chars:
                    continue
                for c in [SPACE, *flat[a:min(b, a + chars)].tolist()]:
                    auto.extend(c)
                n += b - a + 1
            tables.append(Transitions(auto.next, len(alphabet) + FIRST))
            lengths.append(int(n))
        model = cls(alphabet, langs, tables, lengths, [math.inf] * len(langs))
        for k, lang in enumerate(langs):
            if held := samples[lang][3::4]:
                found, size = model.phrases(held)
                if size.sum():
                    model.usual[k] = float(found[k].sum() / size.sum() * math.log2(max(lengths[k], 2)))
        return model

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and each text's coded length."""
        flat, at = coded(texts, self.alphabet)
        size = np.diff(at)
        parts = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = at[:-1][doc] + nth * WINDOW
        length = np.minimum(WINDOW, at[1:][doc] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, doc = begin[order], length[order], doc[order]
        live = np.searchsorted(-length, -np.arange(WINDOW), "left")      # windows longer than each step
        found = np.zeros((len(self.langs), len(texts)), np.int64)
        for k, table in enumerate(self.tables):
            state = np.ones(len(doc), np.int64)
            count = np.ones(len(doc), np.int64)
            for j in range(WINDOW):
                n = live[j]
                if not n:
                    break
                c = flat[begin[:n] + j]
                new = table.step(state[:n], c)
                stop = np.flatnonzero(new == 0)
                if len(stop):
                    count[stop] += 1
                    again = table.root[c[stop]]
                    new[stop] = np.where(again == 0, 1, again)
                state[:n] = new
            found[k] = np.bincount(doc, count, len(texts))
        return found, size

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits for a character of each text in each language, and coded lengths."""
        found, size = self.phrases(texts)
        return found * np.log2(np.maximum(self.lengths, 2))[:, None] / np.maximum(size, 1), size

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits, size = self.bits(texts)
        best = bits.argmin(0)
        weight = np.exp(-SHARPNESS * math.log(2) * (bits - bits.min(0)))
        score = np.where(size > 0, 1 / weight.sum(0), 0.0)
        return [self.langs[b] if n else "und" for b, n in zip(best, size)], score

    def known(self, texts: list[str | None], foreign: float = FOREIGN) -> np.ndarray:
        """Whether each text is in a learned language: it needs at most EXCESS times
        the bits of the winner's held-out text (and SLACK phrases), and at most the
        share ``foreign`` of its letters is outside the alphabet."""
        if not self.langs or not texts:
            return np.zeros(len(texts), bool)
        bits, size = self.bits(texts)
        best = bits.argmin(0)
        phrase = np.log2(np.maximum(self.lengths, 2))[best]
        usual = np.array(self.usual)[best]
        flat, at = coded(texts, self.alphabet)
        strange = np.diff(np.concatenate([[0], np.cumsum(flat == OTHER)])[at])
        letters = np.diff(np.concatenate([[0], np.cumsum(flat != SPACE)])[at])
        return (size > 0) & (strange <= foreign * letters) & (bits.min(0) * size <= EXCESS * usual * size + SLACK * phrase)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from the rows where ``learn`` holds and the label is not null; the
    driver gets the bounded sample only.

    A language's candidates are the texts whose digest lies below a share that its
    number of different texts gives, so copies are one candidate and no task gets
    more than some CANDIDATES of a language."""
    rows = (docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
            .select(F.col(lang).alias("lang"), F.md5(text).alias("key"), F.col(text).alias("text")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()
    if not counts:
        return Model.fit({})
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    below = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, int(min(1.0, 2 * CANDIDATES / max(r.n, 1)) * (1 << 32)))))
    chosen = rows.where(place < below[F.col("lang")]).groupBy("lang", "key").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("key")
    before = F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    top = (chosen.select("*", F.row_number().over(order).alias("k"), F.coalesce(before, F.lit(0)).alias("before"))
           .where((F.col("k") <= SAMPLE_DOCS) & (F.col("before") < 2 * TRAIN_CHARS)).orderBy("lang", "key").collect())
    samples: dict[str, list[str]] = {}
    for r in top:
        samples.setdefault(r.lang, []).append(r.text)
    return Model.fit(samples)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of every whole text.  The
    model is broadcast: its size is bounded by ``TRAIN_CHARS`` for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in small_batches(batches, "text", 1 << 20):
            ids, texts = columns_of(b, "doc_id", "text")
            yield rows_out(schema, ids, *shared.value.predict(texts))

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id bigint, lang_pred string, score double"))


def accepted(docs: DataFrame, model: Model, text: str = "text", foreign: float = FOREIGN) -> DataFrame:
    """The rows of ``docs`` in a learned language (:meth:`Model.known`): rejects texts
    that are null or have no letter, need many more bits than held-out text of the
    language that wins, or are mostly in letters foreign to all learned text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    inner = names[docs.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in small_batches(batches, inner, 1 << 20):
            yield b.filter(pa.array(shared.value.known(b.column(inner).to_pylist(), foreign), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
