"""Operator 2: byte-level BPE encoding and decoding through a transducer lexicon.

The corpus' most frequent words are counted by Spark over all documents and
compiled, with their id sequences, into a minimal acyclic automaton: equal
suffixes share states, and additive numbers on the arcs give each word its rank,
which points at its ids (a transducer).  The automaton is one flat file in the
shared scratch folder; Spark ships it to the executors (``addFile``), whose
Python workers memory-map it.  Words that it lacks are merged exactly, by rank.
The result never depends on which words are in the lexicon.

Defined results: a null text counts as empty (no ids, empty decoded text); an
added token's string in a text becomes that token's id; repeated rows are
encoded each; an empty table gives an empty table; other columns are not read, but one
named like the output column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import columns_of, rows_out, saved, small_batches, worker_cache

#: The byte-level pre-tokenizer's pattern (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the lexicon; they alter the speed, not the ids.
LEXICON_WORDS = 1 << 17
#: Encoded pieces that a worker remembers; the longest word of the lexicon.
MEMO_PIECES, MEMO_CHARS = 400_000, 64
#: Ids after which the memo starts anew.
MEMO_IDS = 1 << 23
#: Pieces whose parts are gathered at a time.
GATHER = 100_000
SPACE_RUN = re.compile(r" (?:\s|$)")
#: Stands between pieces that are cut into words at a time: a code point that Unicode keeps free.
BETWEEN = "\ufdd0"
#: ``WORDS`` over pieces with ``BETWEEN`` between them: it is a word of its own and, for the rest, the end of the text.
WORDS_BETWEEN = BETWEEN + "|" + WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{BETWEEN}]").replace(r"(?!\S)", rf"(?![^\s{BETWEEN}])")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 bytes stand
    for themselves, the others follow from code point 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def parts_of(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``flat`` that begin there and have that size, end to end, and where each begins and ends."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])], upto


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(chars[c] for c in s) for s, i in vocab.items()}
        self.id_of_byte = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.words, self.words_between = regex.compile(WORDS), regex.compile(WORDS_BETWEEN)
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def _by_id(self, shown: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of every id end to end, and by id where they begin and their size."""
        parts = [shown.get(i, b"") for i in range(max(shown, default=-1) + 1)]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    @cached_property
    def raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each id decodes to."""
        return self._by_id(self.bytes_of)

    @cached_property
    def decimal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each id as decimal text and a comma."""
        return self._by_id({i: b"%d," % i for i in self.bytes_of})

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mergeable pairs as ascending keys, the rank of each, and the new id by rank."""
        keys = np.array([a << 20 | b for a, b in self.merges], np.int64)
        rank = np.array([r for r, _ in self.merges.values()], np.int64)
        made = np.zeros(rank.max(initial=0) + 1, np.int64)
        made[rank] = [i for _, i in self.merges.values()]
        order = np.argsort(keys)
        return keys[order], rank[order], made

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The id of each byte, and the rank of each pair of bytes; 256 is no byte."""
        none = len(self._pairs[2])
        rank = np.full((257, 257), none, np.int64)
        byte_of = {i: b for b, i in enumerate(self.id_of_byte)}
        for (a, b), (r, _) in self.merges.items():
            if a in byte_of and b in byte_of:
                rank[byte_of[a], byte_of[b]] = r
        return np.array([*self.id_of_byte, -1], np.int64), rank

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: the pair of least rank, leftmost first, until none is left."""
        flat, begin, size = self.merged(words)
        return [flat[i:i + n].tolist() for i, n in zip(begin.tolist(), size.tolist())]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as all ids end to end, and where each word's begin and their number.
        Words of like length step together, long ones go through a heap."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        short = int(np.searchsorted(length[order], 48, "right"))
        flats, sizes = [], []
        for k in range(0, short, 4096):
            ids = self._merge_block([words[i] for i in order[k:min(k + 4096, short)].tolist()])
            flats.append(ids[ids >= 0])
            sizes.append((ids >= 0).sum(1))
        for i in order[short:].tolist():
            flats.append(np.array(self._merge_long([self.id_of_byte[b] for b in words[i]]), np.int64))
            sizes.append([len(flats[-1])])
        size = np.zeros(len(words), np.int64)
        begin = size.copy()
        if len(words):
            size[order] = np.concatenate(sizes)
            begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([np.zeros(0, np.int64), *flats]), begin, size

    def _merge_block(self, words: list[bytes]) -> np.ndarray:
        """One row of ids for each word, -1 after the last."""
        keys, ranks, made = self._pairs
        none = len(made)
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=0))
        id_of, rank_of_bytes = self._bytes
        cells = np.full((len(words), width + 1), 256, np.int64)
        if not width:
            return id_of[cells]
        cols = np.arange(width + 1)
        cells[cols < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = id_of[cells]

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 20 | b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((keys[at] == key) & (a >= 0) & (b >= 0), ranks[at], none)

        rank = np.full(ids.shape, none, np.int64)
        rank[:, :-1] = rank_of_bytes[cells[:, :-1], cells[:, 1:]]
        live = np.arange(len(words))
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            live, at, best = live[best < none], at[best < none], best[best < none]
            if not len(live):
                break
            take = np.minimum(cols + (cols > at[:, None]), width)     # the pair's second id goes
            new, old = np.take_along_axis(ids[live], take, 1), np.take_along_axis(rank[live], take, 1)
            row = np.arange(len(live))
            new[row, at] = made[best]
            new[:, width] = -1
            old[:, width] = none
            old[row, at] = rank_of(new[row, at], new[row, np.minimum(at + 1, width)])
            before = np.maximum(at - 1, 0)
            old[row, before] = np.where(at > 0, rank_of(new[row, before], new[row, at]), old[row, before])
            ids[live], rank[live] = new, old
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for words of any length."""
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        get, heap = self.merges.get, []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (m := get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (m[0], i, m[1], ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            if ids[i] != a or (j := right[i]) >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]


class Lexicon:
    """A minimal acyclic automaton over the words' bytes, in four flat arrays.

    ``keys``: state * 256 + byte of every arc, ascending; ``target``: the state
    it leads to; ``rank``: what it adds to the word's rank; ``final``: states
    that end a word.  ``start``/``ids``: the ids of the word of each rank."""

    FIELDS = (("keys", "<i8"), ("target", "<i4"), ("rank", "<i4"), ("final", "|u1"), ("start", "<i4"), ("ids", "<i4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(entries)
        known: dict[tuple, int] = {}
        arcs: list[list[tuple[int, int]]] = []
        ends: list[int] = []
        below: list[int] = []

        def settle(node: list) -> int:
            """The number of the state that equals this finished node."""
            key = (node[0], *node[1])
            if (at := known.get(key)) is None:
                known[key] = at = len(arcs)
                arcs.append(node[1])
                ends.append(node[0])
                below.append(node[0] + sum(below[t] for _, t in node[1]))
            return at

        path, last = [[0, []]], b""
        for w in [*words, None]:
            same = 0 if w is None else next((i for i, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))
            while len(path) > same + 1:
                state = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            if w is None:
                break
            path.extend([0, []] for _ in w[same:])
            path[-1][0] = 1
            last = w
        root = settle(path[0])
        n = len(arcs)
        order = [root, *(s for s in range(n) if s != root)]
        new = {s: i for i, s in enumerate(order)}
        keys, target, rank = [], [], []
        for s in order:
            before = ends[s]
            for label, t in arcs[s]:
                keys.append(new[s] * 256 + label)
                target.append(new[t])
                rank.append(before)
                before += below[t]
        lists = [entries[w] for w in words]
        return cls({"keys": np.array(keys, "<i8"), "target": np.array(target, "<i4"), "rank": np.array(rank, "<i4"),
                    "final": np.array([ends[s] for s in order], "|u1"),
                    "start": np.cumsum([0, *map(len, lists)]).astype("<i4"),
                    "ids": np.array([i for x in lists for i in x], "<i4")})

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, f), t).tobytes() for f, t in self.FIELDS]
        head = np.array([len(p) for p in parts], "<i8").tobytes()
        return head + b"".join(p + bytes(-len(p) % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
        sizes = data[:8 * len(cls.FIELDS)].view("<i8")
        at, arrays = 8 * len(cls.FIELDS), {}
        for (f, t), n in zip(cls.FIELDS, sizes.tolist()):
            arrays[f] = data[at:at + n].view(t)
            at += n + -n % 8
        return cls(arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is absent: all words step together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        live, state, rank, step = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            done = size[live] == step
            if done.any():
                ended = live[done]
                out[ended] = np.where(self.final[state[done]] == 1, rank[done], -1)
                live, state, rank = live[~done], state[~done], rank[~done]
                if not len(live):
                    break
            key = state * 256 + flat[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, rank = self.target[arc].astype(np.int64), rank[ok] + self.rank[arc]
            step += 1
        return out

    def ids_at(self, rank: int) -> list[int]:
        return self.ids[self.start[rank]:self.start[rank + 1]].tolist()

    def extents(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each rank begin, and their number."""
        begin = self.start[ranks].astype(np.int64)
        return begin, self.start[ranks + 1] - begin


def spans(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` pieces each (one text at least)."""
    i, n = 0, len(first) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Encoder:
    """Encodes texts in one worker: the pieces between spaces are looked up in a
    bounded memo; the words of new ones go through the lexicon, else are merged.

    A space that stands between a non-space and a non-space always starts a new
    word of the pattern, so a text cut there encodes to the same ids."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon = vocabulary, lexicon
        self._forget()

    def _forget(self) -> None:
        """The memo: pieces' numbers and, end to end, their ids."""
        self.at: dict[str, int] = {}
        self.ids_of, self.ends = array("i"), array("q")

    def _put(self, pieces: list[str], ids: np.ndarray, upto: np.ndarray) -> None:
        """Remembers new pieces with their ids, end to end up to ``upto``."""
        self.at.update(zip(pieces, range(len(self.ends), len(self.ends) + len(pieces))))
        self.ends.frombytes((upto + len(self.ids_of)).astype(np.int64).tobytes())
        self.ids_of.frombytes(ids.astype(np.int32).tobytes())

    def _cut(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of all pieces, their numbers in order, and how many words each piece has."""
        whole, between = BETWEEN.join(pieces), BETWEEN
        if whole.count(BETWEEN) < len(pieces):
            words = self.v.words_between.findall(whole)
        else:                                           # a text holds it itself
            between = None
            words = [w for p in pieces for w in (None, *self.v.words.findall(p))][1:]
        found = {w: i for i, w in enumerate(dict.fromkeys([between, *words]))}
        ks = np.fromiter(map(found.__getitem__, words), np.int64, len(words))
        held = np.diff(np.concatenate([[-1], np.flatnonzero(ks == 0), [len(ks)]])) - 1
        return list(found)[1:], ks[ks > 0] - 1, held

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self.at]
        if not new:
            return
        words, ks, held = self._cut(new)
        coded = [w.encode() for w in words]
        ranks = self.lexicon.ranks(coded) if self.lexicon else np.full(len(coded), -1)
        there = ranks >= 0
        ids, begin, size = self.v.merged([coded[i] for i in np.flatnonzero(~there).tolist()])
        starts, sizes = np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64)
        starts[~there], sizes[~there] = begin, size
        if there.any():
            starts[there], sizes[there] = self.lexicon.extents(ranks[there])
            starts[~there] += len(self.lexicon.ids)
            ids = np.concatenate([self.lexicon.ids, ids])
        flat, upto = parts_of(ids, starts[ks], sizes[ks])
        self._put(new, flat, upto[np.cumsum(held)])

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.v.bytes_of.__getitem__, ids))

    def _odd(self, text: str) -> bool:
        return SPACE_RUN.search(text) is not None or any(a in text for a in self.v.added)

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """The memo's numbers of texts with runs of space or strings of added tokens."""
        lists = []
        for text in texts:
            parts = self.v.cut.split(text) if self.v.cut else [text]
            lists.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.v.words.findall(p))])
        found = dict.fromkeys(chain.from_iterable(lists))
        for w in found.keys() & self.v.added.keys() - self.at.keys():
            self._put([w], np.array([self.v.added[w]]), np.array([1]))
        self._learn(list(found))
        return [np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)) for ws in lists]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The memo's numbers of all pieces in order, and where each text's begin and end."""
        if len(self.at) > MEMO_PIECES or len(self.ids_of) > MEMO_IDS:
            self._forget()
        odd = [self._odd(t) for t in texts]
        cut = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd)], pa.large_string()), " ")
        first = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        later = [" " + p for p in coded.dictionary.to_pylist()]
        opening = ["" if o else t.partition(" ")[0] for t, o in zip(texts, odd)]
        self._learn(later)
        self._learn(opening)
        ks = np.fromiter(map(self.at.__getitem__, later), np.int64, len(later))[coded.indices.to_numpy()]
        ks[first[:-1]] = list(map(self.at.__getitem__, opening))
        if any(odd):
            lists = [ks[a:b] for a, b in zip(first, first[1:])]
            at = np.flatnonzero(odd).tolist()
            for i, own in zip(at, self._words([texts[i] for i in at])):
                lists[i] = own
            ks, first = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
        return ks, first

    def _ids(self, ks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids end to end and where each text's begin and end."""
        ends = np.frombuffer(self.ends, np.int64)
        flat, upto = parts_of(np.frombuffer(self.ids_of, np.int32), np.concatenate([[0], ends])[ks], np.diff(ends, prepend=0)[ks])
        return flat, upto[first]

    def flat_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin and end."""
        return self._ids(*self.numbers(texts))

    def ids(self, texts: list[str]) -> list[list[int]]:
        flat, at = self.flat_ids(texts)
        return [flat[a:b].tolist() for a, b in zip(at, at[1:])]

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, digest of the ids and digest of the decoded text."""
        ks, first = self.numbers(texts)
        sizes, shown, raw = [np.zeros(0, np.int64)], [], []
        for i, j in spans(first, GATHER):               # few texts at a time: the gathered parts are large
            ids, at = self._ids(ks[first[i]:first[j]], first[i:j + 1] - first[i])
            sizes.append(np.diff(at))
            data, ends = self._shown(self.v.decimal, ids, at)
            shown += [hashlib.sha256(data[x:max(x, y - 1)]).hexdigest() for x, y in zip(ends, ends[1:])]
            data, ends = self._shown(self.v.raw, ids, at)
            raw += [hashlib.sha256(self.as_text(data[x:y]).encode()).hexdigest() for x, y in zip(ends, ends[1:])]
        return np.concatenate(sizes), shown, raw

    @staticmethod
    def _shown(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int]]:
        """The table's bytes of all ids end to end, and where each text's begin and end."""
        flat, begin, size = table
        data, upto = parts_of(flat, begin[ids], size[ids])
        return data.tobytes(), upto[at].tolist()

    @staticmethod
    def as_text(data: bytes) -> str:
        return data.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.as_text(self.decode_bytes(ids))


@worker_cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@worker_cache
def _encoder(vocabulary_file: str, lexicon_file: str | None) -> Encoder:
    """One encoder for each worker process, the last one used: the lexicon is
    mapped, not copied, and an earlier memo is let go."""
    return Encoder(_vocabulary(SparkFiles.get(vocabulary_file)),
                   Lexicon.mapped(SparkFiles.get(lexicon_file)) if lexicon_file else None)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every word between white space of all texts with its count: tasks count
    what they read, Spark adds the partial counts (``word``, ``n``)."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def added(counts: list[pa.Table]) -> pa.Table:
        """One row for each word of all the counts."""
        both = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return both.rename_columns(["word", "n"]).cast(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [schema.empty_table()]
        for b in small_batches(batches, "text"):
            words, n = pc.utf8_split_whitespace(b.column("text")).flatten().value_counts().flatten()
            seen.append(pa.table([words.cast(pa.string()), n], schema=schema).filter(pc.not_equal(words, "")))
            if sum(map(len, seen)) > 2 * MEMO_PIECES:
                seen = [added(seen)]
                if len(seen[0]) > MEMO_PIECES:
                    yield from seen[0].to_batches()
                    seen = [schema.empty_table()]
        yield from added(seen).to_batches()

    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def ship(spark: SparkSession, name: str, data: bytes) -> str:
    """``data`` as a file in the shared scratch folder that Spark hands to every
    executor under the returned name (its size is bounded by the caller)."""
    from foldwise.sources.files import scratch_dir
    folder = scratch_dir(spark)
    name = f"{name}-{folder.rsplit('/', 1)[-1]}.bin"     # Spark takes a file name once only
    path = f"{folder}/{name}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString())
    return name


def frequent(counts: DataFrame, words: int) -> list[str]:
    """The most frequent words, at most ``words``: all above a count that a
    histogram of the counts (sixteen bins for each doubling) gives.  Only the
    bounded list and the histogram reach the driver."""
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = words, None
    for r in sorted(counts.groupBy(step.alias("bin")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.bin):
        if (left := left - r.k) < 0:
            break
        least = r.bin
    return [] if least is None else [r.word for r in counts.where(step >= least).select("word").collect()]


def fit_lexicon(docs: DataFrame, vocabulary: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Counts the words of all documents, compiles the most frequent ones (at most
    ``words``) and ships the automaton; returns its file name."""
    counts = saved(word_counts(docs, text).where(F.length("word") <= MEMO_CHARS))
    v = Vocabulary(vocabulary)
    # a word of the corpus is met after a space or at the start of a line
    parts = sorted({w.encode() for word in frequent(counts, words) for form in (" " + word, word) for w in v.words.findall(form)})
    data = Lexicon.build(dict(zip(parts, v.merge_all(parts)))).to_bytes()
    return ship(docs.sparkSession, "lexicon", data)


def _prepared(docs: DataFrame, vocabulary: str, lexicon: str | None, text: str) -> tuple[str, str]:
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return os.path.basename(vocabulary), lexicon or fit_lexicon(docs, vocabulary, text)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids", lexicon: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text as an array column ``out``."""
    files = _prepared(docs, vocabulary, lexicon, text)
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*keep).schema.add(out, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(*files)
        for b in small_batches(batches, text, 2 << 20):
            flat, at = enc.flat_ids([t or "" for t in b.column(text).to_pylist()])
            col = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    return docs.select(*keep).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that each id list stands for (null: empty);
    bytes that are not UTF-8 become U+FFFD."""
    encoded.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    keep = [c for c in encoded.columns if c != out]
    schema = encoded.select(*keep).schema.add(out, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(name, None)
        for b in small_batches(batches, ids, 4 << 20):
            texts = [enc.decode(x or []) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return encoded.select(*keep).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                   lexicon: str | None = None) -> DataFrame:
    """Number of ids and the digests of ids and decoded text of every document,
    in one pass without writing the ids out."""
    files = _prepared(docs, vocabulary, lexicon, text)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(*files)
        for b in small_batches(batches, "text", 4 << 20):
            ids, texts = columns_of(b, "doc_id", "text")
            yield rows_out(schema, ids, *enc.digests([t or "" for t in texts]))

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
