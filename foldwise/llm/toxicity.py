"""Operator 7: toxicity by Levenshtein automata over a learned lexicon.

Learning: the words of all labelled texts are counted by Spark in toxic and other
ones, copies once; words whose toxic share has a high lower bound are candidates.
A candidate's evidence is then the number of its different contexts (the words
around it) in either class, and every word whose share of contexts has a high lower
bound is in the lexicon.  The same pass counts the contexts of misspelled forms in
documents without a well-spelled hit, so forms that are words of their own in clean
text lose their weight.  Words come in parts of about ``PART``, so each trie that is
broadcast is bounded at any size of the lexicon; with several parts, a token takes
its nearest word of all of them.

Matching: the lexicon trie is intersected with the Levenshtein automata (edits,
neighbouring letters swapped) of all words at once; the product is determinised
on demand into a table through which all different tokens of a batch step
together.  Short words must match exactly, longer ones with one or two edits.

Scoring: each hit carries its word's toxic share, less for misspelled ones and
less for hits in quotation (quotation marks around it, or a word that speaks of
a word before it, without a second person near).  Hits combine as independent
evidence: 1 - (1 - base) * product(1 - weight).

Defined results: null and empty texts get the score of a text without hits;
without labelled rows the score is 0 everywhere; rows without a label or with a null one teach nothing; repeated
rows are scored each; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foldwise.llm.common import columns_of, rows_out, saved, small_batches

#: Least texts (and contexts) of a word, and least lower bound of its toxic share.
LEAST_DOCS, LEAST_SHARE = 5, 0.6
#: Words that one trie holds, about.
PART = 20_000
#: Digests of texts that a task knows it has listed.
LISTED = 200_000
#: What is left of a word's weight after one and two edits, and in quotation.
EDITED, QUOTED = (1.0, 0.9, 0.75), 0.3
#: Characters around a hit that make its context.
CONTEXT = 60
#: Words that speak of words, and second persons (fixed lists).
MENTION = frozenset("said says say called calls word words term terms wrote quote quoted quotes means meaning spelled slur insult phrase".split())
ADDRESS = frozenset("you your youre u are yourself".split())
_QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "`": "`"}
_LETTERS = re.compile(r"[^\W\d_]+")
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "“”„«»‘’…–—¿¡·"


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


def forms(token: str) -> list[str]:
    """What a token between spaces may spell: without outer punctuation, and its runs of letters."""
    core = token.strip(PUNCTUATION)
    if core.isalpha():
        return [core]
    runs = _LETTERS.findall(core)
    return [core, *runs] if len(runs) > 1 or runs and runs[0] != core else runs


class FuzzyTrie:
    """The lexicon trie times the words' Levenshtein automata, determinised on demand.

    A position is (trie node, edits, letter awaited after a swap); a state is a set
    of positions.  State 0 is dead, state 1 the start."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.most: list[int] = [0]             # edits that some word below allows
        for k, w in enumerate(self.words):
            node, allowed = 0, edits_allowed(w)
            self.most[0] = max(self.most[0], allowed)
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.word[node] = k
        letters = sorted({c for w in self.words for c in w})
        self.code = {c: i + 1 for i, c in enumerate(letters)}      # code 0: any other character
        self.letters = ["", *letters]
        self._start()

    def _start(self) -> None:
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.table = np.full((1024, len(self.letters)), -1, np.int32)
        self.best: list[tuple[int, int]] = []  # (edits, word) that ends here, or (9, -1)
        self._state(frozenset())
        self.table[0] = 0
        self._state(self._closed({(0, 0, "")}))

    def _closed(self, positions: set) -> frozenset:
        """With letters left out, and without positions that another beats."""
        todo, best = list(positions), {}
        while todo:
            node, e, wait = p = todo.pop()
            if best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait and e < self.most[node]:
                todo.extend((ch, e + 1, "") for ch in self.children[node].values() if e + 1 <= self.most[ch])
        return frozenset((n, e, w) for (n, w), e in best.items())

    def _state(self, s: frozenset) -> int:
        if s not in self.number:
            self.number[s] = k = len(self.states)
            self.states.append(s)
            ends = [(e, self.word[n]) for n, e, w in s if not w and self.word[n] >= 0 and e <= edits_allowed(self.words[self.word[n]])]
            self.best.append(min(ends, default=(9, -1)))
            if k >= len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return self.number[s]

    def _step(self, state: int, code: int) -> int:
        c, out = self.letters[code], set()
        for node, e, wait in self.states[state]:
            kids = self.children[node]
            if wait:                           # the swapped pair's first letter comes now
                if wait == c:
                    out.add((node, e, ""))
                continue
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.most[node]:
                out.add((node, e + 1, ""))
                for x, ch in kids.items():
                    if e + 1 <= self.most[ch]:
                        if x != c:
                            out.add((ch, e + 1, ""))
                        after = self.children[ch].get(c)
                        if after is not None and x != c and e + 1 <= self.most[after]:
                            out.add((after, e + 1, x))
        to = self._state(self._closed(out))
        self.table[state, code] = to
        return to

    def match(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(edits, word number) of each token's nearest word, or (9, -1)."""
        if len(self.states) > 100_000:
            self._start()
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        get = self.code.get
        flat = np.fromiter((get(c, 0) for t in tokens for c in t), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        end_state = np.where(size == 0, 1, 0)
        live, state, step = np.flatnonzero(size > 0), np.ones(int((size > 0).sum()), np.int64), 0
        while len(live):
            c = flat[begin[live] + step]
            new = self.table[state, c]
            if (new < 0).any():
                for s, x in np.unique(np.stack([state, c], 1)[new < 0], axis=0).tolist():
                    self._step(s, x)
                new = self.table[state, c]
            step += 1
            ended = size[live] == step
            end_state[live[ended]] = new[ended]
            on = ~ended & (new > 0)
            live, state = live[on], new[on].astype(np.int64)
        return [self.best[s] for s in end_state.tolist()]


def quoted(text: str, begin: int, end: int) -> bool:
    """Whether the hit at text[begin:end] is spoken of rather than used."""
    before, after = text[max(0, begin - CONTEXT):begin], text[end:end + CONTEXT]
    near = [w.lower() for w in _LETTERS.findall(before)[-4:]]
    if ADDRESS & set(near[-2:]):
        return False
    line_before, line_after = before.rpartition("\n")[2], after.partition("\n")[0]
    for opening, closing in _QUOTES.items():
        shut = max((line_before.rfind(c) for c in closing), default=-1)
        at = line_before.rfind(opening)
        odd = line_before.count(opening) % 2 == 1 if opening in closing else at > shut
        if at >= 0 and odd and any(c in line_after for c in closing):
            return True
    return bool(MENTION & set(near))


def spelled(trie: FuzzyTrie, texts: list[str | None]) -> tuple[dict[str, tuple[int, int]], list[int]]:
    """(edits, word number) of every lower-case token that spells a lexicon word,
    and the texts that hold such tokens."""
    cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())))
    at = cut.offsets.to_numpy()
    words = cut.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    pairs = [(t, f) for t in names for f in forms(t)]
    hits: dict[str, tuple[int, int]] = {}
    for (t, _), (e, w) in zip(pairs, trie.match([f for _, f in pairs])):
        if w >= 0:
            hits[t] = min(hits.get(t, (e, w)), (e, w))
    is_hit = np.fromiter((n in hits for n in names), bool, len(names))
    where = np.flatnonzero(is_hit[words.indices.to_numpy()]) if len(names) else np.zeros(0, np.int64)
    return hits, np.unique(np.searchsorted(at, where, "right") - 1).tolist()


def occurrences(text: str, hits: dict[str, tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(edits, word number, begin, end) of each hit in a text."""
    for m in re.finditer(r"\S+", text):
        if (h := hits.get(m[0].lower())) is not None:
            yield *h, m.start(), m.end()


class Part:
    """A part of the lexicon and the weight of each of its words at each number of edits."""

    def __init__(self, weight: dict[tuple[str, int], float], base: float):
        self.base = base
        self.trie = FuzzyTrie(sorted({w for w, _ in weight}))
        number = {w: i for i, w in enumerate(self.trie.words)}
        self.weight = {(number[w], e): x for (w, e), x in weight.items()}

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, begin, edits, word number, evidence) of each hit."""
        hits, docs = spelled(self.trie, texts)
        for d in docs:
            for e, w, begin, end in occurrences(texts[d], hits):
                yield d, begin, e, w, self.weight[w, e] * (QUOTED if quoted(texts[d], begin, end) else 1)

    def scores(self, texts: list[str | None]) -> list[float]:
        clean = [1 - self.base] * len(texts)
        for d, _, _, _, x in self.hits(texts) if self.weight else ():
            clean[d] *= 1 - x
        return [min(1.0, max(0.0, 1 - c)) for c in clean]


class Scorer(NamedTuple):
    """The learned lexicon in parts, and the base rate."""

    parts: list[dict[tuple[str, int], float]]
    base: float


def lower_bound(k: float, n: float, z: float = 1.645) -> float:
    """Wilson's lower bound of a share."""
    if n <= 0:
        return 0.0
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _least_share(k: Column, n: Column, z: float = 1.645) -> Column:
    """:func:`lower_bound` as a column."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _parts(words: DataFrame) -> Iterator[list[Row]]:
    """The rows of a table of words, about PART words at a time."""
    n = words.select("word").distinct().count()
    m = -(-n // PART)
    for i in range(m):
        yield words.where(F.pmod(F.xxhash64("word"), F.lit(m)) == i).collect()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Learns from all rows of ``labels`` (id, 0/1 label) that have a document.
    Counts stay in Spark; the driver gets the words that pass the bounds."""
    # merge joins at every size: labels follow the rows, so they are never broadcast
    marked = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label) > 0).cast("int").alias("y")).hint("merge")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    spark = docs.sparkSession
    counted = pa.schema([("word", pa.string()), ("y", pa.int32()), ("n", pa.int64())])

    def listing(with_words: bool):
        """Digest of every row's set of words; or the words of each digest, once in a task."""
        schema = pa.schema([("h", pa.string()), ("words", pa.string()) if with_words else ("id", pa.int64())])

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[str] = set()
            for b in small_batches(batches, "text"):
                ids, texts = columns_of(b, "id", "text")
                words = [" ".join(sorted({w for w in _LETTERS.findall(t.lower()) if 3 <= len(w) <= 30})) for t in texts]
                h = [hashlib.blake2b(w.encode(), digest_size=16).hexdigest() for w in words]
                if with_words:
                    fresh = {x: w for x, w in zip(h, words) if x not in seen}
                    seen.update(fresh)
                    if len(seen) > LISTED:
                        seen.clear()
                    h, ids = list(fresh), list(fresh.values())
                if h:
                    yield rows_out(schema, h, ids)

        return rows.mapInArrow(distinct, "h string, " + ("words string" if with_words else "id bigint"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in small_batches(batches, "words"):
            for ws, y in zip(*columns_of(b, "words", "y")):
                seen.update((w, y) for w in ws.split())
                seen["", y] += 1               # the empty word counts the texts
            if len(seen) > 400_000:
                yield rows_out(counted, [w for w, _ in seen], [y for _, y in seen], list(seen.values()))
                seen.clear()
        if seen:
            yield rows_out(counted, [w for w, _ in seen], [y for _, y in seen], list(seen.values()))

    classes = listing(False).join(marked, F.col("id") == F.col("_id")).select("h", "y").distinct()
    taught = listing(True).join(classes.hint("merge"), "h").dropDuplicates(["h", "y"]).select("words", "y")
    k, n = F.col("k"), F.col("n")
    totals = saved(taught.mapInArrow(count, "word string, y int, n bigint").groupBy("word")
                   .agg(F.sum(F.when(F.col("y") == 1, n).otherwise(0)).alias("k"), F.sum("n").alias("n"))
                   .where((F.col("word") == "") | (k >= LEAST_DOCS) & (_least_share(k, n) >= LEAST_SHARE)))
    all_texts = totals.where("word = ''").first()
    if all_texts is None:
        return Scorer([], 0.0)
    rate = all_texts.k / max(all_texts.n, 1)
    met = pa.schema([("id", pa.int64()), ("word", pa.string()), ("edits", pa.int32()), ("context", pa.string())])

    def contexts_of(shared):
        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = shared.value
            for b in small_batches(batches, "text"):
                ids, texts = columns_of(b, "id", "text")
                hits, found = spelled(trie, texts)
                out = set()
                for d in found:
                    here = list(occurrences(texts[d], hits))
                    if any(e == 0 for e, *_ in here):
                        here = [h for h in here if h[0] == 0]
                    for e, w, begin, end in here:
                        around = texts[d][max(0, begin - CONTEXT):begin].split()[-2:], texts[d][end:end + CONTEXT].split()[:2]
                        out.add((ids[d], trie.words[w], e, " ".join(around[0] + [""] + around[1])))
                if out:
                    yield rows_out(met, *zip(*out))
        return contexts

    weights: list[dict[tuple[str, int], float]] = []
    for part in _parts(totals.where("word != ''")):
        shared = spark.sparkContext.broadcast(FuzzyTrie([r.word for r in part]))
        seen = (rows.mapInArrow(contexts_of(shared), "id bigint, word string, edits int, context string").join(marked, F.col("id") == F.col("_id"))
                .select("word", "edits", "context", "y").distinct().groupBy("word", "edits")
                .agg(F.sum("y").alias("k"), F.count("*").alias("n")).collect())
        count_of = {(r.word, r.edits): (r.k, r.n) for r in seen}
        exact = {w: (k + rate) / (n + 1) for (w, e), (k, n) in count_of.items()
                 if e == 0 and n >= LEAST_DOCS and lower_bound(k, n) >= LEAST_SHARE}
        weight = {}
        for w in sorted(exact):
            for e in range(edits_allowed(w) + 1):
                k, n = count_of.get((w, e), (0, 0))
                weight[w, e] = exact[w] if e == 0 else (k + EDITED[e] * exact[w]) / (n + 1)
        if weight:
            weights.append(weight)
    return Scorer(weights, min(rate, 0.5) / 10)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text.  One part of the lexicon
    is broadcast and scores in one pass; several are broadcast one by one, and their
    hits meet by document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    if len(scorer.parts) > 1:
        return _score_by_parts(rows, scorer)
    shared = spark.sparkContext.broadcast(Part(scorer.parts[0] if scorer.parts else {}, scorer.base))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            ids, texts = columns_of(b, "doc_id", "text")
            yield rows_out(schema, ids, shared.value.scores(texts))

    return rows.mapInArrow(run, "doc_id bigint, score double")


def _score_by_parts(rows: DataFrame, scorer: Scorer) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("sha", pa.string()), ("begin", pa.int64()), ("edits", pa.int32()), ("word", pa.string()), ("x", pa.float64())])
    keyed = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))

    def hits_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = shared.value
            for b in small_batches(batches, "text"):
                ids, texts, sha = columns_of(b, "doc_id", "text", "sha")
                out = [(ids[d], sha[d], begin, e, part.trie.words[w], x) for d, begin, e, w, x in part.hits(texts)]
                if out:
                    yield rows_out(schema, *zip(*out))
        return run

    hits = reduce(DataFrame.unionByName, (
        keyed.mapInArrow(hits_of(rows.sparkSession.sparkContext.broadcast(Part(w, scorer.base))), "doc bigint, sha string, begin bigint, edits int, word string, x double")
        for w in scorer.parts))
    nearest = hits.groupBy("doc", "sha", "begin").agg(F.min(F.struct("edits", "word", "x")).alias("h"))
    clean = nearest.groupBy("doc", F.col("sha").alias("_sha")).agg(F.sum(F.log(1 - F.col("h.x"))).alias("clean"))
    found = keyed.select("doc_id", "sha").join(clean, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("sha") == F.col("_sha")), "left")
    return found.select("doc_id", F.greatest(F.lit(0.0), 1 - (1 - scorer.base) * F.exp(F.coalesce("clean", F.lit(0.0)))).alias("score"))
