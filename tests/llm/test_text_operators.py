"""Operators on texts, against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import bpe, chat, dedup, html_text, langid, ngram_join, toxicity
from foldwise.llm.common import crc_mod, table, vocabulary_path
from tests.conftest import SF001, SF01

DOCS = "doc_id long, text string"
#: Null, empty, white space, repeated rows, a long text, and ties.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Same text"), (4, "Same text"), (5, "same  text"), (6, "a"), (7, "x" * 30_000),
       (8, "word " * 8_000), (None, "no id here at all"), (9, "é ß 中文 😀"), (10, "<|endoftext|> a <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns whose names the operators use themselves
    return (spark.createDataFrame(ODD, DOCS).withColumn("set", F.lit(1)).withColumn("id", F.lit("x")).withColumn("ids", F.lit(0.5))
            .withColumn("block", F.lit(None).cast("int")).withColumn("c0", F.lit("y")))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long")


def nz(x):
    return -1 if x is None else x


# ---- 2: BPE ----

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def test_encoder_equals_library(library):
    v = bpe.Vocabulary(vocabulary_path())
    words = [w.encode() for w in (" the", "the", " then", "ing", " of", "é", " é", ",")]
    enc = bpe.Encoder(v, bpe.Lexicon.build(dict(zip(words, v.merge_all(words)))))
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "1", "²", "'s", "'ll", "'",
             "<|endoftext|>", "<|endof", "😀", "中文", "_", "-", "the", " the", "٣", "ª"]
    rng = random.Random(0)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["a" * 50_000 + "é" * 999, ""]
    for t, ids in zip(texts, enc.ids(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert enc.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): [rng.randrange(99)] * rng.randint(0, 3) for _ in range(400)}
    (tmp_path / "x").write_bytes(bpe.Lexicon.build(entries).to_bytes())
    lex = bpe.Lexicon.mapped(str(tmp_path / "x"))
    words = list(entries)
    assert [lex.ids_at(r) for r in lex.ranks(words).tolist()] == [entries[w] for w in words]
    absent = [w + b"c" for w in words if w + b"c" not in entries] + [b"", b"zz"]
    assert (lex.ranks(absent) < 0).all()
    # no two states have the same right language
    arcs = {}
    for key, to in zip(lex.keys.tolist(), lex.target.tolist()):
        arcs.setdefault(key // 256, []).append((key % 256, to))
    shapes = [(int(f), tuple(arcs.get(s, []))) for s, f in enumerate(lex.final.tolist())]
    assert len(set(shapes)) == len(shapes)


def test_bpe_digests_and_round_trip(spark, odd, nothing, library):
    path = vocabulary_path()
    got = bpe.encode_digests(odd, path).collect()
    want = {}
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.setdefault(i, []).append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                       hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert len(got) == len(ODD)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in got)
    encoded = bpe.encode(odd, path, out="token_ids")
    back = bpe.decode(encoded, path, ids="token_ids").select("text", "decoded", "ids", "c0").collect()
    assert all((r.text or "") == r.decoded and r.ids == 0.5 and r.c0 == "y" for r in back)
    assert bpe.encode(odd, path).columns[-1] == "ids"
    assert bpe.encode_digests(nothing, path).count() == 0


def test_bpe_on_documents(spark, library):
    docs = table(spark, SF001, "documents")
    got = {r.doc_id: r.ids for r in bpe.encode(docs.select("doc_id", "text"), vocabulary_path()).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.encode(r.text, add_special_tokens=False).ids


def test_frequent_words(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 1), ("e", 1)], "word string, n long")
    assert sorted(bpe.frequent(counts, 3)) == ["a", "b", "c"]
    assert sorted(bpe.frequent(counts, 2)) == ["a"]          # never more than asked for
    assert bpe.frequent(counts.limit(0), 3) == []


class Calls:
    """A compiled pattern that keeps how often it searched."""

    def __init__(self, pattern):
        self.pattern, self.n = pattern, 0

    def findall(self, text):
        self.n += 1
        return self.pattern.findall(text)


def test_new_pieces_are_learned_at_a_time(library):
    v = bpe.Vocabulary(vocabulary_path())
    patterns = {k: Calls(p) for k, p in vars(v).items() if hasattr(p, "findall") and k != "cut"}
    vars(v).update(patterns)
    enc = bpe.Encoder(v, bpe.Lexicon.build({b" w1": v.merge_all([b" w1"])[0]}))
    texts = [" ".join(f"w{i + k}, {k}é" for k in range(40)) for i in range(0, 4000, 20)]
    shown = [hashlib.sha256(",".join(map(str, library.encode(t).ids)).encode()).hexdigest() for t in texts]
    assert enc.digests(texts)[1] == shown
    assert sum(p.n for p in patterns.values()) <= 4          # no search for each of 4,080 pieces


def test_pieces_that_hold_the_mark_between_pieces(library):
    mark = "\ufdd0"
    texts = [mark, f"a{mark}b c", f"x {mark} {mark}{mark}!\n", "plain text's end\n", "tail \n\t next", "", "a\n b", f"{mark}'s it's\n\n{mark}", "<|endoftext|>"]
    v = bpe.Vocabulary(vocabulary_path())
    for part in (texts, [t for t in texts if mark not in t], [mark], [""], []):
        enc = bpe.Encoder(v)
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert enc.ids(part) == want
        n, shown, raw = bpe.Encoder(v).digests(part)
        assert n.tolist() == list(map(len, want))
        assert shown == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in want]
        assert raw == [hashlib.sha256(t.encode()).hexdigest() for t in part]


def test_merges_of_words_of_all_lengths(library):
    v = bpe.Vocabulary(vocabulary_path())
    words = ["", "a", "é", "the", "x" * 48, "y" * 49, "ab" * 300, "中文", "thing"]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert v.merge_all([w.encode() for w in words]) == want
    assert v.merge_all([]) == [] and v.merge_all([b""]) == [[]] and v.merge_all([b"y" * 49]) == [want[5]]


def test_word_counts(spark, odd):
    want = {}
    for _, t in ODD:
        for w in (t or "").split():
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in bpe.word_counts(odd).collect()} == want


# ---- 5: n-gram join ----

def brute_components(rows, n, percent):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((nz(d), len(sets[i]), nz(least.get(find(i)) if sets[i] else d), links[i]) for i, (d, _) in enumerate(rows))


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 9, 10, 11, 12, 20, 21, 22, 60, 150, 300]))]
        for _ in range(rng.randint(1, 8)):
            v = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                if v and rng.random() < 0.5:
                    v.pop(rng.choice([0, -1, rng.randrange(len(v))]))
                else:
                    v.insert(rng.choice([0, len(v)]), rng.choice(vocabulary))
            rows.append((len(rows), rng.choice(["", " ", "\n"]) + "  ".join(v) + rng.choice(["", "\t"])))
    return rows


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, odd, n, percent):
    rows = near_rows(n) + [(d and 1000 + d, t) for d, t in ODD]
    got = ngram_join.join(spark.createDataFrame(rows, DOCS), n=n, percent=percent).collect()
    assert sorted((nz(r.doc_id), r.n_shingles, nz(r.component_id), r.n_links) for r in got) == brute_components(rows, n, percent)


def test_join_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 150)
    monkeypatch.setattr(ngram_join, "COMMON_SHARE", 0.01)
    rows = near_rows(9)
    got = ngram_join.join(spark.createDataFrame(rows, DOCS), n=3, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute_components(rows, 3, 80)


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[:rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)]))
        bits = sum((x ^ y).bit_count() for x, y in zip(np.array(ngram_join.sketch(a)).view(np.uint64).tolist(), np.array(ngram_join.sketch(b)).view(np.uint64).tolist()))
        assert bits <= len(np.setxor1d(a, b))
        assert len(ngram_join.sketch(a)) == ngram_join.SKETCH


def test_stars_and_pairs_find_the_same(spark, monkeypatch):
    rows = near_rows(21) + [(1000 + i, " ".join(f"p{j}" for j in range(40)) + f" tail{i}") for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    want = brute_components(rows, 3, 80)
    for paired in (1, 3, 100):
        monkeypatch.setattr(ngram_join, "PAIRED", paired)
        got = ngram_join.join(df, n=3, percent=80).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == want


def test_long_sets_that_share_a_passage_do_not_chain(spark, monkeypatch):
    """Each two of six long texts share a third of their shingles and some segments; only the near copies go on to be verified."""
    rng = random.Random(11)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(2000)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(2000)])) for i in range(6)]
    rows.append((6, rows[0][1] + " a few more words"))
    nodes = []
    real = ngram_join.linked_sets
    monkeypatch.setattr(ngram_join, "linked_sets", lambda docs, reps, clusters, *a: nodes.append(clusters.count()) or real(docs, reps, clusters, *a))
    got = ngram_join.join(spark.createDataFrame(rows, DOCS), n=3, percent=80).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(0, 0, 1), *((i, i, 0) for i in range(1, 6)), (6, 0, 1)]
    assert nodes == [2]


def test_groups_are_tied_by_sketches(spark):
    """A group of families of varying sets, short and long: linked sets stay connected, families stay apart."""
    rng = np.random.default_rng(7)
    sets: list = []
    family: list = []
    for f, n in enumerate([300, 300, 330, 1000, 1300, 2600]):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in rng.random(25) * 0.3:
            edited = int(share * n)
            sets.append(np.unique(np.concatenate([base[edited:] if edited % 2 else base[:n - edited], rng.integers(0, 2**63, edited // 2).astype(np.uint64)])))
            family.append(f)
    names = [int.from_bytes(ngram_join.digest(s)[:8], "big", signed=True) for s in sets]
    reps = spark.createDataFrame([(ngram_join.digest(s).hex(), len(s), ngram_join.sketch(s)) for s in sets], "`set` string, n_shingles bigint, sketch array<bigint>")
    for groups in ([range(75)], [range(75), range(75, 150)], [range(50, 125), range(25, 75), range(100, 150)]):
        met = [(names[i], min(names[j] for j in g), 5 + k) for k, g in enumerate(groups) for i in g]
        edges = spark.createDataFrame([x for x in met if x[0] != x[1]], "u bigint, v bigint, `group` bigint")
        root = {r.node: r.root for r in ngram_join.components(ngram_join.plausible(edges, reps, 80)).collect()}
        linked = 0
        for g in groups:
            for i in g:
                for j in g:
                    one, other = root.get(names[i], names[i]), root.get(names[j], names[j])
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if i < j else 0
                    if i < j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        linked += 1
                        assert one == other
                    assert one != other or family[i] == family[j]
        assert linked > 100


def test_folded_sketches_are_narrower_sketches():
    s = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64))
    wide = np.array(ngram_join.sketch(s))
    odd = np.bincount((s % np.uint64(1024)).astype(np.int64), minlength=1024) & 1
    assert len(wide) == ngram_join.sketch_words(5000) == 256
    assert ngram_join.folded(wide[None], 16)[0].tolist() == np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    assert ngram_join.bits_apart(wide[None], np.zeros(256, np.int64)).tolist() == [sum(x.bit_count() for x in wide.view(np.uint64).tolist())]


def test_allowances_keep_the_pigeonhole():
    for percent in (80, 90):
        low = ngram_join.bands(5000, percent)
        for a, b in zip(low, low[1:]):
            most = max(r + s - 2 * -(-percent * (r + s) // (100 + percent))
                       for r in range(a, b) for s in {r, min(r * 100 // percent, b), r * 100 // percent})
            ones, twos, spare = ngram_join.allowances(a, b - 1, 1000, percent)
            assert ones + 2 * twos - spare >= most + 1
            assert not (twos and spare)
            assert (b - 1) * 100 // percent < low[low.index(b) + 1] if b != low[-1] else True


def test_representatives(spark, odd, nothing):
    rows = near_rows(4)
    kept = ngram_join.representatives(spark.createDataFrame(rows, DOCS), n=3, percent=80)
    want = {c for _, _, c, _ in brute_components(rows, 3, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert ngram_join.representatives(odd).columns == odd.columns
    assert ngram_join.representatives(nothing).count() == 0
    assert ngram_join.join(nothing).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_batches_of_few_words(n):
    for words in range(n + 2):
        for texts in ([" ".join("abcdefg"[:words])], list("abcdefg"[:words]), ["", None, " ".join("abcdefg"[:words])]):
            alone = [ngram_join.Shingler(n).sets(pa.array([t, "x " * 9], pa.string()))[0].tolist() for t in texts]
            assert [s.tolist() for s in ngram_join.Shingler(n).sets(pa.array(texts, pa.string()))] == alone


@pytest.mark.parametrize("holes", [False, True])
def test_sets_of_slices(holes):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ab", "c", "Déf", "GH", "i"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = [None if holes and i % 7 == 3 else t for i, t in enumerate(texts)]
    whole = pa.array(texts, pa.string())
    alone = [ngram_join.Shingler(2).sets(pa.array([t], pa.string()))[0].tolist() for t in texts]
    for start in range(0, 60, 3):
        for size in (1, 7, 60):
            got = ngram_join.Shingler(2).sets(whole.slice(start, size))
            assert [s.tolist() for s in got] == alone[start:start + size]


def test_join_beyond_one_slice(spark):
    """13 MB of text in two input tasks, so that batches are cut into several slices."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40_000)]
    rows = []
    for _ in range(1300):
        words = rng.choices(vocabulary, k=rng.randint(300, 1500))
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            cut = rng.randrange(len(words) - rng.randint(1, 40))
            rows.append((len(rows), " ".join(words[:cut] + words[cut + rng.randint(1, 30):])))
    assert sum(len(t) for _, t in rows) > 12_000_000
    got = ngram_join.join(spark.createDataFrame(rows, DOCS).repartition(2), n=3, percent=90).collect()
    sets = {d: (lambda w: frozenset(zip(w, w[1:], w[2:])))(t.split()) for d, t in rows}
    index: dict = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    shared: dict = {}
    for ds in index.values():
        for k, a in enumerate(ds):
            for b in ds[k + 1:]:
                shared[a, b] = shared.get((a, b), 0) + 1
    up, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= 90 * (len(sets[a]) + len(sets[b]) - k):
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == [(d, len(sets[d]), find(d), links[d]) for d in sorted(sets)]


def test_representatives_of_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (7, c), (7, c + " more"), (7, None), (9, c + " most")]
    kept = [(r.doc_id, r.text) for r in ngram_join.representatives(spark.createDataFrame(rows, DOCS), n=5, percent=80).collect()]
    assert sorted(d for d, _ in kept) == [1, 5, 7, 7] and {(1, a), (5, b), (7, None)} < set(kept)


# ---- 6: exact dedup ----

def test_dedup_equals_brute_force(spark, odd, monkeypatch):
    rng = random.Random(5)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "b", " ", "\n", "é"]) for _ in range(rng.randint(0, 6)))) for i in range(400)]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (d, t), k in zip(rows, norm):
        groups.setdefault(k, []).append((-len(t or ""), d is None, d or 0, d))
    want = sorted((nz(d), nz(min(groups[k])[3]), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for (d, _), k in zip(rows, norm))
    for budget in (dedup.TRIE_BYTES, 2000):                     # the small one spills subtrees
        monkeypatch.setattr(dedup, "TRIE_BYTES", budget)
        got = dedup.verdicts(spark.createDataFrame(rows, DOCS)).collect()
        assert sorted((nz(r.doc_id), nz(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert {r.doc_id for r in got if r.kept} == {min(g)[3] for g in groups.values()}


def test_trie_spill_keeps_all_texts():
    rng = random.Random(6)
    trie, out, want = dedup.Patricia(), [], {}
    for i in range(3000):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
        trie.add(t, len(t), i, 1)
        want.setdefault(t, []).append(i)
        if trie.size > 20_000:
            out += list(trie.spill(5_000))
    out += list(trie.items())
    total = {}
    for t, o in out:
        rows, least = total.get(t, (0, 10 ** 9))
        total[t] = rows + o.rows, min(least, o.id)
    assert total == {t: (len(i), min(i)) for t, i in want.items()}
    for n in range(40):
        a = bytes(n) + b"x" * 5
        assert dedup.common(a, bytes(n) + b"y" + b"x" * 9) == n


def test_drop_copies(spark, odd, nothing):
    kept = dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    norm = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD}
    got = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert sorted(got) == sorted(norm)
    assert dedup.drop_copies(nothing).count() == dedup.verdicts(nothing).count() == 0


# ---- 7: toxicity ----

def edit_distance(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    trie = toxicity.FuzzyTrie(["idiot", "scum", "worthless", "abcab", "abcbaabcb", "aab"])
    tokens = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 11))) for _ in range(600)]
    for w in trie.words:
        for _ in range(60):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                i, kind = rng.randrange(len(x) + 1), rng.randrange(3)
                x[i:i + 1] = [[], [rng.choice("abcix")], x[i:i + 1] + [rng.choice("abcix")]][kind]
            tokens.append("".join(x))
    for t, (e, w) in zip(tokens, trie.match(tokens)):
        near = [edit_distance(t, v) for v in trie.words if edit_distance(t, v) <= toxicity.edits_allowed(v)]
        assert e == min(near, default=9), t
        assert w < 0 or edit_distance(t, trie.words[w]) == e


def test_quotation():
    def at(text):
        return toxicity.quoted(text, text.index("idiot"), text.index("idiot") + 5)
    assert at('the "idiot" word') and at("she called him an idiot there") and at("«un idiot» dit")
    assert not at("you are an idiot") and not at('he left. "Go," she cried, idiot') and not at("an idiot")
    scorer = toxicity.Scorer({("idiot", 0): 0.95, ("idiot", 1): 0.85}, 0.01)
    hit, mis, quote, clean, empty, null = scorer.scores(["an idiot", "an idoit", 'the term "idiot"', "clean", "", None])
    assert hit > 0.9 and 0.8 < mis < hit and quote < 0.5 and clean == empty == null == 0.01


def test_toxicity_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels.where(crc_mod("doc_id", 3) != 1))
    rows = toxicity.score(docs, scorer).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.7) == (r.toxic == 1) for r in held) >= 0.97 * len(held)


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, None), (77, 0)], "doc_id long, toxic int")
    scorer = toxicity.fit(odd, labels)
    got = toxicity.score(odd, scorer).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.0}


def toxic_rows(rng, words, copies):
    """Clean and toxic texts; each of ``words`` marks toxic ones.  One toxic text
    of rare words stands in ``copies`` copies."""
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ran", "lis", "mot", "tun")]
    rows = [(" ".join(rng.choices(plain, k=20)), 0) for _ in range(10 * len(words))]
    for w in words:
        for _ in range(8):
            text = rng.choices(plain, k=20)
            text[rng.randrange(20)] = w
            rows.append((" ".join(text), 1))
    rare = " ".join(f"once{a}{b}{c}" for a in "pqrs" for b in "aeiou" for c in "xyzvw")
    return [(i, t, y) for i, (t, y) in enumerate([*rows, *[(rare, 1)] * copies])]


@pytest.mark.parametrize("part", [20_000, 150])
def test_lexicon_holds_every_word_that_passes(spark, monkeypatch, part):
    """More toxic words than one part holds, and copies that must not teach."""
    monkeypatch.setattr(toxicity, "PART", part)
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "wzvx" for b in "uoy" for c in "kgbdp" for d in ("ashi", "ergu", "olmo", "untz", "iffa", "ekko", "urba", "anso", "imbe", "odri")]
    rows = toxic_rows(rng, words, 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    scorer = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {w for p in scorer.parts for w, _ in p} == set(words) and len(words) == 600
    assert (len(scorer.parts) > 1) == (part < 600)
    probe = [(i, f"baran {w} dimot") for i, w in enumerate(words)] + [(5000 + i, "baran dimot fitun") for i in range(9)] + [(None, None), (7, "baran wukxashi")]
    got = toxicity.score(spark.createDataFrame(probe, DOCS), scorer).collect()
    assert len(got) == len(probe)
    assert all(r.score >= 0.7 for r in got if r.doc_id is not None and r.doc_id < 600)
    assert all(r.score < 0.3 for r in got if r.doc_id is None or r.doc_id >= 5000)


def test_parts_score_as_one(spark):
    docs, labels = (table(spark, SF01, t) for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels)
    words = sorted({w for w, _ in scorer.parts[0]})
    halves = [{k: x for k, x in scorer.parts[0].items() if (k[0] in set(words[::2])) == odd} for odd in (True, False)]
    one = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
    two = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.Scorer(halves, scorer.base)).collect()}
    assert one.keys() == two.keys() and all(abs(one[d] - two[d]) < 1e-9 for d in one)


def brute_toxicity(rows, tests):
    """The method by plain counts and edit distances: scores of ``tests``."""
    letters = re.compile(r"[^\W\d_]+")
    texts = {(frozenset(w for w in letters.findall(t.lower()) if 3 <= len(w) <= 30), y) for _, t, y in rows}
    rate = sum(y for _, y in texts) / len(texts)
    count = {}
    for ws, y in texts:
        for w in ws:
            k, n = count.get(w, (0, 0))
            count[w] = k + y, n + 1
    names = sorted(w for w, (k, n) in count.items() if k >= toxicity.LEAST_DOCS and toxicity.lower_bound(k, n) >= toxicity.LEAST_SHARE)

    def hits(text, names):
        found = []
        for m in re.finditer(r"\S+", text):
            best = min(((edit_distance(f, w), w) for f in toxicity.forms(m[0].lower()) for w in names
                        if edit_distance(f, w) <= toxicity.edits_allowed(w)), default=None)
            if best:
                found.append((*best, m.start(), m.end()))
        return found

    seen = set()
    for _, t, y in rows:
        here = hits(t, names)
        if any(e == 0 for e, *_ in here):
            here = [h for h in here if h[0] == 0]
        for e, w, a, b in here:
            seen.add((w, e, (tuple(t[max(0, a - 60):a].split()[-2:]), tuple(t[b:b + 60].split()[:2])), y))
    tally = {}
    for w, e, _, y in seen:
        k, n = tally.get((w, e), (0, 0))
        tally[w, e] = k + y, n + 1
    share = {w: (k + rate) / (n + 1) for (w, e), (k, n) in tally.items()
             if e == 0 and n >= toxicity.LEAST_DOCS and toxicity.lower_bound(k, n) >= toxicity.LEAST_SHARE}
    out = []
    for t in tests:
        clean = 1 - min(rate, 0.5) / 10
        for e, w, a, b in hits(t, sorted(share)):
            k, n = tally.get((w, e), (0, 0))
            x = share[w] if e == 0 else (k + toxicity.EDITED[e] * share[w]) / (n + 1)
            clean *= 1 - x * (toxicity.QUOTED if toxicity.quoted(t, a, b) else 1)
        out.append(1 - clean)
    return out


def test_toxicity_equals_plain_counts(spark):
    rng = random.Random(11)
    words = ["grubnak", "zorfel", "vexatt", "mulgor"]
    rows = toxic_rows(rng, words, 30)[::3] + [(9000 + i, f"they said grubnk {i} and zorfle", 0) for i in range(6)]
    tests = ["you grubnak", "a grubnakk here", 'she said "zorfel" to us', "zorfle", "vexatt mulgor", "baran", "", "VEXAT!", "mulgro, you"]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], DOCS)
    scorer = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame(list(enumerate(tests)), DOCS), scorer).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx(brute_toxicity(rows, tests), abs=1e-9)


# ---- 8: language identification ----

def normal(t):
    out = ""
    for c in (t or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or out and out[-1] != " ":
            out += c
    return out.strip()


def test_phrases_equal_direct_cross_parsing():
    samples = {"a": ["abab abc cab", "xyz zyx"], "b": ["hello world", "low hell"]}
    model = langid.Model.fit(samples)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcxyzhelo wrld,é\n9") for _ in range(rng.randint(0, 700))) for _ in range(40)] + ["", None, "  ", "1 2", "é"]
    found, size = model.phrases(texts)
    assert size.tolist() == [len(normal(t)) for t in texts]
    for lang, row in zip(model.langs, found.tolist()):
        source = "".join(" " + normal(s) for s in samples[lang])
        for t, n in zip(texts, row):
            t, phrases = normal(t), 0
            for k in range(0, len(t), langid.WINDOW):
                now, phrases = "", phrases + 1
                for c in t[k:k + langid.WINDOW]:
                    if now + c in source:
                        now += c
                    else:
                        now, phrases = c if c in source else "", phrases + 1
            assert n == phrases, t


def test_language_held_out(spark):
    docs = table(spark, SF01, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


SCRIPTS = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "he": "אבגדהוזחטיכלמנסעפצקרשת",
           "ka": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "hy": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "la": "abcdefghijklmnopqrstuvwxyz",
           "zh": "".join(chr(0x4E00 + 7 * i) for i in range(900))}


def written_in(letters, rng, words):
    """Text of a made-up language, from a small stock of words."""
    stock = random.Random(letters)
    parts = ["".join(stock.choices(letters, k=stock.randint(3, 6))) for _ in range(max(80, len(letters) // 3))]
    return " ".join(rng.choices(parts, k=words))


def test_language_of_many_scripts(spark):
    """More letters than any fixed alphabet held; long texts teach as a whole."""
    rng = random.Random(8)
    rows = [(k, written_in(s, rng, rng.randint(20, 400)), lang) for k, (lang, s) in
            enumerate((lang, s) for lang, s in SCRIPTS.items() for _ in range(24))]
    rows += [(1000 + i, "1 " * 3000 + written_in(SCRIPTS["ru"], rng, 200), "late") for i in range(9)]      # letters after 6,000 characters only
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = langid.fit(docs.where("lang != 'late'"), F.lit(True))
    letters = {c for _, t, lang in rows if lang != "late" for c in t.lower() if c.isalpha()}
    assert letters == set(model.alphabet) and len(letters) > 400
    got = {lang: [written_in(s, rng, 60) for _ in range(20)] for lang, s in SCRIPTS.items()}
    for lang, texts in got.items():
        assert model.predict(texts)[0] == [lang] * 20
        assert model.known(texts).all()
    noise = ["".join(rng.choices(SCRIPTS["la"] + " ", k=400)) for _ in range(20)]
    other = [written_in("zyxwvutsrqponmlkjihgfedcba", rng, 60) for _ in range(20)]        # the same letters, another language
    assert not model.known(noise).any() and not model.known(other).any()
    assert langid.fit(docs.where("lang = 'late'"), F.lit(True)).known(got["ru"]).all()


def test_transitions_equal_the_automaton():
    rng = random.Random(1)
    auto = langid.SuffixAutomaton()
    for c in rng.choices(range(300), k=3000):
        auto.extend(c)
    table = langid.Transitions(auto.next, 302)
    state, code = np.array([(s, c) for s in range(1, len(auto.next), 7) for c in range(0, 302, 5)]).T
    assert table.step(state, code).tolist() == [auto.next[s].get(c, 0) for s, c in zip(state, code)]
    assert table.root.tolist() == [auto.next[1].get(c, 0) for c in range(302)]


def test_language_sample_is_not_held_by_copies(spark):
    rng = random.Random(9)
    rows = [(i, written_in(SCRIPTS["la"], rng, 30), "la") for i in range(60)] + [(100 + i, "the very same text", "la") for i in range(3000)]
    model = langid.fit(spark.createDataFrame(rows, DOCS + ", lang string"), F.lit(True))
    assert model.lengths[0] > 30 * 60 and model.known([written_in(SCRIPTS["la"], rng, 50)]).all()


def test_language_odd_rows(spark, odd, nothing):
    model = langid.Model.fit({"en": ["the word and the text here"], "xx": ["ouaie eua"]})
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8, None, 10}   # Chinese letters are foreign
    empty = langid.fit(nothing, F.lit(True))
    assert langid.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


# ---- 9: chat ----

def test_escape_is_reversible():
    rng = random.Random(3)
    parts = ["\\", "#", "<", "/", "turn>", "</turn>", "### User:", "### Assistant:", "<sep>", "a", "\n", "\\\\"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROL)


def test_chat_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "BUCKET", 2)                      # conversations span buckets
    rows = [(1, 0, "system", "s"), (1, 1, "user", "### User: </turn>"), (1, 2, "assistant", "\\### Assistant: ok"), (1, 3, "user", None),
            (1, 4, "assistant", ""), (1, 5, "assistant", "é 😀 <|endoftext|>"), (1, 5, "assistant", "é 😀 <|endoftext|>"),
            (2, None, None, None), (2, 1, "odd <sep> role", "x"), (None, 3, "assistant", "z" * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    path = vocabulary_path()
    formatted = chat.format_turns(turns, path)
    got = {r.conv_id: r for r in chat.read_back(formatted, path).collect()}
    for conv in (1, 2, None):
        mine = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        lost = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    # the segments tile the sequence, and the mask holds assistants' texts only
    parts = sorted((r.bucket, r.place, r.start, len(r.ids), r.loss_from, r.loss_to) for r in formatted.where("conv_id = 1").collect())
    at = 0
    for _, _, start, n, a, b in parts:
        assert start == at and (a is None or start < a <= b == start + n - 1)
        at += n
    assert chat.read_back(chat.format_turns(turns.limit(0), path), path).count() == 0


# ---- 10: HTML ----

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a<b>b</b> c</p>d &lt;x&gt; &#233; &nbsp;z", "ab c\nd <x> é z"),
    ("<article><p>x<div class=ad>buy</div>y<p>z &am", "x\ny\nz &am"),
    ("<article><header><h1>T</h1></header><p>q</p><section class='comments'><p>c</p></section></article><article class='comment'>n</article>", "T\nq"),
    ("<article><p>one <span class='ad'>buy</span> two</p><ul><li>a<li>b</ul><script>var a='<p>x</p>';</script><p>end</article>", "one two\na\nb\nend"),
    ("<header>Site</header><nav>menu</nav><div id=main><h1>Title</h1><p>A long paragraph with very many words in it, as content has them.</p>"
     "<p>Short.</p><aside>side</aside><form>Name <input></form></div><footer>foot</footer>",
     "Title\nA long paragraph with very many words in it, as content has them.\nShort."),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "A paragraph of many words, as the body of a page has them, one after the other, until its end."


def wrapped(*texts):
    return "".join(f"<div><p>{t}</p></div>" for t in texts)


@pytest.mark.parametrize("page,text", [
    # the body stands in divs beside short articles, or beside a short main
    (f"<body><div class=body>{wrapped('Heading', LONG, LONG + '2', 'Short.', LONG + '3')}</div>"
     "<div class=cards><article><a href=x><b>Card</b></a></article><article><a href=y><b>Next</b></a></article></div></body>",
     ["Heading", LONG, LONG + "2", "Short.", LONG + "3"]),
    (f"<body><main><i><b>Hi</b></i></main><div>{wrapped(LONG, LONG + '2', LONG + '3')}</div></body>", [LONG, LONG + "2", LONG + "3"]),
    # no article: every block has a div of its own
    (f"<body><div>{wrapped('T', 'By', 'On', 'At', LONG, 'a', 'b', 'c', 'd', LONG + LONG)}</div></body>",
     ["T", "By", "On", "At", LONG, "a", "b", "c", "d", LONG + LONG]),
    (f"<body>{wrapped('T', 'By', 'On', LONG, 'a', 'b', 'c', LONG + '2', 'e', 'f', 'g')}</body>",
     ["T", "By", "On", LONG, "a", "b", "c", LONG + "2", "e", "f", "g"]),
    # a short section stays in its article
    (f"<article><section><p>{LONG}</p><p>{LONG}</p></section><section><p>x</p></section><section><p>y</p></section></article>", [LONG, LONG, "x", "y"]),
])
def test_ratio_chooses_and_containers_widen(page, text):
    got = html_text.main_text(page).split("\n")
    assert [t for t in got if t in text] == text


def test_ratio_decides_against_an_article():
    menu = "".join(f"<li><a href=x><b>Go {i}</b></a></li>" for i in range(30))
    page = f"<body><article><ul>{menu}</ul></article><div>{wrapped(*[LONG + str(i) for i in range(6)])}</div></body>"
    got = html_text.main_text(page).split("\n")
    assert [t for t in got if t.startswith("A")] == [LONG + str(i) for i in range(6)] and "Go 9" not in got


@pytest.mark.parametrize("part", [
    '<h2 id="related-work">x</h2>', '<section id="search-algorithms"><p>x</p></section>', '<p id="social-history">x</p>', '<div id="notice-of-appeal">x</div>',
    '<h2 id="comments">x</h2>', '<h3 class="section-header">x</h3>', '<div class="search-algorithms">x</div>', '<section id="comments"><p>x</p></section>'])
def test_slugs_are_no_noise_in_an_article(part):
    for tag in ("article", "main"):
        assert html_text.main_text(f"<{tag}><p>{LONG}</p>{part}<p>{LONG}</p></{tag}>") == f"{LONG}\nx\n{LONG}"


def test_slugs_are_no_noise_elsewhere():
    for part in ('<h2 id="related-work">x</h2>', '<section id="search-algorithms"><p>x</p></section>', '<p id="social-history">x</p>'):
        assert html_text.main_text(f"<body><div><p>{LONG}</p>{part}<p>{LONG}</p></div></body>") == f"{LONG}\nx\n{LONG}"
    for part in ('<div id="cookie-notice">x</div>', '<div class="site-footer">x</div>', '<ul role="navigation"><li>x</ul>', '<p class="copyright">x</p>'):
        assert html_text.main_text(f"<body><div><p>{LONG}</p>{part}<p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}"


def test_whole_values_are_noise_in_an_article():
    for part in ('<div class="box comments">x</div>', '<div class="cookie-notice">x</div>', '<ul role="navigation"><li>x</ul>'):
        assert html_text.main_text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"{LONG}\n{LONG}"


BODY = "".join(f"<p>{w} is a long paragraph of the page's own text, and it says something at length.</p>" for w in ("One", "Two", "Three"))
TEXT = "\n".join(f"{w} is a long paragraph of the page's own text, and it says something at length." for w in ("One", "Two", "Three"))


@pytest.mark.parametrize("name", ["share-prices", "post-comment-policy", "home social", "news-tags", "article-header-body"])
def test_the_ratio_overrules_a_doubtful_name(name):
    menu = '<ul class="menu"><li><a href="/">Home</a><li><a href="/a">About</a></ul>'
    assert html_text.main_text(f'<body>{menu}<div class="{name}">{BODY}</div><div class="footer">All rights</div></body>') == TEXT
    side = f'<div class="{name}"><p>Follow us</p></div>'
    assert html_text.main_text(f"<body>{menu}<div>{BODY}</div>{side}</body>") == TEXT


def test_names_of_noise_alone_are_noise():
    for name in ('class="share"', 'class="social share"', 'id="comments"', 'role="navigation"', 'class="cookie-banner"'):
        assert html_text.main_text(f"<body><div>{BODY}</div><div {name}>{BODY}{BODY}</div></body>") == TEXT


def test_an_article_keeps_all_its_own_text():
    parts = ("<p class='byline'>By A. Writer</p>", "<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "<div class='disclaimer'>No advice.</div>",
             "<p>Press <button>Start</button> now.</p>")
    got = html_text.main_text(f"<body><article>{parts[0]}{BODY}{''.join(parts[1:])}</article></body>")
    assert got == f"By A. Writer\n{TEXT}\nWhere x=2 holds.\nNo advice.\nPress Start now."


def test_pages_without_an_article(spark):
    """The given pages with their article made a plain container give the same text."""
    pages = table(spark, SF01, "pages")
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", '<div class="text">'), "</article>", "</div>"))
    want = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    got = {r.page_id: r.text for r in html_text.extract(plain).collect()}
    assert sum(want[i] == got[i] for i in want) >= 0.98 * len(want)


def test_pages(spark):
    pages = table(spark, SF01, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    import html
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_smoothing_keeps_constants():
    assert np.allclose(html_text.smoothed(np.full(5, 3.0)), 3.0)
    assert np.argmax(html_text.smoothed(np.array([0.0, 0, 9, 0, 0]))) == 2
