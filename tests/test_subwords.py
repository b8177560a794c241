"""Sub-word tokens against a brute-force longest match; spans put the text together again."""

import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import subwords as W
from foldwise.plans.q_tokens import vocabulary_file

PARTS = ["the", " the", "ing", "é", "中文", "😀", "a", " ", "  ", "\n", "token", "isation", "X", "ß", "1", ",", "\u200b"]


@pytest.fixture(scope="module")
def vocabulary():
    return W.read_vocabulary(vocabulary_file())


def brute(vocabulary, text):
    """(id, word, bytes) by trying every length at every place."""
    out, longest = [], max(map(len, vocabulary))
    for k, w in enumerate(text.split(" ")):
        data = ((" " if k else "") + w).encode()
        at = 0
        while at < len(data):
            end = next(e for e in range(min(len(data), at + longest), at, -1) if data[at:e] in vocabulary)
            out.append((vocabulary[data[at:end]], k, data[at:end]))
            at = end
    return out


def texts(n):
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)] + ["", " lead", "trail ", "a" * 3000]


def test_longest_match_equals_brute_force(vocabulary):
    match = W.LongestMatch(vocabulary)
    for t in texts(400):
        ids, words, starts, ends = match.text(t)
        want = brute(vocabulary, t)
        assert list(zip(ids, words)) == [(i, k) for i, k, _ in want]
        assert "".join(t[a:b] for a, b in zip(starts, ends)) == t and ends[-1:] == ([len(t)] if t else [])
        for a, b, (_, _, piece) in zip(starts, ends, want):
            if piece.decode("utf-8", "ignore").encode() == piece:
                assert t[a:b] == piece.decode()


def test_memo_stays_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(W, "MEMO", 5)
    match = W.LongestMatch(vocabulary)
    for t in texts(60):
        match.text(t)
        assert len(match.memo) <= 5
    with pytest.raises(ValueError, match="lacks"):
        W.LongestMatch({b"a": 0})


def test_subword_columns(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(W, "TEXTS", 200)                      # several slices of a batch
    rows = [*enumerate(texts(200)), (None, None), (3, "again")]
    df = spark.createDataFrame(rows, "id int, text string").withColumns({"starts": F.lit("old"), "_text2": F.lit(1)}).repartition(3)
    got = W.subword_tokens(df, "text", vocabulary_file())
    assert got.columns == ["id", "text", "_text2", "ids", "word_ids", "starts", "ends"]
    match, seen = W.LongestMatch(vocabulary), 0
    for r in got.collect():
        assert (r.ids, r.word_ids, r.starts, r.ends) == match.text(r.text or "")
        seen += 1
    assert seen == len(rows) and W.subword_tokens(df.limit(0), "text", vocabulary_file()).count() == 0


def test_a_different_word_is_cut_once_for_all_texts(monkeypatch):
    import pyarrow as pa

    from foldwise.operators.subwords import LongestMatch
    match = LongestMatch({bytes([b]): b for b in range(256)} | {b"ab": 256, b" a": 257})
    asked = []
    word = match.word
    monkeypatch.setattr(match, "word", lambda w: asked.append(w) or word(w))
    got = [c.to_pylist() for c in match.texts(pa.array(["ab ab ab", "", " é", "x", "ab  ab"])[1:])]
    assert got[0] == [[], [32, 0xC3, 0xA9], [120], [256, 32, 257, 98]]
    assert got[1] == [[], [1, 1, 1], [0], [0, 1, 2, 2]]
    assert got[2] == [[], [0, 1, 2], [0], [0, 2, 3, 5]] and got[3] == [[], [1, 2, 2], [1], [2, 3, 5, 6]]
    assert sorted(asked) == ["", " ", " ab", " é", "ab", "x"]


def test_span_passes_hold_few_elements(monkeypatch):
    import pyarrow as pa

    from foldwise.operators import spans as S
    monkeypatch.setattr(S, "ELEMENTS", 10)
    rows = [[1] * n for n in (4, 6, 3, 25, 0, 2, 9)] + [None, [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(range(len(rows)))], names=["l", "i"])
    parts = list(S.slices(batch, ["l"]))
    assert [p.column("i").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5], [6, 7, 8]]
    assert sum((p.column("i").to_pylist() for p in parts), []) == list(range(len(rows)))
