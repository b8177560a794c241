import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import pooling as V
from foldwise.operators import spans as S
from foldwise.operators import tokens as K
from foldwise.plans import tables as T
from tests.conftest import SF01


def test_pad_specials_and_single_token(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "c", "d", "e"])], "id int, t array<string>")
    r = {x["id"]: x for x in K.pad(df, "t", 4, "<p>", specials=("<s>", "</s>")).collect()}
    assert r[1]["t"] == ["<s>", "a", "</s>", "<p>"] and r[1]["attention_mask"] == [1, 1, 1, 0]
    assert r[2]["t"] == ["<s>", "a", "b", "</s>"] and r[2]["attention_mask"] == [1, 1, 1, 1]


def test_trim_sum_vs_last_with_hole(spark):
    df = spark.createDataFrame([(0, [1, 0, 1, 0, 0], ["a", "b", "c", "d", "e"]), (0, [1, 1, 0, 0, 0], list("vwxyz"))],
                               "batch int, attention_mask array<int>, tok array<string>")
    s = K.trim_to_batch(df, "batch", ["tok"], how="sum").collect()
    last = K.trim_to_batch(df, "batch", ["tok"], how="last").collect()
    assert {len(r["tok"]) for r in s} == {2} and {len(r["tok"]) for r in last} == {3}


def test_label_codes_unseen_raises(spark):
    train = spark.createDataFrame([(1, ["b", "a"]), (2, ["c"])], "id int, l array<string>")
    codes = K.fit_labels(train, "l")
    assert {r["label"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert K.encode_labels(train, "l", codes, keys=["id"]).where("id = 1").first()["l"] == [1, 0]
    bad = spark.createDataFrame([(1, ["a", "zz"])], "id int, l array<string>")
    with pytest.raises(Exception, match="unseen label"):
        K.encode_labels(bad, "l", codes, keys=["id"]).collect()
    with pytest.raises(ValueError):
        K.encode_labels(bad, "l", codes)


def test_spans_only_ignored_labels(spark):
    df = spark.createDataFrame([(1, [None, 0, 0, 1, None, None], [7, 7])],
                               "doc int, word_ids array<int>, labels array<int>")
    d = S.word_starts(S.word_ids(df))
    assert d.first()["word_ids"] == [-1, 0, 0, 1, -1, -1]
    assert d.first()["word_start"] == [False, True, False, True, False, False]
    t = S.scatter_target(S.align_labels(S.word_ids(df))).first()["target"]
    assert t == [-100] * 6


def test_spans_cursor_counts_ignored_starts(spark):
    df = spark.createDataFrame([(1, [-1, 0, 1, 1, 2, -1], [3, 7, 5])], "doc int, word_ids array<int>, labels array<int>")
    t = S.scatter_target(S.align_labels(df)).first()["target"]
    assert t == [-100, 3, -100, -100, 5, -100]


def _hidden(spark, rows):
    return spark.createDataFrame(rows, "doc int, pos int, mask int, vec array<double>")


def test_pool_all_masked_and_holes(spark):
    df = _hidden(spark, [(1, 0, 0, [1.0, 2.0]), (1, 1, 0, [3.0, 4.0]),
                         (2, 0, 1, [1.0, 5.0]), (2, 1, 0, [9.0, 9.0]), (2, 2, 1, [3.0, -1.0])])
    mean = {r["doc"]: r["pooled"] for r in V.mean_pool(df).collect()}
    mx = {r["doc"]: r["pooled"] for r in V.max_pool(df).collect()}
    mn = {r["doc"]: r["pooled"] for r in V.min_pool(df).collect()}
    assert mean[1] == [0.0, 0.0] and mean[2] == [2.0, 2.0]
    assert mx[1] == [-1e4, -1e4] and mx[2] == [3.0, 5.0]
    assert mn[1] is None and mn[2] == [1.0, -1.0]


def test_attention_pool_weights(spark):
    df = spark.createDataFrame([(1, 0, 1, [1.0, 0.0], 0.0), (1, 1, 1, [0.0, 1.0], 1.0), (1, 2, 0, [5.0, 5.0], 9.0)],
                               "doc int, pos int, mask int, vec array<double>, s double")
    r = V.attention_pool(df, "s").first()["pooled"]
    w = np.exp([0.0, 1.0]) / np.exp([0.0, 1.0]).sum()
    assert r == pytest.approx(list(w))


def test_summarizer_mean_equals_exploded(spark):
    h = T.hidden(spark, SF01)
    ours = V.mean_pool(h, ["doc", "layer"]).select("doc", "layer", F.posexplode("pooled").alias("d", "v"))
    ex = (h.select("doc", "layer", "mask", F.posexplode("vec").alias("d", "x"))
           .groupBy("doc", "layer", "d").agg((F.sum(F.col("x") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-9))).alias("w")))
    bad = ours.join(ex, ["doc", "layer", "d"]).filter(F.abs(F.col("v") - F.col("w")) > 1e-9).count()
    assert bad == 0


def test_project_expr_equals_pandas(spark):
    rng = np.random.default_rng(0)
    W, b = rng.normal(size=(4, 3)), rng.normal(size=3)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "id int, vec array<double>")
    a = {r["id"]: r["proj"] for r in V.project(df, W, b).collect()}
    c = {r["id"]: r["proj"] for r in V.project(df, W, b, method="pandas").collect()}
    for k in a:
        assert a[k] == pytest.approx(c[k])


def test_layers_weighted(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0]), (1, 0, 1, [3.0]), (1, 0, 2, [6.0])],
                               "doc int, pos int, layer int, vec array<double>")
    assert V.pool_layers(df, start=1, weights=[1.0, 2.0]).first()["pooled"] == [5.0]


def test_encode_labels_lists_scalars_and_nulls(spark):
    rows = [(1, ["b", "a", None]), (2, []), (3, ["c", "c"]), (None, ["a"]), (4, None)]
    lists = spark.createDataFrame(rows, "id int, l array<string>")
    codes = K.fit_labels(lists, "l")
    code = {r["label"]: r["code"] for r in codes.collect()}
    assert sorted(code, key=lambda x: (x is not None, x)) == [None, "a", "b", "c"] and sorted(code.values()) == [0, 1, 2, 3]
    # a list column encoded after a repartition: rows are told apart by their keys
    got = {r["id"]: r["l"] for r in K.encode_labels(lists.repartition(5), "l", codes, keys=["id"]).collect()}
    assert got == {i: None if v is None else [code[x] for x in v] for i, v in rows}
    scalars = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, s string")
    sc = K.fit_labels(scalars, "s")
    assert {r["id"]: r["s"] for r in K.encode_labels(scalars, "s", sc).collect()} == {3: 0, 2: 1, 1: 2}


def _python_targets(word_ids, labels, ignore=7):
    """Direct form: the n-th word start takes labels[n]; flagged unless ignored."""
    out, cursor, prev = [], -1, None
    for i, w in enumerate(word_ids):
        w = -1 if w is None else w
        start = w > -1 and (i == 0 or prev != w)
        prev = w
        if start:
            cursor += 1
            lab = labels[cursor] if cursor < len(labels) else None
            out.append(lab if lab is not None and lab != ignore else -100)
        else:
            out.append(-100)
    return out


def test_span_targets_match_direct_form_on_random_ids(spark):
    import random
    rnd = random.Random(11)
    rows = []
    for doc in range(60):
        n = rnd.randint(0, 25)
        ids = [rnd.choice([None, -1, rnd.randint(0, 6)]) if rnd.random() < 0.3 else rnd.randint(0, 6) for _ in range(n)]
        labels = [rnd.randint(0, 7) for _ in range(rnd.randint(0, 12))]
        rows.append((doc, ids, labels))
    df = spark.createDataFrame(rows, "doc int, word_ids array<int>, labels array<int>")
    got = {r["doc"]: r["target"] for r in S.scatter_target(S.align_labels(df)).collect()}
    assert got == {d: _python_targets(i, lab) for d, i, lab in rows}


def _python_pad(tokens, n, pad, specials=None):
    t = list(tokens)
    if specials:
        t = [specials[0]] + t[:n - 2] + [specials[1]]
    real = min(len(t), n)
    return (t + [pad] * n)[:n], [1] * real + [0] * (n - real)


def test_pad_and_trim_match_direct_form_on_random_rows(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for i in range(80):
        toks = [f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 12))]
        mask = [rnd.choice([0, 1]) for _ in range(rnd.choice([0, 3, 6, 6, 9]))]
        rows.append((i, i // 4, toks, mask))
    df = spark.createDataFrame(rows, "id int, batch int, tokens array<string>, m array<int>")
    for specials in (None, ("<s>", "</s>")):
        got = {r["id"]: (r["tokens"], r["attention_mask"])
               for r in K.pad(df, "tokens", 8, "<pad>", specials=specials).collect()}
        assert got == {i: _python_pad(t, 8, "<pad>", specials) for i, _, t, _ in rows}
    for how in ("sum", "last"):
        got = {r["id"]: r["m"] for r in K.trim_to_batch(df, "batch", [], mask="m", how=how).collect()}
        want = {}
        for b in {r[1] for r in rows}:
            members = [r for r in rows if r[1] == b]
            if how == "sum":
                L = max(sum(m) for *_, m in members)
            else:
                L = max(max([j + 1 for j, x in enumerate(m) if x == 1], default=0) for *_, m in members)
            want.update({i: m[:L] for i, _, _, m in members})
        assert got == want, how


def test_trim_batch_of_empty_masks(spark):
    df = spark.createDataFrame([(1, 0, [], []), (2, 0, [], []), (3, 1, ["a"], [0, 0])],
                               "id int, batch int, tokens array<string>, m array<int>")
    for how in ("sum", "last"):
        got = {r["id"]: (r["m"], r["tokens"]) for r in K.trim_to_batch(df, "batch", ["tokens"], mask="m", how=how).collect()}
        assert got == {1: ([], []), 2: ([], []), 3: ([], [])}, how


@pytest.mark.parametrize("width", [1, 4, 64, 65, 300])
def test_pooling_matches_numpy_on_random_groups(spark, width):
    import math
    import random
    rnd = random.Random(21)
    rows = []
    for doc in range(25):
        for pos in range(rnd.randint(1, 7)):
            mask = 0 if doc % 6 == 0 else rnd.choice([0, 1, 1])      # every 6th doc fully masked
            rows.append((doc, pos, mask, [round(rnd.uniform(-3, 3), 3) for _ in range(width)], rnd.uniform(-2, 2)))
    df = spark.createDataFrame(rows, "doc int, pos int, mask int, vec array<double>, s double")
    by_doc = {}
    for doc, pos, m, v, s in rows:
        by_doc.setdefault(doc, []).append((m, np.array(v), s))

    def close(a, b):
        if a is None or b is None:
            return a is None and b is None
        return all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b))

    mean = {r["doc"]: r["pooled"] for r in V.mean_pool(df).collect()}
    mx = {r["doc"]: r["pooled"] for r in V.max_pool(df).collect()}
    mn = {r["doc"]: r["pooled"] for r in V.min_pool(df).collect()}
    att = {r["doc"]: r["pooled"] for r in V.attention_pool(df, "s").collect()}
    for doc, items in by_doc.items():
        real = [(v, s) for m, v, s in items if m == 1]
        vs = np.stack([v for v, _ in real]) if real else None
        assert close(mean[doc], list(vs.mean(0)) if real else [0.0] * width), doc
        assert close(mx[doc], list(vs.max(0)) if real else [-1e4] * width), doc
        assert close(mn[doc], list(vs.min(0)) if real else None), doc
        if real:
            sc = np.array([s for _, s in real])
            w = np.exp(sc - sc.max())
            assert close(att[doc], list((w[:, None] * vs).sum(0) / w.sum())), doc
        else:
            assert att[doc] is None, doc


@pytest.mark.parametrize("width", [3, 130])
def test_word_mean_equals_numpy(spark, width):
    import random
    rnd = random.Random(4)
    rows = []
    for doc in range(12):
        for pos in range(rnd.randint(1, 9)):
            rows.append((doc, pos, rnd.choice([-1, 0, 1, 1, 2, 3]), [round(rnd.uniform(-2, 2), 3) for _ in range(width)]))
    df = spark.createDataFrame(rows, "doc int, pos int, word_id int, vec array<double>")
    got = {(r["doc"], r["pos"]): r["vec"] for r in V.word_mean(df).collect()}
    for doc, pos, w, v in rows:
        want = v if w < 0 else list(np.mean([x for d, _, ww, x in rows if d == doc and ww == w], axis=0))
        assert np.allclose(got[(doc, pos)], want), (doc, pos)


@pytest.mark.parametrize("width", [4, 300])
def test_pooling_rules_do_not_depend_on_the_width(spark, width):
    import math
    nan = float("nan")
    rows = [("hidden nan", 0, [nan] * width), ("hidden nan", 1, [1.0] * width), ("real nan", 1, [nan] * width), ("real nan", 1, [1.0] * width),
            ("mask 2", 2, [5.0] * width), ("mask 2", 1, [2.0] * width), ("null vector", 1, None), ("null vector", 1, [1.0] * width),
            ("null mask", None, [9.0] * width), ("null mask", 1, [1.0] * width), ("no vector", 1, None), ("all hidden", 0, [3.0] * width)]
    df = spark.createDataFrame(rows, "doc string, mask int, vec array<double>")
    mean, mx, mn = ({r["doc"]: r["pooled"] for r in f(df).collect()} for f in (V.mean_pool, V.max_pool, V.min_pool))
    for out, one in ((mean, [1.0] * width), (mx, [1.0] * width), (mn, [1.0] * width)):
        assert out["hidden nan"] == out["null vector"] == out["null mask"] == one and out["no vector"] is None
    assert all(map(math.isnan, mean["real nan"])) and all(map(math.isnan, mx["real nan"])) and mn["real nan"] == [1.0] * width
    assert mean["mask 2"] == [4.0] * width and mx["mask 2"] == [5.0] * width and mn["mask 2"] == [2.0] * width
    assert mean["all hidden"] == [0.0] * width and mx["all hidden"] == [-1e4] * width and mn["all hidden"] is None
    layers = spark.createDataFrame([(1, 0, 0, [1.0] * width), (1, 0, 1, [3.0] * width)], "doc int, pos int, layer int, vec array<double>")
    assert V.pool_layers(layers, 0, [-1.0, 3.0]).first()["pooled"] == [4.0] * width
    assert V.pool_layers(layers, 0, [0.0, 0.0]).first()["pooled"] is None
    mixed = spark.createDataFrame([(1, 1, [1.0] * width), (1, 1, [1.0] * (width + 1))], "doc int, mask int, vec array<double>")
    with pytest.raises(Exception, match="differ in width"):
        V.mean_pool(mixed).collect()



def test_encode_splits_heavy_hitters(spark, monkeypatch):
    """The ids are those of a plain lookup, whatever share is heavy; long and null tokens join."""
    rng = random.Random(12)
    stock = ["the"] * 500 + ["of"] * 120 + [f"w{i}" for i in range(300)] + ["x" * 90] * 40 + [None] * 60
    rows = [(i, [rng.choice(stock) for _ in range(rng.randint(0, 30))]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc int, tokens array<string>")
    train = df.where("doc % 3 != 0")
    want = None
    for heavy in (1, 8, 4096):
        monkeypatch.setattr(K, "HEAVY", heavy)
        vocab = K.fit_vocab(train, "tokens")
        known = {r.token: r.id for r in vocab.collect()}
        assert sorted(known.values()) == list(range(len(known)))
        got = sorted((r.doc, r.pos, r.ids) for r in K.encode(df, "tokens", vocab, ["doc"]).collect())
        assert got == sorted((d, p, known.get(t, -1)) for d, ts in rows for p, t in enumerate(ts))
        assert got == sorted((r.doc, r.pos, r.ids) for r in K.encode(df, "tokens", vocab.drop("count"), ["doc"]).collect())
        assert want in (None, got)
        want = got


def test_few_labels_are_coded_inside_their_rows(spark, monkeypatch):
    from foldwise.plans.checks import exchanges
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, [None, "c"])]
    df = spark.createDataFrame(rows, "id int, l array<string>")
    codes = K.fit_labels(df, "l")
    few = K.encode_labels(df, "l", codes, keys=["id"])
    assert exchanges(few) == []
    got = {r["id"]: r["l"] for r in few.collect()}
    monkeypatch.setattr(K, "HEAVY", 1)
    many = K.encode_labels(df, "l", codes, keys=["id"])
    assert exchanges(many) != [] and got == {r["id"]: r["l"] for r in many.collect()}
    assert got[2] == [] and got[3] is None and got[1][0] == got[1][2] == got[1][1] + 1
