import math

import numpy as np
import pytest

from foldwise.functions import scores as S
from foldwise.operators import ensemble as E
from foldwise.operators import losses as L


def _preds(spark, rows):
    return spark.createDataFrame(rows, "text_id string, fold int, target string, label int, prob double")


def test_vote_ties_go_to_first_seen_label(spark):
    rows = [
        # 2-2-1: labels 1 (folds 1,3) and 2 (folds 0,4) tie at two votes -> 2 seen first
        ("a", 0, "t", 2, 0.2), ("a", 1, "t", 1, 0.9), ("a", 2, "t", 0, 0.5), ("a", 3, "t", 1, 0.7), ("a", 4, "t", 2, 0.4),
        # all different -> fold 0's label
        ("b", 0, "t", 5, 0.1), ("b", 1, "t", 4, 0.2), ("b", 2, "t", 3, 0.3), ("b", 3, "t", 2, 0.4), ("b", 4, "t", 1, 0.5),
        # clear majority
        ("c", 0, "t", 1, 0.5), ("c", 1, "t", 1, 0.7), ("c", 2, "t", 1, 0.9), ("c", 3, "t", 0, 0.1), ("c", 4, "t", 2, 0.1),
    ]
    v = {r["text_id"]: (r["label"], r["prob"]) for r in E.vote(_preds(spark, rows)).collect()}
    assert v["a"][0] == 2 and v["a"][1] == pytest.approx(0.3)
    assert v["b"] == (5, 0.1)
    assert v["c"][0] == 1 and v["c"][1] == pytest.approx(0.7)


def test_vote_single_shuffle(spark):
    from foldwise.plans.checks import exchanges
    rows = [("a", f, "t", f % 2, 0.5) for f in range(5)]
    assert len(exchanges(E.vote(_preds(spark, rows)))) == 1


def test_mean_folds_missing_and_nan(spark):
    df = spark.createDataFrame([("a", 0, "t", 1.0), ("a", 1, "t", None), ("b", 0, "t", float("nan")),
                                ("b", 1, "t", 1.0), ("c", 0, "t", 2.0), ("c", 1, "t", 4.0)],
                               "text_id string, fold int, target string, label double")
    m = {r["text_id"]: r["label"] for r in E.mean_folds(df).collect()}
    assert m["a"] is None and math.isnan(m["b"]) and m["c"] == 3.0
    s = {r["text_id"]: r["label"] for r in E.mean_folds(df, on_missing="skip").collect()}
    assert s["a"] == 1.0


def test_softmax_top_expected(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "z array<double>")
    r = df.select(S.softmax("z").alias("p")).withColumn("t", S.top_level("p")) \
          .withColumn("e", S.expected_score("p")).first()
    p = np.exp([1, 3, 3, 0]) / np.exp([1, 3, 3, 0]).sum()
    assert sum(r["p"]) == pytest.approx(1.0)
    assert r["t"]["level"] == 1 and r["t"]["prob"] == pytest.approx(p[1])
    assert r["e"] == pytest.approx(sum(p * (1 + 0.5 * np.arange(4))))


def test_encode_level_grid(spark):
    ok = spark.createDataFrame([(1.0,), (5.0,), (3.5,)], "s double")
    assert [r[0] for r in ok.select(S.encode_level("s")).collect()] == [0, 8, 5]
    bad = spark.createDataFrame([(2.25,)], "s double")
    with pytest.raises(Exception):
        bad.select(S.encode_level("s")).collect()
    assert ok.select(S.decode_level(S.encode_level("s"))).collect()[1][0] == 5.0


def test_cross_entropy_with_smoothing(spark):
    z = [0.3, -1.2, 2.0, 0.5]
    df = spark.createDataFrame([(z, 2)], "z array<double>, level int")
    got = df.select(L.cross_entropy_expr("z", "level", 0.1)).first()[0]
    logp = np.array(z) - np.log(np.exp(z).sum())
    want = 0.9 * -logp[2] + 0.1 * -logp.mean()
    assert got == pytest.approx(want)


def test_combined_loss_skips_zero_weights(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1, 2.0, 2.5)], "z array<double>, level int, y double, pred double")
    r = L.combined_loss(df, {"cross_entropy": 0.0, "mse": 2.0, "smooth_l1": 1.0}).first()
    assert "cross_entropy" not in r.asDict()
    assert r["loss"] == pytest.approx(2 * 0.25 + 0.5 * 0.25)


def test_token_ce_ignores_minus_100(spark):
    df = spark.createDataFrame([([1.0, 2.0], -100), ([1.0, 2.0], 1)], "z array<double>, t int")
    vals = [r[0] for r in df.select(L.token_ce_expr("z", "t")).collect()]
    assert vals[0] == 0.0 and vals[1] == pytest.approx(np.log(1 + np.exp(-1)))


def test_batch_mean_vs_row_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "batch int, loss double")
    r = L.batch_mean_loss(df).first()
    assert r["batch_mean"] == 5.0 and r["row_mean"] == 4.0


def _python_vote(votes):
    """votes: [(fold, label, prob)] -> (label, prob) by the reference's rule: count,
    strictly more wins, so a tie keeps the label met first in fold order."""
    counts, probs = {}, {}
    for f, lab, p in sorted(votes):
        counts[lab] = counts.get(lab, 0) + 1
        probs.setdefault(lab, []).append(p)
    best = None
    for lab in counts:                       # insertion order = first seen in fold order
        if best is None or counts[lab] > counts[best]:
            best = lab
    return best, sum(probs[best]) / len(probs[best])


def test_vote_matches_direct_form_on_random_folds(spark):
    import random
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        for t in ["a", "b"]:
            for f in rnd.sample(range(5), rnd.randint(1, 5)):
                rows.append((f"id{i}", f, t, rnd.randint(0, 2), round(rnd.random(), 3)))
    got = {(r["text_id"], r["target"]): (r["label"], r["prob"]) for r in E.vote(_preds(spark, rows)).collect()}
    groups = {}
    for i, f, t, lab, p in rows:
        groups.setdefault((i, t), []).append((f, lab, p))
    for key, votes in groups.items():
        lab, p = _python_vote(votes)
        assert got[key][0] == lab and math.isclose(got[key][1], p, rel_tol=1e-12), key


def test_wide_cells_are_gathered_without_a_group_per_cell(spark):
    from foldwise.operators import columns as P
    from foldwise.plans.checks import plan_text
    rows = [("a", "t", "label", 0, 1.0), ("a", "t", "prob", 1, float("nan")), ("b", "u", "label", 1, None), ("c", "other", "label", 0, 5.0),
            ("c", None, "label", 0, 6.0)]
    df = spark.createDataFrame(rows, "id string, target string, kind string, fold int, value double")
    wide = P.to_wide(df, ["id"], ["t", "u"], ["label", "prob"], range(2))
    assert wide.columns == ["id"] + [f"{t}_{k}_fold{f}" for t in "tu" for k in ("label", "prob") for f in range(2)]
    text = plan_text(wide, "simple")
    assert "pivotfirst" not in text and text.count("Aggregate(") == 2
    got = {r["id"]: r for r in wide.collect()}
    assert got["a"]["t_label_fold0"] == 1.0 and got["a"]["t_prob_fold1"] != got["a"]["t_prob_fold1"]
    assert set(got) == {"a", "b", "c"} and all(x is None for x in got["c"][1:]) and all(x is None for x in got["b"][1:])
