"""Operators on vectors, labels and sources, and the pipeline."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwise.llm import dedup, langid, mixing, quality, topk
from foldwise.llm.common import crc_mod, saved, table
from foldwise.llm.components import components
from tests.conftest import SF001, SF01


# ---- 1: top-k ----

def brute_top(rows, is_query, k=5):
    import math
    width = max({len(v) for _, v in rows if v}, key=lambda n: sum(len(v or []) == n for _, v in rows), default=0)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if is_query(i)}):
        v = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 0.5, -1.25, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(200)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]                      # one vector, many rows
    rows += [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [1.0]),
             (None, [1.0] * 4), (10, [9.0] * 4), (910, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("id", F.lit(2))
    assert found(topk.top_k(df, F.col("vec_id") % 10 == 0)) == brute_top(rows, lambda i: i % 10 == 0)


def test_top_k_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert found(topk.top_k(spark.createDataFrame(rows, schema), F.lit(True))) == brute_top(rows, lambda i: True)
    assert found(topk.top_k(spark.createDataFrame(rows[:1], schema), F.lit(True))) == []


def test_top_k_repeated_query_id(spark):
    schema = "vec_id long, embedding array<float>"
    for own in (2, 7):
        rows = [(50, [3.0, 4.0])] * own + [(i, [0.1 * i, 0.5]) for i in range(1, 6)] + [(100 + i, [-2.0, 0.1 * i]) for i in range(40)]
        assert found(topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") == 50)) == brute_top(rows, lambda i: i == 50)


# ---- 3: quality ----

def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = quality.classify(docs, labels, F.col("source"), F.col("lang"), learn=crc_mod("doc_id", 5) != 0).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.keep == (r.quality == 1) for r in held) >= 0.95 * len(held)
    good = [r for r in held if r.quality == 1]
    assert sum(r.keep for r in good) >= 0.99 * len(good)


def test_sparse_sites_shrink(spark):
    rows = ([("big", "p", 1)] * 80 + [("big", "p", 0)] * 20 + [("low", "q", 0)] * 90 + [("low", "q", 1)] * 10 + [("one", "r", 0)] + [(None, None, 1)]
            + [("top", "t", 1)] * 95 + [("top", "t", 0)] * 5)
    rates = {r.host: r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, y int")).collect()}
    overall = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    assert abs(rates["big"].host_rate - 0.8) < 0.05 and abs(rates["low"].host_rate - 0.1) < 0.08
    assert 0.2 < rates["one"].host_rate < overall                   # one bad label moves it a little only
    assert overall < rates[None].host_rate < 1
    assert abs(rates["one"].path_rate - rates["one"].host_rate) < 0.2


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "s"), (3, "x " * 20_000, "s"), (None, "text", "t")],
                                 "doc_id long, text string, source string").withColumn("evidence", F.lit(1)).withColumn("y", F.lit(2))
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (9, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels, F.col("source"), F.lit(None)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.classify(docs, labels.limit(0), F.col("source"), F.lit(None)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.col("source"), F.lit(None)).count() == 0


# ---- 4: mixing ----

def cells_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, n long")


def targets_of(spark, **shares):
    return spark.createDataFrame(list(shares.items()), "value string, share double")


def test_raking_meets_both_margins(spark):
    cells = cells_of(spark, [("a", "x", 60), ("a", "y", 10), ("b", "x", 20), ("b", "y", 10)])
    out = mixing.rake(cells, {"source": targets_of(spark, a=0.5, b=0.5), "lang": targets_of(spark, x=0.6, y=0.4)}, rounds=30).collect()
    share = {(r.source, r.lang): r.weight * r.n / 100 for r in out}
    assert abs(share["a", "x"] + share["a", "y"] - 0.5) < 1e-6 and abs(share["a", "x"] + share["b", "x"] - 0.6) < 1e-6
    odds = share["a", "x"] * share["b", "y"] / share["a", "y"] / share["b", "x"]
    assert abs(odds - 60 * 10 / 10 / 20) < 1e-6                       # raking keeps the interaction


def test_raking_odd_cells(spark):
    cells = cells_of(spark, [("a", None, 10), (None, "x", 10), ("a", "x", 0), ("gone", "x", 10)])
    goal = {"source": targets_of(spark, a=0.7, extra=0.3), "lang": mixing.tempered(cells, "lang")}
    out = {(r.source, r.lang): r.weight for r in mixing.rake(cells, goal, rounds=4).collect()}
    assert out["a", None] > 0 and out["a", "x"] == 0 and out["gone", "x"] == 0 and out[None, "x"] == 0


def test_sample_follows_the_probabilities(spark):
    docs = table(spark, SF01, "documents")
    rows = mixing.decided(docs).collect()
    assert len(rows) == 1000 and max(r.probability for r in rows) <= 1
    expected = sum(r.probability for r in rows)
    assert abs(sum(r.sampled for r in rows) - expected) < 4 * expected ** 0.5
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.sampled)


def test_mixing_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "s", "en"), (3, "w " * 20_000, "s", "en"), (None, "a b", "t", "en")],
                                 schema).withColumn("weight", F.lit(1)).withColumn("m0", F.lit(2)).withColumn("n", F.lit(3))
    got = mixing.decided(docs).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got) and sum(r.n_tokens for r in got) == 20_002
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.decided(docs.limit(0)).count() == mixing.sample(docs.limit(0)).count() == 0


def test_a_tiny_cell_does_not_set_the_sample(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice("aaaaaab"), rng.choice(["en", "en", "de"])) for i in range(3000)]
    docs = spark.createDataFrame(rows + [(9000, "three small words", "rare", "xx")], "doc_id long, text string, source string, lang string")
    got = mixing.decided(docs).collect()
    total, kept = sum(r.n_tokens for r in got), sum(r.n_tokens * r.probability for r in got)
    assert abs(kept / total - mixing.BUDGET) < 1e-3 and max(r.probability for r in got) <= 1
    assert sum(r.sampled for r in got) > 0.75 * len(got)
    out = mixing.report(docs)
    assert out["margin_error"] <= mixing.TOLERANCE and abs(out["tokens"] - kept / total) < 1e-9
    # the margins are met: shares in proportion to the tempered targets, but for values that give all they have
    for m in ("source", "lang"):
        have, want = {}, {}
        for r in got:
            have[r[m]] = have.get(r[m], 0) + r.n_tokens
            want[r[m]] = want.get(r[m], 0) + r.n_tokens * r.probability
        rates = {v: want[v] / have[v] ** mixing.TEMPER for v in have if want[v] < 0.999 * have[v]}
        assert max(rates.values()) < 1.01 * min(rates.values())


def test_targets_beyond_the_tokens_are_reported(spark):
    cells = cells_of(spark, [("a", "x", 60), ("a", "y", 10), ("b", "x", 20), ("b", "y", 10)])
    rows, error = mixing.balanced(cells, {"source": targets_of(spark, a=1.0), "lang": targets_of(spark, y=1.0)}, 0.9)
    assert error > 0.5 and all(0 <= r.probability <= 1 for r in rows.collect())


def test_margin_errors_are_one_query(spark):
    """Nulls are values of their own, a margin's differences are summed, and the largest sum counts."""
    rows = [("a", None, 4.0, 5.0, 6.0), ("a", "y", 2.0, 5.0, 2.0), (None, "y", 1.0, 3.0, 2.0), (None, None, 2.0, 3.0, 6.0)]
    cells = saved(spark.createDataFrame(rows, "s string, l string, w double, _g0 double, _g1 double"))
    assert mixing.margin_error(cells, ["s", "l"]) == 1.0
    assert mixing.margin_error(cells.withColumn("_g1", F.col("_g1") + 9), ["s", "l"]) == 17.0


# ---- components and the pipeline ----

@pytest.mark.parametrize("kind,hub", [("bigint", 1000), ("string", 1000), ("bigint", 3)])
def test_components_equal_brute_force(spark, monkeypatch, kind, hub):
    monkeypatch.setattr("foldwise.llm.components.HUB", hub)          # 3: most nodes are dealt to shards
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    name = (lambda x: x) if kind == "bigint" else (lambda x: f"{x:04d}")
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"u {kind}, v {kind}").repartition(7)).collect()
    want = {name(x): name(find(x)) for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_component_search_plans_little_at_a_time(spark, monkeypatch):
    """The driver's memory grows with the plans it makes: each step has a few exchanges, and stars take no round."""
    plans = []

    def counted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return saved(df)

    monkeypatch.setattr("foldwise.llm.components.saved", counted)
    for hub in (1000, 3):
        monkeypatch.setattr("foldwise.llm.components.HUB", hub)
        chain = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(0, i) for i in range(1000, 1100)], "u bigint, v bigint")
        assert {r.root for r in components(chain.repartition(7)).collect()} == {0}
    assert max(plans) <= 6
    plans.clear()
    got = components(chain.coalesce(1)).collect()
    assert len(got) == 501 and {r.root for r in got} == {0} and len(plans) == 1


def test_pipeline_against_direct_stages(spark):
    docs = table(spark, SF001, "documents")
    from tests.llm.test_text_operators import brute_components, vocabulary_path
    from tokenizers import Tokenizer
    rows = [(r.doc_id, r.text) for r in langid.accepted(docs, langid.fit(docs, F.lit(True))).collect()]
    assert len(rows) >= 0.99 * docs.count()                           # clean documents stay
    owners = {}
    for d, t in rows:
        key = "".join(t.split(" ")).translate({c: None for c in range(9, 14)})
        owners[key] = min(owners.get(key, (0, 0)), (-len(t), d)) if key in owners else (-len(t), d)
    kept = {d for _, d in owners.values()}
    rows = [(d, t) for d, t in rows if d in kept]
    kept = {c for _, _, c, _ in brute_components(rows, 5, 80)}
    near = docs.where(F.col("doc_id").isin(sorted(kept)))
    sampled = {r.doc_id: r.text for r in mixing.sample(near).collect()}
    library = Tokenizer.from_file(vocabulary_path())
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {r.doc_id for r in got} == set(sampled) and len(got) == len(sampled)
    for r in got:
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_take_odd_rows(spark):
    """Null ids and texts, repeated rows, a very long text and clashing extra columns through all stages."""
    from tests.llm.test_text_operators import ODD
    text = [r.text for r in table(spark, SF001, "documents").limit(40).collect()]
    rows = [(d, t, "en" if i % 3 else None, "src" if i % 2 else None, len(t or "")) for i, (d, t) in enumerate(ODD)]
    rows += [(100 + i, t, "en", "src", len(t or "")) for i, t in enumerate(text)] * 2 + [(None, text[0] * 200, None, None, 7), (99, None, "fr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"ids": F.lit("x"), "n_tokens": F.lit(0.5), "set": F.lit(1), "_key": F.lit("k"), "c0": F.lit(True), "probability": F.lit(2)})
    now, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, now, SF001))
        n = out.count()
        assert 0 < n <= before, name
        if name != "bpe":
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        now, before = out, n
    assert {f.name: f.dataType.simpleString() for f in now.schema}["ids"] == "array<int>" and "n_tokens" in now.columns   # replaced, as documented
    assert now.where("n_tokens != size(ids)").count() == 0


def test_margins_must_not_clash(spark):
    docs = table(spark, SF001, "documents")
    with pytest.raises(ValueError, match="margins"):
        mixing.sample(docs, {"n": F.col("lang")})


def test_stages_keep_the_columns_and_take_nothing(spark):
    docs = table(spark, SF001, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF001)
        assert empty.columns == docs.columns and empty.count() == 0
    assert dedup.drop_copies(docs).schema.simpleString() == docs.schema.simpleString()
