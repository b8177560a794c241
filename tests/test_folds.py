import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.constants import TARGETS
from foldwise.operators import batching as B
from foldwise.operators import columns as P
from foldwise.operators import folds as K
from foldwise.plans import tables as T
from foldwise.plans.scratch import written
from tests.conftest import SF01


def test_deal_folds_sizes_and_strata(spark):
    d = K.deal_folds(T.labelled_docs(spark, SF01), "doc_id", ["quality", "toxic"], k=5, seed=42)
    sizes = sorted(r["n"] for r in K.fold_sizes(d).collect())
    assert sizes == [79, 80, 80, 80, 80]
    per = d.groupBy("quality", "toxic").pivot("fold", list(range(5))).count().fillna(0).collect()
    for r in per:
        counts = [r[str(i)] for i in range(5)]
        assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_deal_folds_independent_of_partitioning(spark, parts):
    base = K.deal_folds(T.labelled_docs(spark, SF01), "doc_id", ["quality", "toxic"])
    other = K.deal_folds(T.labelled_docs(spark, SF01).repartition(parts), "doc_id", ["quality", "toxic"])
    a = {r["doc_id"]: r["fold"] for r in base.collect()}
    b = {r["doc_id"]: r["fold"] for r in other.collect()}
    assert a == b


def test_quota_folds_properties(spark):
    e = T.essays(spark, SF01)
    results = []
    for parts in (1, 7):
        f = K.stratified_folds(e.repartition(parts), "text_id", TARGETS, k=5, seed=42)
        results.append({r["text_id"]: r["fold"] for r in f.collect()})
        assert len(results[-1]) == e.count()
        assert set(results[-1].values()) == set(range(5))
        sizes = [r["n"] for r in K.fold_sizes(f).collect()]
        assert max(sizes) - min(sizes) <= 2
        bal = K.fold_balance(f, TARGETS, 5).agg(F.max("spread")).first()[0]
        assert bal <= 5
    assert results[0] == results[1]


def test_quota_beats_deal_on_value_balance(spark):
    e = T.essays(spark, SF01)
    q = K.fold_balance(K.stratified_folds(e, "text_id", TARGETS), TARGETS, 5).agg(F.avg("spread")).first()[0]
    d = K.fold_balance(K.deal_folds(e, "text_id", TARGETS), TARGETS, 5).agg(F.avg("spread")).first()[0]
    assert q <= d


def test_with_ordinal_hot_group_dense(spark):
    # one group holds two thirds of the rows; small partitions split it
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long")
    out = P.with_ordinal(df, ["x"], by=["g"], num_partitions=13)
    got = {(r["g"], r["x"]): r["ordinal"] for r in out.collect()}
    for g in {r[0] for r in rows}:
        xs = sorted(x for gg, x in rows if gg == g)
        assert [got[(g, x)] for x in xs] == list(range(len(xs)))


def test_with_ordinal_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x long")
    out = {r["x"]: r["ordinal"] for r in P.with_ordinal(df, ["x"], by=["g"]).collect()}
    assert out == {1: 0, 2: 1, 3: 0}


@pytest.mark.parametrize("size,drop_last", [(1, False), (1, True), (10, False), (10, True), (11, False), (11, True)])
def test_batches_edge_sizes(spark, size, drop_last):
    n = 10
    df = spark.createDataFrame([(i,) for i in range(n)], "id long")
    b = B.batches(df, size, ["id"], drop_last=drop_last).collect()
    expect = n - (n % size) if drop_last else n
    assert len(b) == expect
    for r in b:
        assert r["batch"] == r["id"] // size
    cnt = B.batch_counts(df, size, drop_last).first()["batches"]
    assert cnt == (n // size if drop_last else -(-n // size))


def test_shuffle_reseeds_per_epoch(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    a = [r["id"] for r in B.shuffle(df, "id", 1, epoch=0).orderBy("ordinal").collect()]
    b = [r["id"] for r in B.shuffle(df, "id", 1, epoch=1).orderBy("ordinal").collect()]
    c = [r["id"] for r in B.shuffle(df, "id", 2, epoch=0).orderBy("ordinal").collect()]
    assert sorted(a) == list(range(50)) and a != b and b == c


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_with_ordinal_random_groups_match_pandas(spark, parts):
    import random
    rnd = random.Random(parts)
    rows = [(i, rnd.choice([None, "a", "b", "hot", "hot", "hot"]), rnd.randint(0, 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, x int").repartition(5)
    got = {r["id"]: r["ordinal"] for r in P.with_ordinal(df, ["x", "id"], by=["g"], num_partitions=parts).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "g", "x"]).fillna({"g": "<null>"})
    pdf["o"] = pdf.sort_values(["x", "id"]).groupby("g").cumcount()
    assert got == dict(zip(pdf["id"], pdf["o"]))
    glob = {r["id"]: r["ordinal"] for r in P.with_ordinal(df, ["x", "id"], num_partitions=parts, start=1).collect()}
    assert sorted(glob.values()) == list(range(1, 401))
    assert glob == dict(zip(pdf.sort_values(["x", "id"])["id"], range(1, 401)))


@pytest.mark.parametrize("drop_last", [False, True])
def test_batches_match_direct_form_on_random_groups(spark, drop_last):
    import random
    rnd = random.Random(17)
    rows = [(i, rnd.choice([None, "r1", "r2", "r2"]), rnd.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, run string, x double").repartition(4)
    for size in (1, 4, 7):
        got = {r["id"]: r["batch"] for r in B.batches(df, size, ["x", "id"], drop_last, by=["run"]).collect()}
        want = {}
        for g in {r[1] for r in rows}:
            members = sorted([r for r in rows if r[1] == g], key=lambda r: (r[2], r[0]))
            keep = len(members) // size * size if drop_last else len(members)
            want.update({r[0]: j // size for j, r in enumerate(members[:keep])})
        assert got == want, size
        counts = {r["run"]: r["batches"] for r in B.batch_counts(df, size, drop_last, by=["run"]).collect()}
        assert counts == {g: (len([r for r in rows if r[1] == g]) // size if drop_last
                              else -(-len([r for r in rows if r[1] == g]) // size)) for g in {r[1] for r in rows}}


def test_quota_folds_with_null_labels(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}", None if i % 11 == 0 else i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, s string, x int")
    f = K.stratified_folds(df, "id", ["s", "x"])
    assert sorted(r["id"] for r in f.collect()) == list(range(500))
    sizes = [r["n"] for r in K.fold_sizes(f).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
    for t in ("s", "x"):
        per = f.groupBy(t).pivot("fold", list(range(5))).count().fillna(0).collect()
        assert all(max(r[str(i)] for i in range(5)) - min(r[str(i)] for i in range(5)) <= 5 for r in per)


@pytest.mark.parametrize("block,pool", [(16, 64), (64, 4096)])
def test_quota_folds_over_many_blocks(spark, monkeypatch, block, pool):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "POOL", pool)
    rows = [(i, (i * 7919) % 61, (i * 104729) % 13, i % 2) for i in range(2000)]
    f = K.stratified_folds(spark.createDataFrame(rows, "id int, a int, b int, c int"), "id", ["a", "b", "c"])
    got = f.collect()
    assert sorted(r["id"] for r in got) == list(range(2000)) and {r["fold"] for r in got} == set(range(5))
    sizes = [r["n"] for r in K.fold_sizes(f).collect()]
    assert max(sizes) - min(sizes) <= 2
    assert all(r["spread"] <= 5 for r in K.fold_balance(f, ["a", "b", "c"], 5).collect())
    by = {}
    for r in got:                                   # every combination gives each fold floor(n/k) rows or one more
        by.setdefault((r["a"], r["b"], r["c"]), [0] * 5)[r["fold"]] += 1
    assert all(set(c) <= {sum(c) // 5, sum(c) // 5 + 1} for c in by.values())


def test_quota_folds_on_tens_of_thousands_of_combinations(spark):
    """Five targets of nine values each: level cells, and the same folds however the rows are partitioned."""
    targets = ["a", "b", "c", "d", "e"]
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, shuffles in ((1, 8), (32, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            df = spark.range(0, 40_000, 1, parts).select("id", *[F.pmod(F.xxhash64("id", F.lit(t)), F.lit(9)).cast("int").alias(t) for t in targets])
            f = written(K.stratified_folds(df, "id", targets))
            seen.add(f.agg(F.sum(F.xxhash64("id", "fold").cast("decimal(38,0)"))).first()[0])
            sizes = [r["n"] for r in K.fold_sizes(f).collect()]
            assert max(sizes) - min(sizes) <= 2
            assert K.fold_balance(f, targets, 5).agg(F.max("spread")).first()[0] <= 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_moves_lower_the_squares():
    rng = np.random.default_rng(4)
    for _ in range(20):
        k, n = int(rng.integers(2, 6)), int(rng.integers(1, 80))
        cells = rng.integers(0, 7, (n, 3)) + np.array([0, 7, 14])
        held = rng.random((n, k)) < 0.4
        sums = np.stack([[held[(cells == c).any(1), f].sum() for f in range(k)] for c in range(21)])
        sizes = held.sum(0)
        rows, start = held.sum(1), (sums ** 2).sum() + K.SIZE_WEIGHT * (sizes ** 2).sum()
        K.move_rows(held, cells, sums, sizes)
        assert (held.sum(1) == rows).all() and (held.sum(0) == sizes).all()
        assert (sums == np.stack([[held[(cells == c).any(1), f].sum() for f in range(k)] for c in range(21)])).all()
        end = (sums ** 2).sum() + K.SIZE_WEIGHT * (sizes ** 2).sum()
        assert end <= start
        for i in range(n):                           # no single move is left that lowers them
            for a in np.flatnonzero(held[i]):
                for b in np.flatnonzero(~held[i]):
                    assert (sums[cells[i], a] - sums[cells[i], b] - 1).sum() + K.SIZE_WEIGHT * (sizes[a] - sizes[b] - 1) <= 0


def test_with_ordinal_ties_and_descending(spark):
    df = spark.createDataFrame([(i, i % 4, None if i == 9 else i % 3) for i in range(40)], "id int, g int, x int")
    tied = P.with_ordinal(df, ["x"], by=["g"]).collect()
    for g in range(4):
        mine = sorted((r["ordinal"], -1 if r["x"] is None else r["x"]) for r in tied if r["g"] == g)
        assert [o for o, _ in mine] == list(range(10)) and [x for _, x in mine] == sorted(x for _, x in mine)
    down = {r["id"]: r["ordinal"] for r in P.with_ordinal(df, [("id", "desc")]).collect()}
    assert down == {i: 39 - i for i in range(40)}


def test_hashed_ordinal_equals_the_general_one(spark):
    from foldwise.functions.hashing import seeded_key
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(300)], "id int, g int").withColumn("k", seeded_key(1, "id"))
    a = {r["id"]: r["ordinal"] for r in P.with_hashed_ordinal(df, "k", ["id"], by=["g"], across=True).collect()}
    b = {r["id"]: r["ordinal"] for r in P.with_ordinal(df, ["g", "k", "id"]).collect()}
    c = {r["id"]: r["ordinal"] for r in P.with_hashed_ordinal(df, "k", ["id"], by=["g"], start=1).collect()}
    d = {r["id"]: r["ordinal"] for r in P.with_ordinal(df, ["k", "id"], by=["g"], start=1).collect()}
    assert a == b and c == d


def test_ordinals_of_small_groups_need_no_counts(spark):
    from foldwise.plans.checks import plan_text
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    want = {r["id"]: r["o"] for r in P.with_hashed_ordinal(df, "k", ["id"], by=["g"], name="o", start=1).collect()}
    small = P.with_hashed_ordinal(df, "k", ["id"], by=["g"], name="o", start=1, largest=100)
    assert "Join" not in plan_text(small, "simple")
    assert want == {r["id"]: r["o"] for r in small.collect()}
    for largest in (1 << 17, 1 << 22, 1 << 40):
        assert want == {r["id"]: r["o"] for r in P.with_hashed_ordinal(df, "k", ["id"], by=["g"], name="o", start=1, largest=largest).collect()}
