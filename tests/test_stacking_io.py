import pytest
from pyspark.sql import functions as F

from foldwise.operators import columns as P
from foldwise.operators import joins as J
from foldwise.operators import stacking as G
from foldwise.plans.checks import pushed_filters
from foldwise.sources import files as S


def _out(spark, src, rows):
    return spark.createDataFrame([(i, src, float(a), float(b), float(t)) for i, a, b, t in rows],
                                 "text_id string, src int, p_a double, p_b double, target double")


def test_stack_four_files_with_clashing_targets(spark):
    outs = [_out(spark, s, [("x", s, 10 + s, 1.0), ("y", 2 * s, 20 + s, 2.0)]) for s in range(4)]
    long = J.union_all(outs)
    tab = {r["text_id"]: r["features"] for r in G.stack_table(long, "text_id", ["p_a", "p_b"], 4).collect()}
    assert tab["x"] == [0.0, 10.0, 1.0, 11.0, 2.0, 12.0, 3.0, 13.0]
    wide = [P.rename(o.drop("src"), {"p_a": f"p_a_label_{i}", "p_b": f"p_b_label_{i}"}) for i, o in enumerate(outs)]
    chain = J.join_all(wide, ["text_id"], drop_right=["target"])
    assert set(chain.columns) == {"text_id", "target", *G.feature_names(["p_a", "p_b"], 4)}
    named = G.stack_wide(G.stack_table(long, "text_id", ["p_a", "p_b"], 4), ["p_a", "p_b"], 4)
    assert sorted(chain.drop("target").collect()) == sorted(named.select(*chain.drop("target").columns).collect())


def test_stack_duplicate_source_raises(spark):
    outs = [_out(spark, 0, [("x", 1, 1, 1)]), _out(spark, 0, [("x", 2, 2, 1)]), _out(spark, 1, [("x", 3, 3, 1)])]
    with pytest.raises(Exception):
        G.stack_table(J.union_all(outs), "text_id", ["p_a", "p_b"], 2).collect()


def test_null_key_join_and_duplicates(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "key string, a int")
    b = spark.createDataFrame([(None, 10), ("k", 20), ("k", 30)], "key string, b int")
    assert J.join_outputs(a, b, "key").count() == 2
    assert J.join_outputs(a, b, "key", null_safe=True).count() == 3
    assert J.duplicate_keys(b, "key").first()["count"] == 2
    with pytest.raises(ValueError):
        J.assert_unique(b, "key")


def test_join_suffixed_rejects_existing_name(spark):
    a = spark.createDataFrame([("k", 1, 5)], "key string, v int, v_y int")
    b = spark.createDataFrame([("k", 2)], "key string, v int")
    with pytest.raises(ValueError):
        J.join_suffixed(a, b, "key")
    a2 = spark.createDataFrame([("k", 1)], "key string, v int")
    assert J.join_suffixed(a2, b, "key").columns == ["key", "v", "v_y"]


def test_wide_long_roundtrip(spark):
    rows = [("a", t, k, f, float(f + (k == "prob"))) for t in ["c", "s"] for k in ["label", "prob"] for f in range(3)]
    long = spark.createDataFrame(rows, "text_id string, target string, kind string, fold int, value double")
    back = P.to_long(P.to_wide(long, ["text_id"], ["c", "s"], ["label", "prob"], range(3)), ["text_id"])
    assert sorted(back.collect()) == sorted(long.collect())


def test_csv_roundtrip_newlines_quotes(spark, tmp_path):
    df = spark.createDataFrame([("1", 'line one\nline "two"', 1.0), ("2", "plain, comma", 2.5)],
                               "text_id string, full_text string, cohesion double")
    S.write_table(df, str(tmp_path / "e.csv"), fmt="csv")
    back = S.read_essays(spark, str(tmp_path / "e.csv"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_fold_layout_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "id int, fold int")
    S.write_folds(df, str(tmp_path / "f"))
    train, valid = P.split_fold(S.read_folds(spark, str(tmp_path / "f")), 3)
    assert any("fold" in f for f in pushed_filters(valid))
    assert valid.count() == 10 and train.count() == 40


def test_run_missing_only_runs_missing(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "run string")
    seen = []

    def work(missing):
        seen.append(sorted(r["run"] for r in missing.collect()))
        return missing.withColumn("v", F.lit(1))

    path = str(tmp_path / "o")
    S.run_missing(spark, keys.filter("run = 'b'"), path, work, ["run"])
    S.run_missing(spark, keys, path, work, ["run"])
    S.run_missing(spark, keys, path, work, ["run"])
    assert seen == [["b"], ["a", "c"]]
    assert spark.read.parquet(path).count() == 3


def test_read_tagged(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"r{i}", i * 1.0)], "text_id string, v double").write.parquet(str(tmp_path / f"f{i}.parquet"))
    paths = [str(tmp_path / f"f{i}.parquet") for i in (2, 0, 1)]
    got = {r["text_id"]: r["src"] for r in S.read_tagged(spark, paths).collect()}
    assert got == {"r2": 0, "r0": 1, "r1": 2}


def test_read_tagged_prefix_paths(spark, tmp_path):
    from foldwise.sources import files as S
    a, ab = str(tmp_path / "out" / "a"), str(tmp_path / "out" / "ab")
    spark.createDataFrame([(1,)], "x int").write.parquet(a)
    spark.createDataFrame([(2,), (3,)], "x int").write.parquet(ab)
    for paths in ([a, ab], [ab, a]):
        got = {r["x"]: r["src"] for r in S.read_tagged(spark, paths, fmt="parquet").collect()}
        assert got == {1: paths.index(a), 2: paths.index(ab), 3: paths.index(ab)}


def test_importable_by_workers_adds_package_folder_once(spark):
    import os

    import foldwise
    env = spark.sparkContext.environment
    before = env.get("PYTHONPATH")
    try:
        env["PYTHONPATH"] = "/some/other/path"
        foldwise.importable_by_workers(spark)
        foldwise.importable_by_workers(spark)
        root = os.path.dirname(os.path.dirname(os.path.abspath(foldwise.__file__)))
        assert env["PYTHONPATH"].split(os.pathsep) == [root, "/some/other/path"]
    finally:
        if before is None:
            env.pop("PYTHONPATH", None)
        else:
            env["PYTHONPATH"] = before
