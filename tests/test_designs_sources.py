"""Designs, hashing, sources and partition independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from salient.functions.hashing import hash_uniform, sql_uniform
from salient.operators import designs as D
from salient.operators import metrics as M
from salient.operators import scoring as S
from salient.plans.verify import duck
from salient.sources import tables as T
from tests.conftest import SMOKE
from tests.helpers import model, samples_df, softmax, targets_df


def test_hash_uniform_matches_duckdb(spark):
    got = {r["id"]: r["u"] for r in spark.range(200).select("id", hash_uniform(9, F.col("id"), 3).alias("u")).collect()}
    con = duck(SMOKE)
    want = dict(con.execute(f"SELECT range AS id, {sql_uniform(9, 'range', '3')} AS u FROM range(200)").fetchall())
    assert all(0 < v < 1 for v in got.values())
    assert got == want


def test_sobol_stratification_and_binary(spark):
    pts = np.zeros((64, 30))
    for r in D.sobol_design(spark, 64, 30).collect():
        pts[r["draw"], r["cell"]] = r["m"]
    for i in range(30):
        assert len(set(np.floor(pts[:, i] * 64).astype(int))) == 64
    b = {r["m"] for r in D.sobol_design(spark, 16, 5, binary=True).collect()}
    assert b <= {0.0, 1.0}


def test_primitive_polynomials():
    assert D.primitive_polynomials(6) == ((1, 3), (2, 7), (3, 11), (3, 13), (4, 19), (4, 25))


def test_replicated_design(spark):
    a = D.uniform_design(spark, 3, 4, seed=1)
    b = D.uniform_design(spark, 3, 4, seed=2)
    rep = D.replicated_design(a, b, 4)
    assert rep.filter(F.col("block") == "C").count() == 3 * 4 * 4
    A = {(r["draw"], r["cell"]): r["m"] for r in a.collect()}
    B = {(r["draw"], r["cell"]): r["m"] for r in b.collect()}
    for r in rep.filter(F.col("block") == "C").collect():
        want = B[(r["draw"], r["cell"])] if r["cell"] == r["rep"] else A[(r["draw"], r["cell"])]
        assert r["m"] == want


def test_off_class_never_true(spark):
    df = spark.range(500).select("id", (F.col("id") % 10).cast("int").alias("t"))
    off = df.select("t", D.off_class(F.col("t"), 10, 42, F.col("id")).alias("o")).collect()
    assert all(r["o"] != r["t"] and 0 <= r["o"] < 10 for r in off)


def test_predictions_and_udf_scorer(spark):
    rng = np.random.default_rng(5)
    W, X = rng.normal(size=(4, 6)), rng.normal(size=(10, 6))
    X[0] = 0.0  # all logits tie -> lowest class
    mdl = model(spark, W)
    smp = samples_df(spark, X)
    pred = {r["sample_id"]: r for r in S.predictions(mdl, smp).collect()}
    for i in range(10):
        p = softmax(W @ X[i])
        assert pred[i]["pred"] == int(np.argmax(p))
        assert pred[i]["p_pred"] == pytest.approx(p.max(), abs=1e-12)
        assert pred[i]["one_hot"] == [1.0 if c == np.argmax(p) else 0.0 for c in range(4)]
    t = np.argmax(X @ W.T, axis=1)
    udf = {r["sample_id"]: r["score"] for r in
           S.udf_scorer(smp.join(targets_df(spark, t), "sample_id"), S.numpy_linear_softmax(W)).collect()}
    lin = {r["sample_id"]: r["score"] for r in S.target_scores(mdl, smp, targets_df(spark, t)).collect()}
    for i in range(10):
        assert udf[i] == pytest.approx(lin[i], abs=1e-12)


def test_interrupted_and_second_builds(spark, tmp_path):
    path = str(tmp_path / "prep")
    # what a build left that was interrupted while it wrote
    spark.range(3).write.parquet(path + "/build-left")
    with pytest.raises(FileNotFoundError):
        T.materialize_or_load(spark, path, None)

    def failing():
        raise RuntimeError("interrupted")

    with pytest.raises(RuntimeError):
        T.materialize_or_load(spark, path, failing)
    assert T.materialize_or_load(spark, path, lambda: spark.range(5)).count() == 5

    def slow():  # another builder finishes while this one builds
        assert T.materialize_or_load(spark, other, lambda: spark.range(7)).count() == 7
        return spark.range(8)

    other = str(tmp_path / "two")
    assert T.materialize_or_load(spark, other, slow).count() == 7
    assert T.materialize_or_load(spark, other, None).count() == 7


def test_explanations_roundtrip_and_missing(spark, tmp_path):
    maps = spark.createDataFrame([(1, [0.1, 0.2], "m", "e1"), (2, [0.3, 0.4], "m", "e2")],
                                 "sample_id BIGINT, e ARRAY<DOUBLE>, model STRING, explainer STRING")
    path = str(tmp_path / "maps")
    T.write_explanations(maps, path)
    back = T.read_explanations(spark, path, "m", "e2").collect()
    assert [(r["sample_id"], r["e"]) for r in back] == [(2, [0.3, 0.4])]
    smp = spark.createDataFrame([(1, [0.0, 0.0]), (3, [0.0, 0.0])], "sample_id BIGINT, x ARRAY<DOUBLE>")
    preds = spark.createDataFrame([(1, 0), (3, 0)], "sample_id BIGINT, pred INT")
    with pytest.raises(Exception, match="has no explanation"):
        M.metric_triplets(smp, preds, T.read_explanations(spark, path), check=True).collect()


def test_materialize_or_load(spark, tmp_path):
    path = str(tmp_path / "prep")
    built = T.materialize_or_load(spark, path, lambda: spark.range(5))
    again = T.materialize_or_load(spark, path, None)
    assert built.count() == again.count() == 5
    with pytest.raises(FileNotFoundError):
        T.materialize_or_load(spark, str(tmp_path / "nothing"), None)


def test_summary_counts_undefined(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "metric STRING, score DOUBLE")
    r = T.summarize_scores(df, keys=("metric",)).first()
    assert (r["mean_score"], r["n"], r["n_undefined"]) == (2.0, 3, 1)


def test_result_independent_of_partitioning(spark):
    from salient.plans import fixtures as fx
    from salient.operators import explainers as E
    a = fx.samples(spark, SMOKE)
    mdl = fx.model(a)
    tgt = fx.targets(mdl, a)
    one = {(r["sample_id"], r["pos"]): r["e"] for r in E.gradient_input(mdl, a.repartition(1), tgt).collect()}
    many = {(r["sample_id"], r["pos"]): r["e"] for r in E.gradient_input(mdl, a.repartition(13, "sample_id"), tgt).collect()}
    assert one.keys() == many.keys()
    assert all(abs(one[k] - many[k]) < 1e-12 for k in one)


def test_contracts(spark):
    from salient.operators import explainers as E
    from salient.operators.masking import Shape, step_thresholds
    from tests.helpers import arrays_df
    rng = np.random.default_rng(9)
    W, X = rng.normal(size=(2, 4)), rng.normal(size=(2, 4))
    mdl, smp, tgt = model(spark, W), samples_df(spark, X), targets_df(spark, [0, 1])
    trip = smp.join(tgt, "sample_id").join(arrays_df(spark, X), "sample_id")
    with pytest.raises(ValueError):
        M.causal_curve(mdl, trip, "sideways")
    with pytest.raises(ValueError):
        step_thresholds(spark, 4, 5, max_pct=0.0)
    with pytest.raises(ValueError):
        step_thresholds(spark, 4, 1)
    with pytest.raises(ValueError):
        E.sobol_attribution(mdl, smp, tgt, Shape(2, 2, 1), grid_size=2, nb_design=6)
    with pytest.raises(ValueError):
        E.integrated_gradients(mdl, smp, tgt, steps=1)
    with pytest.raises(ValueError):
        E.sobol_attribution(mdl, smp, tgt, Shape(2, 2, 1), grid_size=2, nb_design=4, perturbation="melting")


def test_partitions_follow_the_plans_size(spark):
    from salient.session import PARTITION_BYTES, partitions_for
    slots = spark.sparkContext.defaultParallelism
    assert partitions_for(spark.range(10)) == slots
    assert partitions_for(spark.range(40 * PARTITION_BYTES // 8 * slots)) == 40 * slots


def test_read_samples_is_a_plain_scan(spark):
    from tests.conftest import SMOKE
    plan = T.read_samples(spark, f"{SMOKE}/embeddings.parquet")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_missing_map_is_an_error(spark, tmp_path):
    path = str(tmp_path / "maps")
    T.write_explanations(spark.createDataFrame([(1, [1.0], "m", "e")], T.MAP_SCHEMA), path)
    assert T.read_explanations(spark, path, "m", "e").count() == 1
    for pair in (("m", "other"), ("other", "e")):
        with pytest.raises(FileNotFoundError):
            T.read_explanations(spark, path, *pair)
    with pytest.raises(FileNotFoundError):
        T.read_explanations(spark, str(tmp_path / "none"))


def test_triplets_without_map_or_prediction_are_an_error(spark):
    smp = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "sample_id long, x array<double>")
    preds, maps = spark.createDataFrame([(1, 0), (2, 0)], "sample_id long, pred int"), spark.createDataFrame([(1, [1.0]), (2, [1.0])], "sample_id long, e array<double>")
    assert M.metric_triplets(smp, preds, maps).count() == 2
    with pytest.raises(Exception, match="sample 2 has no explanation"):
        M.metric_triplets(smp, preds, maps.where("sample_id = 1")).collect()
    with pytest.raises(Exception, match="sample 2 has no prediction"):
        M.metric_triplets(smp, preds.where("sample_id = 1"), maps).collect()
    assert M.metric_triplets(smp, preds, maps.where("sample_id = 1"), check=False).count() == 1


def test_building_triplets_runs_no_job(spark):
    smp = spark.createDataFrame([(1, [1.0])], "sample_id long, x array<double>")
    preds, maps = spark.createDataFrame([(1, 0)], "sample_id long, pred int"), spark.createDataFrame([(1, [1.0])], "sample_id long, e array<double>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("triplets", "building")
    trip = M.metric_triplets(smp, preds, maps)
    assert not tracker.getJobIdsForGroup("triplets")
    assert trip.collect()[0]["target"] == 0 and tracker.getJobIdsForGroup("triplets")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace
    from salient.session import ensure_checkpoint_dir
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(far)


def test_changed_input_is_prepared_anew(spark, tmp_path):
    from salient.plans import fixtures as fx
    path = str(tmp_path / "sf")
    rows = lambda n: spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(n)], "vec_id long, embedding array<float>, label int")
    rows(4).write.parquet(f"{path}/embeddings.parquet")
    first = fx.setup(spark, path)
    assert fx.setup(spark, path)[0] is not None and first[0].count() == 4 and fx.setup(spark, path)[1] is first[1]
    rows(6).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    assert fx.setup(spark, path)[0].count() == 6
