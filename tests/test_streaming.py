"""Streaming scores equal the batch metrics on the same map files."""

import numpy as np
import pytest

from salient.operators import metrics as M
from salient.sources import tables as T
from salient.streaming import scoring as SS


def test_stream_scores_match_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    maps = [(i, [float(v) for v in rng.normal(size=16)], "m", "e1" if i % 2 else "e2") for i in range(20)]
    df = spark.createDataFrame(maps, "sample_id BIGINT, e ARRAY<DOUBLE>, model STRING, explainer STRING")
    src = str(tmp_path / "maps")
    T.write_explanations(df.filter("sample_id < 10"), src, mode="append")
    T.write_explanations(df.filter("sample_id >= 10"), src, mode="append")
    out, summ = str(tmp_path / "scores"), str(tmp_path / "summary")
    SS.run_available(spark, src, out, summ)
    got = {(r["metric"], r["sample_id"]): r["score"] for r in spark.read.parquet(out).collect()}
    assert len(got) == 40
    ref = {r["sample_id"]: r["score"] for r in M.complexity(df).collect()}
    for i in range(20):
        assert got[("complexity", i)] == pytest.approx(ref[i], abs=1e-12)
    summary = {(r["explainer"], r["metric"]): r["n"] for r in spark.read.parquet(summ).collect()}
    assert summary == {("e1", "complexity"): 10, ("e2", "complexity"): 10, ("e1", "sparseness"): 10,
                       ("e2", "sparseness"): 10}
