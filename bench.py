"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is run to completion (``write`` to the no-op sink) after an
untimed JVM warm-up on the smallest test folder.  The scorer and prepared
(input, prediction) table are built by the first query that needs them and
reused by later ones, as the prepared dataset is in the benchmark workflow.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "deletion_gradient_input",
    "insertion_saliency",
    "mu_fidelity",
    "complexity",
    "sparseness",
    "integrated_gradients",
    "smoothgrad",
    "occlusion",
    "rise",
    "sobol",
    "hsic",
    "lime",
    "kernel_shap",
    "random_logit",
    "model_randomization",
    "detection_manifest",
    "recognition_manifest",
    "caption_manifest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from salient.session import get_spark
    from salient.plans.catalog import QUERIES

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = sys.argv[1:] or [q for q in HEADLINE if q in QUERIES]
    # JVM warm-up on the smallest test folder (separate inputs, nothing shared with the timed runs)
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for q in ("deletion_gradient_input", "complexity"):
        QUERIES[q](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
