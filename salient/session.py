"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "salient") -> SparkSession:
    """Build (or reuse) a session tuned for this workload.

    AQE stays on so shuffle partitions coalesce at run time and skewed sample
    groups are split; the UI is off (no server is opened).
    """
    master = master or os.environ.get("SALIENT_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # work per input byte is large here (every sample is scored in many
        # perturbed copies): keep small shuffle partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SALIENT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset (tests, local runs) a fresh local folder is
    created and registered.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="salient-ckpt-")
    spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    return f"{qualified(spark, ensure_checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, so that readers outside Spark find it where Spark writes it: a bare path belongs to the default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString())


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a written table of the shared folder that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


PARTITION_BYTES = 4 << 20  # of files as they lie; rows in a task's sort are many times as large


def partitions_for(df, factor: int = 1) -> int:
    """Partitions for a shuffle of ``df``: from the size of its inputs, without a job, at least ``factor`` for each task slot.

    Files and local rows count by the optimizer's estimate, checkpointed inputs
    by their own number of partitions.  (An estimate for the plan as a whole
    would multiply the sides of joins.)
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            n += leaf.rdd().getNumPartitions()
        else:
            n += -(-int(str(leaf.stats().sizeInBytes())) // PARTITION_BYTES)
    return max(factor * df.sparkSession.sparkContext.defaultParallelism, min(n, 1 << 20))


def materialize(df, key: str | None = None, partitions: int | None = None):
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used where the reference itself materializes (the prepared dataset of inputs
    and predictions, the explanation maps before scoring): the lineage is cut
    and lost executors re-read the files instead of recomputing.  With ``key``
    the table is hash-partitioned by it first and the checkpoint keeps that
    partitioning, so later key-based joins, windows and aggregates need no
    shuffle.  (The write itself runs without adaptive re-planning: a plan
    re-planned at run time does not pass its partitioning on to the
    checkpointed table.)
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if key is not None:
        df = df.repartition(partitions or partitions_for(df), key)
    previous = spark.conf.get("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", previous)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``salient`` importable in Python workers (once per Spark application).

    Functions run by ``mapInPandas`` refer to this package; like ``--py-files``,
    a zip of the package is added with ``addPyFile``, which distributes it to
    every executor and puts it on the workers' path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="salient-pyfiles-"), "salient.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
