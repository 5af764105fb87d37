"""Sources and sinks for samples, maps and scores.

Samples and maps are Parquet tables keyed by ``sample_id``; map tables are
partitioned by ``model`` and ``explainer`` so one (model, explainer) pair is
read by partition pruning instead of building a path.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SAMPLE_SCHEMA = "sample_id BIGINT, x ARRAY<DOUBLE>, label INT"
MAP_SCHEMA = "sample_id BIGINT, e ARRAY<DOUBLE>, model STRING, explainer STRING"


def read_samples(spark: SparkSession, path: str, id_col: str = "vec_id", x_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Load ``(sample_id, x, label)``; inputs are widened to DOUBLE.

    A plain scan: no job runs when it is built and nothing is shuffled.  Work
    that needs samples together by key shuffles them where it does (the prepared
    table of inputs and predictions is written hash-partitioned by key).
    """
    return spark.read.parquet(path).select(F.col(id_col).cast("bigint").alias("sample_id"),
                                           F.col(x_col).cast("array<double>").alias("x"),
                                           F.col(label_col).cast("int").alias("label"))


def write_explanations(maps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per sample per (model, explainer), partitioned like the map folders."""
    (maps.select("sample_id", "e", "model", "explainer")
     .write.mode(mode).partitionBy("model", "explainer").parquet(path))


def read_explanations(spark: SparkSession, path: str, model: str | None = None,
                      explainer: str | None = None) -> DataFrame:
    """Load the maps of one (model, explainer); the filters prune partitions.

    A pair without any map is an error, as a missing map folder is (one pruned
    read of at most one row tells).
    """
    try:
        df = spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        raise FileNotFoundError(path) from exc
    if model is not None:
        df = df.filter(F.col("model") == model)
    if explainer is not None:
        df = df.filter(F.col("explainer") == explainer)
    if (model is not None or explainer is not None) and df.select("sample_id").isEmpty():
        raise FileNotFoundError(f"{path} holds no map of model {model!r}, explainer {explainer!r}")
    return df


#: Names the finished build of a prepared table.
PREPARED = "PREPARED"


def materialize_or_load(spark: SparkSession, path: str, build: Callable[[], DataFrame] | None) -> DataFrame:
    """P5: reuse a prepared table if present, else build and save it, else fail.

    Each build is written to a folder of its own below ``path``; when it is
    complete the file ``PREPARED``, made only if it is not there yet, names it.  What
    an interrupted build left is not named and never read, and of two builders
    at once the first to finish is the one that both read.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{PREPARED}")
    files = marker.getFileSystem(conf)

    def named() -> str | None:
        for _ in range(50):
            if not files.exists(marker):
                return None
            stream = files.open(marker)
            try:
                name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if name.endswith("\n"):  # the other builder has closed it
                return name.strip()
            time.sleep(0.1)
        raise TimeoutError(f"{marker.toString()} was never completed")

    found = named()
    if found is None:
        if build is None:
            raise FileNotFoundError(f"no prepared table at {path} and nothing to build it from")
        own = f"build-{uuid.uuid4().hex[:12]}"
        build().write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{own}")
        try:
            stream = files.create(marker, False)
            try:
                stream.write(bytearray(f"{own}\n", "utf-8"))
            finally:
                stream.close()
            found = own
        except Py4JJavaError:  # another builder was first
            found = named()
            if found is None:
                raise
    return spark.read.parquet(f"{path.rstrip('/')}/{found}")


def coverage_matrix(maps: DataFrame) -> DataFrame:
    """``(model, explainer, n_maps)`` for every model and every explainer that occur, 0 where a pair has no map.

    The names are a column of the counted pairs, so no name becomes a column or query text.
    """
    pairs = maps.groupBy("model", "explainer").agg(F.count(F.lit(1)).alias("n"))
    named = pairs.withColumn("every", F.collect_set("explainer").over(Window.partitionBy()))  # one row a pair
    held = named.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("explainer", "n"))).alias("held"),
                                      F.first("every").alias("every"))
    return (held.select("model", "held", F.explode("every").alias("explainer"))
            .select("model", "explainer", F.coalesce(F.col("held")[F.col("explainer")], F.lit(0)).cast("bigint").alias("n_maps")))


def channel_mean(samples: DataFrame, channels: int) -> DataFrame:
    """P10: ``(channel, mean)`` of all inputs, channels last (partial sums in every task, ``channels`` rows out)."""
    return (samples.select(F.posexplode("x").alias("pos", "x"))
            .groupBy((F.col("pos") % channels).cast("int").alias("channel")).agg(F.avg("x").alias("mean")))


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-sample scores as JSON lines, one folder per (model, explainer, metric)."""
    scores.write.mode(mode).partitionBy("model", "explainer", "metric").json(path)


def summarize_scores(scores: DataFrame, keys=("model", "explainer", "metric")) -> DataFrame:
    """Mean per metric; undefined scores (NULL) are counted, not averaged."""
    return (scores.groupBy(*keys)
            .agg(F.avg("score").alias("mean_score"),
                 F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col("score").isNull(), 1).otherwise(0)).cast("bigint").alias("n_undefined")))
