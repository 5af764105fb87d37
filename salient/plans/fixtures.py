"""Inputs of the registered queries, read from the driver tables.

``embeddings(vec_id, embedding[64], label)`` provides the samples (an 8x8x1
map, or 4x4x4 when channels are needed) and, through per-label centroids, the
weights of the linear-softmax scorer.  These helpers only give rows in the
schema the operators expect; the operators do the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.operators.masking import Shape
from salient.operators.scoring import LinearSoftmaxModel, predictions, weights_from_centroids
from salient.session import materialize
from salient.sources.tables import read_samples

TAU = 10.0  # fixed: temperature of the centroid scorer
MAP = Shape(8, 8, 1)
MAP_CH = Shape(4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_samples(spark, f"{sf_dir}/embeddings.parquet")


def model(smp: DataFrame, tau: float = TAU) -> LinearSoftmaxModel:
    return LinearSoftmaxModel(weights_from_centroids(smp), tau)


def targets(mdl: LinearSoftmaxModel, smp: DataFrame) -> DataFrame:
    """Predicted class of every sample as ``(sample_id, target)``."""
    return predictions(mdl, smp).select("sample_id", F.col("pred").alias("target"))


_PREPARED: dict[tuple, tuple] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells a table from itself after a change: bytes, files, and the time of the last change of its folder (or file)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = files.getContentSummary(hadoop)
    return path, held.getLength(), held.getFileCount(), files.getFileStatus(hadoop).getModificationTime()


def setup(spark: SparkSession, sf_dir: str):
    """Samples, scorer and predicted targets.

    As with the reference's prepared dataset (P4 + P5: built once per model,
    then reused by every explainer and metric run), the scorer and the
    (input, prediction) table are built once per input folder and Spark
    application and checkpointed; later queries of the same application read
    the written tables while the input stays as it was.  Explanation maps are
    never shared between queries.
    """
    key = (spark.sparkContext.applicationId, *_state(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _PREPARED:
        smp = samples(spark, sf_dir)
        mdl = model(smp)
        prepared = materialize(smp.join(targets(mdl, smp), "sample_id"), key="sample_id")
        _PREPARED[key] = (prepared, mdl)
    prepared, mdl = _PREPARED[key]
    return prepared.select("sample_id", "x", "label"), mdl, prepared.select("sample_id", "target")


def weights_from_samples(smp: DataFrame) -> DataFrame:
    """The raw layer table of the centroid scorer (layer 0 scale, layer 1 centroids)."""
    return weights_from_centroids(smp)
