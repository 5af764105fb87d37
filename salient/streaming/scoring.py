"""Streaming versions of the row-wise metrics and of the score summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.functions.arrays import channel_reduce, entropy, gini
from salient.session import scratch_path
from salient.sources.tables import MAP_SCHEMA

# Row-wise metrics: each map is scored alone, so a stream keeps no state for them.
ROW_WISE = {"complexity": entropy, "sparseness": gini}


def map_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Explanation files (``MAP_SCHEMA``, partitioned by model/explainer) as a stream."""
    reader = spark.readStream.schema(MAP_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def score_map_stream(maps: DataFrame, metrics=("complexity", "sparseness"), channels: int = 1) -> DataFrame:
    """Per-map scores ``(model, explainer, metric, sample_id, score)`` of a (streaming) map table."""
    out = None
    for name in metrics:
        scored = maps.select("model", "explainer", F.lit(name).alias("metric"), "sample_id",
                             ROW_WISE[name](channel_reduce("e", channels)).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def summary_stream(scores: DataFrame) -> DataFrame:
    """Streaming P8: running mean, count and undefined count per (model, explainer, metric)."""
    return (scores.groupBy("model", "explainer", "metric")
            .agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col("score").isNull(), 1).otherwise(0)).cast("bigint").alias("n_undefined")))


def run_available(spark: SparkSession, maps_path: str, out_path: str, summary_path: str | None = None):
    """Score every map file present now (``availableNow`` trigger) and stop.

    Scores are appended to Parquet; the summary, when asked for, is a
    complete-mode aggregate rewritten per micro-batch through ``foreachBatch``.
    Both queries checkpoint to fresh folders under the shared checkpoint folder.
    """
    scores = score_map_stream(map_stream(spark, maps_path))
    q1 = (scores.writeStream.format("parquet").option("path", out_path)
          .option("checkpointLocation", scratch_path(spark, "stream-scores"))
          .outputMode("append").trigger(availableNow=True).start())
    queries = [q1]
    if summary_path:
        def write_summary(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(summary_path)
        q2 = (summary_stream(scores).writeStream.foreachBatch(write_summary)
              .option("checkpointLocation", scratch_path(spark, "stream-summary"))
              .outputMode("complete").trigger(availableNow=True).start())
        queries.append(q2)
    for q in queries:
        q.awaitTermination()
    return queries
