"""Training-text pipeline: toxicity, line dedup, near-dedup, decontamination, SentencePiece round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet and read again.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.bottomk_dedup import near_duplicates
from salient.llm.common import prepare, row_key, written
from salient.llm.decontam import contaminated
from salient.llm.line_spread import remove_spread_lines
from salient.llm.sentencepiece_spans import round_trip
from salient.llm.toxicity import toxicity
from salient.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic (score below its threshold)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    row = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return toxicity(row, labels).where("predicted = 0").select("row.*")


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of lines spread over many sites.

    ``n_chars``, where there is one, follows the new text.  Of the documents with
    one text of which nothing but blanks would remain, the first (smallest
    ``doc_id``) keeps its whole text, so that near-dedup decides about copies of
    it elsewhere; the others go.  A document that was blank before stays.
    """
    found = remove_spread_lines(docs).select("row", "clean", "n_removed", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    found = found.withColumn("emptied", (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("clean", r"\s+", " ")) == ""))
    cut = (F.col("n_removed") > 0) & ~F.col("emptied")
    new = {"text": F.when(cut, F.col("clean")).otherwise(F.col("text")),
           "n_chars": F.when(cut, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    rows = found.select(F.struct(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]).alias("row"), "emptied", "doc_id", *row_key(),
                        F.xxhash64("text", F.lit(11)).alias("t1"), F.xxhash64(F.lit(13), "text").alias("t2"))
    # written, so that lines are not cut again for the first of each text
    rows = written(rows, "line-dedup")
    gone = rows.where("emptied")
    first = gone.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    return rows.where("not emptied").select("row.*").unionByName(gone.join(first, ["k1", "k2"], "left_semi").select("row.*"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id (and all rows without id).

    Rows that repeat a kept id with the same text are one document; they are kept once.
    """
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    some = rows.join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi").dropDuplicates(["k1", "k2"])
    return some.select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("k1", "k2").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    return rows.join(found, ["k1", "k2"], "left_anti").select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) of every document that remains."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_spread_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
