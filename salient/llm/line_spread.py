"""Cross-site boilerplate lines by their spread over distinct sites.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; the
sketches merge by aggregation.  Lines whose estimate lies near the threshold get
an exact distinct count.  Lines on enough sites are removed everywhere but at
their first occurrence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from salient.llm.common import prepare, row_key, written

#: Sites from which a line is boilerplate.
MIN_SITES = 8
#: log2 of the sketch's registers; the standard error is 1.04 / sqrt(2^LG_K).
LG_K = 10
#: Estimates within this share of the threshold (over four standard errors) are counted exactly.
NEAR = 0.15


def _line_key(line: Column) -> list[Column]:
    line = F.trim(line)
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def occurrences(docs: DataFrame, site: str) -> DataFrame:
    """(k1, k2, doc_id, site, pos, h1, h2) of every line that is not blank."""
    lines = docs.select(*row_key(), F.col("doc_id").alias("doc_id"), F.col(f"`{site}`").cast("string").alias("site"),
                        F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("k1", "k2", "doc_id", "site", "pos", *_line_key(F.col("line")))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first_doc, first_pos) of the lines on at least ``min_sites`` sites.

    Rows without a site count for no site.  The exact count deduplicates
    (line, site) before it counts, so a line that occurs a million times costs
    one row for each of its sites and tasks.
    """
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about"),
        F.min(F.struct("doc_id", "pos")).alias("first"))
    some = written(sketched.where(F.col("about") >= min_sites * (1 - NEAR)), "spread-lines")
    near = some.where(F.col("about") <= min_sites * (1 + NEAR)).select("h1", "h2")
    exact = (lines.where(F.col("site").isNotNull()).join(near, ["h1", "h2"], "left_semi")
             .select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")))
    return (some.join(exact, ["h1", "h2"], "left")
            .where(F.coalesce(F.col("sites") >= min_sites, F.col("about") > min_sites * (1 + NEAR)))
            .select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")))


@F.pandas_udf(StringType())
def _without(text: pd.Series, drop: pd.Series) -> pd.Series:
    out = []
    for t, d in zip(text, drop):
        gone = set(d)
        out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def remove_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(row, clean, n_removed): each row as a struct, its text without spread lines, and how many went.

    Lines are compared without surrounding spaces; blank lines stay.  The first
    occurrence (smallest ``doc_id``, then line number) of a spread line stays.
    Rows equal in ``doc_id`` and text are treated alike; a null text stays null
    and an empty one empty; ``n_removed`` is then 0.
    """
    prepare(docs.sparkSession)
    lines = occurrences(docs, site)
    # written, so that the join below shuffles both sides and a very common line's rows can be split
    flagged = written(spread_lines(lines, min_sites), "boilerplate")
    drops = (lines.select("k1", "k2", "doc_id", "pos", "h1", "h2").join(flagged, ["h1", "h2"])
             .where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
             .groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    joined = rows.join(drops, ["k1", "k2"], "left").select("row", "drop")
    return joined.select(
        "row", F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(_without(F.coalesce("row.text", F.lit("")), F.coalesce("drop", F.array().cast("array<int>")))).alias("clean"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"))


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and the digest of its text without spread lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = remove_spread_lines(docs)
    return found.select(F.col("row.doc_id").alias("doc_id"),
                        F.coalesce(F.size(F.split("row.text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
                        F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.encode("clean", "UTF-8")).alias("clean_md5"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d WHERE text IS NOT NULL),
f AS (SELECT trim(line) AS line, min((doc_id, pos)) AS first FROM l WHERE trim(line) <> ''
      GROUP BY trim(line) HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND f.first <> (l.doc_id, l.pos) AS gone
      FROM l LEFT JOIN f ON trim(l.line) = f.line),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_md5
      FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, clean_md5
FROM d LEFT JOIN c USING (doc_id)
"""
