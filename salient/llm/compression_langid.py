"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of training texts.
A text is encoded in blocks with every dictionary; the language whose
dictionary gives the fewest bytes is chosen.  The margin to the runner-up is
turned into a score by a logistic curve fitted on training texts that are in no
dictionary, and choices of narrow margin are marked as rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salient.llm.common import fold, prepare, text_or_empty

#: Bytes of a language's dictionary, and the most that one text gives to it.
DICTIONARY, SHARE = 64 << 10, 2 << 10
#: Distinct training texts of a language that are sampled: those of odd rank (by hash) go into the
#: dictionary until it is full, those of even rank calibrate the score.
SAMPLE, SHARES = 512, 32
#: Bytes that are encoded at once, so that a long text is judged by the dictionaries all the way through.
BLOCK = 4 << 10
LEVEL = 9
#: Scores below this are rejected.
ACCEPT = 0.9

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased text with runs of anything else than letters as one space; empty without a letter."""
    text = _OTHER.sub(" ", (text or "").lower()).strip()
    return text.encode("utf-8", "replace") if any(map(str.isalpha, text)) else b""


@dataclass(frozen=True)
class Dictionaries:
    """Languages, commonest first, their raw contents, and the curve from margin to score."""

    langs: tuple[str, ...]
    contents: tuple[bytes, ...]
    curve: tuple[float, float] = (0.0, 1.0)

    def compressors(self) -> list:
        import zstandard as z

        out = []
        for content in self.contents:
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False))
        return out

    def score(self, margin: int) -> float:
        a, b = self.curve
        return float(1.0 / (1.0 + np.exp(-(a + b * np.log1p(margin)))))


def encoded_sizes(text: bytes, compressors: list) -> list[int]:
    """Bytes of the whole text under each dictionary, encoded block by block."""
    sizes = [0] * len(compressors)
    for at in range(0, len(text), BLOCK):
        block = text[at:at + BLOCK]
        for i, c in enumerate(compressors):
            sizes[i] += len(c.compress(block))
    return sizes


def choose(sizes: list[int]) -> tuple[int, int]:
    """(index of the smallest, bytes to the second smallest); of equal ones the first."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    return best, min((s for i, s in enumerate(sizes) if i != best), default=sizes[best]) - sizes[best]


def _content(texts: list[bytes]) -> bytes:
    """Texts one after the other until the dictionary is full; of a long one the middle."""
    parts, room = [], DICTIONARY
    for t in texts:
        if room <= 0:
            break
        cut = min(len(t), SHARE, room)
        a = (len(t) - cut) // 2
        parts.append(t[a:a + cut])
        room -= cut + 1
    return b" ".join(reversed(parts))


def _curve(margins: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Logistic curve of being right on log(1 + margin), slightly pulled to (0, 1); Newton steps."""
    x = np.stack([np.ones(len(margins)), np.log1p(margins)], 1)
    w, prior = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (p - right) + 0.1 * (w - prior))
    return float(w[0]), float(max(w[1], 1e-3))


def learn_dictionaries(train: DataFrame) -> Dictionaries:
    """Dictionaries of the languages of ``train`` (text, lang).

    Rows with a null text or language, or without a letter, teach nothing;
    repeated texts of a language count once.  At most ``SAMPLE`` distinct texts a
    language (those with the smallest hashes) are read; the driver holds
    ``DICTIONARY`` bytes a language, and a margin for each calibrating text.
    """
    rows = train.select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    count = rows.groupBy("lang").count()
    order = {r["lang"]: r["count"] for r in count.collect()}
    langs = sorted(order, key=lambda lang: (-order[lang], lang))
    if not langs:
        return Dictionaries((), ())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # first within shares of a language, so that a common one is not ranked in one task
    share = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SHARES))).orderBy("h"))
    few = rows.groupBy("lang", "h").count().withColumn("rank", share).where(F.col("rank") <= SAMPLE)
    few = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).groupBy("lang").agg(F.max("h").alias("last"))
    last = {r["lang"]: r["last"] for r in few.collect()}
    bound = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(last[lang]))])
    sample = rows.where(F.col("h") <= bound[F.col("lang")]).dropDuplicates(["lang", "h"]).withColumn("rank", rank)

    held: dict[str, list] = {lang: [] for lang in langs}
    odd = sample.where("rank % 2 = 1")
    most = 4 * SHARE  # characters sent of a text; its middle has the bytes wanted
    part = F.when(F.length("text") > most, F.substring("text", (F.length("text") - most) / 2, F.lit(most))).otherwise(F.col("text"))
    for r in odd.select("lang", "rank", part.alias("text")).collect():
        held[r["lang"]].append((r["rank"], letters(r["text"])))
    model = Dictionaries(tuple(langs), tuple(_content([t for _, t in sorted(held[lang])]) for lang in langs))

    found = _chosen(sample.where("rank % 2 = 0").select("lang", "text"), model).select("margin", (F.col("lang_pred") == F.col("lang")).alias("ok")).collect()
    margins, right = np.array([r["margin"] for r in found], float), np.array([r["ok"] for r in found], float)
    return Dictionaries(model.langs, model.contents, _curve(margins, right) if len(found) else (0.0, 1.0))


def _chosen(rows: DataFrame, model: Dictionaries) -> DataFrame:
    """``rows`` (any columns, one named text) without the text, with lang_pred, score and margin."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.LongType())])

    def run(batches):
        encoders = model.compressors()
        for batch in batches:
            pred, score, margin = [], [], []
            for text in batch.column("text"):
                plain = letters(text.as_py())
                if not plain or not encoders:
                    pred.append("und")
                    score.append(0.0)
                    margin.append(0)
                    continue
                best, wide = choose(encoded_sizes(plain, encoders))
                pred.append(model.langs[best])
                score.append(model.score(wide))
                margin.append(wide)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, model: Dictionaries, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected, judged by ``text`` alone.

    ``margin`` is how many bytes the runner-up's encoding is longer; ``score``
    the chance, by the fitted curve, that the choice is right; ``rejected`` says
    that it is below ``accept``.  Null texts and texts without a letter (and every
    text where no language was learned) give ``und``, score 0, rejected.  Equal
    sizes go to the commoner language of the training texts, then by name.
    Columns of these names in ``docs`` are replaced, other columns, rows and
    repeats stay.  Whole texts are encoded; a task holds a few copies of one text.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "rejected")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_or_empty().alias("text"))
    return _chosen(rows, model).select("row.*", "lang_pred", "score", "margin", (F.col("score") < accept).alias("rejected"))


def op11_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the texts and languages of three of four folds.

    Rows without an id belong to no fold: they teach nothing and are not held out.
    """
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = fold(F.col("doc_id"), 4)
    model = learn_dictionaries(docs.where(part != 2))
    out = identify(docs.select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
