"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts are unlabelled,
toxic ones among them.  Linear classifiers over the hashed presence of words,
word beginnings and word endings are trained in numpy on a risk estimate that corrects for the class prior and whose part for
negatives is kept from falling below zero.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import fold, prepare, text_or_empty, written, with_row

#: Hashed words, beginnings and endings.
DIMS = 1 << 20
#: Lengths of the beginnings and endings.
BEGINNINGS, ENDINGS = (4, 5, 6), (4, 5)
#: A beginning or ending shared by at least so many distinct words is a feature of its own.
SHARED = (2, 3)
#: Training rows expected at most; beyond, rows are drawn by a hash of their id.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 10_000
#: Features kept at most: those that tell positives from unlabelled texts most surely, by at least MIN_Z standard
#: errors (were both alike), in at least MIN_POSITIVE positive texts and MIN_SHARE of them.
FEATURES, MIN_Z, MIN_POSITIVE, MIN_SHARE = 2048, 6.0, 5, 0.02
#: Share of a step that goes against the gradient where the risk's part for negatives is below zero.
BACK = 0.05
#: Classifiers trained on different parts of the sample and averaged.
MEMBERS = 3
THRESHOLD = 0.3
#: Words whose features a task keeps.
KEPT = 100_000
_WORD = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, then its beginnings and endings."""
    parts = [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n), *(word[-n:] + "$" for n in ENDINGS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode()) % DIMS for x in parts)


def shared_feature(feature: int, words: int) -> int:
    """The feature that at least ``words`` distinct words have ``feature``."""
    return (feature * 0x9E3779B1 + words * 0x85EBCA6B + 1) % DIMS


def text_features(text: str, kept: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted distinct features of a whole text; ``kept`` holds those of words met before (bounded)."""
    every: list[int] = []
    for w in set(_WORD(text.lower())):
        got = kept.get(w)
        if got is None:
            got = word_features(w)
            if len(kept) < KEPT:
                kept[w] = got
        every.extend(got)
    ids, n = np.unique(np.array(every, np.int64), return_counts=True)
    return np.unique(np.concatenate([ids, *(shared_feature(ids[n >= k], k) for k in SHARED)])).astype(np.int32)


@dataclass
class PuModel:
    """Weights of the chosen features (by hashed id) and biases of the members."""

    features: np.ndarray
    weights: np.ndarray  # members x features
    bias: np.ndarray

    def scorer(self):
        """A function that scores whole texts; it keeps the useful features of words met before (bounded)."""
        place = {int(f): i for i, f in enumerate(self.features)}
        kept: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            seen: dict[int, int] = {}
            for w in set(_WORD(text.lower())):
                got = kept.get(w)
                if got is None:
                    got = tuple(f for f in word_features(w) if f in place or any(shared_feature(f, k) in place for k in SHARED))
                    if len(kept) < KEPT:
                        kept[w] = got
                for f in got:
                    seen[f] = seen.get(f, 0) + 1
            found = {place[f] for f in seen if f in place}
            for k in SHARED:
                found |= {place[g] for g in (shared_feature(f, k) for f, n in seen.items() if n >= k) if g in place}
            z = self.weights[:, sorted(found)].sum(1) + self.bias
            return float(np.mean(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

        return score


def choose_features(ids: np.ndarray, p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Of features in ``p`` positive and ``u`` unlabelled texts, those more frequent in positives by the surest difference."""
    p, u = p / max(n_p, 1), u / max(n_u, 1)
    z = (p - u) / np.sqrt(np.maximum(u, 1 / max(n_u, 1)) * (1 - u) * (1 / max(n_p, 1) + 1 / max(n_u, 1)) + 1e-12)
    order = np.lexsort((ids, -z))[:FEATURES]
    return np.sort(ids[order[z[order] >= MIN_Z]])


def train_member(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float,
                 steps: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss by Adam.

    Rows are arrays of feature places.  Where the part for negatives is below
    zero, a share BACK of the step goes against its gradient instead.
    """
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def laid(rows):
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)

    def risk(flat, owner, n, sign):
        """Mean loss log(1 + exp(-sign * z)) and its gradient."""
        z = np.bincount(owner, weights=w[flat], minlength=n) + w[-1]
        pull = -sign / (1 + np.exp(np.clip(sign * z, -30, 30))) / n
        g = np.bincount(flat, weights=pull[owner], minlength=width + 1)
        g[-1] += pull.sum()
        return np.logaddexp(0, -sign * z).mean(), g

    p, u = laid(pos), laid(unl)
    for step in range(1, steps + 1):
        _, up = risk(*p, 1.0)
        lost, down = risk(*p, -1.0)
        all_lost, all_down = risk(*u, -1.0)
        if all_lost - prior * lost >= 0:
            g = prior * up + all_down - prior * down
        else:
            g = BACK * (prior * down - all_down)
        g[:-1] += l2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (0.5 * (1 + np.cos(np.pi * step / steps))) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(chosen: np.ndarray, pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> PuModel:
    """Train the members, each without one part of the sample; rows are arrays of places in ``chosen``.

    Without positives every score is near 0.
    """
    if not pos or not unl:
        return PuModel(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([-30.0]))
    prior = min(max(prior, 1e-4), 0.9)
    members = []
    for k in range(MEMBERS):
        part = [[r for i, r in enumerate(side) if i % MEMBERS != k or len(side) < 10 * MEMBERS] for side in (pos, unl)]
        members.append(train_member(part[0], part[1], len(chosen), prior))
    return PuModel(chosen, np.array([w for w, _ in members]), np.array([b for _, b in members]))


def train_toxicity(docs: DataFrame, labels: DataFrame) -> PuModel:
    """Train on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, both already cut to the training fold.

    The class prior is the share of toxic rows among the labelled ones.
    Positives: documents labelled toxic (in any of their label rows).
    Unlabelled: all documents of the fold, whatever their label.  Both are
    drawn by a hash of ``doc_id`` at a rate that expects ``MAX_POSITIVE`` and
    ``MAX_UNLABELLED`` rows at most.  Features are counted and chosen over the
    written sample; the driver gets the counts of features in enough positives
    and each sample row's chosen features.  Documents without id are not trained on.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_docs = docs.where("doc_id is not null").count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / float(1 << 30)
    rate = lambda most, there: min(1.0, most / max(there, 1))
    ids = known.where("toxic = 1").where(draw < rate(MAX_POSITIVE, n_pos)).select("doc_id", F.lit(1).alias("positive"))
    rows = (docs.where("doc_id is not null").join(F.broadcast(ids), "doc_id", "left")
            .select(F.coalesce("positive", F.lit(0)).alias("positive"), (draw < rate(MAX_UNLABELLED, n_docs)).alias("drawn"), "text")
            .where("positive = 1 or drawn"))

    def hashed(batches):
        kept: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            ids = [text_features(t, kept) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("drawn"), pa.array(ids, pa.list_(pa.int32()))], ["positive", "drawn", "ids"])

    sample = written(rows.mapInArrow(hashed, "positive int, drawn boolean, ids array<int>"), "toxicity-sample")

    def counted(batches):
        n = np.zeros((2, DIMS), np.int32)
        for batch in batches:
            for i, which in enumerate((batch.column("positive").to_numpy() == 1, batch.column("drawn").to_numpy(zero_copy_only=False))):
                n[i] += np.bincount(batch.column("ids").filter(pa.array(which)).flatten().to_numpy(), minlength=DIMS).astype(np.int32)
        f = np.flatnonzero(n[0] + n[1])
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(n[0][f]), pa.array(n[1][f])], ["f", "p", "u"])

    n_p, n_u = sample.agg(F.coalesce(F.sum("positive"), F.lit(0)), F.coalesce(F.sum(F.col("drawn").cast("int")), F.lit(0))).first()
    # only features in enough positives reach the driver
    often = (sample.mapInArrow(counted, "f long, p int, u int").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
             .where(F.col("p") >= max(MIN_POSITIVE, MIN_SHARE * n_p)).toPandas())
    chosen = choose_features(often["f"].to_numpy(np.int64), often["p"].to_numpy(np.float64), often["u"].to_numpy(np.float64), n_p, n_u)

    def placed(batches):
        for batch in batches:
            kept = [_places(chosen, np.asarray(x.values.to_numpy(), np.int64)).astype(np.int32).tobytes() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("drawn"), pa.array(kept, pa.binary())], ["positive", "drawn", "at"])

    pos, unl = [], []
    for positive, drawn, raw in sample.mapInArrow(placed, "positive int, drawn boolean, at binary").toPandas().itertuples(index=False):
        at = np.frombuffer(bytes(raw), np.int32).astype(np.int64)
        if positive:
            pos.append(at)
        if drawn:
            unl.append(at)
    for rows in (pos, unl):  # the same members whatever the order in which rows arrive
        rows.sort(key=lambda r: r.tobytes())
    return learn(chosen, pos, unl, (n_pos or 0) / max(n, 1))


def _places(chosen: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places in ``chosen`` (sorted) of those ids that it holds."""
    spot = np.searchsorted(chosen, ids)
    inside = spot < len(chosen)
    inside[inside] = chosen[spot[inside]] == ids[inside]
    return spot[inside]


def score_texts(df: DataFrame, model: PuModel, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (probability of toxic, also for empty and null texts) over each whole text."""
    keep = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "score"]).alias("row"), text_or_empty(text).alias("t"))

    def run(batches):
        score = model.scorer()
        for batch in batches:
            scores = [score(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], ["row", "score"])
        pa.default_memory_pool().release_unused()

    return keep.mapInArrow(run, with_row(keep, ("score", "double"))).select("row.*", "score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Learns only from rows whose crc32 of the id modulo 4 is not 2; a row
    without id is neither held out nor learned from.  Columns of these names in
    ``docs`` are replaced; repeated rows stay.  Empty labels give scores near 0.
    """
    prepare(docs.sparkSession)
    train = fold(F.col("doc_id"), 4) != 2
    model = train_toxicity(docs.where(train).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")),
                           labels.where(train).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))
    return (score_texts(docs.drop("held_out", "predicted"), model)
            .withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
