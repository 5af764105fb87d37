"""URL filter by a character language-model ratio.

Two smoothed variable-order Markov models are counted over the bytes of URLs:
one for accepted, one for rejected URLs (those that a rule decides).  A context
is the last 0 to ``MAX_ORDER`` bytes themselves, so none is taken for another, and the
tables grow with the contexts that the corpus holds.  They lie in the shared
folder, where each task reads them.  Each order is smoothed by the next lower
one (Witten-Bell).  A URL's score is the difference of its two log-likelihoods
divided by its number of symbols; the threshold is calibrated on a fold of the
rule-decided URLs which the models have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salient.llm.common import arrow_bytes, filesystem, prepare
from salient.session import scratch_path

#: Longest context.
MAX_ORDER = 4
#: The 256 bytes, and 0 for the border before and after a URL; bits of a symbol in a key.
SYMBOLS, BITS = 257, 9
#: Score bins used by the calibration (width 0.01 nats a symbol).
BINS, BIN_WIDTH = 2001, 0.01

#: Rules of the query: (rule, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits.

    A rule ``host/path`` fits its host and all subdomains where the path starts
    with the rule's.  The rule list is a parameter, not data.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, word in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _symbols(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all URLs, each after MAX_ORDER zeros and before one zero, and each URL's number of symbols."""
    data, offsets = arrow_bytes(urls)
    length = np.diff(offsets)
    start = np.concatenate([[0], np.cumsum(length + MAX_ORDER + 1)])[:-1] + MAX_ORDER
    out = np.zeros(int((length + MAX_ORDER + 1).sum()), np.int64)
    if len(length):
        body = data[int(offsets[0]):int(offsets[-1])]
        out[np.repeat(start - (offsets[:-1] - offsets[0]), length) + np.arange(len(body))] = body.astype(np.int64) + 1
    return out, length + 1


def _keys(urls: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the key of (context, symbol) at each predicted symbol (the context's key is it without the last BITS bits); symbols by URL."""
    s, count = _symbols(urls)
    first = np.cumsum(count + MAX_ORDER) - count
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    keys, context = [], np.zeros(len(at), np.int64)
    for order in range(MAX_ORDER + 1):
        if order:
            context = context | (s[at - order] << (BITS * (order - 1)))
        keys.append((((order << (BITS * MAX_ORDER)) | context) << BITS) | s[at])
    return keys, count


@dataclass
class UrlModel:
    """Counts of both models (0 rejected, 1 accepted) by key, and the calibrated threshold.

    ``path`` is the folder of the tables; a process reads them when it first scores.
    """

    path: str | None
    threshold: float = 0.0
    held: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"path": self.path, "threshold": self.threshold, "held": None}

    def _tables(self) -> tuple:
        if self.held is None:
            parts = []
            for name, columns in (("pairs", ("n0", "n1")), ("contexts", ("n0", "n1", "t0", "t1"))):
                if self.path is None:
                    parts.append((np.zeros(0, np.int64), np.zeros((len(columns), 0))))
                    continue
                files, root = filesystem(f"{self.path}/{name}")
                table = pq.read_table(root, filesystem=files)
                key = table.column("key").to_numpy()
                order = np.argsort(key)
                parts.append((key[order], np.stack([table.column(c).to_numpy()[order].astype(np.float64) for c in columns])))
            self.held = tuple(parts)
        return self.held

    def scores(self, urls: pa.Array) -> np.ndarray:
        """(log P accepted - log P rejected) / symbols; 0 for an empty URL only if both models agree."""
        keys, count = _keys(urls)
        (pair_key, pair), (context_key, context) = self._tables()

        def found(table: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
            if not len(table):
                return np.zeros((len(values), len(want)))
            distinct, place = np.unique(want, return_inverse=True)
            spot = np.minimum(np.searchsorted(table, distinct), len(table) - 1)
            return np.where(table[spot] == distinct, values[:, spot], 0.0)[:, place]

        p = np.full((2, int(count.sum())), 1.0 / SYMBOLS)
        for key in keys:
            c = found(pair_key, pair, key)
            n0, n1, t0, t1 = found(context_key, context, key >> BITS)
            n, t = np.stack([n0, n1]), np.stack([t0, t1])
            p = np.where(n > 0, (c + t * p) / np.maximum(n + t, 1), p)
        ratio = np.log(p[1]) - np.log(p[0])
        return np.add.reduceat(ratio, np.cumsum(count) - count) / count if len(count) else np.zeros(0)


def train_url_model(labelled: DataFrame) -> UrlModel:
    """Count and calibrate from ``labelled(url, accepted boolean)``.

    Every labelled URL is used: one fifth (by hash of the URL) for calibration,
    the rest for the counts.  The tables are written to the shared folder; the
    driver gets 2 * BINS numbers at most.  A task that scores holds the tables: 50
    bytes for each distinct run of up to ``MAX_ORDER + 1`` bytes in the counted
    URLs.  Without labelled URLs of either kind the threshold is 0.
    """
    rows = labelled.where(F.col("url").isNotNull()).select(
        F.col("url").cast("string").alias("url"), F.col("accepted").cast("int").alias("k"),
        (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("calibrate"))

    def count(batches):
        for batch in batches:
            kind = np.asarray(batch.column("k").to_numpy(zero_copy_only=False))
            for k in (0, 1):
                urls = batch.column("url").filter(pa.array(kind == k))
                if len(urls):
                    key, n = np.unique(np.concatenate(_keys(urls)[0]), return_counts=True)
                    counts = [pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(counts if k == 0 else counts[::-1])], ["key", "n0", "n1"])

    path = scratch_path(labelled.sparkSession, "url-model")
    counted = rows.where(~F.col("calibrate")).select("url", "k").mapInArrow(count, "key long, n0 long, n1 long")
    counted.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).write.parquet(f"{path}/pairs")
    pairs = labelled.sparkSession.read.schema("key long, n0 long, n1 long").parquet(f"{path}/pairs")
    (pairs.groupBy(F.shiftright("key", BITS).alias("key"))
     .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"))
     .write.parquet(f"{path}/contexts"))
    model = UrlModel(path)

    def bins(batches):
        for batch in batches:
            b = np.clip(np.rint(model.scores(batch.column("url")) / BIN_WIDTH), -(BINS // 2), BINS // 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(b, pa.int64())], ["k", "bin"])

    found = (rows.where("calibrate").select("url", "k").mapInArrow(bins, "k int, bin long")
             .groupBy("k", "bin").count().collect())
    share = np.zeros((2, BINS))
    for r in found:
        share[r["k"], r["bin"] + BINS // 2] += r["count"]
    return UrlModel(path, best_threshold(share))


def best_threshold(share: np.ndarray) -> float:
    """The middle of the thresholds that put most of both kinds right, each kind counting as one; 0 if a kind is missing."""
    if share.sum(1).min() <= 0:
        return 0.0
    share = share / share.sum(1, keepdims=True)
    # at threshold i, rejected URLs below it and accepted ones from it on are right
    right = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 - BINS // 2 - 0.5) * BIN_WIDTH


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Judge each row's ``url``: (page_id, host, path, rule, verdict, score).

    Null or without ``://``: host and path empty and no rule fits; the models
    then judge the text as it is (null like empty).  An empty table gives an
    empty result.  Repeated rows stay; other columns of ``pages`` are not read.  A URL
    of any length is judged whole; a task holds about 100 bytes for each of its bytes.
    """
    prepare(pages.sparkSession)
    host, path = url_host(F.coalesce(F.col("url"), F.lit(""))), url_path(F.coalesce(F.col("url"), F.lit("")))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    model = train_url_model(base.where(F.col("by_rule").isNotNull())
                            .select("url", (F.col("by_rule") == "allow").alias("accepted")))

    def score(batches):
        for batch in batches:
            s = model.scores(batch.column("url"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return (base.mapInArrow(score, f"page_id {kind}, url string, host string, path string, rule string, by_rule string, score double")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(F.col("score") >= model.threshold, "allow").otherwise("block")).alias("verdict"),
                    "score"))


def op1_url_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` with its host, path, rule and verdict."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
