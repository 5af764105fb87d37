import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salient.llm import compression_langid as ci
from salient.llm import dynamic_phrases as dp
from salient.llm import str_negatives as sn
from tests.llm.helpers import no_docs, odd_docs

SMALL = "/root/testdata/sf0.001"


# ---- language by compression

def plain_sizes(text, contents):
    """The method in a few lines: the sum of the library's sizes of all blocks under each dictionary."""
    import zstandard as z

    data = ci.letters(text)
    out = []
    for c in contents:
        made = z.ZstdCompressor(level=ci.LEVEL, dict_data=z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
        out.append(sum(len(made.compress(data[a:a + ci.BLOCK])) for a in range(0, len(data), ci.BLOCK)))
    return out


def test_held_out_languages_are_found(spark):
    from __spark_entry__ import queries

    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries()["op11_compression_langid"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0.0 <= r["score"] <= 1.0 and r["rejected"] == (r["score"] < ci.ACCEPT) for r in got)
    held = [r for r in got if r["held_out"]]
    right = [docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held]
    assert sum(right) >= 0.98 * len(held)
    sure = [ok for ok, r in zip(right, held) if not r["rejected"]]
    assert sum(sure) / len(sure) >= sum(right) / len(right) and len(sure) >= 0.9 * len(held)


def test_choices_equal_the_plain_method(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = ci.learn_dictionaries(docs.select("text", "lang"))
    assert all(0 < len(c) <= ci.DICTIONARY for c in model.contents)
    again = ci.learn_dictionaries(docs.select("text", "lang").repartition(7))
    assert again == model  # whatever the partitioning
    for r in ci.identify(docs, model).collect():
        sizes = plain_sizes(r["text"], model.contents)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if not any(ch.isalpha() for ch in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        assert r["lang_pred"] == model.langs[best]
        assert r["margin"] == sorted(sizes)[1] - sizes[best]
        assert math.isclose(r["score"], model.score(r["margin"]))


def test_languages_of_odd_rows(spark):
    rows = [(i, lang, t * 40) for i, (lang, t) in enumerate([("xx", "abba cabba dabba "), ("yy", "zorro muzzo fuzzo ")] * 12)]
    model = ci.learn_dictionaries(spark.createDataFrame(rows + [(98, None, "abba"), (99, "zz", None), (97, "vv", "12 34"), (96, "xx", "abba cabba dabba " * 40)], "i int, lang string, text string"))
    assert set(model.langs) == {"xx", "yy"}
    odd = odd_docs(spark).withColumn("lang_pred", F.lit("old")).withColumn("my-col", F.lit(1))
    out = ci.identify(odd, model)
    assert out.columns == [c for c in odd.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score", "margin", "rejected"]
    got = out.collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert ci.identify(no_docs(spark), model).count() == 0
    assert ci.learn_dictionaries(no_docs(spark)).langs == ()
    assert {r["lang_pred"] for r in ci.identify(odd, ci.Dictionaries((), ())).collect()} == {"und"}


def test_long_texts_are_encoded_to_the_end():
    model = ci.Dictionaries(("a", "b"), (b"lorem ipsum dolor sit amet " * 200, b"quick brown foxes jump over lazy dogs " * 200))
    text = ("xkcd " * 3 + "".join(random.Random(3).choice("abcdefgh ") for _ in range(50_000))) + " quick brown foxes jump over lazy dogs" * 800
    sizes = ci.encoded_sizes(ci.letters(text), model.compressors())
    assert sizes == plain_sizes(text, model.contents) and ci.choose(sizes)[0] == 1


# ---- phrases

def plain_collocations(docs, most=3, threshold=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    counts = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(rb"[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    counts["und" if lang is None else lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        total = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= threshold}
        rows, longer = [], Counter()
        for q, c in cand.items():
            for n in range(2, len(q)):
                for i in range(len(q) - n + 1):
                    longer[q[i:i + n]] = max(longer[q[i:i + n]], c)
        for p, a in cand.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in longer or 100 * longer[p] < share * a:
                rows.append((-score, -a, b" ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def found_collocations(df, **kw):
    return sorted(tuple(r) for r in dp.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrase_docs(n=400, seed=3):
    rnd = random.Random(seed)
    word = lambda: "W" + str(min(int(rnd.expovariate(0.08)), 60))
    fixed = ["New York city", "of the", "é x ü", "in spite of"]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 30)):
            parts.append(rnd.choice(fixed) if rnd.random() < 0.2 else word())
            parts.append(rnd.choice([" ", "  ", "\t", ". ", "\n", ",", " ; "]) if rnd.random() < 0.4 else " ")
        docs.append((i, rnd.choice(["en", "fr", None]), "".join(parts)))
    # one word that turns common only in the last shards read, and a long text without any break
    docs += [(n + i, "late", "rare bird sings " * (i % 3)) for i in range(30)]
    docs += [(n + 40, "en", " ".join(word() for _ in range(6000))), (n + 41, "en", None), (n + 42, None, ""), (n + 43, "en", "Z" * 3000 + " a " * 30)]
    return docs


@pytest.mark.parametrize("kw", [{}, {"most": 4, "threshold": 6, "share": 70, "top": 40, "shards": 3}, {"most": 2, "shards": 1}])
def test_phrases_equal_full_counts(spark, monkeypatch, kw):
    monkeypatch.setattr(dp, "MIN_SLOTS", 1 << 8)  # slots shared by many phrases change no result
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("cnt", F.lit("x")).withColumn("len", F.lit(7))
    plain = {k: v for k, v in kw.items() if k != "shards"}
    assert found_collocations(df, **kw) == plain_collocations([(lang, t) for _, lang, t in docs], **plain)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(dp, "_SEGMENT", 64)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["ab", "c", "dé", "efg", "x" * 90]) + rnd.choice(["", "", "", ".", "\t"]) for _ in range(rnd.randint(0, 200))) for _ in range(20)]
    langs = pa.array(["en"] * len(texts))
    data, offsets = dp.arrow_bytes(pa.array(texts))
    slots = np.zeros(1 << 8, np.uint8)  # all reached at step 0
    got, hashed = Counter(), Counter()
    for seg, borders, i, held in dp._segments(data, offsets):
        part = langs.slice(i, len(borders) - 1)
        for n, phrases, _, counts, _ in dp._count(seg, borders, part, held, 3, [slots] * 3, None, 1):
            for phrase, c in zip(phrases.to_pylist(), counts):
                got[(n, phrase)] += c
        for step in (0, 1):
            for n, h, counts in dp._count(seg, borders, part, held, 3, [slots, slots], step, 1):
                assert (n > 1) == (step == 1)
                for x, c in zip(h.tolist(), counts):
                    hashed[(n, x)] += c
    assert got.pop((0, "")) == sum(c for (n, _), c in got.items() if n == 1)
    assert sorted((n, c) for (n, _), c in hashed.items()) == sorted((n, c) for (n, _), c in got.items())
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", t):
            w = piece.split()
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    want[(n, " ".join(w[i:i + n]))] += 1
    assert got == want


def test_phrases_start_and_end_with_their_cycle(spark):
    docs = [(i, "en", "big red car") for i in range(64)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    counts, totals = dp.phrase_counts(df, threshold=10)
    assert [tuple(r) for r in totals.collect()] == [("en", 192)]
    assert {r["phrase"]: r["cnt"] for r in counts.collect()} == {p: 64 for p in ("big", "red", "car", "big red", "red car", "big red car")}


def test_phrases_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert found_collocations(docs, threshold=2) == plain_collocations(rows, threshold=2)
    assert dp.collocations(no_docs(spark)).count() == 0


# ---- hard negatives

def plain_negatives(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """Every score of every anchor, in whole numbers."""
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows})
    out = []
    for a in sorted({(i, label, tuple(v)) for i, label, v in anchors}):
        score = [(sum(x * y for x, y in zip(a[2], r[2])), r) for r in rows if r != a]
        same = sorted((-s, r[0]) for s, r in score if r[1] == a[1])[:positives]
        for p, pid in same:
            p = -p
            fit = sorted((-s, r[0]) for s, r in score if r[1] != a[1] and low * p <= 100 * s <= high * p)[:negatives]
            out += [(a[0], pid, k, nid, p, -n) for k, (n, nid) in enumerate(fit, 1)]
    return sorted(out)


def as_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, v array<long>")


def found_negatives(rows, anchors, **kw):
    return sorted(tuple(r) for r in sn.hard_negatives(rows, anchors, **kw).collect())


def vectors(n, dims, seed, spread=40):
    rnd = random.Random(seed)
    base = [[rnd.randint(-spread, spread) for _ in range(dims)] for _ in range(6)]
    hot = [rnd.randint(-spread, spread) for _ in range(dims)]
    out = []
    for i in range(n):
        v = hot if rnd.random() < 0.3 else [x + rnd.randint(-8, 8) for x in rnd.choice(base)]
        out.append((i, 0 if rnd.random() < 0.4 else rnd.randint(-1, 5), list(v)))
    return out + out[:3]


@pytest.mark.parametrize("dims,spread", [(8, 40), (3, 3), (1, 5), (4, 1 << 29), (2, 1 << 40)])
def test_negatives_equal_all_scores(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(sn, "SLAB_BYTES", 8 * dims * 40)
    monkeypatch.setattr(sn, "FAN", 3)
    rows = vectors(300, dims, dims, spread)
    asked = [r for r in rows if r[0] % 20 == 0]
    if spread > 1 << 30:  # scores beyond 64 bits are an error, and no wrong number
        with pytest.raises(Exception, match="64 bits"):
            found_negatives(as_rows(spark, rows), as_rows(spark, asked))
        return
    monkeypatch.setattr(sn.pack, "__defaults__", (8,))
    assert found_negatives(as_rows(spark, rows), as_rows(spark, asked)) == plain_negatives(rows, asked)
    assert found_negatives(as_rows(spark, rows), as_rows(spark, asked), positives=2, negatives=40, low=-50, high=90) == plain_negatives(rows, asked, 2, 40, -50, 90)


def test_boxes_out_of_reach_stay_closed():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 10, (200, 2)) + c for c in ([0, 0], [500, 500], [-500, 500])]).astype(np.int64)
    ids, label = np.arange(len(v)), np.repeat([0, 1, 2], 200)
    leaves = sn.tile(label, ids, v, 32)
    assert sorted(np.concatenate(leaves).tolist()) == ids.tolist()
    assert all(len(x) <= 32 and len(set(label[x])) == 1 for x in leaves)
    opened = []

    class Slab:
        lo, hi = (np.stack([f(v[x], axis=0) for x in leaves]) for f in (np.min, np.max))
        label_lo = label_hi = np.array([label[x[0]] for x in leaves])
        node_lo, node_hi = (f.reduceat(b, np.arange(0, len(leaves), sn.FAN)) for f, b in ((np.minimum, lo), (np.maximum, hi)))
        node_label = np.minimum.reduceat(label_lo, np.arange(0, len(leaves), sn.FAN)), np.maximum.reduceat(label_lo, np.arange(0, len(leaves), sn.FAN))
        most, rows = 1000, None

        def __len__(self):
            return len(leaves)

        def open(self):
            slab = self

            class Rows:
                def __getitem__(self, k):
                    opened.append(k)
                    return ids[leaves[k]], label[leaves[k]], v[leaves[k]]
            slab.rows = Rows()

        def close(self):
            pass

    anchor = v[ids == 250]
    got = list(sn.mine_block([Slab()], np.array([250]), np.array([1]), anchor, 3, 2, 80, 100))
    assert got == plain_negatives([(int(i), int(l), x.tolist()) for i, l, x in zip(ids, label, v)], [(250, 1, anchor[0].tolist())], 3, 2)
    assert len(opened) < len(leaves)  # the windows and the k-th score keep most boxes shut


def test_negatives_of_odd_rows(spark):
    bad = float("nan"), float("inf"), None
    rows = [(0, [1.0, 2.0], 1), (100, [0.5, None], 1), (200, [1.0, float("nan")], 1), (300, None, 1), (None, [1.0, 1.0], 1), (400, [1.0, 1.0], None),
            (1, [1.0, 2.0], 1), (2, [1.0, 1.9], 2), (3, [1.0, 1.9], 2), (4, [0.9, 1.9], 3), (5, [float("-inf"), 0.0], 1), (6, [], 1), (8, [1.0], 1), (100, [-1.0, -1.0], 3)]
    df = spark.createDataFrame([(i, v, l, "c", 1) for i, v, l in rows], "vec_id long, embedding array<float>, label int, row string, `my-col` int")
    good = [(i, l, [math.floor(256 * x) for x in v] + [0] * (2 - len(v))) for i, v, l in rows if i is not None and l is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    scored = sn.scored_rows(df)
    asked = [g for g in good if g[0] % 100 == 0]
    assert sorted((r["vec_id"], r["label"]) for r in scored.collect()) == sorted((i, l) for i, l, _ in good) and bad
    # float rounding of 1.9 and 0.9 is the double's of the float
    exact = [(r["vec_id"], r["label"], list(r["v"]) + [0] * (2 - len(r["v"]))) for r in scored.collect()]
    assert found_negatives(scored, scored.where("vec_id % 100 = 0")) == plain_negatives(exact, [e for e in exact if e[0] % 100 == 0]) and len(asked) == 2
    none = spark.createDataFrame([], df.schema)
    assert sn.hard_negatives(sn.scored_rows(none), sn.scored_rows(none)).count() == 0
    assert sn.hard_negatives(scored, sn.scored_rows(none)).count() == 0
