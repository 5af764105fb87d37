import base64
import hashlib
import io
import random
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salient.llm import url_lm, warc
from salient.session import scratch_path

URLS = [None, "", "no scheme", "http://a.Example.ORG/es/x?q#f", "https://example.org/en/1", "https://xexample.org/en/2", "ftp://b.com/fr/", "http://com/de/1?x",
        "http://www.a.net/en/3", "http://org", "http://a.org?/x", "x://y://z.com/fr/1", "http://a.com/fr", "http://ü.com/de/é"] + [
    f"http://s{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)]


def plain(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = (None, None)
    for rule, verdict in url_lm.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_url_rules_and_model(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "y")]
    got = url_lm.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, score string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, (rule, verdict) = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == verdict)
    decided = [(r["score"], plain(URLS[r["page_id"]])[2][1]) for r in got if r["rule"]]
    low = [s for s, v in decided if v == "block"]
    high = [s for s, v in decided if v == "allow"]
    assert sum(high) / len(high) > sum(low) / len(low) + 0.2  # the models learned to tell them apart


def test_no_urls(spark):
    assert url_lm.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    one = url_lm.url_verdicts(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")).first()
    assert one["rule"] is None and one["verdict"] in ("allow", "block")


def test_untrained_models_agree():
    assert url_lm.UrlModel(None).scores(pa.array(["http://x/", ""])).tolist() == [0.0, 0.0]


def plain_score(url, counts):
    """Witten-Bell models over byte strings, symbol by symbol."""
    raw = [None] * url_lm.MAX_ORDER + list(url.encode()) + [None]
    total = 0.0
    for i in range(url_lm.MAX_ORDER, len(raw)):
        both = []
        for seen in counts:
            p = 1 / url_lm.SYMBOLS
            for order in range(url_lm.MAX_ORDER + 1):
                after = seen.get(tuple(raw[i - order:i]), {})
                n, t = sum(after.values()), len(after)
                if n:
                    p = (after.get(raw[i], 0) + t * p) / (n + t)
            both.append(math.log(p))
        total += both[1] - both[0]
    return total / (len(raw) - url_lm.MAX_ORDER)


def test_verdicts_equal_the_plain_models(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé%") for _ in range(rnd.randint(1, 5)))
    urls = [f"http://{word()}.example.{rnd.choice(['org', 'com', 'net'])}/{rnd.choice(['en', 'fr', 'de', 'es'])}/{word()}{rnd.randint(0, 30)}" for _ in range(400)]
    urls += ["", None, "no host", "http://x.net/" + "long/" * 5000, "http://ünï.net/ß", urls[0]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_lm.url_verdicts(df).collect()}
    part = {r["page_id"]: r["c"] for r in df.select("page_id", F.expr("pmod(xxhash64(url), 5) = 0").alias("c")).collect()}
    decided = {i: r["verdict"] == "allow" for i, r in got.items() if r["rule"] is not None}
    counts = [{}, {}]
    for i, accepted in decided.items():
        if not part[i]:
            raw = [None] * url_lm.MAX_ORDER + list(urls[i].encode()) + [None]
            for at in range(url_lm.MAX_ORDER, len(raw)):
                for order in range(url_lm.MAX_ORDER + 1):
                    after = counts[accepted].setdefault(tuple(raw[at - order:at]), {})
                    after[raw[at]] = after.get(raw[at], 0) + 1
    score = {i: plain_score(u or "", counts) for i, u in enumerate(urls)}
    assert all(abs(got[i]["score"] - s) < 1e-9 for i, s in score.items())
    # the threshold: of all bin borders the middle of those that put most right
    half = url_lm.BINS // 2
    bins = [[max(-half, min(half, round(score[i] / url_lm.BIN_WIDTH))) for i, a in decided.items() if part[i] and a == kind] for kind in (False, True)]
    value = {c: sum(b < c for b in bins[0]) / len(bins[0]) + sum(b >= c for b in bins[1]) / len(bins[1]) for c in range(-half, half + 2)}
    best = [c for c, v in value.items() if v >= max(value.values()) - 1e-12]
    threshold = ((best[0] + best[-1]) / 2 - 0.5) * url_lm.BIN_WIDTH
    for i, r in got.items():
        if r["rule"] is None:
            assert r["verdict"] == ("allow" if score[i] >= threshold else "block") or abs(score[i] - threshold) < 1e-9


def test_archives_round_trip(spark):
    big = "zé" * 400_000
    rows = [(1, "u 1", "same", 0), (5, "u", "same", 0), (3, None, "same", 0), (2, "u", None, 0), (4, "u", "", 0), (6, "u", big, 0), (7, "u", "WARC/1.1\r\n\r\n", 0), (7, "u", "WARC/1.1\r\n\r\n", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    folder = scratch_path(spark, "warc-test")
    chunks = warc.read_chunks(warc.write_archives(pages, folder), folder).persist()
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.records(chunks).collect()}
    last = {"same": 5, "": 4, big: 6, "WARC/1.1\r\n\r\n": 7}
    want = set()
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        to = last[html or ""]
        want.add((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == page else "revisit", None if to == page else to))
    assert got == want and warc.records(chunks).count() == len(rows)
    parts = chunks.where("page_id = 6").orderBy("chunk").collect()
    assert len(parts) == -(-len(big.encode()) // warc.CHUNK) and b"".join(bytes(p["data"]) for p in parts) == big.encode()
    done = hashlib.sha1()
    for p in parts:  # the digest so far is that of all bytes up to the row
        done.update(bytes(p["data"]))
        assert p["digest_so_far"] == base64.b32encode(done.digest()).decode()
    chunks.unpersist()


def test_small_records_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    got = {r["page_id"]: r["record_type"] for r in warc.records(warc.read_chunks(warc.write_archives(pages, folder, min_bytes=3), folder)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages(spark):
    folder = scratch_path(spark, "warc-test")
    assert warc.read_chunks(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder), folder).count() == 0


def test_cut_archive_is_an_error():
    import zlib
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = z.compress(warc.record_head("response", 1, "u", "X", 100, None) + b"short") + z.flush()
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(raw)))
