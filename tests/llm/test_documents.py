import hashlib
import math
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from salient.llm import bottomk_dedup as bk
from salient.llm import common, decontam, fingerprints as fp, line_spread, maxent_lm as lm, toxicity as tox
from tests.llm.helpers import no_docs, odd_docs, shingles, words


def test_word_hashes_follow_the_words(monkeypatch):
    monkeypatch.setattr(common, "_SEGMENT", 64)
    rnd = random.Random(1)
    docs = ["".join(rnd.choice("aAbé \n\t\x1c ") for _ in range(rnd.randint(0, 300))) for _ in range(300)] + ["x" * 500, "", "   ", None]
    h, bounds = common.word_hashes(*common.arrow_bytes(pa.array(docs)))
    seen = {}
    for i, d in enumerate(docs):
        own = h[bounds[i]:bounds[i + 1]]
        assert len(own) == len(words(d))
        for w, x in zip(words(d), own):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# ---- near-duplicates

def plain_components(docs):
    """Components over all pairs by comparing sets of shingles themselves."""
    sets = [(i, shingles(t)) for i, t in docs if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(k)
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}, dict(sets)


def copies(n=220):
    """Chains, groups of near copies of all degrees, and a passage that half of the documents share."""
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 400))
    passage = [word() for _ in range(70)]
    base = [[word() for _ in range(length)] for length in (6, 30, 65, 90, 150, 400)]
    out = []
    for i in range(n):
        ws = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            ws[rnd.randrange(len(ws))] = word()
        out.append((1000 - 3 * i, " ".join(passage + [word() for _ in range(rnd.randint(5, 90))] if i % 3 == 0 else ws)))
    return out


@pytest.mark.parametrize("block", [512, 12])
def test_components_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(bk, "BLOCK", block)
    docs = copies() + [(2001, None), (2002, ""), (2003, " \n"), (2004, "a"), (2005, "A"), (2006, "a b"), (copies()[0])]
    want, sets = plain_components(docs)
    got = bk.near_duplicates(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, label string")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_components_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, _ = plain_components(rows)
    got = bk.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == want.get(r["doc_id"])) for r in got)
    assert bk.near_duplicates(no_docs(spark)).count() == 0


def test_links_connect_what_all_links_connect():
    rnd = np.random.default_rng(4)
    base = np.unique(rnd.integers(0, 1 << 62, 200).astype(np.uint64))
    sets = []
    for i in range(60):
        keep = base[rnd.random(len(base)) < rnd.choice([0.8, 0.9, 0.97])]
        sets.append((i, np.unique(np.concatenate([keep, rnd.integers(0, 1 << 62, rnd.integers(0, 40)).astype(np.uint64)]))))

    def joined(pairs):
        parent = list(range(60))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in pairs:
            parent[find(a)] = find(b)
        return [min(j for j in range(60) if find(j) == find(i)) for i in range(60)]

    full = [(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))]
    assert joined(bk.links_between(sets, None)) == joined(full)
    split = bk.links_between(sets[:25], None) + bk.links_between(sets[25:], None) + bk.links_between(sets[:25], sets[25:])
    assert joined(split) == joined(full)


def test_components_of_edges(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in bk.components(spark.createDataFrame(chain, "a long, b long"), "test").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_components_of_a_long_chain(spark):
    ids = list(range(1000))
    random.Random(8).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    got = {r["node"]: r["label"] for r in bk.components(spark.createDataFrame(chain, "a long, b long"), "chain").collect()}
    assert got == dict.fromkeys(range(1000), 0)
    assert bk.components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(1000)]
    ids = list(range(1, 301))
    random.Random(9).shuffle(ids)
    docs = [(d, " ".join(words[2 * i:2 * i + 60])) for i, d in enumerate(ids)]  # each is similar to its neighbours alone
    got = bk.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1} and [r["doc_id"] for r in got if r["kept"]] == [1]


def twins(n=10):
    """Two different words of 2^n letters whose polynomial hashes are equal modulo 2^64 for every odd radix."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_word_hashes_of_twins_differ(spark):
    a, b = twins()
    h, _ = common.word_hashes(*common.arrow_bytes(pa.array([a, b, a.upper()])))
    assert h[0] != h[1] and h[0] == h[2]
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r["component_id"] for r in bk.near_duplicates(docs).collect()} == {1, 2}
    assert len({r["fingerprint"] for r in fp.with_fingerprint(docs).collect()}) == 2


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 17, 5000])
def test_hashes_tell_words_apart_by_every_byte(size):
    rnd = random.Random(size)
    text = bytes(rnd.randrange(97, 123) for _ in range(size))
    for i in rnd.sample(range(size), min(size, 40)):
        other = text[:i] + bytes([text[i] ^ 1]) + text[i + 1:]
        data = np.frombuffer(b"xy" + text + b" " + other + b" " + text, np.uint8)
        at = np.array([2, 3 + size, 4 + 2 * size])
        h = common.hash_runs(data, at, at + size)
        assert h[0] != h[1] and h[0] == h[2]
        assert common.differ(data, at[:1].repeat(2), at[:1].repeat(2) + size, data, at[1:], at[1:] + size).tolist() == [True, False]


# ---- lines

def plain_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(site)
                key = (i is not None, i or 0, p)
                first[line.strip(" ")] = min(first.get(line.strip(" "), key), key)
    out = Counter()
    for i, text, _ in rows:
        kept = [x for p, x in enumerate((text or "").split("\n"))
                if len(sites[x.strip(" ")] - {None}) < min_sites or not x.strip(" ") or first[x.strip(" ")] == (i is not None, i or 0, p)]
        out[(i, None if text is None else "\n".join(kept))] += 1
    return out


def test_spread_lines(spark):
    rnd = random.Random(2)
    lines = [f"line {k}" for k in range(30)]
    rows = [(i, "\n".join([rnd.choice(lines[:3 + i % 27]) for _ in range(rnd.randint(1, 12))] + [" line 1 ", "", "own %d" % i]), f"s{rnd.randint(0, 11)}") for i in range(150)]
    rows += [(900, None, "s1"), (901, "", "s2"), (902, "line 1", None), rows[7]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, clean string")
    for sites in (2, 9, 11):
        got = Counter((r["row"]["doc_id"], r["clean"]) for r in line_spread.remove_spread_lines(df, min_sites=sites).collect())
        assert got == plain_lines(rows, sites)


def test_spread_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = line_spread.remove_spread_lines(docs, min_sites=2)
    assert Counter((r["row"]["doc_id"], r["clean"]) for r in got.collect()) == plain_lines([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 2)
    assert line_spread.remove_spread_lines(no_docs(spark)).count() == 0


# ---- benchmark items

ITEM = "Question: a train leaves Paris at 9 and travels 120 km to Lyon in 2 hours, then Paris calls back. How fast did that train travel on its way there?"


def copies_found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, h long, slots string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, pos string")
    return {(r["doc_id"], r["item_id"]): r["slots_changed"] for r in decontam.contaminated(d, b).collect()}


def test_verbatim_and_changed_questions(spark):
    noise = "Some words of another text stand before and after it. " * 20
    changed = ITEM.replace("Paris", "Rome").replace("120 km", "3,450.5 miles").replace("Lyon", "Genoa").replace("at 9", "at 11")
    mixed = ITEM.replace("Paris", "Rome", 1)  # one value of the item meets two values here
    docs = [(1, noise + ITEM + " " + noise), (2, noise + "\n" + changed + "\n" + noise), (3, noise + mixed), (4, noise), (5, None), (6, ""),
            (7, ITEM.upper()[:20] + " is not it"), (8, "so " + ITEM.replace("train", "bus").replace("leaves", "quits").replace("travels", "goes").replace("then", "as").replace("fast", "slow")),
            (9, "we saw red blue green"), (1, noise + ITEM + " " + noise)]
    items = [(10, ITEM), (11, "red blue green"), (12, "no"), (13, None), (14, ITEM)]
    got = copies_found(spark, docs, items)
    assert got[(1, 10)] is False and got[(1, 14)] is False and got[(2, 10)] is True and got[(9, 11)] is False
    assert got[(3, 10)] is False  # most of its windows are the item's, word for word
    assert not {d for d, _ in got} & {4, 5, 6, 7, 8}


def test_one_altered_value_leaves_the_other_windows(spark):
    noise = "Some words of another text stand before and after it. " * 20
    mixed = ITEM.replace("Paris", "Rome", 1)
    moved = ITEM.replace("Lyon", "Genoa").replace("Paris", "Rome", 1)  # a consistent new value beside the altered one
    swapped = ITEM.replace("leaves Paris", "leaves Rome").replace("then Paris", "then Genoa")
    got = copies_found(spark, [(3, noise + mixed), (4, moved), (5, noise), (6, swapped)], [(10, ITEM)])
    assert got == {(3, 10): False, (4, 10): True, (6, 10): True}


def test_verbatim_copies_do_not_depend_on_typing(spark):
    items = [(1, "The Old Man And The Sea Was Written By Ernest Hemingway In Cuba"), (2, "12 km + 7 km = 19 km"), (3, "WHICH CITY IS THE CAPITAL OF FRANCE"),
             (4, "Which rivers flow through the old city"), (5, "Water boils"), (6, "Why"), (7, ITEM), (8, "?!"), (9, "3 kg of 5 kg and 7 kg less 1 kg of 9 kg is how many kg")]
    docs = [(i, f"so it is that {t} and nothing more") for i, t in items] + [
        (14, "Question: Which rivers flow through the old city?"), (15, "we know, WATER BOILS"), (17, "as said, " + ITEM.upper()), (18, "the water may boil, which is old")]
    got = copies_found(spark, docs, items)
    assert got == {(i, i): False for i, _ in items if i != 8} | {(14, 4): False, (15, 5): False, (17, 7): False}
    texts = [(21, "12 km + 8 km = 20 km"), (22, ITEM.replace("120", "340")), (23, "3 kg of 5 kg and 7 kg less 1 kg of 9 kg"), (24, "no"), (25, None)]
    assert copies_found(spark, texts, items) == {(22, 7): True, (23, 9): False}


def plain_copies(docs, items, window=8, least=0.5):
    """Every document against every item, by tokens."""
    def read(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, kind, start, end = decontam.plain_tokens(raw, 0, len(raw))
        toks = []
        for a, b in zip(start, end):
            t = raw[a:b].tobytes().decode("utf-8", "replace")
            toks.append("".join(c.lower() if c in string.ascii_uppercase or "À" <= c <= "Þ" and c != "×" else c for c in t))
        return toks, kind.tolist()

    out = {}
    texts = {i: read(t) for i, t in docs}
    for item, text in items:
        it, ik = read(text)
        n = min(window, len(it))
        if not n:
            continue
        spots = range(len(it) - n + 1)
        usable = {p for p in spots if n >= 3 and 2 * sum(k == 0 for k in ik[p:p + n]) >= n}
        value = lambda toks, kinds, p: [f"{k}:{t.lower()}" for t, k in zip(toks[p:p + n], kinds[p:p + n]) if k]
        shape = lambda toks, kinds, p: [(k, t if k == 0 else "") for t, k in zip(toks[p:p + n], kinds[p:p + n])]
        for doc, (dt, dk) in texts.items():
            held, changed = set(), False
            for p in spots:
                if any(dt[q:q + n] == it[p:p + n] for q in range(len(dt) - n + 1)):
                    held.add(p)
            for shift in range(-len(it), len(dt) + 1):
                found = [p for p in sorted(usable) if 0 <= p + shift <= len(dt) - n and shape(it, ik, p) == shape(dt, dk, p + shift)
                         and 2 * sum(k == 0 for k in dk[p + shift:p + shift + n]) >= n]
                pairs = [(value(it, ik, p), value(dt, dk, p + shift)) for p in found]
                for p, good, (a, b) in zip(found, decontam.agreeing(pairs), pairs):
                    if good:
                        held.add(p)
                        changed |= a != b
            share = max(len(held) / len(spots), len(held & usable) / len(usable) if usable else 0)
            if share >= least:
                out[(doc, item)] = (share, changed)
    return out


def test_copies_equal_all_comparisons(spark):
    rnd = random.Random(12)
    plain_words = [f"w{c}{d}" for c in "abcdef" for d in "ghijk"]
    some = lambda n: [rnd.choice(plain_words) if rnd.random() < 0.75 else rnd.choice(["Paris", "Rome", "Oslo", "7", "12.5", "1,000", "km", "kg"]) for _ in range(n)]
    stem = some(12)
    items = [(i, " ".join((stem if i % 2 else some(rnd.randint(1, 12))) + some(rnd.randint(0, 14)))) for i in range(40)]
    docs = []
    for i in range(120):
        ws = some(rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            part = rnd.choice(items)[1].split(" ")
            a = rnd.randint(0, len(part) - 1)
            part = part[:len(part) - a // 2] if rnd.random() < 0.5 else part[a // 2:]
            if rnd.random() < 0.5:
                part = [{"Paris": "Lima", "7": "9", "kg": "mg"}.get(w, w) for w in part]
            if rnd.random() < 0.3 and part:
                part[rnd.randrange(len(part))] = "Quito"
            at = rnd.randint(0, len(ws))
            ws = ws[:at] + part + ws[at:]
        docs.append((i, " ".join(ws)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["slots_changed"]) for r in decontam.contaminated(d, b).collect()}
    want = plain_copies(docs, items)
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v[0], 9) for k, v in want.items()}
    assert {k for k, v in got.items() if v[1]} == {k for k, v in want.items() if v[1]} and 20 < len(want) < len(docs) * len(items) / 4


def test_values_that_conflict_with_most_windows_do_not_count():
    same, new, odd = (["2:paris", "1:9"],) * 2, (["2:paris"], ["2:rome"]), (["2:paris"], ["2:oslo"])
    assert decontam.agreeing([same, new, new, odd]) == [True, True, True, False]
    assert decontam.agreeing([same, new]) == [True, False] and decontam.agreeing([new, odd, odd]) == [False, True, True]


def test_templates_and_segments(monkeypatch):
    text = "In May Anna paid 1,200.50 euros for 3 kg; élan. Then 5 Cats ran — École!\nBob slept."
    data, offsets = common.arrow_bytes(pa.array([text]))
    h, kind, start, end = decontam.tokens(data, 0, int(offsets[1]))
    got = [(data[a:b].tobytes().decode(), int(k)) for k, a, b in zip(kind, start, end)]
    assert got == [("In", 0), ("May", 2), ("Anna", 2), ("paid", 0), ("1,200.50", 1), ("euros", 3), ("for", 0), ("3", 1), ("kg", 3), ("élan", 0), ("Then", 0),
                   ("5", 1), ("Cats", 2), ("ran", 0), ("École", 2), ("Bob", 0), ("slept", 0)]
    monkeypatch.setattr(decontam, "SEGMENT", 7)
    again = decontam.tokens(data, 0, int(offsets[1]))
    assert all(np.array_equal(a, b) for a, b in zip((h, kind, start, end), again))


def test_decontamination_of_odd_rows(spark):
    docs = odd_docs(spark)
    item = docs.where("doc_id = 8").first()["text"]
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contaminated(docs, bench).collect()} == {8}
    assert decontam.contaminated(no_docs(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


# ---- toxicity

def toxic_corpus():
    rnd = random.Random(8)
    common_words = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["bad" + "".join(rnd.choice("klmnop") for _ in range(3)) for _ in range(40)]
    docs, labels = [], []
    for i in range(3000):
        toxic = rnd.random() < 0.12
        ws = [rnd.choice(common_words) for _ in range(rnd.randint(20, 80))] + ([rnd.choice(bad) for _ in range(4)] if toxic else [])
        rnd.shuffle(ws)
        docs.append((i, " ".join(ws), toxic))
        if i % 3:
            labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):

    docs, labels = toxic_corpus()
    truth = {i: t for i, _, t in docs}
    got = tox.toxicity(spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"]]
    assert sum(p for t, p in held if t) >= 0.95 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.03 * len(held)


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (8, None), (77, 1)], "doc_id long, toxic int")
    for table in (labels, labels.limit(0)):
        got = tox.toxicity(docs, table).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["row"] in ("r", None) for r in got)
    assert tox.toxicity(no_docs(spark), labels).count() == 0


def test_toxicity_scores_equal_the_plain_model(spark, monkeypatch):
    """Scores from the model's weights, feature by feature; learned from the training fold alone."""
    kept, plain = [], tox.train_toxicity
    monkeypatch.setattr(tox, "train_toxicity", lambda *a: (kept.append(plain(*a)), kept[-1])[1])
    rnd = random.Random(5)
    letters = lambda abc, n: "".join(rnd.choice(abc) for _ in range(n))
    good, bad = ["w" + letters("abcdefghij", 5) for _ in range(2000)], ["bad" + letters("klmnop", 3) for _ in range(40)]
    docs, labels = [], []
    for i in range(1200):
        ws = [rnd.choice(good) for _ in range(rnd.randint(20, 90))] + ([rnd.choice(bad) for _ in range(5)] if i % 8 == 0 else [])
        rnd.shuffle(ws)
        docs.append((i, " ".join(ws)))
        if i % 3:
            labels.append((i, int(i % 8 == 0)))
    docs += [(9001, None), (9002, ""), docs[0]]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    got = tox.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    model, = kept
    place = {int(f): k for k, f in enumerate(model.features)}
    for r in got:
        found = sorted({place[int(f)] for f in tox.text_features(r["text"] or "", {}) if int(f) in place})
        want = sum(1 / (1 + math.exp(-(b + sum(w[k] for k in found)))) for w, b in zip(model.weights, model.bias)) / len(model.bias)
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= tox.THRESHOLD) and r["held_out"] == held(r["doc_id"])
    other = [(i, t if held(i) else 0) for i, t in labels if held(i)]
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]  # labels of held-out documents are never learned from
    again = tox.toxicity(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert other and sorted((r["doc_id"], round(r["score"], 9)) for r in again) == sorted((r["doc_id"], round(r["score"], 9)) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert sum((r["doc_id"] % 8 == 0) == (r["predicted"] == 1) for r in out) >= 0.95 * len(out)


def plain_risk(w, b, pos, unl, prior):
    """The non-negative risk estimate, text by text."""
    loss = lambda z, sign: math.log1p(math.exp(-sign * z))
    z = lambda row: b + sum(w[k] for k in row)
    positive = prior * sum(loss(z(r), 1) for r in pos) / len(pos)
    negative = sum(loss(z(r), -1) for r in unl) / len(unl) - prior * sum(loss(z(r), -1) for r in pos) / len(pos)
    return positive + max(0.0, negative)


def test_members_minimise_the_risk():
    rnd = np.random.default_rng(2)
    rows = lambda n, p: [np.flatnonzero(rnd.random(6) < p) for _ in range(n)]
    pos, unl = rows(60, [0.9, 0.7, 0.2, 0.5, 0.1, 0.3]), rows(160, [0.2, 0.2, 0.3, 0.5, 0.4, 0.3]) + rows(40, [0.9, 0.7, 0.2, 0.5, 0.1, 0.3])
    w, b = tox.train_member(pos, unl, 6, 0.2)
    best = plain_risk(w, b, pos, unl, 0.2)
    assert best < plain_risk(np.zeros(6), math.log(0.25), pos, unl, 0.2)
    for _ in range(30):
        step = rnd.normal(0, 0.3, 7)
        assert plain_risk(w + step[:6], b + step[6], pos, unl, 0.2) > best - 2e-3


# ---- language model

def plain_base(docs):

    count, out = Counter(), {}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in docs:
        if not held(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        ws = [*words(t), None]
        out[(i, t)] = (held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    return out


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 0.002)  # so that the join with rare words has work to do
    rnd = random.Random(6)
    tongues = [[f"{t}{rnd.randint(0, 99)}" for _ in range(80)] for t in "xyz"]
    docs = [(i, " ".join(rnd.choice(tongues[i % 3]) if rnd.random() < 0.97 else f"rare{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(5, 120)))) for i in range(900)]
    docs += [(9001, None), (9002, ""), (None, "x1 y1"), docs[3], docs[3]]
    got = lm.language_model_scores(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int")).collect()
    want = plain_base(docs)
    by_id = {i: v for (i, _), v in want.items()}
    assert len(got) == len(docs)
    for r in got:
        w = by_id[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4] and abs(r["base_score"] - w[4]) < 1e-6
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.08 * sum(r["n_tokens"] for r in held)


def test_every_round_reads_all_training_tokens(spark, monkeypatch):
    read, plain = [], lm.train_round
    monkeypatch.setattr(lm, "MOST", 3)
    monkeypatch.setattr(lm, "train_round", lambda events, *rest: (read.append(events.agg({"tokens": "sum"}).first()[0]), plain(events, *rest))[1])
    docs = spark.createDataFrame([(i, f"a{i % 7} b c{i % 3}") for i in range(60)], "doc_id long, text string")
    held = sum(r["held_out"] for r in lm.language_model_scores(docs).select("held_out").collect())
    assert 0 < held < 60 and read == [4 * (60 - held)] * lm.ROUNDS


def test_scores_equal_the_plain_sum(spark, monkeypatch):
    """The score from the model's tables, token by token in plain Python."""
    kept, plain = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: (kept.append((*plain(*a), a[1])), kept[-1][:2])[1])
    monkeypatch.setattr(lm, "FREQUENT", 0.01)
    rnd = random.Random(16)
    docs = [(i, " ".join(rnd.choice("alpha beta gamma delta epsilon".split()) if rnd.random() < 0.8 else f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 30)))) for i in range(80)]
    got = {r["doc_id"]: r["score"] for r in lm.language_model_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    (model, norm, corpus), = kept
    count = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), None])
    kind = dict(zip(model.words.tolist(), model.kind.tolist()))
    start = model.vocabulary + model.groups
    wide, narrow = model.tables(model.weights.astype(np.float64))
    assert abs(wide).max() > 0 and abs(narrow).max() > 0

    def log10(two, one, t):
        _, cb, wb = model.blocks(np.array([(two << 42) | (one << 21) | t]))
        x = [sum(wide[r][j] for r in cb[0]) + model.class_bias[j] for j in range(model.classes)]
        y = [sum(narrow[r][j] for r in wb[0]) + model.word_bias[t // lm.WIDTH][j] for j in range(lm.WIDTH)]
        return (x[t // lm.WIDTH] - math.log(sum(map(math.exp, x))) + y[t % lm.WIDTH] - math.log(sum(map(math.exp, y)))) / math.log(10)

    for i, text in docs:
        h, g, _ = lm.token_hashes(*common.arrow_bytes(pa.array([text])))
        total, two, one = 0.0, start, start
        for w, x, y in zip([*words(text), None], h.tolist(), g.tolist()):
            t = kind.get(x, model.vocabulary + (y * model.groups >> 8))
            total += log10(two, one, t)
            if t >= model.vocabulary:
                total += math.log10(count[w] + 0.5) - norm[t - model.vocabulary]
            two, one = one, t
        assert abs(total - got[i]) < 1e-4 * max(1, abs(total))


def test_language_model_of_odd_rows(spark):
    docs = odd_docs(spark)
    want = plain_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = lm.language_model_scores(docs).collect()
    assert len(got) == docs.count()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == Counter(
        (r["doc_id"], want[(r["doc_id"], r["text"])][1], want[(r["doc_id"], r["text"])][2], round(want[(r["doc_id"], r["text"])][4], 5)) for r in docs.collect())
    assert lm.language_model_scores(no_docs(spark)).count() == 0


def test_events_in_pieces_keep_their_counts():
    events, times = np.arange(50) * 7, np.arange(50) % 37 * 5 + 1
    e, n = lm.pieces_of(events, times)
    assert n.max() <= lm.MOST and n.min() > 0
    assert {int(k): int(n[e == k].sum()) for k in events} == dict(zip(events.tolist(), times.tolist()))


@pytest.mark.parametrize("tokens", [0, 10 ** 6, 10 ** 8, 10 ** 12])
def test_model_is_a_distribution_and_its_gradient_is_right(tokens):
    rnd = np.random.default_rng(0)
    vocabulary, groups, bits = lm.sizes(tokens)
    h = np.unique(rnd.integers(1, 1 << 63, 900).astype(np.uint64) * np.uint64(2))
    model = lm.initial_model(h, np.arange(len(h), 0, -1), np.full(groups, 7.0), vocabulary, bits)
    assert (model.types(h, np.zeros(len(h), np.uint16)) == np.arange(len(h))).all()  # no word of the vocabulary is lost
    model.weights[:] = rnd.normal(0, 0.3, len(model.weights))
    top = vocabulary + groups
    t = rnd.integers(0, top, 40)
    bounds = np.array([0, 3, 3, 40])
    five = np.repeat(model.events(t, bounds)[5:6] >> 21 << 21, top) | np.arange(top)  # every possible sixth token
    assert abs(np.exp(model.forward(model.weights, *model.blocks(five))[0]).sum() - 1) < 1e-4
    assert abs((10 ** model.log10(five)).sum() - 1) < 1e-4
    where = model.blocks(model.events(t, bounds))
    times = rnd.integers(1, 5, len(t))
    for k, rows, grad in lm.gradients(model, model.weights, *where, times):
        spot, column = rnd.integers(len(rows)), rnd.integers(grad.shape[1])
        slopes = []
        for table_rows, table_grad in [(r, g) for kk, r, g in lm.gradients(model, model.weights, *where, times) if kk == k]:
            slopes += table_grad[table_rows == rows[spot], column].tolist()  # one row can serve several features
        value = []
        for step in (1e-3, -1e-3):
            w = model.weights.astype(np.float64)
            model.tables(w)[k][rows[spot], column] += step
            value.append((model.forward(w, *where)[0] * times).sum())
        assert abs((value[0] - value[1]) / 2e-3 - sum(slopes)) < 2e-3


# ---- fingerprints

def plain_fingerprint(text, k=64):
    """The k smallest distinct shingle hashes, with the words' hashes put together in plain Python."""
    ws = words(text)
    if not ws:
        return []
    h, _ = common.word_hashes(*common.arrow_bytes(pa.array([" ".join(w.decode() for w in ws)])))
    h, n, top = h.tolist(), min(5, len(ws)), (1 << 64) - 1

    def mixed(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & top
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & top
        return x ^ (x >> 32)

    out = set()
    for i in range(len(h) - n + 1):
        x = 0
        for w in h[i:i + n]:
            x = (x * 0xA24BAED4963EE407 + w) & top
        out.add(mixed((x + n) & top))
    return sorted(out)[:k], len(out)


def plain_likeness(a, b, k=64):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else sum(x in a and x in b for x in union) / len(union)


@pytest.mark.parametrize("part", [1 << 16, 12])
def test_fingerprints_equal_the_plain_ones(spark, monkeypatch, part):
    monkeypatch.setattr(fp, "PART", part)
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fp.neighbour_fingerprints(docs).collect()}
    plain = {t: plain_fingerprint(t) or ([], 0) for _, t in rows}
    for at, (i, t) in enumerate(rows):
        after = rows[(at + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = plain_fingerprint(t[:len(t) - cut] + after[:cut]) or ([], 0)
        own, n = plain[t]
        r = got[i]
        assert fp.unpack(r["fingerprint"]).tolist() == own and fp.unpack(r["edited_fingerprint"]).tolist() == edited[0]
        assert abs(r["near_edited"] - plain_likeness(own, edited[0])) < 1e-12 and abs(r["near_next"] - plain_likeness(own, plain[after][0])) < 1e-12
        assert r["n_shingles"] == n if n < 64 else abs(r["n_shingles"] - n) < 0.6 * n
        both = set(own) & set(edited[0])
        if n < 64 and edited[1] < 64 and len(set(own) | set(edited[0])) <= 64:  # sketches that hold everything are exact
            assert abs(r["in_edited"] - (len(both) / n if n else 1.0)) < 1e-9


def test_column_names_of_any_kind(spark):
    import public_tokenizers
    from salient.llm import sentencepiece_spans as sps
    docs = spark.createDataFrame([(1, "a b c d e f", 3, "x"), (2, None, 4, None)], "doc_id long, text string, `my-col` int, `a.b c` string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for df in (fp.with_fingerprint(docs), tox.toxicity(docs, labels), sps.encode_spans(docs, public_tokenizers.path("piece_bpe_32k.model"))):
        assert {(r["my-col"], r["a.b c"]) for r in df.collect()} == {(3, "x"), (4, None)}


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fp, "range_starts", lambda df, key, weight: common.range_starts(df, key, weight, 3000))
    docs = odd_docs(spark).where("doc_id is not null or text is not null")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        want[(i, len(t), hashlib.sha256((t[:len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest())] += 1
    got = fp.neighbour_fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[r["doc_id"]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prints[4] == prints[5] and all(len(v) == 1 for v in prints.values())
    assert fp.neighbour_fingerprints(no_docs(spark)).count() == 0


def test_sketches_merge_and_estimate(spark):
    rnd = np.random.default_rng(1)
    a, b = (np.unique(rnd.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    half = np.unique(np.concatenate([a[::2], b]))
    assert np.array_equal(fp.merge(fp.sketch(a), fp.sketch(b)), fp.sketch(np.union1d(a, b)))
    assert fp.resemblance(a[:64], a[:64]) == 1 and fp.containment(a[:64], a[:64]) == 1 and fp.resemblance(a[:0], a[:0]) == 1 and fp.resemblance(a[:0], a[:9]) == 0
    k = 1024
    true = len(np.intersect1d(a, half)) / len(np.union1d(a, half))
    assert abs(fp.resemblance(a[:k], half[:k], k) - true) < 0.06 and abs(fp.containment(a[:k], half[:k], k) - 0.5) < 0.1
    assert abs(fp.distinct_shingles(a[:k], k) / len(a) - 1) < 0.15 and fp.distinct_shingles(a[:10], k) == 10
    docs = spark.createDataFrame([(g, " ".join(f"{g}{i}" for i in range(s, s + 40)), "x") for g in ("p", "q", None) for s in range(0, 200, 20)], "g string, text string, f string")
    parts = fp.with_fingerprint(docs)
    merged = {r["g"]: r["fingerprint"] for r in fp.merge_fingerprints(parts, ["g"]).collect()}
    for g in ("p", "q", None):
        own = np.zeros(0, np.uint64)
        for r in parts.where("g is null" if g is None else f"g = '{g}'").collect():
            own = np.union1d(own, fp.unpack(r["fingerprint"]))
        assert np.array_equal(fp.unpack(merged[g]), own[:fp.K])
