import inspect
import random

import pytest

import corpus_pipeline
from salient.llm.queries import ORACLES, QUERIES
from salient.session import scratch_path
from tests.llm.helpers import DOCS, no_docs, odd_docs, shingles


@pytest.fixture(scope="module")
def folder(spark):
    """Documents with planted cases beside clean ones, labels, and a benchmark."""
    rnd = random.Random(21)
    vocabulary = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    bad = ["bad" + "".join(rnd.choice("klmnop") for _ in range(3)) for _ in range(40)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    item, shared = "What is the share of " + prose(30), prose(60)
    docs, labels, kind = [], [], {}
    for i in range(1500):
        text = "\n".join(prose(rnd.randint(15, 40)) for _ in range(3))
        kind[i] = "clean"
        if i % 8 == 0:
            text += " " + " ".join(rnd.choice(bad) for _ in range(5))
            kind[i] = "toxic"
        elif i % 50 == 1:
            text = prose(30) + "\n" + item + "\n" + prose(30)
            kind[i] = "leak"
        elif i % 30 == 2:
            text = text + "\n" + shared
            kind[i] = "passage"
        elif i % 100 == 3 and i > 3:
            text, kind[i] = docs[3][1], "copy"
        elif i % 100 == 5 and i > 5:
            ws = docs[5][1].split(" ")
            ws[rnd.randrange(len(ws))] = "changed"
            text, kind[i] = " ".join(ws), "near"
        docs.append((i, text, "en", f"src{rnd.randrange(20)}", len(text), "r", 0.5, i, "l"))
        if i % 3:
            labels.append((i, 1, int(kind[i] == "toxic")))
    kind[3] = kind[5] = "first"
    path = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kind, shared, {d[0]: d[1] for d in docs}


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage-test")
        stage(spark, docs, folder).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_take_effect(spark, folder):
    path, kind, shared, text = folder
    out = stages(spark, path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    ids = {n: {r["doc_id"] for r in out[n].select("doc_id").collect()} for n in names}
    for n in names[:-1]:
        assert out[n].schema.names == spark.read.parquet(f"{path}/documents.parquet").schema.names
    toxic = {i for i, k in kind.items() if k == "toxic"}
    assert len(toxic - ids["toxicity"]) >= 0.95 * len(toxic) and len(ids["toxicity"] - toxic) >= 0.98 * (len(kind) - len(toxic))
    after = {r["doc_id"]: r for r in out["line dedup"].collect()}
    holds = sorted(i for i in ids["toxicity"] if kind[i] == "passage")
    assert [i for i in holds if shared in after[i]["text"]] == holds[:1]
    assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in holds)
    assert all(after[i]["text"] == text[i] for i in ids["line dedup"] if kind[i] in ("clean", "first"))
    seen = ids["line dedup"]
    assert all(kind[i] in ("copy", "near", "first", "leak") for i in seen - ids["MinHash near-dedup"])
    left = [shingles(after[i]["text"]) for i in ids["MinHash near-dedup"] if kind[i] in ("copy", "near", "first")]
    assert not any(a is not b and 100 * len(a & b) >= 75 * len(a | b) for a in left for b in left)
    gone = ids["MinHash near-dedup"] - ids["benchmark decontamination"]
    # line dedup leaves the item in its first document; all that still hold it go
    assert gone and all(kind[i] == "leak" for i in gone) and not any("What is the share of" in after[i]["text"] for i in ids["benchmark decontamination"])
    assert ids[names[-1]] == ids["benchmark decontamination"]


def test_run_is_the_stages_in_order(spark, folder):
    whole = corpus_pipeline.run(spark, folder[0]).collect()
    last = stages(spark, folder[0])[corpus_pipeline.STAGES[-1][0]].collect()
    assert sorted(whole) == sorted(last)


def test_texts_of_spread_lines_keep_one_document(spark, folder):
    rows = [(i, f"own {i}\nAll rights reserved.\nA.", f"s{i}") for i in range(10)]  # where both lines occur first
    rows += [(20 + i, "A.", f"s{i % 10}") for i in range(4)] + [(30, "A.\nAll rights reserved.", "s1"), (31, " \nA.\n", "s2"), (40, " \n", "s3"), (30, "A.\nAll rights reserved.", "s1")]
    docs = spark.createDataFrame([(i, t, s, len(t), i, "r") for i, t, s in rows], "doc_id long, text string, source string, n_chars long, k1 long, row string")
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.drop_spread_lines(spark, docs, folder[0]).collect())
    text = dict((i, t) for i, t, _ in rows)
    want = [(i, text[i] if i == 0 else f"own {i}") for i in range(10)] + [(i, text[i]) for i in (20, 30, 30, 31, 40)]
    assert got == [(i, t, len(t)) for i, t in want]


def test_one_id_with_two_texts_is_two_rows(spark, folder):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(7, one), (7, two), (7, one), (8, one)], "doc_id long, text string")
    got = sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder[0]).collect())
    assert got == [(7, one), (7, two)]


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_stages_of_odd_rows(spark, folder, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage-test")
        stage(spark, docs, folder[0]).write.parquet(path)
        docs = spark.read.parquet(path)
    if make is odd_docs:
        ids = [r["doc_id"] for r in docs.collect()]
        assert ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and {0, 1, 2, 3} <= set(ids)


def test_queries_are_registered_and_read_whole_tables():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    for q in QUERIES.values():
        assert "limit(" not in inspect.getsource(q) and "sample(" not in inspect.getsource(q)
