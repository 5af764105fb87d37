"""Manifest operators on hand-made fixtures."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from salient.operators import manifests as K


def test_box_conversion_formats(spark):
    df = spark.createDataFrame([("a", [[10.0, 20.0, 4.0, 6.0]])], "path STRING, bbox ARRAY<ARRAY<DOUBLE>>")
    expect = {
        "yxyx": [10.0, 20.0, 4.0, 6.0],
        "xyxy": [20.0, 10.0, 6.0, 4.0],
        "yxhw": [10.0, 20.0, 14.0, 26.0],
        "xywh": [20.0, 10.0, 26.0, 14.0],
        "cycxhw": [8.0, 17.0, 12.0, 23.0],
        "cxcywh": [17.0, 8.0, 23.0, 12.0],
    }
    for fmt, want in expect.items():
        assert K.convert_boxes(df, fmt).first()["bbox"][0] == pytest.approx(want)
    with pytest.raises(ValueError):
        K.convert_boxes(df, "bad")


def test_label_index_numeric_and_mixed(spark):
    num = spark.createDataFrame([("3",), ("10",), ("3",)], "label STRING")
    assert {r["raw_label"]: r["label_id"] for r in K.label_index(num).collect()} == {"3": 3, "10": 10}
    mixed = spark.createDataFrame([("dog",), ("10",), ("cat",)], "label STRING")
    assert {r["raw_label"]: r["label_id"] for r in K.label_index(mixed).collect()} == {"10": 0, "cat": 1, "dog": 2}


def test_recognition_manifest_unknown_test_label(spark):
    train = spark.createDataFrame([("r/a/1.jpg",), ("r/b/2.jpg",)], "path STRING")
    test = spark.createDataFrame([("t/c/3.jpg",)], "path STRING")
    with pytest.raises(KeyError):
        K.recognition_manifest(train, test)
    rows, info, classes = K.recognition_manifest(train, spark.createDataFrame([("t/b/9.jpg",)], "path STRING"))
    assert sorted((r["split"], r["label"]) for r in rows.collect()) == [("test", 1), ("train", 0), ("train", 1)]
    assert info.first()["num_classes"] == 2


def test_round_robin_captions(spark):
    images = spark.createDataFrame([("d/a.jpg", 0), ("d/b.jpg", 1), ("d/c.jpg", 2)], "image STRING, image_pos BIGINT")
    caps = spark.createDataFrame([("a.jpg", "a1", 0), ("a.jpg", "a2", 1), ("a.jpg", "a3", 2), ("c.jpg", "c1", 0)],
                                 "image STRING, caption STRING, line BIGINT")
    got = K.match_captions(images, caps).orderBy("rn", "image_pos").collect()
    assert [r["caption"] for r in got] == ["a1", "c1", "a2", "a3"]  # b has no caption: dropped


def test_caption_lines_cleaning(spark):
    tr = spark.createDataFrame([("i.jpg", "x\ty\nz", 1, 0)], "image STRING, caption STRING, rn BIGINT, image_pos BIGINT")
    te = tr.limit(0)
    lines = [r["line"] for r in K.caption_manifest_lines(tr, te, "/b").orderBy("section", "rn", "image_pos").collect()]
    assert lines == ["base_path\t/b", "i.jpg\tx yz", "TEST\tTEST"]


def test_parse_box_text_and_encode(spark):
    files = spark.createDataFrame([("f1", "cat 1 2 3 4\ndog 5 6 7 8\n"), ("f2", "bird 0 0 1 1")], "path STRING, value STRING")
    objs = K.parse_box_text(files)
    got = {r["path"]: (r["label"], r["bbox"]) for r in objs.collect()}
    assert got["f1"] == (["cat", "dog"], [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]])
    enc, info = K.encode_box_labels(objs, F.col("path") == "f1")
    labels = {r["path"]: r["label"] for r in enc.collect()}
    assert labels == {"f1": [0, 1], "f2": [-1]}
    assert info.first()["num_classes"] == 2
    digits = spark.createDataFrame([("f", "7 1 1 1 1\n2 1 1 1 1")], "path STRING, value STRING")
    enc2, info2 = K.encode_box_labels(K.parse_box_text(digits))
    assert enc2.first()["label"] == [7, 2] and info2.first()["num_classes"] == 8


def test_coco_boxes_and_backgrounds(spark):
    images = spark.createDataFrame([(1, "a.jpg", 10.0, 20.0), (2, "b.jpg", 10.0, 10.0)],
                                   "image_id INT, file_name STRING, width DOUBLE, height DOUBLE")
    anns = spark.createDataFrame([(1, 5, [1.0, 2.0, 3.0, 4.0], 0, 0), (1, 6, [0.0, 0.0, 1.0, 1.0], 1, 1)],
                                 "image_id INT, category_id INT, bbox ARRAY<DOUBLE>, iscrowd INT, ann_order INT")
    cats = spark.createDataFrame([(5, "x"), (6, "y")], "id INT, name STRING")
    objs, i2l = K.coco_boxes(images, anns, cats)
    r = objs.first()
    assert r["image"] == "a.jpg" and r["label"] == [5]
    assert r["bbox"][0] == pytest.approx([0.1, 0.1, 0.3, 0.4])
    assert dict(i2l.first()["indices_2_labels"]) == {5: "x", 6: "y"}
    full = K.add_backgrounds(images.select("image_id", F.col("file_name").alias("image")), objs, "image_id")
    assert {x["image"]: len(x["label"]) for x in full.collect()} == {"a.jpg": 1, "b.jpg": 0}


def test_match_label_files_and_ordinal(spark):
    imgs = spark.createDataFrame([("d/1.jpg",), ("d/2.png",), ("d/3.jpg",)], "image STRING")
    labs = spark.createDataFrame([("l/1.txt",), ("l/2.txt",)], "path STRING")
    matched, missing = K.match_label_files(imgs, labs)
    assert sorted(r["image"] for r in matched.collect()) == ["d/1.jpg", "d/2.png"]
    assert [r["image"] for r in missing.collect()] == ["d/3.jpg"]
    files = spark.createDataFrame([(f"v/ILSVRC2012_val_{i:08d}.JPEG",) for i in (1, 3)], "path STRING")
    lines = spark.createDataFrame([(1, "n01 "), (2, "n02"), (3, "n03")], "line_no INT, label STRING")
    ok, miss = K.assign_labels_by_ordinal(files, lines)
    assert sorted((r["path"][-10:], r["label"]) for r in ok.collect()) == [("00001.JPEG", "n01"), ("00003.JPEG", "n03")]
    assert [r["line_no"] for r in miss.collect()] == [2]


def test_list_files_binary_source(spark):
    root = tempfile.mkdtemp(prefix="salient-list-")
    for cls, name in (("a", "1.jpg"), ("a", "2.txt"), ("b", "3.png"), ("b", "4.JPEG")):
        os.makedirs(os.path.join(root, cls), exist_ok=True)
        with open(os.path.join(root, cls, name), "wb") as fh:
            fh.write(b"x" * 3)
    got = sorted(os.path.relpath(r["path"], root) for r in K.list_files(spark, root).collect())
    assert got == ["a/1.jpg", "b/3.png", "b/4.JPEG"]


def test_hash_split_is_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    a = {r["k"]: r["split"] for r in K.hash_split(df, "k", 0.3).collect()}
    b = {r["k"]: r["split"] for r in K.hash_split(df.repartition(7), "k", 0.3).collect()}
    assert a == b
    assert 200 < sum(v == "test" for v in a.values()) < 400


def test_rank_within_key_splits_hot_key(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 3), ("a", 1), ("b", 7)]
    df = spark.createDataFrame(rows, "key STRING, line INT")
    got = {(r["key"], r["line"]): r["rn"] for r in K.rank_within_key(df, "key", "line", partitions=7).collect()}
    assert all(got[("hot", i)] == i + 1 for i in range(500))
    assert got[("a", 1)] == 1 and got[("a", 3)] == 2 and got[("b", 7)] == 1
    pieces = (df.repartitionByRange(7, "key", "line").withColumn("p", F.spark_partition_id())
              .filter(F.col("key") == "hot").select("p").distinct().count())
    assert pieces > 1  # the hot key really is spread over several tasks


def test_write_lines_global_order(spark, tmp_path):
    rows = [(1, rn, pos, f"img{pos}\tc{rn}") for rn in (1, 2) for pos in range(30)]
    rows += [(0, 0, 0, "base_path\t"), (2, 0, 0, "TEST\tTEST"), (3, 1, 5, "t5\tx")]
    df = spark.createDataFrame(rows, "section INT, rn BIGINT, image_pos BIGINT, line STRING").repartition(5)
    path = str(tmp_path / "tsv")
    K.write_lines(df, path)
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    text = [ln for p in parts for ln in open(os.path.join(path, p)).read().splitlines()]
    want = ["base_path\t"] + [f"img{pos}\tc{rn}" for rn in (1, 2) for pos in range(30)] + ["TEST\tTEST", "t5\tx"]
    assert text == want


def test_caption_readers(spark, tmp_path):
    import json
    tsv = tmp_path / "caps.tsv"
    tsv.write_text("a.jpg#0\tfirst a\na.jpg#1\tsecond a\nb.jpg#0\tonly b\n")
    got = sorted((r["image"], r["caption"]) for r in K.read_captions(spark, str(tsv), "tsv").collect())
    assert got == [("a.jpg", "first a"), ("a.jpg", "second a"), ("b.jpg", "only b")]
    js = tmp_path / "caps.json"
    js.write_text(json.dumps([{"image": "x/a.jpg", "caption": "c1"}, {"image": "x/b.jpg", "caption": "c2"}]))
    got = sorted((r["image"], r["caption"]) for r in K.read_captions(spark, str(js), "json").collect())
    assert got == [("x/a.jpg", "c1"), ("x/b.jpg", "c2")]
    both = tmp_path / "both.json"
    both.write_text(json.dumps({"train": [{"image": "a.jpg", "caption": "t"}], "test": [{"image": "b.jpg", "caption": "u"}]}))
    assert [r["caption"] for r in K.read_captions(spark, str(both), "json", "test").collect()] == ["u"]
    coco = tmp_path / "coco.json"
    coco.write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],
                                "annotations": [{"image_id": 2, "caption": "bb"}, {"image_id": 1, "caption": "aa"},
                                                {"image_id": 2, "caption": "bb2"}]}))
    got = [(r["image"], r["caption"]) for r in K.read_captions(spark, str(coco), "coco").orderBy("line").collect()]
    assert got == [("b.jpg", "bb"), ("a.jpg", "aa"), ("b.jpg", "bb2")]


def test_read_box_text_files(spark, tmp_path):
    d = tmp_path / "labels"
    d.mkdir()
    (d / "img1.txt").write_text("car 0.1 0.2 0.3 0.4\nbus 0.5 0.6 0.7 0.8\n")
    (d / "img2.txt").write_text("car 1 1 2 2\n")
    got = {os.path.basename(r["path"]): (r["label"], r["bbox"]) for r in K.read_box_text(spark, str(d)).collect()}
    assert got["img1.txt"] == (["car", "bus"], [[0.1, 0.2, 0.3, 0.4], [0.5, 0.6, 0.7, 0.8]])
    assert got["img2.txt"] == (["car"], [[1.0, 1.0, 2.0, 2.0]])


def test_coco_objects_hot_image(spark):
    images = spark.createDataFrame([(1, "hot.jpg", 10.0, 10.0), (2, "a.jpg", 10.0, 10.0), (3, "bg.jpg", 5.0, 5.0)],
                                   "image_id INT, file_name STRING, width DOUBLE, height DOUBLE")
    anns = [(1, 7, [float(i), 0.0, 1.0, 1.0], 0, i) for i in range(300)] + [(2, 8, [1.0, 1.0, 2.0, 2.0], 0, 0)]
    anns = spark.createDataFrame(anns, "image_id INT, category_id INT, bbox ARRAY<DOUBLE>, iscrowd INT, ann_order INT")
    objs = K.coco_objects(images, anns)
    hot = sorted((r["obj_idx"], r["lft"]) for r in objs.filter(F.col("image_id") == 1).collect())
    assert [o for o, _ in hot] == list(range(300))
    assert [l for _, l in hot] == pytest.approx([i / 10.0 for i in range(300)])
    full = K.add_background_rows(images.select("image_id", F.col("file_name").alias("image")), objs)
    bg = full.filter(F.col("image_id") == 3).collect()
    assert len(bg) == 1 and bg[0]["obj_idx"] is None and bg[0]["image"] == "bg.jpg"
    assert full.count() == 302


def test_equal_records_keep_their_own_objects(spark):
    rows = [("a", ["cat"], [[0.0, 0.0, 1.0, 1.0]]), ("a", ["dog"], [[0.0, 0.0, 1.0, 1.0]]), ("b", [], []), ("c", ["dog", "emu", "cat"], [[0.0] * 4] * 3)]
    df = spark.createDataFrame(rows, "path string, label array<string>, bbox array<array<double>>")
    out, info = K.encode_box_labels(df, F.col("path") != "c")
    assert sorted((r["path"], r["label"], len(r["bbox"])) for r in out.collect()) == [("a", [0], 1), ("a", [1], 1), ("b", [], 0), ("c", [1, -1, 0], 3)]
    assert info.first()["num_classes"] == 2


def test_root_is_plain_text(spark):
    df = spark.createDataFrame([("data.x/a/1.jpg",), ("dataQx/a/2.jpg",), ("data.x/3.jpg",)], "path string")
    assert [r["path"] for r in K.list_paths(df, root="data.x/").collect()] == ["data.x/a/1.jpg"]


def test_images_with_one_basename(spark):
    images = spark.createDataFrame([("x/i.jpg", 2), ("y/i.jpg", 1), ("z/j.jpg", 3)], "image string, image_pos long")
    caps = spark.createDataFrame([("i.jpg", "one", 0), ("i.jpg", "two", 1), ("j.jpg", "three", 0)], "image string, caption string, line long")
    got = sorted((r["image"], r["caption"], r["rn"]) for r in K.match_captions(images, caps).collect())
    assert got == [("y/i.jpg", "one", 1), ("y/i.jpg", "two", 2), ("z/j.jpg", "three", 1)]
    assert [tuple(r) for r in K.duplicate_images(images).collect()] == [("i.jpg", 2, "y/i.jpg")]


# --- JSON arrays by byte ranges ----------------------------------------------------------

TRICKY = ["", "plain", '"', "\\", '\\"', "[", "]", "{", "},", ",", '"items": [', '"items"', "é中🙂", "\n\t", "\\\\\\", 'a\\"]}', " "]


def json_file(path, rng, field):
    import json
    items = [{"id": i, "name": "".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 6))), "box": [float(i), 0.5] * rng.randint(0, 2)} for i in range(rng.randint(0, 60))]
    if field is None:
        doc = items
    else:
        doc = {"info": {"items": [1, {"items": ["]"]}], "note": '"items": [{"id": 7}]'}, "others": [{"id": -1, "items": [{"id": -2}]}], "items": items, "after": [{"id": -3}], "x": None}
    path.write_text(json.dumps(doc, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5), encoding="utf-8")
    return [(i["id"], i["name"], i["box"]) for i in items]


@pytest.mark.parametrize("field,range_bytes", [("items", 7), ("items", 100), ("items", 1 << 20), (None, 11), (None, 64)])
def test_json_arrays_are_read_whole(spark, tmp_path, field, range_bytes):
    import random
    from salient.sources.json_arrays import read_json_array
    rng = random.Random(range_bytes)
    want = {f"f{k}.json": json_file(tmp_path / f"f{k}.json", rng, field) for k in range(3)}
    if range_bytes < 20:  # few bytes a range, and so many ranges: one short file
        want = {"s.json": []}
        (tmp_path / "one").mkdir()
        for k in range(50):
            want["s.json"] = json_file(tmp_path / "one" / "s.json", rng, field)
            if 300 < (tmp_path / "one" / "s.json").stat().st_size < 1200:
                break
    folder = tmp_path / "one" if range_bytes < 20 else tmp_path
    rows = read_json_array(spark, str(folder), "id long, name string, box array<double>", field, range_bytes).orderBy("file", "place").collect()
    got = {name: [(r["id"], r["name"], r["box"]) for r in rows if r["file"].endswith(name)] for name in want}
    assert got == want and len(rows) == sum(map(len, want.values()))


@pytest.mark.parametrize("field,range_bytes,piece_bytes", [("items", 1 << 20, 5), ("items", 300, 64), (None, 1 << 20, 9)])
def test_json_arrays_do_not_depend_on_the_pieces(spark, tmp_path, field, range_bytes, piece_bytes):
    import random
    from salient.sources.json_arrays import read_json_array
    want = json_file(tmp_path / "f.json", random.Random(piece_bytes), field)
    rows = read_json_array(spark, str(tmp_path), "id long, name string, box array<double>", field, range_bytes, piece_bytes).orderBy("place").collect()
    assert [(r["id"], r["name"], r["box"]) for r in rows] == want


def test_json_ranges_are_read_in_little_memory(spark, tmp_path, monkeypatch):
    """a range of 8 MB took more than 40 times its size."""
    import json
    import tracemalloc
    from salient.sources import json_arrays
    n = 80000
    (tmp_path / "a.json").write_text("[" + ",".join(json.dumps({"id": i, "name": "\\" * (i % 3) + '"[,{' + "x" * 60}) for i in range(n)) + "]")
    peaks = []

    def each(session, ranges, schema, work):  # in this process, to see what it holds
        rows = []
        names = [c.strip().split(" ")[0] for c in "path string, size long, start long, end long, inside boolean, depth long, first long, last long".split(",")]
        for r in ranges:
            with json_arrays.pafs.LocalFileSystem().open_input_file(str(tmp_path / "a.json")) as file:
                tracemalloc.start()
                for batch in work(file, dict(zip(names, (*r, False, 0, -1, -1)[:8]))):
                    if "json" in batch.schema.names:
                        rows.append((r[0], batch.num_rows, str(batch.column("json")[0])))
                    else:
                        rows += [tuple(x.values()) for x in batch.to_pylist()]
                peaks.append(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()
        return session.createDataFrame(rows, schema)

    monkeypatch.setattr(json_arrays, "_each", each)
    out = json_arrays.read_json_array(spark, str(tmp_path / "a.json"), "id long, name string")
    assert out.agg({"place": "sum"}).first()[0] == n  # the batches' row counts stand in for places
    assert len(peaks) == 3 and max(peaks) < 40 << 20


def test_json_arrays_that_are_not_there(spark, tmp_path):
    from salient.sources.json_arrays import read_json_array
    (tmp_path / "a.json").write_text('{"other": [{"id": 1}], "items": null}')
    (tmp_path / "b.json").write_text('{"items": []}')
    (tmp_path / "c.json").write_text("")
    assert read_json_array(spark, str(tmp_path), "id long", "items").count() == 0
    assert read_json_array(spark, str(tmp_path), "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        read_json_array(spark, str(tmp_path / "none"), "id long")


def test_images_of_a_file_are_not_broadcast_for_their_ranges_size(spark, tmp_path):
    """the images counted as the few bytes of their ranges, and the driver held them all."""
    import json
    n = 20000
    doc = {"images": [{"id": i, "file_name": f"{i}.jpg", "width": 10, "height": 20} for i in range(n)],
           "annotations": [{"image_id": i, "category_id": 5, "bbox": [1, 2, 3, 4]} for i in range(n)], "categories": []}
    (tmp_path / "ann.json").write_text(json.dumps(doc))
    listing = spark.range(1, n + 5).select(F.concat(F.lit("set/"), F.col("id").cast("string"), F.lit(".jpg")).alias("image"))
    images, anns, _ = K.read_coco(spark, str(tmp_path / "ann.json"))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        objs = K.coco_objects(images, anns, [5], listing)
        got = objs.collect()
        text = objs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    assert sorted((r["image"], r["obj_idx"], r["top"]) for r in got) == sorted((f"set/{i}.jpg", 0, 0.1) for i in range(1, n))
    assert "isFinalPlan=true" in text and "SortMergeJoin" in text and "Broadcast" not in text


def test_a_json_range_is_a_task(spark, tmp_path):
    import json
    from salient.sources.json_arrays import read_json_array
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "name": "x" * 50} for i in range(300)]))
    size = (tmp_path / "a.json").stat().st_size
    rows = read_json_array(spark, str(tmp_path / "a.json"), "id long, name string", range_bytes=1000)
    found = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("id").alias("n")).collect()
    assert len(found) == -(-size // 1000) and sum(r["n"] for r in found) == 300
    assert max(r["n"] for r in found) <= 20


def test_coco_files_listing_and_targets(spark, tmp_path):
    import json
    doc = {"images": [{"id": i, "file_name": f"{i}.jpg", "width": 10, "height": 20} for i in (1, 2, 3)],
           "annotations": [{"image_id": 1, "category_id": c, "bbox": [1, 2, 3, 4], "iscrowd": int(c == 9)} for c in (5, 6, 9)]
           + [{"image_id": 2, "category_id": 5, "bbox": [0, 0, 10, 20]}, {"image_id": 3, "category_id": 6, "bbox": [0, 0, 1, 1]}],
           "categories": [{"id": 5, "name": "car"}, {"id": 9, "name": "bus"}]}
    (tmp_path / "ann.json").write_text(json.dumps(doc))
    images, anns, cats = K.read_coco(spark, str(tmp_path / "ann.json"))
    listing = spark.createDataFrame([("set/1.jpg",), ("set/3.jpg",), ("set/4.jpg",)], "image string")
    objs = K.coco_objects(images, anns, [5, 9], listing)
    assert [(r["image"], r["obj_idx"], r["label"], r["top"], r["rgt"]) for r in objs.collect()] == [("set/1.jpg", 0, 5, 0.1, 0.4)]
    rows, info, classes = K.detection_manifest(listing, objs, categories=cats, base_path="/b")
    assert tuple(info.first()) == (10, "/b")  # the largest category number + 1
    assert sorted((r["image"], r["label"]) for r in rows.collect()) == [("set/1.jpg", 5), ("set/3.jpg", None), ("set/4.jpg", None)]
    assert sorted(tuple(r) for r in classes.collect()) == [("bus", 9), ("car", 5)]


def test_detection_manifest_from_label_files(spark, tmp_path):
    d = tmp_path / "labels"
    d.mkdir()
    (d / "a.txt").write_text("dog 1 2 3 4\n\ncat 0 0 2 2\n")
    (d / "b.txt").write_text("cat 5 5 1 1\n")
    (d / "t.txt").write_text("emu 1 1 1 1\ncat 2 2 2 2\n")
    images = spark.createDataFrame([("i/a.jpg",), ("i/b.png",), ("i/c.jpg",)], "image string")
    test = spark.createDataFrame([("i/t.jpg",), ("i/u.jpg",)], "image string")
    lines = K.read_box_lines(spark, str(d))
    objs, missing = K.label_dir_objects(images, lines)
    assert [r["image"] for r in missing.collect()] == ["i/c.jpg"]
    tobjs, _ = K.label_dir_objects(test, lines)
    rows, info, classes = K.detection_manifest(images, objs, test, tobjs, box_format="xywh", base_path="b")
    got = sorted(((r["split"], r["image"], -1 if r["obj_idx"] is None else r["obj_idx"], r["label"], r["top"], r["rgt"]) for r in rows.collect()), key=str)
    assert got == sorted([("train", "i/a.jpg", 0, 1, 2.0, 4.0), ("train", "i/a.jpg", 1, 0, 0.0, 2.0), ("train", "i/b.png", 0, 0, 5.0, 6.0), ("train", "i/c.jpg", -1, None, None, None),
                          ("test", "i/t.jpg", 0, -1, 1.0, 2.0), ("test", "i/t.jpg", 1, 0, 2.0, 4.0), ("test", "i/u.jpg", -1, None, None, None)], key=str)
    assert tuple(info.first()) == (2, "b") and sorted(tuple(r) for r in classes.collect()) == [("cat", 0), ("dog", 1)]
    digits = spark.createDataFrame([("i/a.jpg", 0, "7", 0.0, 0.0, 1.0, 1.0), ("i/a.jpg", 1, "3", 0.0, 0.0, 1.0, 1.0)], "image string, obj_idx int, label string, v1 double, v2 double, v3 double, v4 double")
    rows, info, _ = K.detection_manifest(images, digits, box_format="yxyx")
    assert info.first()["num_classes"] == 8 and sorted(r["label"] for r in rows.where("obj_idx is not null").collect()) == [3, 7]
    nested = {r["image"]: (r["label"], r["bbox"]) for r in K.nested_objects(rows).collect()}
    assert nested["i/a.jpg"][0] == [7, 3] and nested["i/b.png"] == ([], [])


def test_label_index_is_no_single_task(spark):
    labels = spark.createDataFrame([(f"c{i:04d}",) for i in range(500)], "label string")
    out = K.label_index(labels)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["raw_label"]: r["label_id"] for r in out.collect()} == {f"c{i:04d}": i for i in range(500)}


def test_caption_manifest_json(spark, tmp_path):
    import json
    train = spark.createDataFrame([(f"{i}.jpg", f"c{i} {k}", k, i) for k in (1, 2) for i in range(40)], "image string, caption string, rn int, image_pos long")
    test = spark.createDataFrame([("t.jpg", "t\t\"x\"", 1, 0)], "image string, caption string, rn int, image_pos long")
    rows, info = K.caption_manifest(train.repartition(5), test, "/b")
    path = str(tmp_path / "out")
    K.write_caption_json(rows, info, path)
    read = lambda split: [json.loads(line) for f in sorted(os.listdir(f"{path}/rows/split={split}")) if f.startswith("part-") for line in open(f"{path}/rows/split={split}/{f}")]
    assert [(r["image"], r["caption"]) for r in read("train")] == [(f"{i}.jpg", f"c{i} {k}") for k in (1, 2) for i in range(40)]
    assert [(r["image"], r["caption"]) for r in read("test")] == [("t.jpg", "t\t\"x\"")]
    assert spark.read.json(f"{path}/info").first()["base_path"] == "/b"
    assert K.caption_manifest(train)[0].select("split").distinct().collect()[0]["split"] == "train"


def test_rank_within_key_writes_no_copy_of_small_keys(spark, monkeypatch):
    """all rows were written and shuffled three times, whatever the size of their keys."""
    rows = [(f"k{i % 7}", i) for i in range(100)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key STRING, line INT")
    monkeypatch.setattr(K, "materialize", lambda *a, **kw: pytest.fail("rows written"))
    got = {(r["key"], r["line"]): r["rn"] for r in K.rank_within_key(df, "key", "line").collect()}
    assert got == {(f"k{i % 7}", i): i // 7 + 1 for i in range(100)}


@pytest.mark.parametrize("most", [1, 10000])
def test_rank_within_key_large_and_small_keys(spark, monkeypatch, most):
    monkeypatch.setattr(K, "HEAVY_KEYS", most)
    rows = [("hot", i) for i in range(300)] + [("warm", i) for i in range(150)] + [("a", 3), ("a", 1), (None, 0)]
    df = spark.createDataFrame(rows, "key STRING, line INT").repartition(5)
    ranked = K.rank_within_key(df, "key", "line", heavy_rows=100)
    got = sorted((r["key"], r["line"], r["rn"]) for r in ranked.collect())
    assert got == sorted([("hot", i, i + 1) for i in range(300)] + [("warm", i, i + 1) for i in range(150)] + [("a", 1, 1), ("a", 3, 2)])
    assert dict(ranked.dtypes)["rn"] == "bigint"


def test_coco_objects_lie_over_as_many_tasks_as_their_size_asks(spark, monkeypatch):
    """the joined boxes were ranked over as many tasks as there are partitions in the settings."""
    images = spark.createDataFrame([(i, f"{i}.jpg", 10.0, 10.0) for i in range(30)], "image_id LONG, file_name STRING, width DOUBLE, height DOUBLE")
    anns = spark.createDataFrame([(i % 30, 1, [1.0, 1.0, 2.0, 2.0], 0, i) for i in range(90)], "image_id LONG, category_id INT, bbox ARRAY<DOUBLE>, iscrowd INT, ann_order INT")
    many = 4 * spark.sparkContext.defaultParallelism + 8
    monkeypatch.setattr(K, "partitions_for", lambda df, factor=1: many)
    objs = K.coco_objects(images, anns)
    assert objs.rdd.getNumPartitions() == many
    assert sorted((r["image_id"], r["obj_idx"]) for r in objs.collect()) == [(i, k) for i in range(30) for k in range(3)]


def test_add_backgrounds_query_sorts_nothing_to_count(spark, tmp_path):
    """F8: the largest image name of a group was found by sorting all rows."""
    from salient.plans.manifest_queries import q_add_backgrounds
    spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "o_orderkey LONG, o_custkey LONG").write.parquet(f"{tmp_path}/orders.parquet")
    li = [(1, "A", 1, 5.0, 0.1, 0.1), (1, "N", 2, 5.0, 0.1, 0.2), (2, "R", 1, 3.0, 0.0, 0.0)]
    spark.createDataFrame(li, "l_orderkey LONG, l_returnflag STRING, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = q_add_backgrounds(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [("1.jpg", 2), ("2.jpg", 0), ("3.jpg", 0)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
