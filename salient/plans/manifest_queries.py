"""Queries for the dataset manifests (K1-K15) over the page, document, conversation and order tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from salient.functions.arrays import rounded
from salient.functions.hashing import sql_uniform
from salient.operators import manifests as K
from salient.plans import fixtures as fx
from salient.plans.catalog import register
from salient.session import scratch_path

# --- shared fixture views -----------------------------------------------------------

URL_PATH_SQL = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '/+$', '')"
PATHS_SQL = f"""SELECT url, path FROM (SELECT url, {URL_PATH_SQL} AS path FROM pages)
WHERE len(string_split(regexp_replace(path, '^/', ''), '/')) = 2"""


def _listing(spark, sf_dir):
    """K1 over the page URLs: files one folder below the site root (all suffixes)."""
    return K.list_paths(K.url_paths(fx.table(spark, sf_dir, "pages")), "path", depth=2, suffixes=None)


@register("list_files", f"SELECT url, path FROM ({PATHS_SQL})")
def q_list_files(spark, sf_dir):
    """K1: listing of files one folder below the root, keyed by full URL."""
    return _listing(spark, sf_dir).select("url", "path")


@register("label_index", f"""
SELECT raw_label, CAST(dense_rank() OVER (ORDER BY raw_label) - 1 AS INTEGER) AS label_id
FROM (SELECT DISTINCT regexp_extract(path, '([^/]*)/[^/]*$', 1) AS raw_label FROM ({PATHS_SQL}))""")
def q_label_index(spark, sf_dir):
    """K2: class folders (non-numeric) -> sorted index 0..n-1."""
    paths = _listing(spark, sf_dir).select(K.parent_name(F.col("path")).alias("label"))
    return K.label_index(paths)


@register("label_index_numeric", """
SELECT DISTINCT CAST(quality AS VARCHAR) AS raw_label, CAST(quality AS INTEGER) AS label_id FROM labels""")
def q_label_index_numeric(spark, sf_dir):
    """K2: all-numeric class names keep their own integer."""
    lab = fx.table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("label"))
    return K.label_index(lab)


@register("recognition_manifest", f"""
WITH p AS (SELECT url, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS raw_label FROM ({PATHS_SQL})),
ix AS (SELECT raw_label, CAST(dense_rank() OVER (ORDER BY raw_label) - 1 AS INTEGER) AS label_id
       FROM (SELECT DISTINCT raw_label FROM p))
SELECT CASE WHEN {sql_uniform(42, 'url')} < 0.2 THEN 'test' ELSE 'train' END AS split, url AS image, label_id AS label
FROM p JOIN ix USING (raw_label)""")
def q_recognition_manifest(spark, sf_dir):
    """K3 + K4: (split, image, label) with label = parent folder, 20 % hashed test split."""
    rows, _, _ = K.recognition_manifest(_listing(spark, sf_dir), test_fraction=0.2, path_col="path", image_col="url")
    return rows


@register("recognition_info", f"""
SELECT CAST(count(*) AS BIGINT) AS num_classes, '/data' AS base_path FROM
(SELECT DISTINCT regexp_extract(path, '([^/]*)/[^/]*$', 1) FROM ({PATHS_SQL}))""")
def q_recognition_info(spark, sf_dir):
    """K3: manifest info (number of classes, base path)."""
    _, info, _ = K.recognition_manifest(_listing(spark, sf_dir), path_col="path", image_col="url", base_path="/data")
    return info.select(F.col("num_classes").cast("bigint"), "base_path")


@register("train_test_split", f"""
SELECT doc_id, CASE WHEN {sql_uniform(42, 'doc_id')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents""")
def q_train_test_split(spark, sf_dir):
    """K4: seeded 20 % test split by key hash (stable under repartitioning)."""
    return K.hash_split(fx.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2)


# --- captions ---------------------------------------------------------------------------

def _caption_rows(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    raw = conv.select(F.concat(F.lit("img_"), F.col("conv_id").cast("string"), F.lit(".jpg#"),
                               F.col("turn").cast("string")).alias("image"),
                      F.col("text").alias("caption"), F.col("turn").alias("line"))
    return K.parse_caption_rows(raw)


@register("read_captions", """
SELECT 'img_' || conv_id || '.jpg' AS image, text AS caption, turn AS line FROM conversations""")
def q_read_captions(spark, sf_dir):
    """K5: TSV-form caption rows ``image#k`` -> (image, caption, line)."""
    return _caption_rows(spark, sf_dir)


def _json_files(rows, head: str, tail: str, name: str):
    """Rows of JSON texts ``(json)`` as files that each hold one JSON document: the task's rows between ``head`` and ``tail``."""
    def lines(batches):
        first = True
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                texts = batch.column("json").slice(a, 1024).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([(head if first and not i else ",") + t for i, t in enumerate(texts)])], ["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([tail])], ["value"])

    path = scratch_path(rows.sparkSession, name)
    rows.mapInArrow(lines, "value string").write.text(path)
    return path


@register("read_captions_json", """
SELECT 'img_' || conv_id || '.jpg' AS image, text AS caption, count(*) AS n FROM conversations GROUP BY ALL""")
def q_read_captions_json(spark, sf_dir):
    """K5: caption files that are JSON lists, written from the conversations and read by byte ranges."""
    conv = fx.table(spark, sf_dir, "conversations")
    image = F.concat(F.lit("img_"), F.col("conv_id").cast("string"), F.lit(".jpg"))
    path = _json_files(conv.select(F.to_json(F.struct(image.alias("image"), F.col("text").alias("caption"))).alias("json")), "[", "]", "captions-json")
    return K.read_captions(spark, path, "json").groupBy("image", "caption").agg(F.count("*").alias("n"))


def _matched(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations")
    images = (conv.select("conv_id").distinct()
              .select(F.concat(F.lit("images/img_"), F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image"),
                      F.col("conv_id").alias("image_pos")))
    return K.match_captions(images, _caption_rows(spark, sf_dir))


MATCHED_SQL = """SELECT 'images/img_' || conv_id || '.jpg' AS image, text AS caption,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, conv_id AS image_pos
FROM conversations"""


@register("match_captions", f"SELECT image, caption, rn, image_pos FROM ({MATCHED_SQL})")
def q_match_captions(spark, sf_dir):
    """K6: round-robin caption matching, order key (rn, image_pos)."""
    return _matched(spark, sf_dir).select("image", "caption", F.col("rn").cast("bigint"), "image_pos")


@register("caption_manifest", f"""
WITH m AS ({MATCHED_SQL}),
s AS (SELECT *, CASE WHEN {sql_uniform(42, 'image')} < 0.25 THEN 3 ELSE 1 END AS section FROM m)
SELECT 0 AS section, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS image_pos, 'base_path' || chr(9) AS line
UNION ALL SELECT 2, 0, 0, 'TEST' || chr(9) || 'TEST'
UNION ALL SELECT section, rn, image_pos,
       image || chr(9) || regexp_replace(regexp_replace(caption, chr(9), ' ', 'g'), chr(10), '', 'g') FROM s""")
def q_caption_manifest(spark, sf_dir):
    """K7 + K4: TSV caption manifest lines (info, train, TEST marker, test) with a 25 % test split."""
    m = K.hash_split(_matched(spark, sf_dir), "image", 0.25)
    return K.caption_manifest_lines(m.filter(F.col("split") == "train"), m.filter(F.col("split") == "test"))


@register("caption_manifest_json", f"""
WITH m AS ({MATCHED_SQL}),
s AS (SELECT *, CASE WHEN {sql_uniform(42, 'image')} < 0.25 THEN 'test' ELSE 'train' END AS split FROM m)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY rn, image_pos) AS pos, image, caption FROM s""")
def q_caption_manifest_json(spark, sf_dir):
    """K7 sink (JSON): caption records written in manifest order and read back with their place in each split."""
    m = K.hash_split(_matched(spark, sf_dir), "image", 0.25)
    rows, info = K.caption_manifest(m.where("split = 'train'"), m.where("split = 'test'"), "/data")
    path = scratch_path(spark, "captions-manifest")
    K.write_caption_json(rows, info, path)
    back = (spark.read.schema("split STRING, rn BIGINT, image_pos BIGINT, image STRING, caption STRING").json(f"{path}/rows")
            .withColumn("at", F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())))
    # the place as the files tell it, not as the columns rn and image_pos do
    return K.rank_within_key(back, "split", "at", out="pos").select("split", F.col("pos").cast("bigint").alias("pos"), "image", "caption")


# --- detection --------------------------------------------------------------------------

STEM_SQL = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '')"


def _label_files(spark, sf_dir):
    """A label file for every labelled document, named by its number."""
    docs = fx.table(spark, sf_dir, "labels")
    return docs.select(F.concat(F.lit("labels/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))


@register("match_label_files", f"""
SELECT p.path AS image, 'labels/' || d.doc_id || '.txt' AS label_path
FROM ({PATHS_SQL}) p JOIN labels d ON CAST(d.doc_id AS VARCHAR) = {STEM_SQL.replace('path', 'p.path')}""")
def q_match_label_files(spark, sf_dir):
    """K8: images paired with label files by file stem."""
    matched, _ = K.match_label_files(_listing(spark, sf_dir).select(F.col("path").alias("image")),
                                     _label_files(spark, sf_dir))
    return matched


@register("unmatched_images", f"""
SELECT p.path AS image FROM ({PATHS_SQL}) p
WHERE NOT EXISTS (SELECT 1 FROM labels d WHERE CAST(d.doc_id AS VARCHAR) = {STEM_SQL.replace('path', 'p.path')})""")
def q_unmatched_images(spark, sf_dir):
    """K8 report: images without a label file (anti join)."""
    _, missing = K.match_label_files(_listing(spark, sf_dir).select(F.col("path").alias("image")),
                                     _label_files(spark, sf_dir))
    return missing


def _box_files(spark, sf_dir):
    """One label text per order built from its line items: ``label q n d t`` per line."""
    li = fx.table(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", "l_returnflag", F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_discount").cast("string"), F.col("l_tax").cast("string"))
    per = (li.groupBy("l_orderkey")
           .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax",
                                                      "l_returnflag", line.alias("line")))).alias("s")))
    return per.select(F.concat(F.lit("labels/"), F.col("l_orderkey").cast("string"), F.lit(".txt")).alias("path"),
                      F.concat_ws("\n", F.transform("s", lambda r: r["line"])).alias("value"))


BOX_LINES_SQL = """SELECT 'labels/' || l_orderkey || '.txt' AS path,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS INTEGER) AS obj_idx,
       l_returnflag AS label, l_quantity AS v1, CAST(l_linenumber AS DOUBLE) AS v2, l_discount AS v3, l_tax AS v4
FROM lineitem"""


def _objects_long(objs, label_type=None):
    o = objs.select("path", F.posexplode(F.arrays_zip("label", "bbox")).alias("obj_idx", "o"))
    lab = F.col("o.label") if label_type is None else F.col("o.label").cast(label_type)
    return o.select("path", F.col("obj_idx").cast("int"), lab.alias("label"),
                    *[rounded(F.element_at("o.bbox", i)).alias(f"v{i}") for i in (1, 2, 3, 4)])


@register("read_box_text", f"SELECT path, obj_idx, label, v1, v2, v3, v4 FROM ({BOX_LINES_SQL})")
def q_read_box_text(spark, sf_dir):
    """K9: label text files (one per image, lines ``label v1 v2 v3 v4``) parsed into objects."""
    return _objects_long(K.parse_box_text(_box_files(spark, sf_dir)))


def _fmt_sql(fmt: str) -> str:
    v1, v2, v3, v4 = "v1", "v2", "v3", "v4"
    return {
        "yxyx": (v1, v2, v3, v4),
        "xyxy": (v2, v1, v4, v3),
        "yxhw": (v1, v2, f"{v1} + {v3}", f"{v2} + {v4}"),
        "xywh": (v2, v1, f"{v2} + {v4}", f"{v1} + {v3}"),
        "cycxhw": (f"{v1} - {v3} / 2", f"{v2} - {v4} / 2", f"({v1} - {v3} / 2) + {v3}", f"({v2} - {v4} / 2) + {v4}"),
        "cxcywh": (f"{v2} - {v4} / 2", f"{v1} - {v3} / 2", f"({v2} - {v4} / 2) + {v4}", f"({v1} - {v3} / 2) + {v3}"),
    }[fmt]


@register("convert_boxes", "\nUNION ALL\n".join(
    f"SELECT path, '{f}' AS fmt, obj_idx, " + ", ".join(f"round({e}, 6) + 0.0 AS b{i + 1}" for i, e in enumerate(_fmt_sql(f)))
    + f" FROM ({BOX_LINES_SQL})" for f in K.BOX_FORMATS))
def q_convert_boxes(spark, sf_dir):
    """Every box of K9 converted from each of the 6 source formats to [top, left, bottom, right]."""
    objs = K.parse_box_text(_box_files(spark, sf_dir))
    each = F.posexplode("bbox").alias("obj_idx", "b")
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("fmt"), K.convert_box(F.col("b"), f).alias("b")) for f in K.BOX_FORMATS])).alias("f")
    out = objs.select("path", each).select("path", "obj_idx", forms)
    return out.select("path", "f.fmt", F.col("obj_idx").cast("int"), *[rounded(F.element_at("f.b", i)).alias(f"b{i}") for i in (1, 2, 3, 4)])


@register("encode_box_labels", f"""
WITH b AS ({BOX_LINES_SQL}),
tr AS (SELECT DISTINCT label FROM b WHERE {sql_uniform(42, 'path')} >= 0.2),
ix AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM tr)
SELECT b.path, b.obj_idx, coalesce(ix.label_id, -1) AS label FROM b LEFT JOIN ix USING (label)""")
def q_encode_box_labels(spark, sf_dir):
    """Non-digit labels numbered by the sorted training labels (80 % hashed train split); unknown -> -1."""
    objs = K.hash_split(K.parse_box_text(_box_files(spark, sf_dir)), "path", 0.2)
    enc, _ = K.encode_box_labels(objs, F.col("split") == "train")
    o = enc.select("path", F.posexplode("label").alias("obj_idx", "label"))
    return o.select("path", F.col("obj_idx").cast("int"), F.col("label").cast("int"))


def _coco(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    li = fx.table(spark, sf_dir, "lineitem")
    images = orders.select(F.col("o_orderkey").alias("image_id"),
                           F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"),
                           (F.lit(8.0) + F.col("o_orderkey") % 5).alias("width"),
                           (F.lit(50.0) + (F.col("o_custkey") % 3) * 10).alias("height"))
    anns = li.select(F.col("l_orderkey").alias("image_id"), F.ascii("l_returnflag").alias("category_id"),
                     F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity"),
                             F.col("l_discount") * 100, F.col("l_tax") * 100).alias("bbox"),
                     F.when(F.col("l_tax") == 0.0, 1).otherwise(0).alias("iscrowd"),
                     F.col("l_linenumber").alias("ann_order"))
    cats = li.select("l_returnflag").distinct().select(F.ascii("l_returnflag").alias("id"),
                                                        F.col("l_returnflag").alias("name"))
    return images, anns, cats


COCO_SQL = """
im AS (SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS image, 8.0 + o_orderkey % 5 AS width,
              50.0 + (o_custkey % 3) * 10 AS height FROM orders),
an AS (SELECT l_orderkey AS image_id, ascii(l_returnflag) AS label, l_linenumber AS ann_order,
              CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y, l_discount * 100 AS w, l_tax * 100 AS h
       FROM lineitem WHERE NOT (l_tax = 0.0)),
bx AS (SELECT i.image, a.label, a.ann_order, a.y / i.height AS top, a.x / i.width AS lft,
              (a.y + a.h) / i.height AS bottom, (a.x + a.w) / i.width AS rgt FROM an a JOIN im i USING (image_id)),
ob AS (SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY ann_order, label, top, lft, bottom, rgt) - 1 AS INTEGER) AS obj_idx,
              label, top, lft, bottom, rgt FROM bx)"""


def _objects_out(objs, *lead):
    return objs.select(*lead, "image", F.col("obj_idx").cast("int"), F.col("label").cast("int"),
                       *[rounded(c).alias(c) for c in K.COCO_BOX])


@register("coco_boxes", f"""WITH {COCO_SQL}
SELECT image, obj_idx, label, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('top', 'lft', 'bottom', 'rgt'))} FROM ob""")
def q_coco_boxes(spark, sf_dir):
    """COCO-style annotations (crowd dropped) -> per-image boxes [top, left, bottom, right] in 0..1."""
    images, anns, _ = _coco(spark, sf_dir)
    return _objects_out(K.coco_objects(images, anns))


@register("add_backgrounds", f"""WITH {COCO_SQL}
SELECT i.image, CAST(count(o.obj_idx) AS BIGINT) AS n_objects FROM im i LEFT JOIN ob o USING (image) GROUP BY i.image""")
def q_add_backgrounds(spark, sf_dir):
    """Every image with its object count; images without boxes appended as backgrounds."""
    images, anns, _ = _coco(spark, sf_dir)
    full = K.add_background_rows(images.select("image_id", F.col("file_name").alias("image")),
                                 K.coco_objects(images, anns))
    return full.groupBy("image").agg(F.count("obj_idx").cast("bigint").alias("n_objects"))


@register("detection_manifest", f"""WITH {COCO_SQL}
SELECT CASE WHEN {sql_uniform(42, 'i.image')} < 0.2 THEN 'test' ELSE 'train' END AS split, i.image, o.obj_idx, o.label,
       {', '.join(f'round(o.{c}, 6) + 0.0 AS {c}' for c in ('top', 'lft', 'bottom', 'rgt'))}
FROM im i LEFT JOIN ob o USING (image)""")
def q_detection_manifest(spark, sf_dir):
    """Detection manifest rows (split, image, objects) incl. backgrounds, 20 % hashed test split."""
    return _objects_out(_detection(spark, sf_dir)[0], "split")


def _detection(spark, sf_dir):
    images, anns, cats = _coco(spark, sf_dir)
    return K.detection_manifest(images.select(F.col("file_name").alias("image")), K.coco_objects(images, anns), test_fraction=0.2, categories=cats, base_path="/data")


@register("detection_info", """
SELECT CAST(max(ascii(l_returnflag)) + 1 AS BIGINT) AS num_classes, '/data' AS base_path FROM lineitem""")
def q_detection_info(spark, sf_dir):
    """Manifest info: the largest category number + 1, and the base path."""
    return _detection(spark, sf_dir)[1]


@register("coco_boxes_file", f"""WITH {COCO_SQL.replace("o_orderkey || '.jpg' AS image", "'set/' || o_orderkey || '.jpg' AS image").replace("FROM orders", "FROM orders WHERE o_orderstatus <> 'P'").replace("l_tax = 0.0)", "l_tax = 0.0) AND l_returnflag <> 'R'")}
SELECT image, obj_idx, label, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('top', 'lft', 'bottom', 'rgt'))} FROM ob""")
def q_coco_boxes_file(spark, sf_dir):
    """Annotation files (JSON documents) read by byte ranges; only listed images and the wanted categories."""
    images, anns, cats = _coco(spark, sf_dir)
    head = images.join(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_orderstatus"), "image_id")
    records = [images.select(F.col("image_id").alias("id"), "file_name", "width", "height"), anns.drop("ann_order"), cats]
    # a line's number orders an order's annotations: files are written in that order
    box = [F.element_at("bbox", i) for i in (2, 1, 4, 3)]
    records[1] = anns.repartitionByRange("image_id").sortWithinPartitions("image_id", "ann_order", "category_id", *box).drop("ann_order")
    found = []
    for rows, field, place in zip(records, ("images", "annotations", "categories"), range(3)):
        path = _json_files(rows.select(F.to_json(F.struct(*rows.columns)).alias("json")), f'{{"info": {{"{field}": [1, "]"]}}, "{field}": [', "]}", f"coco-{field}")
        found.append(K.read_coco(spark, path)[place])
    listing = head.where("o_orderstatus <> 'P'").select(F.concat(F.lit("set/"), "file_name").alias("image"))
    wanted = [ord(c) for c in "AN"]
    return _objects_out(K.coco_objects(found[0], found[1], wanted, listing))


LABEL_LINES_SQL = f"""
im AS (SELECT 'images/' || o_orderkey || '.jpg' AS image, 'labels/' || o_orderkey || '.txt' AS path, o_orderkey FROM orders),
sp AS (SELECT *, CASE WHEN {sql_uniform(42, 'image')} < 0.2 THEN 'test' ELSE 'train' END AS split FROM im),
li AS (SELECT l_orderkey, 'part' || l_partkey AS label,
              CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1 AS INTEGER) AS obj_idx,
              l_linenumber AS x, l_quantity AS y, l_discount AS w, l_tax AS h FROM lineitem),
ix AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (
         SELECT DISTINCT label FROM li JOIN sp ON o_orderkey = l_orderkey WHERE split = 'train'))"""


def _label_lines(spark, sf_dir):
    """Label files of the orders: a line an item, ``label x y w h``."""
    li = fx.table(spark, sf_dir, "lineitem")
    text = F.concat_ws(" ", F.concat(F.lit("part"), "l_partkey"), *[F.col(c).cast("string") for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")])
    return li.select(F.concat(F.lit("labels/"), F.col("l_orderkey").cast("string"), F.lit(".txt")).alias("path"),
                     F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax").alias("ln"), text.alias("value"))


def _label_manifest(spark, sf_dir):
    images = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("images/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("image"))
    objects, _ = K.label_dir_objects(images, K.box_lines(_label_lines(spark, sf_dir)))
    return K.detection_manifest(images, objects, test_fraction=0.2, box_format="xywh", base_path="data")


@register("detection_manifest_labels", f"""WITH {LABEL_LINES_SQL}
SELECT s.split, s.image, l.obj_idx, CASE WHEN l.label IS NOT NULL THEN coalesce(ix.label_id, -1) END AS label,
       round(l.y, 6) + 0.0 AS top, round(CAST(l.x AS DOUBLE), 6) + 0.0 AS lft, round(l.y + l.h, 6) + 0.0 AS bottom, round(l.x + l.w, 6) + 0.0 AS rgt
FROM sp s LEFT JOIN li l ON l.l_orderkey = s.o_orderkey LEFT JOIN ix USING (label)""")
def q_detection_manifest_labels(spark, sf_dir):
    """K14 + K8 + K9 + K12 + K13: the manifest from a folder of label files; labels only met in the test split are -1."""
    return _objects_out(_label_manifest(spark, sf_dir)[0], "split")


@register("detection_classes", f"""WITH {LABEL_LINES_SQL} SELECT label AS raw_label, label_id FROM ix""")
def q_detection_classes(spark, sf_dir):
    """K13 + K2: classes of the label folder's training part, numbered in sorted order without a single task."""
    return _label_manifest(spark, sf_dir)[2]


ORD_NAME_SQL = "'ILSVRC2012_val_' || lpad(CAST(doc_id + 1 AS VARCHAR), 8, '0') || '.JPEG'"


@register("assign_labels_by_ordinal", f"""
SELECT 'val/' || {ORD_NAME_SQL.replace('doc_id', 'l.doc_id')} AS path, trim(d.source) AS label
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def q_assign_labels_by_ordinal(spark, sf_dir):
    """Label line i (documents by id) -> file number i (files named from the labels table)."""
    files, lines = _ordinal_inputs(spark, sf_dir)
    assigned, _ = K.assign_labels_by_ordinal(files, lines)
    return assigned


@register("ordinal_missing_files", """
SELECT CAST(d.doc_id + 1 AS BIGINT) AS line_no, trim(d.source) AS label FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_ordinal_missing_files(spark, sf_dir):
    """K15 report: label lines whose numbered file is missing."""
    files, lines = _ordinal_inputs(spark, sf_dir)
    _, missing = K.assign_labels_by_ordinal(files, lines)
    return missing


def _ordinal_inputs(spark, sf_dir):
    lab = fx.table(spark, sf_dir, "labels")
    files = lab.select(F.concat(F.lit("val/ILSVRC2012_val_"), F.lpad((F.col("doc_id") + 1).cast("string"), 8, "0"),
                                F.lit(".JPEG")).alias("path"))
    docs = fx.table(spark, sf_dir, "documents")
    lines = docs.select((F.col("doc_id") + 1).alias("line_no"), F.col("source").alias("label"))
    return files, lines


@register("recognition_manifest_json", f"""
WITH p AS (SELECT url, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS raw_label FROM ({PATHS_SQL})),
ix AS (SELECT raw_label, CAST(dense_rank() OVER (ORDER BY raw_label) - 1 AS INTEGER) AS label_id
       FROM (SELECT DISTINCT raw_label FROM p))
SELECT CASE WHEN {sql_uniform(42, 'url')} < 0.2 THEN 'test' ELSE 'train' END AS split, url AS image, label_id AS label
FROM p JOIN ix USING (raw_label)""")
def q_recognition_manifest_json(spark, sf_dir):
    """K3 sink: the recognition manifest written as JSON lines (split folders + info) and read back."""
    rows, info, classes = K.recognition_manifest(_listing(spark, sf_dir), test_fraction=0.2, path_col="path", image_col="url")
    path = scratch_path(spark, "recognition")
    K.write_manifest_json(rows, info, path, classes)
    return K.read_manifest_json(spark, path, "image STRING, label INT, split STRING").select("split", "image", "label")


@register("caption_manifest_tsv", f"""
WITH m AS ({MATCHED_SQL}),
s AS (SELECT *, CASE WHEN {sql_uniform(42, 'image')} < 0.25 THEN 3 ELSE 1 END AS section FROM m)
SELECT 'base_path' || chr(9) AS value
UNION ALL SELECT 'TEST' || chr(9) || 'TEST'
UNION ALL SELECT image || chr(9) || regexp_replace(regexp_replace(caption, chr(9), ' ', 'g'), chr(10), '', 'g') FROM s""")
def q_caption_manifest_tsv(spark, sf_dir):
    """K7 sink: caption manifest lines written as globally ordered text and read back."""
    m = K.hash_split(_matched(spark, sf_dir), "image", 0.25)
    lines = K.caption_manifest_lines(m.filter(F.col("split") == "train"), m.filter(F.col("split") == "test"))
    path = scratch_path(spark, "captions")
    K.write_lines(lines, path)
    return spark.read.text(path)


@register("detection_manifest_json", f"""WITH {COCO_SQL}
SELECT CASE WHEN {sql_uniform(42, 'i.image')} < 0.2 THEN 'test' ELSE 'train' END AS split, i.image, o.obj_idx, o.label,
       {', '.join(f'round(o.{c}, 6) + 0.0 AS {c}' for c in ('top', 'lft', 'bottom', 'rgt'))}
FROM im i LEFT JOIN ob o USING (image)""")
def q_detection_manifest_json(spark, sf_dir):
    """K14 sink: the detection manifest (objects nested per image) written as JSON lines by split and read back."""
    rows, info, classes = _detection(spark, sf_dir)
    path = scratch_path(spark, "detection")
    K.write_manifest_json(K.nested_objects(rows), info, path, classes)
    back = K.read_manifest_json(spark, path, "image STRING, label ARRAY<INT>, bbox ARRAY<ARRAY<DOUBLE>>, split STRING")
    o = back.select("split", "image", F.posexplode_outer(F.arrays_zip("label", "bbox")).alias("obj_idx", "o"))
    return o.select("split", "image", F.col("obj_idx").cast("int"), F.col("o.label").cast("int").alias("label"),
                    *[rounded(F.element_at("o.bbox", i)).alias(n) for i, n in ((1, "top"), (2, "lft"), (3, "bottom"), (4, "rgt"))])
