"""Dataset manifests as table jobs.

The benchmark starts from recognition, caption and detection manifests.  Each
step is a DataFrame transformation: listings are path tables, label maps number
distinct labels range by range, pairing is an equi-join, unmatched items are
anti joins, ranks within a data key (captions and objects of one image) come
from :func:`rank_within_key`, which splits a large key over several tasks, and
sinks are ordinary writers (only a nested output record groups one image's
objects, or one label file's lines).  Nothing is gathered on the driver.  Label indices and image tables are data-derived, so they get no
broadcast hint: Spark's size check (and AQE at run time) picks the join.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salient.functions.hashing import hash_uniform
from salient.session import materialize, partitions_for
from salient.sources.json_arrays import read_json_array

# Fixed values of the manifest tools.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "JPEG")
TEST_MARKER = ("TEST", "TEST")
SPLIT_SEED = 42
ORDINAL_NAME_PATTERN = r"ILSVRC2012_val_0*([0-9]+)\.JPEG$"
BOX_FORMATS = ("yxyx", "xyxy", "yxhw", "xywh", "cycxhw", "cxcywh")


# --- K1 listing ------------------------------------------------------------------------

def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def list_paths(paths: DataFrame, path_col: str = "path", depth: int = 2, root: str = "",
               suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """K1 on a path table: files ``depth - 1`` folders below ``root`` with a listed suffix.

    Order is made deterministic by path (the reference shuffles).
    """
    rel, base = F.col(path_col), root.rstrip("/")
    if base:  # the root is plain text, not a pattern; paths outside it are no files of it
        paths = paths.filter(rel.startswith(base + "/"))
        rel = F.substr(rel, F.lit(len(base) + 2))
    parts = F.size(F.split(F.regexp_replace(rel, "^/", ""), "/"))
    df = paths.filter(parts == F.lit(depth))
    if suffixes:
        df = df.filter(F.regexp_extract(F.col(path_col), r"\.([^./]*)$", 1).isin(list(suffixes)))
    return df


def list_files(spark: SparkSession, root: str, depth: int = 2, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """K1: image files under ``root`` via the ``binaryFile`` source; the content column is pruned."""
    pattern = "/".join([root.rstrip("/")] + ["*"] * depth)
    df = spark.read.format("binaryFile").load(pattern).select(F.col("path"), "length")
    df = df.withColumn("path", F.regexp_replace("path", "^file:", ""))
    if suffixes:
        df = df.filter(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(list(suffixes)))
    return df


def url_paths(pages: DataFrame) -> DataFrame:
    """Fixture view of a URL table as a file listing: ``(url, path)`` with the URL path
    (host dropped; query, fragment and trailing '/' removed).  Last parts repeat,
    so the full URL stays the image key."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+([^?#]*)", 1), "/+$", "")
    return pages.select("url", path.alias("path"))


# --- K2 label index ---------------------------------------------------------------------

def label_index(labels: DataFrame, col: str = "label", excludes=()) -> DataFrame:
    """K2: ``(raw_label, label_id)``: all-numeric names map to their own integer, otherwise
    sorted order 0..n-1.

    One row per class.  The order is numbered piece by piece of its range
    (:func:`rank_by_ranges`), and whether all names are numbers is one value
    joined to every row, so that no task sees all classes.
    """
    d = labels.select(F.col(col).alias("raw_label")).distinct()
    if excludes:
        d = d.filter(~F.col("raw_label").isin(list(excludes)))
    # one row a class, written once: what the labels come from is not worked out for each use
    d = materialize(d).withColumn("_all", F.lit(0))
    numbers = d.groupBy("_all").agg(F.min(F.when(F.col("raw_label").rlike("^[0-9]+$"), 1).otherwise(0)).alias("_numbers"))
    numbers = numbers.select(F.col("_all").alias("_one"), "_numbers")
    ranked = rank_by_ranges(d, "_all", "raw_label", out="_rn")
    return (ranked.join(F.broadcast(numbers), F.col("_all") == F.col("_one"))  # one row
            .select("raw_label", F.when(F.col("_numbers") == 1, F.expr("try_cast(raw_label as int)"))
                    .otherwise((F.col("_rn") - 1).cast("int")).alias("label_id")))


# --- K3 / K4 recognition ------------------------------------------------------------------

def hash_split(df: DataFrame, key: str, test_fraction: float, seed: int = SPLIT_SEED) -> DataFrame:
    """K4: ``split`` = 'test' for a seeded hash share of the keys (stable under repartitioning)."""
    u = hash_uniform(seed, F.col(key))
    return df.withColumn("split", F.when(u < F.lit(float(test_fraction)), "test").otherwise("train"))


def recognition_manifest(train: DataFrame, test: DataFrame | None = None, test_fraction: float = 0.0,
                         path_col: str = "path", image_col: str | None = None,
                         check: bool = True, base_path: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """K3: ``(split, image, label)`` rows, the info row ``(num_classes, base_path)`` and the classes ``(label_id, raw_label)``.

    The class of an image is the parent folder of ``path_col``; ``image_col``
    (default: the path) is the image key.  The label index (one row per class)
    is built from the training folders.  A test image whose
    folder is not a training class is an error (found by an anti join).
    With no test set, ``test_fraction`` of the training images is split off (K4).
    """
    image_col = image_col or path_col

    def prep(df):
        return df.select(F.col(image_col).alias("image"), parent_name(F.col(path_col)).alias("raw_label"))
    tr = prep(train)
    index = label_index(tr, "raw_label")
    if test is not None:
        te = prep(test)
        rows = tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
        if check and te.join(index, "raw_label", "left_anti").limit(1).count():
            raise KeyError("test images with a label not seen in training")
    elif test_fraction > 0:
        rows = hash_split(tr, "image", test_fraction)
    else:
        rows = tr.withColumn("split", F.lit("train"))
    out = rows.join(index, "raw_label").select("split", "image", F.col("label_id").alias("label"))
    info = index.agg(F.count(F.lit(1)).alias("num_classes")).select("num_classes", F.lit(base_path).alias("base_path"))
    return out, info, index.select("label_id", "raw_label")


# --- K5-K7 captions -----------------------------------------------------------------------

def parse_caption_rows(raw: DataFrame, image_col: str = "image", caption_col: str = "caption") -> DataFrame:
    """K5 (TSV form): ``image#k<TAB>caption`` -> ``(image, caption, line)`` with the image cut at '#'."""
    return raw.select(F.split(F.col(image_col), "#").getItem(0).alias("image"),
                      F.col(caption_col).alias("caption"), "line")


def read_captions(spark: SparkSession, path: str, fmt: str = "tsv", field: str | None = None) -> DataFrame:
    """K5: ``(image, caption, line)`` from TSV (``image#k<TAB>caption``), a JSON list or COCO JSON; ``line`` orders the captions.

    JSON files are read by byte ranges (:func:`salient.sources.json_arrays.read_json_array`);
    ``field`` names the list of an object that holds several (``train`` and ``test`` captions in one file).
    """
    if fmt == "tsv":
        # order within a file: its blocks by their start, the lines of a block as read
        raw = (spark.read.option("sep", "\t").option("quote", "").schema("_c0 STRING, _c1 STRING").csv(path)
               .select(F.col("_c0").alias("image"), F.col("_c1").alias("caption"),
                       F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                F.monotonically_increasing_id().alias("at")).alias("line")))
        return parse_caption_rows(raw)
    order = F.struct("file", "place").alias("line")
    if fmt == "json":
        return read_json_array(spark, path, "image string, caption string", field).select("image", "caption", order)
    if fmt == "coco":
        images = read_json_array(spark, path, "id long, file_name string", "images").select(F.col("id").alias("image_id"), F.col("file_name").alias("image"))
        anns = read_json_array(spark, path, "image_id long, caption string", "annotations")
        return anns.join(images, "image_id").select("image", "caption", order)
    raise ValueError(f"unknown caption format {fmt!r}")


#: Rows of one key that a single task ranks; a key with more is ranked by ranges.
HEAVY_ROWS = 1 << 17
#: Heavy keys told apart by their hashes; where there are more, all rows are ranked by ranges.
HEAVY_KEYS = 10000


def by_key(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """``df`` dealt by ``key`` over ``n`` partitions, or left to Spark where ``n`` is None."""
    return df.repartition(n, key) if n else df


def rank_within_key(df: DataFrame, key: str, order: str, out: str = "rn", partitions: int | None = None,
                    heavy_rows: int = HEAVY_ROWS, build: Callable[[DataFrame, int | None], DataFrame] | None = None) -> DataFrame:
    """``row_number() over (partition by key order by order)`` without a large key in one task.

    Rows are counted by the hash of their key first.  Keys of at most ``heavy_rows`` rows are
    ranked by the window itself: one shuffle, or none where the rows lie by key
    already; the others go through :func:`rank_by_ranges`.  A large input is dealt over as many
    partitions as its size asks for.  Rows whose key is null are left out, and ties in
    ``order`` get distinct, arbitrary numbers.

    ``build(rows, n)``, where given, makes the rows to be ranked from those of ``df``
    (a join on the key, say), lying by key over ``n`` partitions if ``n`` is a number.
    """
    build = build or (lambda rows, n: by_key(rows, key, n))
    df = df.where(F.col(key).isNotNull())
    name = F.xxhash64(key)
    large = df.groupBy(name.alias("_h")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > heavy_rows).select("_h")
    heavy = [r["_h"] for r in large.limit(HEAVY_KEYS + 1).collect()]
    if len(heavy) > HEAVY_KEYS:
        return rank_by_ranges(build(df, None), key, order, out, partitions)
    spark = df.sparkSession
    n = partitions_for(build(df, None), 2)
    # a small input is left to Spark, which joins its partitions at run time
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > 2 * spark.sparkContext.defaultParallelism else None
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint")
    if not heavy:
        return build(df, n).withColumn(out, number)
    split = build(df.where(name.isin(heavy)), None)
    return build(df.where(~name.isin(heavy)), n).withColumn(out, number).unionByName(rank_by_ranges(split, key, order, out, partitions))


def rank_by_ranges(df: DataFrame, key: str, order: str, out: str = "rn", partitions: int | None = None) -> DataFrame:
    """:func:`rank_within_key` where a key may have any share of the rows.

    Rows are range-partitioned on ``(key, order)``, so a key holding a large
    share of the rows spans several partitions.  Each (partition, key) piece is
    ranked locally; a piece's offset is the count of the same key's rows in
    earlier partitions, a prefix sum over the small (partition, key, count)
    table (at most one row per partition for a key).  Ties in ``order`` get
    distinct, arbitrary numbers.  The range-partitioned pieces are
    checkpointed, since their ids depend on sampled range bounds.
    """
    n = partitions or partitions_for(df, 2)
    # The piece id depends on run-time range bounds, so the pieces are written
    # once (shared checkpoint folder): both branches below then read the same ids.
    pieces = materialize(df.repartitionByRange(n, key, order).withColumn("_pid", F.spark_partition_id()))
    local = pieces.withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", key).orderBy(order)))
    counts = pieces.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_pid", key, F.coalesce(F.sum("_c").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(offsets, ["_pid", key])
            .withColumn(out, F.col("_lr") + F.col("_off")).drop("_pid", "_lr", "_off"))


def match_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """K6: round robin — every image's first caption in image order, then every second, ...

    ``images(image, image_pos)``, ``captions(image, caption, line)`` keyed by basename.
    Images without captions are dropped.  Output ``(image, caption, rn, image_pos)``:
    the manifest order is ``(rn, image_pos)``, applied by the sink's global
    (range-partitioned) sort.  The per-image caption number comes from
    :func:`rank_within_key`, so an image with very many captions is split
    across tasks.
    """
    cap = captions.select(basename(F.col("image")).alias("key"), "caption", "line")
    img = images.select("image", "image_pos", basename(F.col("image")).alias("key"))
    # of images that share a basename the first takes the captions; duplicate_images() reports the others
    first = img.groupBy("key").agg(F.min(F.struct("image_pos", "image")).alias("i")).select("key", "i.image", "i.image_pos")
    return first.join(rank_within_key(cap, "key", "line"), "key").select("image", "caption", "rn", "image_pos")


def duplicate_images(images: DataFrame) -> DataFrame:
    """K6 report: ``(key, n_images, image)`` for each basename that several images share; ``image`` takes the captions."""
    img = images.select("image", "image_pos", basename(F.col("image")).alias("key"))
    return (img.groupBy("key").agg(F.count(F.lit(1)).alias("n_images"), F.min(F.struct("image_pos", "image"))["image"].alias("image"))
            .filter("n_images > 1"))


def caption_manifest_lines(train: DataFrame, test: DataFrame, base_path: str = "") -> DataFrame:
    """K7 (TSV): info rows, train rows, the ``TEST\tTEST`` marker, test rows.

    ``(section, rn, image_pos, line)``; tabs in captions become spaces and
    newlines are removed.  :func:`write_lines` sorts by the first three columns.
    """
    def fmt(df, section):
        cap = F.regexp_replace(F.regexp_replace("caption", "\t", " "), "\n", "")
        return df.select(F.lit(section).alias("section"), F.col("rn").cast("bigint").alias("rn"),
                         F.col("image_pos").cast("bigint").alias("image_pos"),
                         F.concat_ws("\t", "image", cap).alias("line"))
    spark = train.sparkSession
    schema = "section INT, rn BIGINT, image_pos BIGINT, line STRING"
    info = spark.createDataFrame([(0, 0, 0, f"base_path\t{base_path}")], schema)
    marker = spark.createDataFrame([(2, 0, 0, "\t".join(TEST_MARKER))], schema)
    return info.unionByName(fmt(train, 1)).unionByName(marker).unionByName(fmt(test, 3))


def caption_manifest(train: DataFrame, test: DataFrame | None = None, base_path: str = "") -> tuple[DataFrame, DataFrame]:
    """K7 (JSON, the default form): records ``(split, rn, image_pos, image, caption)`` in manifest order ``(rn, image_pos)``, and the info row.

    Sets matched from separate caption files, or from the embedded ``train`` and
    ``test`` captions of one, are given apart; without a test set there are no test records.
    """
    def part(df, split):
        return df.select(F.lit(split).alias("split"), F.col("rn").cast("bigint").alias("rn"), F.col("image_pos").cast("bigint").alias("image_pos"), "image", "caption")
    rows = part(train, "train") if test is None else part(train, "train").unionByName(part(test, "test"))
    return rows, train.sparkSession.range(1).select(F.lit(base_path).alias("base_path"))


def write_caption_json(rows: DataFrame, info: DataFrame, path: str) -> None:
    """K7 sink (JSON): the records of each split as JSON lines in manifest order over the files (range-partitioned sort), and the info record."""
    (rows.repartitionByRange("split", "rn", "image_pos").sortWithinPartitions("split", "rn", "image_pos")
     .write.mode("overwrite").partitionBy("split").json(f"{path}/rows"))
    info.coalesce(1).write.mode("overwrite").json(f"{path}/info")


def write_lines(lines: DataFrame, path: str) -> None:
    """Sink for manifest lines, globally ordered (range-partitioned sort, then text files)."""
    lines.orderBy("section", "rn", "image_pos").select("line").write.mode("overwrite").text(path)


# --- K8-K14 detection -------------------------------------------------------------------------

def match_label_files(images: DataFrame, label_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8: pair images with label files by file stem; second result = images with no label file."""
    img = images.select("image", stem(F.col("image")).alias("stem"))
    lab = label_files.select(F.col("path").alias("label_path"), stem(F.col("path")).alias("stem"))
    return img.join(lab, "stem").select("image", "label_path"), img.join(lab, "stem", "left_anti").select("image")


def parse_box_text(files: DataFrame, path_col: str = "path", text_col: str = "value") -> DataFrame:
    """K9: one text per image, lines ``label v1 v2 v3 v4`` -> ``(path, label[], bbox[][])`` in line order."""
    lines = (files.select(path_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("ln", "text"))
             .withColumn("text", F.trim("text")).filter(F.col("text") != ""))
    parts = F.split("text", " ")
    rows = lines.select(path_col, "ln", parts.getItem(0).alias("label"),
                        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda v: v.cast("double")).alias("box"))
    return (rows.groupBy(path_col)
            .agg(F.array_sort(F.collect_list(F.struct("ln", "label", "box"))).alias("o"))
            .select(path_col, F.transform("o", lambda s: s["label"]).alias("label"),
                    F.transform("o", lambda s: s["box"]).alias("bbox")))


def read_box_text(spark: SparkSession, path: str) -> DataFrame:
    """K9 reader: one row per label file (``wholetext``), parsed by :func:`parse_box_text`."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return parse_box_text(files)


BOX_NUMBERS = ("v1", "v2", "v3", "v4")


def box_lines(lines: DataFrame, path_col: str = "path", order_col: str = "ln", text_col: str = "value") -> DataFrame:
    """K9, long form: ``(path, obj_idx, label, v1..v4)`` from the lines of label files ``label v1 v2 v3 v4``.

    Blank lines are no objects.  Objects are numbered in line order by
    :func:`rank_within_key`, so a file with very many lines is never one task's.
    """
    said = lines.select(F.col(path_col).alias("path"), F.col(order_col).alias("_o"), F.trim(F.col(text_col)).alias("t")).where("t <> ''")
    parts = F.split("t", " ")
    ranked = rank_within_key(said, "path", "_o", out="_rn")
    return ranked.select("path", (F.col("_rn") - 1).cast("int").alias("obj_idx"), parts[0].alias("label"),
                         *[F.get(parts, F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate(BOX_NUMBERS)])


def read_box_lines(spark: SparkSession, path: str) -> DataFrame:
    """K9 reader, long form: files are read line by line, a large one by several tasks; order is file block, then line as read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"),
                                         F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("ln"))
    return box_lines(lines)


def convert_box_columns(objects: DataFrame, fmt: str = "yxyx", columns=BOX_NUMBERS) -> DataFrame:
    """K12, long form: the four numbers of every object as ``top, lft, bottom, rgt``."""
    box = convert_box(F.array(*columns), fmt)
    return objects.select("*", *[F.element_at(box, i + 1).alias(c) for i, c in enumerate(COCO_BOX)]).drop(*[c for c in columns if c not in COCO_BOX])


COCO_BOX = ("top", "lft", "bottom", "rgt")


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K10 reader: ``(images, annotations, categories)`` of annotation files, read by byte ranges; ``ann_order`` is the file's order."""
    images = read_json_array(spark, path, "id long, file_name string, width double, height double", "images").withColumnRenamed("id", "image_id").drop("file", "place")
    anns = (read_json_array(spark, path, "image_id long, category_id int, bbox array<double>, iscrowd int", "annotations")
            .withColumn("ann_order", F.struct("file", "place")).drop("file", "place"))
    return images, anns, read_json_array(spark, path, "id int, name string", "categories").select("id", "name").distinct()


def coco_objects(images: DataFrame, annotations: DataFrame, target_ids: list[int] | None = None,
                 listing: DataFrame | None = None) -> DataFrame:
    """K10, long form: one row per kept object,
    ``(image_id, image, obj_idx, label, top, lft, bottom, rgt)`` with the box normalized to 0..1.

    Crowd annotations and categories outside ``target_ids`` are dropped and
    image sizes come from a join on ``image_id``.  With ``listing(image)`` only images
    listed there count, and ``image`` is the listed path whose last part is the file name.  The object number follows
    ``(ann_order, label, box)`` within the image and comes from
    :func:`rank_within_key`, so an image with a huge share of the annotations
    is never gathered in one task.
    """
    ann = annotations
    if target_ids is not None:
        ann = ann.filter(F.col("category_id").isin(list(target_ids)))
    ann = ann.filter(~F.coalesce(F.col("iscrowd").cast("boolean"), F.lit(False)))
    sized = images.select("image_id", F.col("file_name").alias("image"), "width", "height")
    if listing is not None:
        paths = listing.groupBy(basename(F.col("image")).alias("_name")).agg(F.min("image").alias("_path"))
        sized = sized.join(paths, F.col("image") == F.col("_name")).select("image_id", F.col("_path").alias("image"), "width", "height")
    x, y, w, h = (F.element_at("bbox", i) for i in (1, 2, 3, 4))
    coords = [y / F.col("height"), x / F.col("width"), (y + h) / F.col("height"), (x + w) / F.col("width")]

    def boxes(found: DataFrame, n: int | None) -> DataFrame:
        j = by_key(found, "image_id", n).join(by_key(sized, "image_id", n), "image_id")
        return (j.select("image_id", "image", "ann_order", F.col("category_id").alias("label"), *[c.alias(n) for c, n in zip(coords, COCO_BOX)])
                .withColumn("_o", F.struct("ann_order", "label", *COCO_BOX)))

    ranked = rank_within_key(ann, "image_id", "_o", out="_rn", build=boxes)
    return ranked.select("image_id", "image", (F.col("_rn") - 1).cast("int").alias("obj_idx"), "label", *COCO_BOX)


def coco_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame,
               target_ids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """K10, nested manifest form: ``(image_id, image, label[], bbox[][])`` per image, boxes
    [top, left, bottom, right] in 0..1, plus ``indices_2_labels`` (one entry per category).

    The nesting is the manifest record format (one record per image); queries
    and joins use :func:`coco_objects`, which never groups an image.
    """
    objs = coco_objects(images, annotations, target_ids)
    nested = (objs.groupBy("image_id")
              .agg(F.max("image").alias("image"),
                   F.array_sort(F.collect_list(F.struct("obj_idx", "label", F.array(*COCO_BOX).alias("box")))).alias("o"))
              .select("image_id", "image", F.transform("o", lambda s: s["label"]).alias("label"),
                      F.transform("o", lambda s: s["box"]).alias("bbox")))
    i2l = categories.agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("int"), "name")))
                         .alias("indices_2_labels"))
    return nested, i2l


def add_background_rows(images: DataFrame, objects: DataFrame, key: str = "image_id") -> DataFrame:
    """K11, long form: images with no object get one row with NULL object fields (anti join + union)."""
    cols = [c for c in objects.columns if c in images.columns]
    bg = images.select(*cols).join(objects.select(key).distinct(), key, "left_anti")
    fill = [F.lit(None).cast(t).alias(c) for c, t in objects.dtypes if c not in cols]
    return objects.unionByName(bg.select(*cols, *fill))


def add_backgrounds(images: DataFrame, matched: DataFrame, key: str = "image") -> DataFrame:
    """Images without objects appended with empty label and box arrays (anti join + union).

    ``key`` is the join key (``image_id`` keeps the partitioning of :func:`coco_boxes`).
    """
    cols = [c for c in matched.columns if c not in ("label", "bbox")]
    bg = images.select(*cols).join(matched.select(key), key, "left_anti")
    return matched.unionByName(bg.select(*cols, F.array().cast("array<int>").alias("label"),
                                         F.array().cast("array<array<double>>").alias("bbox")))


def convert_box(b: Column, fmt: str) -> Column:
    """K12 on one box: ``fmt`` -> ``[top, left, bottom, right]``.

    A format's name lists what its four numbers are: ``x`` and ``y`` (a corner
    on that axis), ``cx`` and ``cy`` (the centre), ``w`` and ``h`` (the extent).
    Per axis, the low edge is the first corner or half an extent before the
    centre, the high edge the second corner or one extent after the low edge.
    """
    if fmt not in BOX_FORMATS:
        raise ValueError(f"unknown box format {fmt!r}; known are {', '.join(BOX_FORMATS)}")
    said = [(name, F.element_at(b, i + 1)) for i, name in enumerate(re.findall("c?[xy]|[wh]", fmt))]

    def edges(axis: str, extent: str) -> tuple[Column, Column]:
        corners, centre, size = ([v for n, v in said if n == what] for what in (axis, "c" + axis, extent))
        low = corners[0] if corners else centre[0] - size[0] / 2
        return low, corners[1] if len(corners) > 1 else low + size[0]

    (top, bottom), (left, right) = edges("y", "h"), edges("x", "w")
    return F.array(top, left, bottom, right)


def convert_boxes(objects: DataFrame, fmt: str = "yxyx", col: str = "bbox") -> DataFrame:
    """Convert every box of every image to [top, left, bottom, right]."""
    return objects.withColumn(col, F.transform(col, lambda b: convert_box(b, fmt)))


def encode_box_labels(objects: DataFrame, train_filter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """String labels -> ints.  All-digit labels keep their value (num_classes = max + 1);
    otherwise the sorted training labels are numbered and unknown labels become -1.

    The digit test is one scalar aggregate over the distinct training labels.
    Records get a number of their own, so equal records stay apart; only that
    number, the position and the label are exploded, joined with the class
    table and brought together again, and boxes stay where they are.
    Returns the objects with integer labels and ``(num_classes, indices_2_labels)``.
    """
    train = objects if train_filter is None else objects.filter(train_filter)
    labels = train.select(F.explode("label").alias("raw_label")).distinct()
    digits = bool(labels.agg(F.min(F.when(F.col("raw_label").rlike("^[0-9]+$"), 1).otherwise(0))).first()[0] or 0)
    if digits:
        index = labels.select("raw_label", F.col("raw_label").cast("int").alias("label_id"))
        out = objects.withColumn("label", F.transform("label", lambda v: v.cast("int")))
        n_classes = F.max("label_id") + 1
    else:
        index = label_index(labels, "raw_label")
        # written once: both branches below must see the same numbers
        rows = materialize(objects.withColumn("_rec", F.monotonically_increasing_id()))
        ids = (rows.select("_rec", F.posexplode("label").alias("li", "raw_label")).join(index, "raw_label", "left")
               .groupBy("_rec").agg(F.array_sort(F.collect_list(F.struct("li", F.coalesce("label_id", F.lit(-1)).alias("id")))).alias("_ids")))
        out = rows.join(ids, "_rec", "left").withColumn("label", F.coalesce(
            F.transform("_ids", lambda s: s["id"]), F.when(F.col("label").isNotNull(), F.array().cast("array<int>"))))
        n_classes = F.count(F.lit(1))
    info = index.agg(n_classes.alias("num_classes"),
                     F.map_from_entries(F.collect_list(F.struct("label_id", "raw_label"))).alias("indices_2_labels"))
    return out.select(*objects.columns), info


# --- K14 detection manifest -----------------------------------------------------------------

def detection_classes(train: DataFrame, categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K13, long form: classes ``(raw_label, label_id)`` and one row ``(num_classes)`` from training objects ``(label)``.

    Category numbers of an annotation file, and labels that are all digits, keep
    their own value, and there are the largest + 1 classes; other labels are
    numbered in sorted order.
    """
    if categories is not None:
        classes = categories.select(F.col("name").alias("raw_label"), F.col("id").cast("int").alias("label_id"))
        return classes, classes.agg((F.max("label_id") + 1).cast("bigint").alias("num_classes"))
    said = train.where("label is not null").select(F.col("label").alias("raw_label"))
    classes = label_index(said, "raw_label")
    own = F.min(F.when(F.col("raw_label").rlike("^[0-9]+$"), 1).otherwise(0)) == 1
    return classes, classes.agg(F.when(own, F.max("label_id") + 1).otherwise(F.count(F.lit(1))).cast("bigint").alias("num_classes"))


def detection_manifest(images: DataFrame, objects: DataFrame, test_images: DataFrame | None = None, test_objects: DataFrame | None = None,
                       test_fraction: float = 0.0, categories: DataFrame | None = None, box_format: str | None = None,
                       base_path: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(split, image, obj_idx, label, top, lft, bottom, rgt)``, the info row ``(num_classes, base_path)`` and the classes.

    ``images(image)`` lists all images, ``objects(image, obj_idx, label, ...)`` their
    objects, from either source: annotation files (:func:`coco_objects`, with ``categories``; boxes
    are ``top, lft, bottom, rgt``) or a folder of label files (:func:`label_dir_objects`;
    boxes are ``v1..v4`` in ``box_format``, labels are text).  Images without
    objects are backgrounds: one row without object.  The test set is given, or
    (``test_fraction``) split off by the image's hash; its text labels are numbered by the training
    classes, unknown ones are -1.
    """
    def part(listed, found):
        found = found.select("image", "obj_idx", "label", *(BOX_NUMBERS if box_format else COCO_BOX))
        if box_format:
            found = convert_box_columns(found, box_format)
        return add_background_rows(listed.select("image").distinct(), found, "image")

    rows = part(images, objects)
    if test_images is not None:
        test = part(test_images, objects if test_objects is None else test_objects)
        rows = rows.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    else:
        rows = hash_split(rows, "image", test_fraction) if test_fraction > 0 else rows.withColumn("split", F.lit("train"))
    classes, number = detection_classes(rows.where("split = 'train'"), categories)
    if categories is None:
        index = classes.select(F.col("raw_label").alias("label"), "label_id")
        rows = rows.join(index, "label", "left").withColumn("label", F.when(F.col("label").isNotNull(), F.coalesce("label_id", F.lit(-1))))
    out = rows.select("split", "image", "obj_idx", F.col("label").cast("int").alias("label"), *COCO_BOX)
    return out, number.select("num_classes", F.lit(base_path).alias("base_path")), classes


def label_dir_objects(images: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K8 + K9: ``(image, obj_idx, label, v1..v4)`` of the images that have a label file, and the images that have none.

    ``lines`` is ``(path, obj_idx, label, v1..v4)`` from :func:`box_lines`; a file
    belongs to the images of its stem.
    """
    matched, missing = match_label_files(images, lines.select("path").distinct())
    return matched.join(lines, F.col("label_path") == F.col("path")).drop("label_path", "path"), missing


# --- K15 ordinal labels ---------------------------------------------------------------------

def assign_labels_by_ordinal(files: DataFrame, label_lines: DataFrame,
                             path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """The i-th label line belongs to file number i (``ILSVRC2012_val_000NNNNN.JPEG``).

    ``label_lines(line_no, label)`` with 1-based numbers; files of other names
    take no part, however many there are.  Returns ``(path, label)`` and the
    label lines whose file is missing.  Files are not moved.
    """
    num = F.regexp_extract(basename(F.col(path_col)), ORDINAL_NAME_PATTERN, 1)
    f = (files.select(F.col(path_col).alias("path"), F.nullif(num, F.lit("")).cast("bigint").alias("line_no"))
         .filter(F.col("line_no").isNotNull()))
    lab = label_lines.select(F.col("line_no").cast("bigint"), F.trim("label").alias("label"))
    return f.join(lab, "line_no").select("path", "label"), lab.join(f, "line_no", "left_anti")


# --- manifest sinks -------------------------------------------------------------------------

def write_manifest_json(rows: DataFrame, info: DataFrame, path: str, classes: DataFrame | None = None) -> None:
    """K3/K14 sink: manifest rows as JSON lines partitioned by split, plus a one-row info record.

    Rows are written in parallel (one file per task); the info record goes to
    ``path/info``, the classes, one record each, to ``path/classes``.
    """
    rows.write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    info.coalesce(1).write.mode("overwrite").json(f"{path}/info")
    if classes is not None:
        classes.write.mode("overwrite").json(f"{path}/classes")


def nested_objects(rows: DataFrame) -> DataFrame:
    """K14 records: ``(split, image, label[], bbox[][])``, one for each image, as the output format nests an image's objects."""
    o = F.array_sort(F.collect_list(F.when(F.col("obj_idx").isNotNull(), F.struct("obj_idx", "label", F.array(*COCO_BOX).alias("box")))))
    return rows.groupBy("split", "image").agg(o.alias("o")).select("split", "image", F.transform("o", lambda v: v["label"]).alias("label"), F.transform("o", lambda v: v["box"]).alias("bbox"))


def read_manifest_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read the rows of a manifest written by :func:`write_manifest_json`."""
    return spark.read.schema(schema).json(f"{path}/rows")
