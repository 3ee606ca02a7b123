"""Readers of scene files. Paths may lie in any store Spark reads; schemas are explicit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = "object_id long, label string, size string, `3d_bbox` array<double>, `3d_location` array<double>, first_frame string"
FRAME_OBJECT = "object_id long, label string, size string, visibility double, truncated boolean, occluded boolean, `2d_bbox` array<int>, camera_location array<double>, `3d_bbox` array<double>, `3d_location` array<double>"
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
# Classes that are no objects.
INVALID_CLASSES = (0, 1, 2, 3, 11, 13, 15, 16, 17, 20, 21, 22, 23, 26, 28, 29, 31, 34, 37, 38, 39, 40, 81)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """One row per scene; room_size is a number or a record with an area."""
    raw = spark.read.schema(f"scene_id string, room_size string, objects array<struct<{_struct(OBJECT)}>>").option("multiLine", True).json(path)
    size = F.coalesce(F.col("room_size").try_cast("double"), F.get_json_object("room_size", "$.area").cast("double"), F.lit(0.0))
    return raw.withColumn("room_size", size)


def _bare(c):
    """Without blanks and line breaks at either end."""
    return F.btrim(c, F.lit(" \t\r\n"))


def _struct(fields: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().rsplit(" ", 1) for x in fields.split(", ")))


def scene_objects(scenes: DataFrame) -> DataFrame:
    """Exploded objects; the size in centimetres whatever its form."""
    o = scenes.select("scene_id", F.explode("objects").alias("o")).select("scene_id", "o.*")
    box = F.col("3d_bbox")
    sides = [F.abs(F.get(box, 3 + i) - F.get(box, i)) for i in range(3)]
    named = [F.get_json_object("size", f"$.{k}").cast("double") for k in ("length", "width", "height")]
    cm = F.coalesce(F.col("size").try_cast("double"), 100 * F.greatest(*named), 100 * F.greatest(*sides))
    return o.withColumn("size_cm", cm)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame files; the numeric frame comes from the name in the file or of the file."""
    raw = spark.read.schema(f"scene_id string, frame_id string, objects array<struct<{_struct(FRAME_OBJECT)}>>").option("multiLine", True).json(path)
    name = F.coalesce("frame_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return raw.select("scene_id", name.alias("frame_name"), F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z0-9]+)*$", 1).cast("int").alias("frame_id"), "objects")


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """Text files of 16 numbers; frame from the name. Files of another length give null."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    m = F.transform(F.split(_bare(F.col("value")), r"\s+"), lambda x: x.try_cast("double"))
    good = (F.size(m) == 16) & ~F.exists(m, lambda x: x.isNull())
    return raw.select("path", F.regexp_extract("path", r"(\d+)\.[A-Za-z0-9]+$", 1).try_cast("int").alias("frame_id"), F.when(good, m).alias("m"))


def axis_alignment(spark: SparkSession, path: str) -> DataFrame:
    """The axisAlignment line of key = value files; the identity where it is missing or broken."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    line = F.regexp_extract("value", r"(?m)^\s*axisAlignment\s*=\s*(.*)$", 1)
    m = F.transform(F.split(_bare(line), r"\s+"), lambda x: x.try_cast("double"))
    good = (F.size(m) == 16) & ~F.exists(m, lambda x: x.isNull())
    return raw.select("path", F.when(good, m).otherwise(F.array(*[F.lit(v) for v in IDENTITY])).alias("axis_align"))


POINTS = "path string, vertex_id int, x float, y float, z float"


def points(spark: SparkSession, path: str, schema: str = POINTS, vertices: int = 1_000_000) -> DataFrame:
    """Vertices of all PLY files below a path, at most `vertices` a task; other properties by the schema."""
    from scenery.sources.mesh import MeshSource

    spark.dataSource.register(MeshSource)
    return spark.read.format("mesh").schema(schema).option("vertices", vertices).load(path)


def segment_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of an aggregation file, one row per group and segment; ids count from 1."""
    raw = spark.read.schema("sceneId string, segGroups array<struct<objectId: int, label: string, segments: array<int>>>").option("multiLine", True).json(path)
    g = raw.select(F.col("sceneId").alias("scene_id"), F.posexplode("segGroups").alias("group_pos", "g"))
    return g.select("scene_id", "group_pos", (F.col("g.objectId") + 1).alias("object_id"), F.col("g.label").alias("label"), F.explode("g.segments").alias("seg_id"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("sceneId string, segIndices array<int>").option("multiLine", True).json(path)
    return raw.select(F.col("sceneId").alias("scene_id"), F.posexplode("segIndices").alias("vertex_id", "seg_id"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of raw categories; ids that are no integers are null."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    return raw.withColumn("nyu40id", F.col("nyu40id").try_cast("int"))


def harmonised_labels(spark: SparkSession, path: str) -> DataFrame:
    """Canonical labels and their aliases, one row per raw form."""
    raw = spark.read.schema("labels map<string, struct<aliases: array<string>>>").option("multiLine", True).json(path)
    m = raw.select(F.explode("labels").alias("canonical", "v"))
    return m.select(F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("v.aliases", F.array().cast("array<string>"))))).alias("raw"), "canonical").select(F.lower(F.trim("raw")).alias("raw"), "canonical")


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a time stamp, an angle-axis and a translation; any other length is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("t", F.split(_bare(F.col("value")), r"\s+"))
    ok = F.assert_true(F.size("t") == 7, F.concat(F.lit("a trajectory line has 7 numbers: "), F.col("value")))
    names = ["ts", "ax", "ay", "az", "tx", "ty", "tz"]
    return raw.where(ok.isNull()).select(*[F.get("t", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]).withColumn("ts", F.round("ts", 3))


def pincam(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(_bare(F.col("value")), r"\s+").alias("t"))
    names = ["width", "height", "fx", "fy", "cx", "cy"]
    return raw.select("path", file_time(F.col("path")).alias("ts"), *[F.get("t", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def file_time(path):
    """Seconds in a name such as video_123.456.png, to three places."""
    return F.round(F.regexp_extract(path, r"(?:^|[/_])(\d+\.\d+)\.[A-Za-z]+$", 1).try_cast("double"), 3)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with the time in their names; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", file_time(F.col("path")).alias("ts"))


def transforms(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Frames of a transforms file that aren't marked bad, the first n if asked."""
    raw = spark.read.schema("frames array<struct<file_path: string, is_bad: boolean, transform_matrix: array<array<double>>>>").option("multiLine", True).json(path)
    good = F.filter("frames", lambda f: ~F.coalesce(f["is_bad"], F.lit(False)))
    kept = good if first is None else F.slice(good, 1, first)
    return raw.select(F.posexplode(kept).alias("pos", "f")).select("pos", F.col("f.file_path").alias("file_path"), F.flatten("f.transform_matrix").alias("m"))


def scene_ids(spark: SparkSession, path: str | None = None, ids: Iterable[str] = ()) -> DataFrame:
    """Ids of a list file and of the caller, distinct."""
    own = spark.createDataFrame([(x.strip(),) for x in ids], "scene_id string")
    if path:
        own = own.union(spark.read.text(path).select(F.trim("value").alias("scene_id")))
    return own.where("scene_id <> ''").distinct()


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset by its extension; path@split reads the split's files of a folder."""
    path, _, split = path.partition("@")
    kind = path.rsplit(".", 1)[-1].lower()
    reader = {"jsonl": "json", "json": "json", "csv": "csv", "parquet": "parquet"}.get(kind)
    if reader is None:
        reader = "parquet"
    options = {"header": "true"} if reader == "csv" else {"multiLine": "true"} if kind == "json" else {}
    return spark.read.format(reader).options(**options).load(f"{path}/{split}*" if split else path)


def option_letters(options):
    """A question's options as lettered lines."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")


def last_part(answer, mark: str = "#### "):
    """What follows the last mark of a worked answer."""
    return F.trim(F.substring_index(answer, mark, -1))


def first_existing(spark: SparkSession, *paths: str) -> DataFrame:
    """A CSV table from the first of the paths that exists."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.read.option("header", True).csv(path)
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def grouped(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """One row per key with its sorted distinct values: one scan of many visits, as a list."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(into))


def assets(spark: SparkSession, path: str, *alternatives: str) -> DataFrame:
    """By folder the first of alternative file names that is there, at any depth below the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    rank = F.array_position(F.array(*[F.lit(a) for a in alternatives]), F.col("name"))
    return parts.withColumn("rank", rank).where("rank > 0").groupBy("folder").agg(F.min_by("name", "rank").alias("name"))


ANNOTATION = "data array<struct<uid: string, label: string, segments: struct<obbAligned: struct<centroid: array<double>, axesLengths: array<double>>, obb: struct<centroid: array<double>, axesLengths: array<double>>>>>"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of annotation files in metres: the aligned one as it is, else the other, which is in centimetres."""
    raw = spark.read.schema(ANNOTATION).option("multiLine", True).json(path)
    d = raw.select(F.explode("data").alias("d")).select("d.uid", "d.label", "d.segments.obbAligned", "d.segments.obb")
    metres = lambda field: F.coalesce(F.col(f"obbAligned.{field}"), F.transform(F.col(f"obb.{field}"), lambda x: x / 100.0))
    return d.select("uid", "label", metres("centroid").alias("centroid"), metres("axesLengths").alias("axes")).where("centroid IS NOT NULL")


def label_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every label in JSON files of lists and records at any depth, with its forms in lower case and with blanks for _ and -.

    The text's leaves are found in the file itself, so any nesting will do; names of fields are no labels.
    """
    raw = spark.read.text(path, wholetext=True)
    # Whole strings with the colon after them, if any, so that the end of one is never taken for the start of the next.
    every = F.regexp_extract_all("value", F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    strings = F.transform(F.filter(every, lambda s: ~s.endswith(":")), lambda s: F.regexp_replace(F.trim(s), r'^"|"$', ""))
    low = raw.select(F.explode(strings).alias("s")).select(F.lower(F.trim("s")).alias("label")).where("label <> ''")
    return low.select(F.explode(F.array("label", F.trim(F.regexp_replace("label", r"[_\-\s]+", " ")))).alias("label")).distinct()


def configuration(spark: SparkSession, path: str) -> DataFrame:
    """path and value of every setting of a JSON or YAML file, as text; a small table the planner may broadcast."""
    import json

    body = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        tree = yaml.safe_load(body)
    else:
        tree = json.loads(body)
    flat: list[tuple[str, str]] = []
    todo = [("", tree)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{at}/{k}" if at else str(k), v) for k, v in node.items()]
        else:
            flat.append((at, node if isinstance(node, str) else json.dumps(node)))
    return spark.createDataFrame(sorted(flat), "path string, value string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Selected frames, one row each: a record of lists by scene, or a list of records with scene_id and frame_ids."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<struct<scene_id: string, frame_ids: array<string>>>")
    mapped = F.from_json("value", "map<string,array<string>>")
    is_list = F.ltrim("value").startswith("[")
    one = raw.where(is_list).select(F.explode(listed).alias("e")).select(F.trim("e.scene_id").alias("scene_id"), F.posexplode("e.frame_ids").alias("pos", "frame"))
    two = raw.where(~is_list).select(F.explode(mapped).alias("scene_id", "frames")).select("scene_id", F.posexplode("frames").alias("pos", "frame"))
    both = one.unionByName(two).withColumn("frame", F.trim("frame")).where("frame <> '' AND scene_id <> ''")
    return both.withColumn("frame", F.when(F.col("frame").contains("."), F.col("frame")).otherwise(F.concat("frame", F.lit(".jpg"))))


DEPTH = "path string, v int, u int, depth int"


def decode_png(data: bytes) -> np.ndarray:
    """A grey PNG of 8 or 16 bits, not interlaced, as rows of numbers."""
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    width, height, bits, colour, _, _, interlaced = size
    if colour != 0 or bits not in (8, 16) or interlaced:
        raise ValueError("only grey PNGs of 8 or 16 bits that are not interlaced")
    step, flat = bits // 8, np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, -1).astype(np.int64)
    out = np.zeros((height, width * step), np.int64)
    for y in range(height):
        kind, row = flat[y, 0], flat[y, 1:]
        up = out[y - 1] if y else np.zeros_like(row)
        if kind in (0, 2):
            out[y] = (row + (up if kind == 2 else 0)) % 256
            continue
        for x in range(len(row)):
            left = out[y, x - step] if x >= step else 0
            corner = up[x - step] if x >= step else 0
            guess = left + up[x] - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up[x]), 1, up[x]), (abs(guess - corner), 2, corner))[2]
            out[y, x] = (row[x] + {1: left, 3: (left + up[x]) // 2, 4: near}[kind]) % 256
    return out if bits == 8 else out[:, ::2] * 256 + out[:, 1::2]


def depth(spark: SparkSession, path: str) -> DataFrame:
    """The cells of depth images, a row each: what projected points are joined with by path, v and u."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                d = decode_png(content)
                v, u = np.indices(d.shape)
                yield pd.DataFrame({"path": path, "v": v.ravel().astype(np.int32), "u": u.ravel().astype(np.int32), "depth": d.ravel().astype(np.int32)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, DEPTH)


# Where benchmarks keep question and answer, how often each is asked, and which are samples of 1,000.
BENCHMARKS = {
    "math": ("Question", "Answer", 1),
    "gsm8k": ("question", "answer", 1),
    "amc": ("question", "answer", 32),
    "minerva": ("problem", "answer", 1),
    "olympiad": ("question", "final_answer", 1),
    "aime2024": ("problem", "answer", 32),
    "aime2025": ("problem", "answer", 32),
    "mmlu_pro": ("question", "answer", 1),
    "bbeh": ("question", "answer", 1),
    "super_gpqa": ("question", "answer_letter", 1),
    "gpqa": ("Question", "Correct Answer", 1),
    "custom": ("problem", "answer", 1),
}
SAMPLED = ("mmlu_pro", "bbeh", "super_gpqa", "gpqa")
SAMPLE = 1000
HANDLERS: dict = {}


def register_handler(name: str):
    """Adds a benchmark: a function of its rows that gives question and answer."""

    def add(handler):
        if name in BENCHMARKS or name in HANDLERS:
            raise ValueError(f"{name} is taken")
        HANDLERS[name] = handler
        return handler

    return add


def benchmark(rows: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """question, answer and copy (from 0) of a benchmark's rows, by its name. Samples are drawn by a seeded hash of the question."""
    if name in HANDLERS:
        return HANDLERS[name](rows)
    if name not in BENCHMARKS:
        raise ValueError(f"no benchmark named {name}: {', '.join(sorted([*BENCHMARKS, *HANDLERS]))}")
    question, answer, times = BENCHMARKS[name]
    q, a = F.col(f"`{question}`"), F.col(f"`{answer}`")
    lettered = lambda options: F.concat(q, F.lit("\n\nOptions:\n"), option_letters(options), F.lit("\n"))
    if name == "gsm8k":
        a = F.substring_index(a, "#### ", -1)
    elif name == "olympiad":
        a = F.get(a, F.lit(0))
    elif name in ("mmlu_pro", "super_gpqa"):
        q = lettered(F.col("options"))
    elif name == "gpqa":
        wrong = [F.col(f"`Incorrect Answer {i}`") for i in (1, 2, 3)]
        drawn = F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), q, c)).alias("k"), c.alias("o")) for c in [a, *wrong]]))
        options = F.transform(drawn, lambda x: x["o"])
        q, a = lettered(options), F.char(F.array_position(options, a) + 64)
    out = rows.select(q.alias("question"), a.cast("string").alias("answer"))
    if name in SAMPLED:
        out = out.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "question")), "question", "answer").limit(SAMPLE)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
