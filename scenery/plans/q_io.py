"""Readers and writers over files that the queries write themselves, from the derived scenes, poses and requests."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenery.functions.geometry import tidy
from scenery.plans.catalogue import query
from scenery.plans.q_answers import _table
from scenery.plans.q_batch import rollouts
from scenery.plans.q_scene import _ROT, cameras, objects
from scenery.session import scratch
from scenery.sources import readers, sinks
from scenery.sources.adapters import with_views


def _files(spark, name: str, rows: DataFrame, path: str, body: str) -> str:
    """A folder with a file for every row, by its columns of path and body."""
    folder = scratch(spark, name)
    sinks.write_files(rows, folder, path, body)
    return folder


def _scene(spark, sf) -> DataFrame:
    box = F.array(*[F.col(f"{c}{k}") for k in (0, 1) for c in "xyz"])
    size = F.when(F.col("object_id") % 3 == 0, F.lit("120")).when(F.col("object_id") % 3 == 1, F.to_json(F.struct(F.lit(0.5).alias("length"), F.lit(0.25).alias("width"), F.lit(0.75).alias("height"))))
    o = objects(spark, sf).withColumns({"3d_bbox": box, "3d_location": F.array("x", "y", "z"), "size": size, "first_frame": F.lit("0")})
    fields = F.array_sort(F.collect_list(F.struct("object_id", "label", "size", "3d_bbox", "3d_location", "first_frame")))
    s = o.groupBy(F.concat(F.lit("scene"), F.col("scene_id")).alias("scene_id")).agg(fields.alias("objects"))
    return s.withColumn("room_size", F.to_json(F.struct(F.size("objects").cast("double").alias("area"))))


@query("s01_scene_files", with_views("objects") + "SELECT concat('scene', CAST(scene_id AS VARCHAR)) AS scene_id, object_id, label, round(CASE object_id % 3 WHEN 0 THEN 120 WHEN 1 THEN 75 ELSE 100 * greatest(abs(x1-x0), abs(y1-y0), abs(z1-z0)) END, 6) AS size_cm, CAST(count(*) OVER (PARTITION BY scene_id) AS DOUBLE) AS room_size FROM objects")
def scene_files(spark, sf):
    """Scenes written a file each and read back, whatever the form of their sizes."""
    path = scratch(spark, "scenes")
    rows = _scene(spark, sf)
    assert sinks.scenes(rows, path) > 0 and sinks.scenes(rows, path) == 0
    s = readers.scenes(spark, path)
    o = readers.scene_objects(s).join(s.select("scene_id", "room_size"), "scene_id")
    return o.select("scene_id", "object_id", "label", F.round("size_cm", 6).alias("size_cm"), "room_size")


@query("s02_frame_files", with_views("objects") + "SELECT concat('scene', CAST(scene_id AS VARCHAR)) AS scene_id, CAST(frame_id * 20 AS INT) AS frame_id, object_id, label, round(visibility, 6) AS visibility, occluded FROM objects")
def frame_files(spark, sf):
    """Frames written a file each and read back with the number in their name."""
    o = objects(spark, sf)
    fields = F.array_sort(F.collect_list(F.struct("object_id", "label", "visibility", "truncated", "occluded")))
    rows = o.groupBy(F.concat(F.lit("scene"), F.col("scene_id")).alias("scene_id"), F.concat((F.col("frame_id") * 20).cast("string"), F.lit(".jpg")).alias("frame_id")).agg(fields.alias("objects"))
    path = scratch(spark, "frames")
    sinks.scenes(rows, path, overwrite=True)
    f = readers.frames(spark, path)
    return f.select("scene_id", "frame_id", F.explode("objects").alias("o")).select("scene_id", "frame_id", "o.object_id", "o.label", F.round("o.visibility", 6).alias("visibility"), "o.occluded")


def _matrix(c: DataFrame) -> DataFrame:
    rows = [[f"r{3 * i}", f"r{3 * i + 1}", f"r{3 * i + 2}", f"t{'xyz'[i]}"] for i in range(3)]
    return c.withColumn("m", F.array(*[F.round(x, 6) for row in rows for x in row], *[F.lit(float(k == 3)) for k in range(4)]))


_M = "SELECT scene_id, frame_id, round(r0, 6) + 0.0 AS r0, round(ty, 6) + 0.0 AS ty, round(r8, 6) + 0.0 AS r8 FROM cam"


@query("s03_matrices", with_views("poses", rest=_ROT) + _M)
def matrix_files(spark, sf):
    """S3 and K2: poses as text, four numbers a line, and back."""
    line = lambda i: F.array_join(F.transform(F.slice("m", 4 * i + 1, 4), lambda x: F.format_string("%.6f", x)), " ")
    rows = _matrix(cameras(spark, sf)).select(F.concat(F.lit("s"), F.col("scene_id"), F.lit("/"), F.col("frame_id"), F.lit(".txt")).alias("p"), F.concat_ws("\n", *[line(i) for i in range(4)]).alias("b"))
    m = readers.matrices(spark, _files(spark, "poses", rows, "p", "b") + "/*")
    scene = F.regexp_extract("path", r"/s(\d+)/", 1).cast("long")
    return m.select(scene.alias("scene_id"), "frame_id", tidy(F.get("m", F.lit(0))).alias("r0"), tidy(F.get("m", F.lit(7))).alias("ty"), tidy(F.get("m", F.lit(10))).alias("r8"))


@query("s04_axis_alignment", with_views("poses", rest=_ROT + ", f AS (SELECT * FROM cam WHERE frame_id = 1)") + "SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN 1.0 ELSE round(r0, 6) + 0.0 END AS r0, CASE WHEN scene_id % 3 = 0 THEN 0.0 ELSE round(ty, 6) + 0.0 END AS ty FROM f")
def alignments(spark, sf):
    """A line of a scene's text file; the identity where it is missing."""
    folder = scratch(spark, "alignment")
    for r in _matrix(cameras(spark, sf).where("frame_id = 1")).select("scene_id", "m").toLocalIterator():
        sinks.scene_text(spark, f"{folder}/s{r['scene_id']}.txt", {"numDepthFrames": 5} | ({} if r["scene_id"] % 3 == 0 else {"axisAlignment": r["m"]}))
    a = readers.axis_alignment(spark, folder)
    return a.select(F.regexp_extract("path", r"s(\d+)\.txt$", 1).cast("long").alias("scene_id"), tidy(F.get("axis_align", F.lit(0))).alias("r0"), tidy(F.get("axis_align", F.lit(7))).alias("ty"))


@query("s05_points", with_views("objects") + "SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY object_id) - 1 AS INT) AS vertex_id, round(x, 3) + 0.0 AS x, round(z, 3) + 0.0 AS z, CAST(object_id % 256 AS INT) AS red FROM objects")
def point_files(spark, sf):
    """meshes' vertices and a colour from binary PLY files, one a scene, by the data source for meshes."""
    folder = scratch(spark, "mesh")
    o = objects(spark, sf).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("object_id", "x", "y", "z"))).alias("v"))
    for r in o.toLocalIterator():
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(r['v'])}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
        sinks.write_file(spark, f"{folder}/s{r['scene_id']}.ply", head.encode() + b"".join(struct.pack("<fffB", p["x"], p["y"], p["z"], p["object_id"] % 256) for p in r["v"]))
    p = readers.points(spark, folder, readers.POINTS + ", red int")
    return p.select(F.regexp_extract("path", r"s(\d+)\.ply$", 1).cast("long").alias("scene_id"), "vertex_id", tidy(F.col("x").cast("double"), 3).alias("x"), tidy(F.col("z").cast("double"), 3).alias("z"), "red")


@query("s06_segment_groups", "SELECT CAST(l_orderkey % 20 AS VARCHAR) AS scene_id, CAST(l_partkey % 7 + 1 AS INT) AS object_id, concat('label', CAST(l_partkey % 7 AS VARCHAR)) AS label, CAST(l_suppkey AS INT) AS seg_id, count(DISTINCT l_orderkey) > 0 AS seen FROM lineitem GROUP BY 1,2,3,4")
def segment_groups(spark, sf):
    """Groups of segments, ids from 1."""
    li = _table(spark, sf, "lineitem").select((F.col("l_orderkey") % 20).cast("string").alias("sceneId"), (F.col("l_partkey") % 7).cast("int").alias("objectId"), F.col("l_suppkey").cast("int").alias("seg")).distinct()
    g = li.groupBy("sceneId", "objectId").agg(F.array_sort(F.collect_list("seg")).alias("segments")).withColumn("label", F.concat(F.lit("label"), F.col("objectId")))
    rows = g.groupBy("sceneId").agg(F.array_sort(F.collect_list(F.struct("objectId", "label", "segments"))).alias("segGroups"))
    path = scratch(spark, "groups")
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return readers.segment_groups(spark, path).select("scene_id", "object_id", "label", "seg_id", F.lit(True).alias("seen"))


@query("s07_segments", "SELECT CAST(o_custkey % 20 AS VARCHAR) AS scene_id, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS INT) AS vertex_id, CAST(o_custkey AS INT) AS seg_id FROM orders")
def segments(spark, sf):
    """The segment of every vertex, by its place."""
    o = _table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).cast("string").alias("sceneId")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("v"))
    path = scratch(spark, "segments")
    o.select("sceneId", F.transform("v", lambda x: x["o_custkey"].cast("int")).alias("segIndices")).write.option("maxRecordsPerFile", 1).json(path)
    return readers.segments(spark, path)


@query("s08_label_map", "SELECT p_name AS raw_category, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS INT) END AS nyu40id FROM part")
def label_map(spark, sf):
    """A table between tabs; ids that are no integers are null."""
    path = scratch(spark, "map")
    p = _table(spark, sf, "part").select(F.col("p_name").alias("raw_category"), F.when(F.col("p_partkey") % 5 == 0, "?").otherwise(F.col("p_size").cast("string")).alias("nyu40id"))
    p.write.option("sep", "\t").option("header", True).csv(path)
    return readers.label_map(spark, path).select("raw_category", "nyu40id")


@query("s09_harmonised_labels", "SELECT lower(n_name) AS raw, n_name AS canonical FROM nation UNION ALL SELECT lower(concat(n_name, ' land')), n_name FROM nation WHERE n_nationkey % 2 = 0")
def harmonised(spark, sf):
    """Canonical labels and their other forms."""
    rows = _table(spark, sf, "nation").select("n_name", "n_nationkey").toLocalIterator()
    body = {"labels": {r["n_name"]: {"aliases": [f" {r['n_name']} Land "]} if r["n_nationkey"] % 2 == 0 else {} for r in rows}}
    path = scratch(spark, "labels") + ".json"
    sinks.write_file(spark, path, json.dumps(body, indent=1))
    return readers.harmonised_labels(spark, path)


@query("s11_trajectory", with_views("poses") + "SELECT scene_id, round(frame_id / 3.0, 3) AS ts, round(ax, 6) + 0.0 AS ax, round(tz, 6) + 0.0 AS tz FROM poses")
def trajectory(spark, sf):
    """Lines of a time, an angle-axis and a translation; numbers are written whole, since a cut one may round to another."""
    p = cameras_raw(spark, sf)
    numbers = ["ts", "ax", "ay", "az", "tx", "ty", "tz"]
    p = p.withColumn("ts", F.col("frame_id") / 3.0).withColumn("value", F.concat_ws(" ", *[F.col(c).cast("string") for c in numbers]))
    path = scratch(spark, "trajectory")
    p.select("scene_id", "value").write.partitionBy("scene_id").text(path)
    out = None
    for r in p.select("scene_id").distinct().collect():
        t = readers.trajectory(spark, f"{path}/scene_id={r[0]}").withColumn("scene_id", F.lit(r[0]).cast("long"))
        out = t if out is None else out.unionByName(t)
    return out.select("scene_id", "ts", tidy(F.col("ax")).alias("ax"), tidy(F.col("tz")).alias("tz"))


def cameras_raw(spark, sf) -> DataFrame:
    from scenery.sources.adapters import spark_view

    return spark_view(spark, sf, "poses")


@query("s12_pincam", with_views("poses") + "SELECT scene_id, CAST(frame_id AS DOUBLE) + 0.125 AS ts, 256.0 AS width, round(abs(ax) * 100, 4) AS fx FROM poses WHERE frame_id <= 3")
def pincams(spark, sf):
    """A camera's numbers from a file with the time in its name; three a scene are written here."""
    p = cameras_raw(spark, sf).where("frame_id <= 3")
    rows = p.select(F.format_string("s%s/%s_%s.125.pincam", "scene_id", "scene_id", "frame_id").alias("p"), F.concat_ws(" ", F.lit("256 192"), F.format_string("%.4f", F.abs("ax") * 100), F.lit("200.0 127.5 95.5")).alias("b"))
    got = readers.pincam(spark, _files(spark, "pincam", rows, "p", "b") + "/*")
    return got.select(F.regexp_extract("path", r"/s(\d+)/", 1).cast("long").alias("scene_id"), "ts", "width", F.round("fx", 4).alias("fx"))


@query("s13_listing", "SELECT o_custkey % 50 + 0.5 AS ts, CAST(max(length(o_orderstatus)) AS BIGINT) AS length FROM orders GROUP BY 1")
def listing(spark, sf):
    """Files below a folder by the time in their names; of alternatives the first that is there."""
    rows = _table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("k")).agg(F.max("o_orderstatus").alias("b")).select(F.format_string("a/b%s/x_%s.500.png", "k", "k").alias("p"), "b")
    folder = _files(spark, "listing", rows, "p", "b")
    return readers.listing(spark, folder, "*.png").select("ts", "length")


@query("s14_first_existing", "SELECT n_nationkey, n_name FROM nation")
def first_existing(spark, sf):
    """A table from the first of two paths that exists."""
    path = scratch(spark, "second")
    _table(spark, sf, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    got = readers.first_existing(spark, path + "-missing", path)
    return got.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("s15_visits", "SELECT c_nationkey AS visit, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS scans FROM customer GROUP BY 1")
def visits(spark, sf):
    """A visit's scans from a CSV, one to many."""
    path = scratch(spark, "visits")
    _table(spark, sf, "customer").select("c_nationkey", "c_custkey").write.option("header", True).csv(path)
    rows = readers.first_existing(spark, path).select(F.col("c_nationkey").cast("int").alias("visit"), F.col("c_custkey").cast("int").alias("scan"))
    return readers.grouped(rows, "visit", "scan", "scans").select("visit", F.array_join(F.transform("scans", lambda x: x.cast("string")), ",").alias("scans"))


@query("s16_assets", "SELECT s_nationkey AS k, CASE WHEN s_nationkey % 3 = 0 THEN 'b.json' WHEN s_nationkey % 3 = 1 THEN 'a.json' ELSE 'c.json' END AS name FROM supplier GROUP BY 1, 2")
def asset_files(spark, sf):
    """Of a folder's alternative files the preferred one that is there, at any depth."""
    k = F.col("s_nationkey")
    names = F.when(k % 3 == 0, F.array(F.lit("b.json"), F.lit("c.json"))).when(k % 3 == 1, F.array(F.lit("c.json"), F.lit("a.json"), F.lit("b.json"))).otherwise(F.array(F.lit("c.json"), F.lit("other")))
    rows = _table(spark, sf, "supplier").select("s_nationkey").distinct().select(k, F.explode(names).alias("n")).select(F.format_string("deep/k%s/%s", "s_nationkey", "n").alias("p"), F.lit("{}").alias("b"))
    got = readers.assets(spark, _files(spark, "assets", rows, "p", "b"), "a.json", "b.json", "c.json")
    return got.select(F.regexp_extract("folder", r"k(\d+)$", 1).cast("int").alias("k"), "name")


@query("s17_transforms", with_views("poses", rest=_ROT) + "SELECT scene_id, frame_id, round(r4, 6) + 0.0 AS r4 FROM cam WHERE frame_id % 4 <> 0")
def transform_files(spark, sf):
    """Frames of transforms files that aren't marked bad."""
    c = _matrix(cameras(spark, sf))
    frame = F.struct(F.format_string("frame_%06d.jpg", F.col("frame_id")).alias("file_path"), (F.col("frame_id") % 4 == 0).alias("is_bad"), F.array(*[F.slice("m", 4 * i + 1, 4) for i in range(4)]).alias("transform_matrix"))
    rows = c.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", frame.alias("f")))).alias("v")).select("scene_id", F.to_json(F.struct(F.col("v.f").alias("frames"))).alias("b"))
    folder = _files(spark, "transforms", rows.select(F.format_string("s%s/transforms.json", "scene_id").alias("p"), "b"), "p", "b")
    out = None
    for r in rows.select("scene_id").collect():
        t = readers.transforms(spark, f"{folder}/s{r[0]}/transforms.json").withColumn("scene_id", F.lit(r[0]))
        out = t if out is None else out.unionByName(t)
    return out.select("scene_id", F.regexp_extract("file_path", r"(\d+)\.jpg$", 1).cast("int").alias("frame_id"), tidy(F.get("m", F.lit(5))).alias("r4"))


@query("s18_annotations", with_views("objects") + "SELECT CAST(object_id AS VARCHAR) AS uid, label, round(x, 6) + 0.0 AS x FROM objects WHERE object_id % 7 <> 0")
def annotation_files(spark, sf):
    """Aligned boxes as they are, others from centimetres; those with neither are left out."""
    o = objects(spark, sf)
    k = F.col("object_id")
    box = lambda scale: F.struct(F.array(*[F.col(c) * scale for c in "xyz"]).alias("centroid"), F.array(*[F.lit(1.0)] * 3).alias("axesLengths"))
    seg = F.struct(F.when((k % 2 == 0) & (k % 7 != 0), box(1.0)).alias("obbAligned"), F.when((k % 2 == 1) & (k % 7 != 0), box(100.0)).alias("obb"))
    rows = o.groupBy("scene_id").agg(F.collect_list(F.struct(k.cast("string").alias("uid"), "label", seg.alias("segments"))).alias("data"))
    path = scratch(spark, "annotations")
    rows.select("data").write.option("maxRecordsPerFile", 1).json(path)
    return readers.annotations(spark, path).select("uid", "label", tidy(F.get("centroid", F.lit(0))).alias("x"))


@query("s19_datasets", "SELECT n_nationkey, n_name FROM nation")
def datasets(spark, sf):
    """A dataset's split by its folder's form."""
    path = scratch(spark, "dataset") + ".parquet"
    _table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1).write.parquet(f"{path}/train")
    return readers.dataset(spark, f"{path}@train")


@query("s20_scene_ids", with_views("objects") + "SELECT DISTINCT concat('scene', CAST(scene_id AS VARCHAR)) AS scene_id FROM objects UNION SELECT 'extra'")
def scene_lists(spark, sf):
    """Ids of a list and of the caller, each once; K2's index is such a list."""
    path = scratch(spark, "index")
    sinks.scene_index(objects(spark, sf).select(F.concat(F.lit("scene"), F.col("scene_id")).alias("scene_id")), path)
    return readers.scene_ids(spark, path, ["extra", " extra ", "scene1"])


@query("s21_label_inventory", r"WITH l AS (SELECT lower(n_name) AS label FROM nation UNION SELECT lower(concat('Big_', n_name)) FROM nation) SELECT label FROM l UNION SELECT trim(regexp_replace(label, '[_\-\s]+', ' ', 'g')) FROM l")
def inventory(spark, sf):
    """Labels at any depth of a JSON file, with blanks for marks as well."""
    names = [r[0] for r in _table(spark, sf, "nation").select("n_name").collect()]
    body = {"group": [{"items": [n, {"deeper": {"k": [f"Big_{n}"]}}]} for n in names]}
    path = scratch(spark, "inventory") + ".json"
    sinks.write_file(spark, path, json.dumps(body))
    return readers.label_inventory(spark, path)


@query("s22_configuration", "SELECT * FROM (VALUES ('tasks/object_size/enabled', 'true'), ('tasks/object_size/weights', '[1, 2.5]'), ('name', 'run'), ('vlm/max_tokens', '20480')) t(path, value)")
def configuration(spark, sf):
    """Settings of a YAML file by their paths."""
    path = scratch(spark, "config") + ".yaml"
    sinks.write_file(spark, path, "name: run\nvlm: {max_tokens: 20480}\ntasks:\n  object_size:\n    enabled: true\n    weights: [1, 2.5]\n")
    return readers.configuration(spark, path)


@query("s23_benchmarks", """SELECT 'gsm8k' AS name, concat('How many? ', n_name) AS question, CAST(n_nationkey AS VARCHAR) AS answer, 1 AS copies FROM nation UNION ALL
SELECT 'amc', concat('How many? ', n_name), concat('because #### ', CAST(n_nationkey AS VARCHAR)), 32 FROM nation UNION ALL
SELECT 'super_gpqa', concat('How many? ', n_name, chr(10), chr(10), 'Options:', chr(10), 'A. one', chr(10), 'B. ', n_name, chr(10)), 'B', 1 FROM nation""")
def benchmarks(spark, sf):
    """Loaders by name: the last part of an answer, repeats, lettered options."""
    n = _table(spark, sf, "nation").select(F.concat(F.lit("How many? "), F.col("n_name")).alias("question"), F.concat(F.lit("because #### "), F.col("n_nationkey")).alias("answer"), F.array(F.lit("one"), F.col("n_name")).alias("options"), F.lit("B").alias("answer_letter"))
    out = None
    for name in ("gsm8k", "amc", "super_gpqa"):
        b = readers.benchmark(n, name).groupBy("question", "answer").agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumn("name", F.lit(name))
        out = b if out is None else out.unionByName(b)
    return out


@query("s24_manifests", with_views("objects") + "SELECT form, CAST(scene_id AS VARCHAR) AS scene_id, CASE WHEN frame_id % 2 = 0 THEN concat(CAST(frame_id AS VARCHAR), '.jpg') ELSE concat(CAST(frame_id AS VARCHAR), '.png') END AS frame FROM (SELECT DISTINCT scene_id, frame_id FROM objects), (VALUES ('list'), ('record')) f(form)")
def manifests(spark, sf):
    """Selected frames in both forms of the file."""
    name = F.when(F.col("frame_id") % 2 == 0, F.col("frame_id").cast("string")).otherwise(F.concat(F.col("frame_id").cast("string"), F.lit(".png")))
    f = objects(spark, sf).select("scene_id", "frame_id").distinct().select("scene_id", name.alias("frame_id"))
    listed, mapped = scratch(spark, "manifest") + ".json", scratch(spark, "manifest") + ".json"
    sinks.manifest(f, listed)
    by_scene = f.groupBy("scene_id").agg(F.collect_list("frame_id").alias("v"))
    sinks.write_file(spark, mapped, json.dumps({str(r["scene_id"]): [f" {x} " for x in r["v"]] for r in by_scene.toLocalIterator()}))
    one, two = readers.manifest(spark, listed), readers.manifest(spark, mapped)
    return one.withColumn("form", F.lit("list")).unionByName(two.withColumn("form", F.lit("record"))).select("form", "scene_id", "frame")


def png(rows: list[list[int]]) -> bytes:
    """A grey PNG of 16 bits."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = b"".join(b"\0" + struct.pack(f">{len(r)}H", *r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 16, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


@query("j18_depth_lookup", with_views("objects", rest="q AS (SELECT object_id, CAST(floor(u0) AS INT) % 16 AS u, CAST(floor(v0) AS INT) % 12 AS v, abs(z) * 1000 AS z FROM objects)") + "SELECT object_id, u, v, (u * 37 + v * 91) % 5000 AS depth, z / 1000 - ((u * 37 + v * 91) % 5000) / 1000.0 > 0.02 AS hidden FROM q")
def depth_lookup(spark, sf):
    """Projected points against the cells of a depth image."""
    folder = scratch(spark, "depth")
    sinks.write_file(spark, f"{folder}/0.png", png([[(u * 37 + v * 91) % 5000 for u in range(16)] for v in range(12)]))
    cells = readers.depth(spark, folder).drop("path")
    q = objects(spark, sf).select("object_id", (F.floor("u0") % 16).cast("int").alias("u"), (F.floor("v0") % 12).cast("int").alias("v"), F.abs("z").alias("z"))
    return q.join(cells, ["u", "v"]).select("object_id", "u", "v", "depth", (F.col("z") - F.col("depth") / 1000.0 > 0.02).alias("hidden"))


@query("k02_frame_map", with_views("poses") + "SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY frame_id) - 1 AS INT) AS export_index, frame_id, concat('video_', CAST(frame_id AS VARCHAR), '.png') AS source FROM poses")
def frame_maps(spark, sf):
    """K2: exported frames and their sources as CSV."""
    from pyspark.sql import Window

    p = cameras_raw(spark, sf).select("scene_id", "frame_id")
    p = p.withColumns({"export_index": F.row_number().over(Window.partitionBy("scene_id").orderBy("frame_id")) - 1, "source": F.format_string("video_%s.png", "frame_id")})
    out = None
    for r in p.select("scene_id").distinct().collect():
        path = scratch(spark, "frame-map")
        sinks.frame_map(p.where(F.col("scene_id") == r[0]), path)
        t = spark.read.option("header", True).csv(path).withColumn("scene_id", F.lit(r[0]))
        out = t if out is None else out.unionByName(t)
    return out.select("scene_id", F.col("export_index").cast("int").alias("export_index"), F.col("frame_id").cast("int").alias("frame_id"), "source")


@query("k04_valid_questions", with_views("rollouts") + "SELECT uid, string_agg(response, '' ORDER BY pos) FILTER (is_valid) AS responses, count(*) FILTER (is_valid) AS n FROM rollouts GROUP BY uid HAVING count(*) FILTER (is_valid) > 0")
def question_log(spark, sf):
    """K4: one line per question with its valid responses in order."""
    path = scratch(spark, "questions")
    sinks.valid_questions(rollouts(spark, sf).select("uid", "pos", F.lit("q").alias("question"), "response", F.col("score").alias("accuracy"), "is_valid"), path)
    got = spark.read.schema("uid long, question string, responses array<string>, accuracies array<double>").json(path)
    return got.select("uid", F.array_join("responses", "").alias("responses"), F.size("accuracies").cast("long").alias("n"))


@query("k05_io_log", with_views("rollouts") + "SELECT step, uid, pos, response FROM rollouts, (VALUES (1), (2)) s(step)")
def io_log(spark, sf):
    """K5: prompts and responses of two steps, appended."""
    path = scratch(spark, "io")
    for step in (1, 2):
        sinks.io_log(rollouts(spark, sf).select("uid", "pos", "response"), path, step)
    return spark.read.schema("step int, uid long, pos int, response string").json(path)


@query("k06_metrics_log", with_views("rollouts") + "SELECT step, round(avg(score) * step, 6) AS score FROM rollouts, (VALUES (1), (2), (3)) s(step) GROUP BY step")
def metrics_log(spark, sf):
    """K6: metrics of three steps, a line each."""
    path = scratch(spark, "metrics")
    mean = rollouts(spark, sf).agg(F.avg("score")).first()[0]
    for step in (1, 2, 3):
        sinks.metrics_log(spark, path, step, {"score": float(mean) * step, "lr": 1e-6})
    return spark.read.schema("step int, metrics map<string,double>").json(path).select("step", F.round(F.element_at("metrics", "score"), 6).alias("score"))


@query("k07_results", "SELECT form, n_nationkey, n_name FROM nation, (VALUES ('json'), ('yaml')) f(form)")
def result_files(spark, sf):
    """K7: results as JSON lines and as YAML."""
    import yaml

    n = _table(spark, sf, "nation").select("n_nationkey", "n_name")
    one, two = scratch(spark, "results"), scratch(spark, "results") + ".yaml"
    sinks.results(n, one)
    sinks.results(n, two, "yaml")
    back = yaml.safe_load(spark.read.text(two, wholetext=True).first()["value"])
    out = spark.read.schema(n.schema).json(one).withColumn("form", F.lit("json"))
    return out.unionByName(spark.createDataFrame([tuple(r[c] for c in n.columns) for r in back], n.schema).withColumn("form", F.lit("yaml")))


@query("k08_saved_batches", with_views("rollouts") + "SELECT uid, pos, score, is_valid FROM rollouts")
def saved(spark, sf):
    """K8: a batch saved with its types and loaded."""
    path = scratch(spark, "batch")
    sinks.save_batch(rollouts(spark, sf).select("uid", "pos", "score", "is_valid"), path)
    return sinks.load_batch(spark, path)


@query("k09_verify_report", "SELECT 3 AS color_count, 2 AS pose_count, true AS required_ok, 'scene.txt' AS optional_present, 'scene.ply' AS optional_missing")
def verify(spark, sf):
    """K9: what a scene's folder holds, as a report that is written and read back."""
    folder = scratch(spark, "verify")
    for p in ("color/0.jpg", "color/1.jpg", "color/2.jpg", "pose/0.txt", "pose/1.txt", "scene.txt"):
        sinks.write_file(spark, f"{folder}/s1/{p}", "x")
    report = scratch(spark, "report") + ".json"
    sinks.verify_report(spark, folder, ("color", "pose"), ("scene.txt", "scene.ply"), report)
    got = spark.read.schema("color_count int, pose_count int, required_ok boolean, optional_present array<string>, optional_missing array<string>").option("multiLine", True).json(report)
    return got.select("color_count", "pose_count", "required_ok", F.array_join("optional_present", ",").alias("optional_present"), F.array_join("optional_missing", ",").alias("optional_missing"))
