"""Readers and writers on small files that the tests write."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from scenery.plans import catalogue
from scenery.sources import readers, sinks
from scenery.streaming import counters


@pytest.fixture
def folder(tmp_path):
    scene = {"scene_id": "s1", "room_size": {"area": 12.5}, "objects": [
        {"object_id": 1, "label": "table", "size": 120, "3d_bbox": [0, 0, 0, 1, 2, 1], "3d_location": [0.5, 1, 0.5], "first_frame": "0"},
        {"object_id": 2, "label": "lamp", "size": {"length": 0.2, "width": 0.2, "height": 1.5}, "3d_bbox": [0, 0, 0, 1, 1, 1], "3d_location": [0, 0, 0], "first_frame": "20"},
        {"object_id": 3, "label": "rug", "3d_bbox": [0, 0, 0, 3, 1, 0], "3d_location": [0, 0, 0], "first_frame": "-1"},
    ]}
    (tmp_path / "scene.json").write_text(json.dumps(scene, indent=1))
    (tmp_path / "pose").mkdir()
    (tmp_path / "pose/120.txt").write_text("\n".join(" ".join(str(float(4 * i + j)) for j in range(4)) for i in range(4)))
    (tmp_path / "pose/140.txt").write_text("1 2 3")
    (tmp_path / "s1.txt").write_text("x = 1\naxisAlignment = " + " ".join(map(str, range(16))) + "\n")
    (tmp_path / "s2.txt").write_text("x = 1\n")
    (tmp_path / "traj").write_text("100.1234 0 0 0 1 2 3\n101 0 0 0 4 5 6\n")
    (tmp_path / "bad").write_text("1 2\n")
    (tmp_path / "map.tsv").write_text("raw_category\tnyu40id\nchair\t5\nodd\tx\n")
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    (tmp_path / "mesh").mkdir()
    (tmp_path / "mesh/a.ply").write_text(head.format("ascii") + "1 2 3 9\n4 5 6 9\n")
    (tmp_path / "mesh/b.ply").write_bytes(head.format("binary_little_endian").encode() + struct.pack("<fffBfffB", 1, 2, 3, 9, 4, 5, 6, 9))
    return tmp_path


def test_scene(spark, folder):
    s = readers.scenes(spark, str(folder / "scene.json"))
    assert s.first()["room_size"] == 12.5
    assert {r["label"]: r["size_cm"] for r in readers.scene_objects(s).collect()} == {"table": 120.0, "lamp": 150.0, "rug": 300.0}


def test_matrices_and_alignment(spark, folder):
    m = {r["frame_id"]: r["m"] for r in readers.matrices(spark, str(folder / "pose")).collect()}
    assert m == {120: [float(i) for i in range(16)], 140: None}
    a = {r["path"][-6:]: r["axis_align"] for r in readers.axis_alignment(spark, str(folder / "s*.txt")).collect()}
    assert a == {"s1.txt": [float(i) for i in range(16)], "s2.txt": readers.IDENTITY}


def test_trajectory(spark, folder):
    assert [r["ts"] for r in readers.trajectory(spark, str(folder / "traj")).collect()] == [100.123, 101.0]
    with pytest.raises(Exception, match="7 numbers"):
        readers.trajectory(spark, str(folder / "bad")).collect()


def test_trajectory_numbers_are_written_whole(spark, tmp_path):
    """Values just beside a half of the sixth digit, which a number cut at nine digits moves across it; small and large ones."""
    ax = [0.022905750200152397, 0.07995975017547607, -0.01724174991250038, 1.1754943508222875e-38, -3e7]
    tz = [-0.012601099908351898, -0.20375970005989075, -0.06955830007791519, 0.0, 9.999999974752427e-07]
    rows = [(20 * k + k % 2, [0.0] * 16 + [a, 0.0, 0.0, 0.0, 0.0, b], 0) for k, (a, b) in enumerate(zip(ax, tz, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.queries()["s11_trajectory"](spark, str(tmp_path))
    want = [(k % 2, round((k // 2 + 1) / 3, 3), round(a * 2, 6) + 0.0, round(b * 5, 6) + 0.0) for k, (a, b) in enumerate(zip(ax, tz, strict=True))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert dict(got.dtypes)["scene_id"] == "bigint"


def test_ply(spark, folder):
    got = readers.points(spark, str(folder / "mesh")).orderBy("path", "vertex_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [(1, 2, 3), (4, 5, 6)] * 2


def test_label_map_and_listing(spark, folder):
    assert {r["raw_category"]: r["nyu40id"] for r in readers.label_map(spark, str(folder / "map.tsv")).collect()} == {"chair": 5, "odd": None}
    assert readers.listing(spark, str(folder / "mesh"), "*.ply").count() == 2
    df = spark.createDataFrame([("/a/42_12.3456.png",), ("9.5.jpg",), ("x.png",)], "p string")
    assert [r[0] for r in df.select(readers.file_time(F.col("p"))).collect()] == [12.346, 9.5, None]


def test_segments(spark, tmp_path):
    (tmp_path / "agg.json").write_text(json.dumps({"sceneId": "s", "segGroups": [{"objectId": 0, "label": "a", "segments": [7, 8]}]}))
    (tmp_path / "seg.json").write_text(json.dumps({"sceneId": "s", "segIndices": [7, 7, 9]}))
    g = readers.segment_groups(spark, str(tmp_path / "agg.json"))
    v = readers.segments(spark, str(tmp_path / "seg.json"))
    assert [r["object_id"] for r in v.join(g, ["scene_id", "seg_id"]).collect()] == [1, 1]


def test_transforms_and_datasets(spark, tmp_path):
    eye = [[1.0, 0.0, 0.0, 0.0]] * 4
    (tmp_path / "transforms.json").write_text(json.dumps({"frames": [{"file_path": "a", "transform_matrix": eye}, {"file_path": "b", "is_bad": True, "transform_matrix": eye}, {"file_path": "c", "is_bad": False, "transform_matrix": eye}]}))
    assert [r["file_path"] for r in readers.transforms(spark, str(tmp_path / "transforms.json")).collect()] == ["a", "c"]
    assert [r["file_path"] for r in readers.transforms(spark, str(tmp_path / "transforms.json"), 1).collect()] == ["a"]
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "d.csv").write_text("a\n1\n")
    assert readers.dataset(spark, str(tmp_path / "d.jsonl")).count() == 2 and readers.dataset(spark, str(tmp_path / "d.csv")).count() == 1
    assert spark.range(1).select(readers.last_part(F.lit("work #### 7"))).first()[0] == "7"


def test_append_new_runs_again(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], "scene_id string, v int")
    path = str(tmp_path / "out")
    assert sinks.append_new(rows, path, "scene_id") == 2
    assert sinks.append_new(rows.union(spark.createDataFrame([("s3", 3)], rows.schema)), path, "scene_id") == 1
    assert spark.read.parquet(path).count() == 3


def test_question_log_and_matrices(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "q", "a", 1.0, True), (1, 1, "q", "b", 0.0, True), (2, 0, "r", "c", 1.0, False)], "uid int, pos int, question string, response string, accuracy double, is_valid boolean")
    sinks.valid_questions(rows, str(tmp_path / "qa"))
    assert [(r["uid"], r["responses"], r["accuracies"]) for r in spark.read.json(str(tmp_path / "qa")).collect()] == [(1, ["a", "b"], [1.0, 0.0])]
    sinks.matrix_text(spark.createDataFrame([([float(i) for i in range(16)],)], "m array<double>"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()["value"].split() == [f"{i:.6f}" for i in range(4)]


def test_counters_follow_a_stream(spark, tmp_path):
    schema = "task int, is_valid boolean"
    for part in ([(1, True), (2, False)], [(1, False), (1, True)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        counters.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["task"]: (r["total"], r["valid"], r["invalid"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (3, 2, 1), 2: (1, 0, 1)} == {r["task"]: (r["total"], r["valid"], r["invalid"]) for r in counters.type_counters(spark.read.parquet(str(tmp_path / "in"))).collect()}


def test_tasks_write_files(spark, tmp_path, monkeypatch):
    """Files of rows are written by tasks, never through the driver, with names and bytes as they are."""
    monkeypatch.setattr(sinks, "write_file", lambda *a: pytest.fail("written by the driver"))
    rows = spark.createDataFrame([(f"s{k % 3}/{k}.txt", f"é{k}\n" if k else "") for k in range(50)], "p string, b string")
    for _ in range(2):  # again over what is there
        assert sinks.write_files(rows, str(tmp_path / "f"), "p", "b") == 50
    assert sorted(x.name for x in (tmp_path / "f").rglob("*") if x.is_file()) == sorted(f"{k}.txt" for k in range(50))
    assert (tmp_path / "f/s1/7.txt").read_bytes() == "é7\n".encode() and (tmp_path / "f/s0/0.txt").read_bytes() == b""
    assert sinks.write_files(rows.where("false"), str(tmp_path / "g"), "p", "b") == 0
    assert sinks.write_files(spark.createDataFrame([("x/y", bytearray(b"\0\xff"))], "p string, b binary"), f"file://{tmp_path}/h", "p", "b") == 1
    assert (tmp_path / "h/x/y").read_bytes() == b"\0\xff"
