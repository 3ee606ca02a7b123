"""The mesh source: every form, tasks of ranges, properties on request, and files that are broken."""

import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.types import StructType

from scenery.sources.mesh import MeshReader, MeshSource

N = 5000
ROWS = np.random.RandomState(1).normal(0, 3, (N, 3)).astype("f4")


def _mesh(form, n=N, before=b"", before_head=""):
    head = f"ply\nformat {form} 1.0\ncomment element vertex 9\n{before_head}element vertex {n}\nproperty float x\nproperty float y\nproperty double q\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    if form == "ascii":
        body = "".join(f"{x:.9g} {y:.9g} {i / 8} {z:.9g} {i % 256}\n" for i, (x, y, z) in enumerate(ROWS[:n])).encode() + b"3 0 1 2\n"
    else:
        order = "<" if "little" in form else ">"
        body = b"".join(struct.pack(order + "ffdfB", x, y, i / 8, z, i % 256) for i, (x, y, z) in enumerate(ROWS[:n])) + b"\x03" + bytes(12)
    return head.encode() + before + body


@pytest.fixture(scope="module")
def read(spark):
    spark.dataSource.register(MeshSource)
    return lambda path, schema=None, **o: (spark.read.format("mesh").schema(schema) if schema else spark.read.format("mesh")).options(**o).load(str(path))


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_forms(read, tmp_path, form):
    (tmp_path / "a.ply").write_bytes(_mesh(form))
    got = sorted(read(tmp_path).collect(), key=lambda r: r["vertex_id"])
    assert [r["vertex_id"] for r in got] == list(range(N)) and got[0]["path"].endswith("/a.ply")
    assert np.array_equal(np.array([(r["x"], r["y"], r["z"]) for r in got], "f4"), ROWS)
    other = sorted(read(f"file:{tmp_path}", "red int, vertex_id int, q double, blue int").collect(), key=lambda r: r["vertex_id"])
    assert [tuple(r) for r in other] == [(i % 256, i, i / 8, None) for i in range(N)]


def test_a_mesh_in_many_tasks(read, spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "big.ply").write_bytes(_mesh("binary_little_endian", before=b"\x01\x02\x03\x04" * 3, before_head="element camera 3\nproperty short u\nproperty short v\n"))
    for k in range(3):
        (tmp_path / f"small{k}.ply").write_bytes(_mesh("ascii", n=2))
    (tmp_path / "note.txt").write_text("no mesh")
    df = read(tmp_path, "path string, vertex_id long, x double", vertices=700, small=2000)
    assert df.rdd.getNumPartitions() == 8 + 1
    got = df.where("path like '%big.ply'").orderBy("vertex_id").collect()
    assert np.array_equal(np.array([r["x"] for r in got]), ROWS[:, 0].astype(float)) and df.count() == N + 6
    # A task reads its own range only.
    reader = MeshReader(StructType.fromDDL("vertex_id long"), {"path": str(tmp_path), "vertices": "700", "small": "2000"})
    assert [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()] == [700] * 7 + [100, 6]


def test_broken_and_empty(read, tmp_path):
    cases = {"short": _mesh("binary_little_endian")[:-5000], "cut": _mesh("ascii")[:3000], "none": b"ply\nformat ascii 1.0\n", "other": b"obj\nend_header\n"}
    for name, data in cases.items():
        (tmp_path / f"{name}.ply").write_bytes(data)
        with pytest.raises(PySparkException, match=f"{name}.ply"):
            read(tmp_path / f"{name}.ply").collect()
    (tmp_path / "empty").mkdir()
    assert read(tmp_path / "empty").count() == 0
    (tmp_path / "empty" / "zero.ply").write_bytes(_mesh("ascii", n=0))
    assert read(tmp_path / "empty").count() == 0
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "a.ply").write_bytes(_mesh("ascii", n=300))
    with pytest.raises(PySparkException):
        read(tmp_path / "wide", "red tinyint").collect()
    with pytest.raises(PySparkException):
        read(tmp_path, "x string").collect()
