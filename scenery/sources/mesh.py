"""The data source `mesh`: vertices of PLY files, in tasks of vertex ranges, with the properties asked for.

    spark.dataSource.register(MeshSource)
    spark.read.format("mesh").load(path)                                          # path, vertex_id, x, y, z
    spark.read.format("mesh").schema("vertex_id long, red int, quality double").load(path)

A file's header says where its vertices start and how wide one is, so a task reads its own
range and no more, in batches; no file is ever one value. `path` is a file, or a folder whose
PLY files at any depth are read, in any store that pyarrow opens. Options: `vertices`, the most
a task reads (1,000,000), and `small`, the bytes up to which files share a task unopened
(16 MiB). Text files and small ones are read whole by one task, in batches too.

`path` and `vertex_id`, counted from 0, are columns of every mesh; others are properties of its
vertices, by name, and null in meshes that lack them. Numbers that don't fit the type asked for, a
broken header, properties that are lists, and files that end too soon are errors that name the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The names of the format's types, old and new, and theirs in numpy.
TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
ARROW = {"string": pa.string(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
BATCH = 65_536
HEADER = 1 << 20


@dataclass(frozen=True)
class Header:
    """Where the vertices are: how they are written, how many, their properties, and the first one's byte (for text: line)."""

    form: str
    count: int
    fields: tuple[tuple[str, str], ...]
    body: int
    skipped: int

    @property
    def dtype(self) -> np.dtype:
        order = ">" if self.form == "binary_big_endian" else "<"
        return np.dtype([(n, order + t) for n, t in self.fields])


def read_header(path: str, data: bytes) -> Header:
    end = re.search(rb"(?m)^end_header[ \t]*\r?\n", data)
    if not data.startswith(b"ply") or not end:
        raise ValueError(f"not a PLY mesh, or its header is longer than {HEADER} bytes: {path}")
    form, elements = "", []
    for line in data[: end.start()].decode("ascii", "replace").splitlines():
        match line.split():
            case ["format", form, *_]:
                pass
            case ["element", name, count]:
                elements.append((name, int(count), []))
            case ["property", "list", *_, name] if elements:
                elements[-1][2].append((name, "list"))
            case ["property", kind, name] if elements and kind in TYPES:
                elements[-1][2].append((name, TYPES[kind]))
            case ["property", *_]:
                raise ValueError(f"unknown property in {path}: {line}")
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format in {path}: {form}")
    skipped = 0
    for name, count, fields in elements:
        listed = any(t == "list" for _, t in fields)
        if name == "vertex":
            if listed:
                raise ValueError(f"vertices with lists in {path}")
            return Header(form, count, tuple(fields), end.end(), skipped)
        if listed and form != "ascii":
            raise ValueError(f"lists before the vertices in {path}")
        skipped += count if form == "ascii" else count * sum(int(t[1]) for _, t in fields)
    return Header(form, 0, (), end.end(), 0)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path within it."""
    if "://" in path or path.startswith("file:"):
        uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]://", "s3://", path))
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    """Whole files, or one file's vertices from start to stop."""

    files: tuple[str, ...]
    start: int = 0
    stop: int | None = None


class MeshReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.most = int(options.get("vertices", 1_000_000))
        self.small = int(options.get("small", 1 << 24))
        self.columns = []
        for f in schema.fields:
            kind = f.dataType.simpleString()
            if kind not in ARROW or (kind == "string") != (f.name == "path"):
                raise ValueError(f"no type of a vertex's {f.name}: {kind}")
            self.columns.append((f.name, ARROW[kind]))

    def partitions(self) -> list[Range]:
        store, root = opened(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(".ply")]
        out, pack, held = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            if i.size > self.small:
                with store.open_input_file(i.path) as f:
                    head = read_header(i.path, f.read(HEADER))
                if head.form != "ascii":
                    out += [Range((i.path,), k, min(k + self.most, head.count)) for k in range(0, head.count, self.most)]
                else:
                    out.append(Range((i.path,)))
                continue
            if pack and held + i.size > self.small:
                out.append(Range(tuple(pack)))
                pack, held = [], 0
            pack.append(i.path)
            held += i.size
        # An empty list would be taken for one task without a range.
        return out + [Range(tuple(pack))] if pack or not out else out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for path in partition.files:
            with store.open_input_file(path) as f:
                head = read_header(path, f.read(HEADER))
                chunks = _text(path, f, head) if head.form == "ascii" else _binary(path, f, head, partition.start, partition.stop)
                for first, rows in chunks:
                    yield self._batch(path, first, rows)

    def _batch(self, path: str, first: int, rows: np.ndarray) -> pa.RecordBatch:
        arrays = []
        for name, kind in self.columns:
            if name == "path":
                column = pa.array([path]).take(pa.array(np.zeros(len(rows), np.int32)))
            elif name == "vertex_id":
                column = pa.array(np.arange(first, first + len(rows))).cast(kind)
            elif name in rows.dtype.names:
                own = np.ascontiguousarray(rows[name])
                column = pa.array(own.astype(own.dtype.newbyteorder("="))).cast(kind, safe=not pa.types.is_floating(kind))
            else:
                column = pa.nulls(len(rows), kind)
            arrays.append(column)
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in self.columns])


def _binary(path: str, f, head: Header, start: int, stop: int | None) -> Iterator[tuple[int, np.ndarray]]:
    kind = head.dtype
    stop = head.count if stop is None else stop
    f.seek(head.body + head.skipped + start * kind.itemsize)
    for at in range(start, stop, BATCH):
        n = min(BATCH, stop - at)
        data = f.read(n * kind.itemsize)
        if len(data) < n * kind.itemsize:
            raise ValueError(f"{path} ends before its vertex {at + n - 1}")
        yield at, np.frombuffer(data, kind, n)


def _text(path: str, f, head: Header) -> Iterator[tuple[int, np.ndarray]]:
    f.seek(head.body)
    lines = (line for line in _lines(f) if line.strip())
    for _ in range(head.skipped):
        next(lines, None)
    at = 0
    while at < head.count:
        n = min(BATCH, head.count - at)
        rows = [tuple(line.split()[: len(head.fields)]) for _, line in zip(range(n), lines)]
        if len(rows) < n or len(rows[-1]) < len(head.fields):
            raise ValueError(f"{path} ends before its vertex {at + n - 1}")
        # Text goes through a number of its own kind: whole numbers stay exact.
        yield at, np.array(rows, dtype=head.dtype)
        at += n


def _lines(f) -> Iterator[str]:
    rest = b""
    while data := f.read(1 << 20):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield line.decode()
    if rest:
        yield rest.decode()


class MeshSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> str:
        return "path string, vertex_id long, x float, y float, z float"

    def reader(self, schema: StructType) -> MeshReader:
        return MeshReader(schema, dict(self.options))
