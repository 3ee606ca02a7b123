"""Writers that can run again: rows whose keys are there already are left out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenery.sources.mesh import opened


def append_new(rows: DataFrame, path: str, *keys: str, form: str = "parquet", partition: str | None = None) -> int:
    """Appends the rows whose keys the target lacks; returns how many."""
    spark = rows.sparkSession
    try:
        there = spark.read.format(form).load(path).select(*keys)
        rows = rows.join(there.distinct(), list(keys), "left_anti").select(*rows.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        w = rows.write.mode("append").format(form)
        (w.partitionBy(partition) if partition else w).save(path)
    rows.unpersist()
    return n


def valid_questions(rows: DataFrame, path: str) -> None:
    """One JSON line per valid question with its responses and scores in order."""
    r = rows.where("is_valid").groupBy("uid").agg(F.min_by("question", "pos").alias("question"), F.array_sort(F.collect_list(F.struct("pos", "response", "accuracy"))).alias("r"))
    r.select("uid", "question", F.col("r.response").alias("responses"), F.col("r.accuracy").alias("accuracies")).write.mode("append").json(path)


def matrix_text(rows: DataFrame, path: str, m: str = "m") -> None:
    """Rows of 16 numbers as text, four to a line."""
    line = lambda i: F.array_join(F.transform(F.slice(m, 4 * i + 1, 4), lambda x: F.format_number(x, 6)), " ")
    rows.select(F.concat_ws("\n", *[line(i) for i in range(4)]).alias("value")).write.mode("overwrite").text(path)


def write_file(spark: SparkSession, path: str, body: str | bytes) -> None:
    """One file in any store Spark writes to; for manifests, reports and other files with a name of their own."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(body.encode() if isinstance(body, str) else body))
    finally:
        out.close()


def write_files(rows: DataFrame, folder: str, path: str, body: str) -> int:
    """A file for every row, by its columns of path, below the folder, and body; returns how many.

    Tasks write them, each under a hidden name first, so an attempt that ran twice leaves whole files.
    Stores that pyarrow doesn't open are written by the driver, a file at a time.
    """
    spark = rows.sparkSession
    try:
        opened(folder)
    except (ValueError, OSError, NotImplementedError):
        n = 0
        for n, r in enumerate(rows.select(path, body).toLocalIterator(), 1):
            write_file(spark, f"{folder}/{r[0]}", r[1])
        return n

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        made = set()
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place, _, last = f"{base.rstrip('/')}/{name}".rpartition("/")
                if place not in made:
                    store.create_dir(place, recursive=True)
                    made.add(place)
                hidden = f"{place}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(data.encode() if isinstance(data, str) else data)
                store.move(hidden, f"{place}/{last}")
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(path, body).repartition(tasks, path).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def scenes(rows: DataFrame, path: str, overwrite: bool = False) -> int:
    """One JSON file for each scene (or frame) row; those that are there stay unless overwritten. Returns how many were written."""
    if overwrite:
        rows.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
        return rows.count()
    keys = [k for k in ("scene_id", "frame_id") if k in rows.columns]
    try:
        there = rows.sparkSession.read.schema(", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)).option("multiLine", True).json(path)
        rows = rows.join(there.distinct(), keys, "left_anti").select(*rows.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").option("maxRecordsPerFile", 1).json(path)
    rows.unpersist()
    return n


def scene_text(spark: SparkSession, path: str, values: dict[str, object]) -> None:
    """A scene's `key = value` lines; lists become numbers between blanks."""
    line = lambda v: " ".join(f"{x:.6f}" for x in v) if isinstance(v, (list, tuple)) else str(v)
    write_file(spark, path, "".join(f"{k} = {line(v)}\n" for k, v in values.items()))


def frame_map(rows: DataFrame, path: str) -> None:
    """Exported frames and the files they came from, as one CSV in order."""
    rows.select("export_index", "frame_id", "source").coalesce(1).sortWithinPartitions("export_index").write.mode("overwrite").option("header", True).csv(path)


def manifest(rows: DataFrame, path: str) -> None:
    """Selected frames by scene, as one JSON list of records."""
    import json

    by_scene = rows.groupBy("scene_id").agg(F.array_sort(F.collect_list("frame_id")).alias("frame_ids")).orderBy("scene_id")
    records = [{"scene_id": str(r["scene_id"]), "frame_ids": [str(f) for f in r["frame_ids"]]} for r in by_scene.toLocalIterator()]
    write_file(rows.sparkSession, path, json.dumps(records, indent=2))


def scene_index(rows: DataFrame, path: str) -> None:
    """The exported scenes' ids, sorted, one a line."""
    rows.select(F.col("scene_id").cast("string").alias("value")).distinct().coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def io_log(rows: DataFrame, path: str, step: int) -> None:
    """Prompts and responses of a step, appended as JSON lines."""
    rows.withColumn("step", F.lit(step)).write.mode("append").json(path)


def metrics_log(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    """A step's metrics, appended as one JSON line."""
    spark.createDataFrame([(step, {k: float(v) for k, v in metrics.items()})], "step int, metrics map<string,double>").coalesce(1).write.mode("append").json(path)


def results(rows: DataFrame, path: str, form: str = "json") -> None:
    """Results as JSON lines, or as one YAML document of a list."""
    if form == "json":
        rows.write.mode("overwrite").json(path)
        return
    import yaml

    write_file(rows.sparkSession, path, yaml.safe_dump([r.asDict(recursive=True) for r in rows.toLocalIterator()], sort_keys=False, allow_unicode=True))


def save_batch(rows: DataFrame, path: str) -> None:
    """A batch with its types, for `load_batch`."""
    rows.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verify_report(spark: SparkSession, folder: str, required: tuple[str, ...], optional: tuple[str, ...], path: str) -> dict:
    """Counts the files of a scene's folders and says which optional files are there; a folder without files is an error.

    Writes the report as JSON and returns it. Contents are not read.
    """
    import json

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    inside = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    counts = {r["parent"]: r["n"] for r in inside.where(F.col("parent").isin(*required)).groupBy("parent").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing = [r for r in required if not counts.get(r)]
    if missing:
        raise ValueError(f"no files in {', '.join(missing)}")
    there = {r["name"] for r in inside.where(F.col("name").isin(*optional)).select("name").distinct().collect()}
    report = {f"{r}_count": counts[r] for r in required} | {"required_ok": True, "optional_present": sorted(there), "optional_missing": sorted(set(optional) - there)}
    write_file(spark, path, json.dumps(report, indent=2))
    return report
