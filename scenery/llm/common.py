"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: x20 and x09 to x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an
    error, since a machine's own folder is no place that executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scenery-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    This cuts the lineage, survives lost executors, and gives the planner the
    table's real size, so that it broadcasts only what is below its threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scenery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, to free the shared folder."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if f"{shared_dir(spark)}/scenery/" in path:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def nullable_key(column: Column) -> Column:
    """A string key that keeps null apart from every value and sorts null last."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def seeded_hex(seed: str, *columns: Column) -> Column:
    """32 hex digits that depend on the seed and the columns; SQL engines agree on md5."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def unit(hex_digits: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def running(
    df: DataFrame,
    group: str | None,
    position: Column,
    order: list[Column],
    n_rows: int,
    sums: dict[str, Column] | None = None,
    rows_per_bucket: int = 4_000,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds `__rank` (from 1) and running sums within a group, without one task per group.

    `position` must lie in [0, 1] and rise with `order`. Rows are dealt into as many
    buckets of positions as their number asks for, so a group that holds a third of
    all rows still spreads over many tasks; only the buckets' totals, one row per
    group and bucket, are summed in order. Where positions are uneven, `bucket` gives
    the bucket itself; it too must rise with `order`.
    """
    sums = sums or {}
    # Of very many rows neither the rows of a bucket nor the buckets' totals grow faster than the root.
    buckets = max(1, math.ceil(n_rows / max(rows_per_bucket, math.isqrt(n_rows))))
    keys = ([group] if group else []) + ["__bucket"]
    even = F.least(F.floor(position * buckets), F.lit(buckets - 1))
    dealt = df.withColumn("__bucket", (even if bucket is None else bucket).cast("long"))
    totals = dealt.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()]
    )
    before = Window.partitionBy(*([group] if group else [F.lit(1)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(
        *keys,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b_n"),
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
    )
    own = Window.partitionBy(*keys).orderBy(*order)
    rows = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(start, keys)
    out = out.withColumns(
        {"__rank": F.row_number().over(own) + F.col("__b_n")}
        | {k: F.sum(c).over(rows) + F.col(f"__b_{k}") for k, c in sums.items()}
    )
    return out.drop("__bucket", "__b_n", *[f"__b_{k}" for k in sums])


def packed(docs: DataFrame, *needed: str | Column) -> DataFrame:
    """The rows as one column, `__row`, beside the columns an operator needs.

    Whatever the operator adds, no column of the input is lost or mistaken for its own.
    """
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), *needed)


def unpacked(rows: DataFrame, *added: str) -> DataFrame:
    """The columns of the input, and those the operator adds; an added one replaces its namesake."""
    names = rows.schema["__row"].dataType.names
    return rows.select(*[F.col("__row")[n].alias(n) for n in names if n not in added], *added)


def chi_square(p: int, level: float) -> float:
    """Quantile of the chi-square distribution by Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(level)
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3
