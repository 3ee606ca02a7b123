"""Running counters over a stream of responses: totals by type, without an end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def type_counters(rows: DataFrame, kind: str = "task", valid: str = "is_valid") -> DataFrame:
    """Total, valid and invalid rows of each type; the same plan for a table and for a stream.

    The state is one row per type and is never evicted, so it needs no watermark; write a
    stream of it in update or complete mode.
    """
    n, v = F.count(F.lit(1)), F.count_if(F.col(valid))
    return rows.groupBy(kind).agg(n.alias("total"), v.alias("valid"), (n - v).alias("invalid"))


def scheduler_totals(rows: DataFrame, kind: str = "task", accuracy: str = "accuracy", weight: str = "weight") -> DataFrame:
    """Weighted count and weighted sum of accuracies of each type."""
    return rows.groupBy(kind).agg(F.sum(weight).alias("count"), F.sum(F.col(accuracy) * F.col(weight)).alias("acc_sum"))


def follow(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, kind: str = "task"):
    """Keeps counters up to date from Parquet files that arrive in a folder; every batch replaces the table at `out`."""
    rows = spark.readStream.schema(schema).parquet(path)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    return type_counters(rows, kind).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
