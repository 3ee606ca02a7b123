"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash of their id and text within their source; a row's fractional rank is
its place there, from 0 to 1. Sorting all rows by fractional rank interleaves the
sources in proportion, so equal cuts hold the mixture of the whole. The law that
holds is `rows`: shards' counts differ by one at most.

Defined results: null sources are a stratum of their own; a null text has size 1; a text
of any length is one row; rows with a null id are told apart by their texts; repeated
rows each get a slot, and which of equal ones gets which makes no difference; of equal
fractional ranks the smaller source comes first; input columns named as the added ones
are replaced, others are returned as they are; an empty table gives no rows; a table
with fewer rows than shards fills as many shards as it has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenery.llm.common import nullable_key, running, seeded_hex, unit

SEED = "scenery-shards"
SHARDS = 16


def shard(docs: DataFrame, n_shards: int = SHARDS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source", rows_per_bucket: int = 4_000) -> DataFrame:
    """Adds size, text_crc32, shard and slot (gapless from 0 within a shard), in place of columns of these names.

    Ranks come from `running`, so neither a source nor the whole table passes through
    one task: only counts per source and bucket do. Columns that are not asked for
    later, the text above all, are pruned before the first shuffle.
    """
    n_rows = docs.select(F.lit(1)).count()
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            "size": (F.octet_length(body) + 1).cast("long"),
            "text_crc32": F.crc32(body.cast("binary")),
            "__stratum": nullable_key(F.col(source)),
        }
    )
    out = out.withColumn("__order", seeded_hex(seed, F.col(doc_id), F.col("text_crc32"), F.col("size")))
    sizes = out.groupBy("__stratum").agg(F.count(F.lit(1)).alias("__rows"))
    ties = [F.col("__order"), F.col(doc_id), F.col("text_crc32"), F.col("size")]
    out = running(out, "__stratum", unit(F.col("__order")), ties, n_rows, rows_per_bucket=rows_per_bucket)
    out = out.withColumnRenamed("__rank", "__place").join(sizes, "__stratum")
    # The seeded offset spreads sources of a few rows over all shards.
    offset = unit(seeded_hex(seed, F.col("__stratum")))
    out = out.withColumn("__fraction", (F.col("__place") - 1 + offset) / F.col("__rows"))
    out = running(out, None, F.col("__fraction"), [F.col("__fraction"), F.col("__stratum"), F.col("__place")], n_rows, rows_per_bucket=rows_per_bucket)
    out = out.withColumn("shard", F.expr(f"int(((__rank - 1) * {n_shards}L) div {max(n_rows, 1)}L)"))
    out = out.withColumn("slot", F.expr(f"__rank - 1 - (shard * {n_rows}L + {n_shards - 1}) div {n_shards}L"))
    return out.drop("__stratum", "__order", "__place", "__rows", "__fraction", "__rank")
