"""Which labels of a pool a text names, for many texts and pools, with one automaton a pool and task.

Texts and labels meet by pool in a cogrouped Arrow map. A pool that many texts share is dealt
into parts by a hash of the text, its labels being sent to each part, so that no task holds
more than some TEXTS_PER_TASK texts; a text's work is one pass whatever the number of labels.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenery.functions.fuzzy import Names, Pool

TEXTS_PER_TASK = 10_000


def named(texts: DataFrame, pools: DataFrame, alike: bool = False, names: Names | None = None, text: str = "text", pool: str = "pool_id", label: str = "label", order: str | None = None) -> DataFrame:
    """texts with `named`, the pool's labels that each holds, in order of where they begin; equal places in the pool's order.

    Texts are compared in lower case, labels as they are. alike: labels that do not stand in a
    text may be named by a run of words that is similar. Texts that are null, or without a pool,
    name nothing. Labels are sorted by `order`, or else by themselves. Only distinct texts are read.
    """
    known = names or Names()
    place = F.col(order or label)
    keys = [pool, "part"]
    distinct = texts.where(F.col(text).isNotNull() & F.col(pool).isNotNull()).select(F.col(pool), F.col(text).alias("text")).distinct()
    parts = distinct.groupBy(pool).agg(F.ceil(F.count(F.lit(1)) / TEXTS_PER_TASK).cast("int").alias("parts"))
    asked = distinct.join(parts, pool).withColumn("part", F.pmod(F.xxhash64("text"), "parts").cast("int")).drop("parts")
    labels = pools.select(pool, place.alias("place"), F.col(label).cast("string").alias("label")).join(parts, pool).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        own = [x for _, x in sorted(zip(right.column("place").to_pylist(), right.column("label").to_pylist(), strict=True)) if x is not None]
        index = Pool(own, known)

        def of(said: str) -> list[str]:
            if alike:
                return index.mentions(said)
            return [index.labels[k] for _, k in sorted((at, k) for k, at in index.found(said.lower()).items())]

        found = pa.array([of(x.as_py()) for x in left.column("text")], pa.list_(pa.string()))
        return pa.table({pool: left.column(pool), "text": left.column("text"), "named": found})

    kind = dict(texts.dtypes)[pool]
    found = asked.groupBy(*keys).cogroup(labels.groupBy(*keys)).applyInArrow(one, f"`{pool}` {kind}, text string, named array<string>")
    found = found.withColumnRenamed("text", "__text")
    out = texts.join(found, (texts[pool] == found[pool]) & (texts[text] == found["__text"]), "left").drop(found[pool], found["__text"])
    return out.withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
