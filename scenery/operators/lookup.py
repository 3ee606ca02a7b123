"""Lookups, filters and joins over scene tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that never anchor a question.
ANCHORLESS = ("wall", "otherprop", "ceiling", "otherfurniture")
VISIBILITY_FLOOR = 0.1


def is_null_like(c: Column) -> Column:
    """Null, blank, one of the words that mean nothing, or an error text."""
    t = F.lower(F.trim(c))
    return c.isNull() | t.isin("", "null", "none", "unknown", "n/a") | t.startswith("error:")


def same_label(a: Column, b: Column) -> Column:
    return ~is_null_like(a) & ~is_null_like(b) & (F.lower(F.trim(a)) == F.lower(F.trim(b)))


def visible(objects: DataFrame, least: float = 0.5) -> DataFrame:
    return objects.where(F.col("visibility") >= max(VISIBILITY_FLOOR, least))


def anchors(objects: DataFrame) -> DataFrame:
    return objects.where(~F.lower(F.trim("label")).isin("", *ANCHORLESS))


def unique_objects(objects: DataFrame, *keys: str) -> DataFrame:
    """The objects whose label occurs once within the keys: one grouped pass, no window over a hot label.

    A label that occurs often only adds to a count, so it never moves its rows.
    """
    rest = [c for c in objects.columns if c not in (*keys, "label")]
    one = objects.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
    return one.where("__n = 1").drop("__n").select(*objects.columns)


def pairs(objects: DataFrame, *keys: str) -> DataFrame:
    """Unordered pairs of objects of different labels within the keys, as columns ending in 1 and 2."""
    side = lambda k: objects.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in objects.columns if c not in keys])
    return side(1).join(side(2), list(keys)).where("label_1 < label_2")


def ordered_pairs(rows: DataFrame, key: str, order: str, block: int = 1024, most: int = 1 << 22) -> DataFrame:
    """Pairs of a key's rows, the first of smaller order, as columns ending in 1 and 2.

    A key's rows are cut into blocks by their order, and every two blocks meet in a cell of their own:
    a task holds one block at a time and has about `most` pairs, however many rows a key has. Each row
    goes into as many cells as its key has blocks.
    """
    spark = rows.sparkSession
    n = F.col("count").cast("double")
    total = rows.groupBy(key).count().agg(F.sum(n * n)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 2 / most))
    w = Window.partitionBy(key)
    dealt = rows.withColumn("__b", F.floor((F.row_number().over(w.orderBy(order)) - 1) / block).cast("int")).withColumn("__last", F.max("__b").over(w))
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != key]
    a = dealt.select(key, *side(1), F.col("__b").alias("__one"), F.explode(F.sequence("__b", "__last")).alias("__two"))
    b = dealt.select(key, *side(2), F.col("__b").alias("__two"), F.explode(F.sequence(F.lit(0), "__b")).alias("__one"))
    cell = [key, "__one", "__two"]
    return a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell).where(F.col(f"{order}_1") < F.col(f"{order}_2")).drop("__one", "__two")


def matches(left: DataFrame, right: DataFrame, key: str, *more: str) -> DataFrame:
    """How many pairs of rows a join by the key has for each of the left side's groups: a product of both sides' counts, not a join of rows."""
    one = left.groupBy(key, *more).agg(F.count(F.lit(1)).alias("__n"))
    two = right.groupBy(key).agg(F.count(F.lit(1)).alias("__m"))
    return one.join(two, key).select(key, *more, (F.col("__n") * F.col("__m")).alias("n"))


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: float, ts: str = "ts", keys: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """The nearest right row within a tolerance, the later one of two equally near.

    Both sides are dealt by key and by a bucket of time, as wide as the tolerance, each
    right row into its own and both neighbouring buckets; so one hot key spreads over as
    many tasks as it has buckets, and the rest is a running maximum within a bucket.
    """
    bucket = F.floor(F.col(ts) / tolerance)
    l = left.withColumns({"__b": bucket, "__side": F.lit(1), "__p": F.lit(None).cast(right.schema[payload].dataType)})
    r = right.select(*keys, ts, F.col(payload).alias("__p")).withColumn("__side", F.lit(0)).withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    rows = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__b")
    own = F.when(F.col("__side") == 0, F.struct(F.col(ts).alias("t"), F.col("__p").alias("p")))
    before = F.last(own, ignorenulls=True).over(w.orderBy(ts, "__side", "__p").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(own, ignorenulls=True).over(w.orderBy(F.desc(ts), "__side", F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"__before": before, "__after": after}).where("__side = 1")
    db, da = F.col(ts) - F.col("__before.t"), F.col("__after.t") - F.col(ts)
    later = F.col("__before").isNull() | (da <= db)
    pick = F.when(F.col("__after").isNotNull() & later, F.col("__after")).otherwise(F.col("__before"))
    out = rows.withColumn("__pick", pick).where(F.abs(F.col("__pick.t") - F.col(ts)) <= tolerance)
    return out.select(*left.columns, F.col("__pick.t").alias(f"{payload}_{ts}"), F.col("__pick.p").alias(payload))


def canonical_labels(rows: DataFrame, dimension: DataFrame, label: str = "label", default: str = "unknown") -> DataFrame:
    """Joins the canonical label of a small dimension (raw, canonical), with a default on a miss."""
    d = dimension.select(F.col("raw").alias("__raw"), "canonical")
    return rows.join(d, F.lower(F.trim(F.col(label))) == F.col("__raw"), "left").drop("__raw").withColumn("canonical", F.coalesce("canonical", F.lit(default)))


def zip_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both sides row by row; a column both have must hold equal values."""
    both = [c for c in a.columns if c in b.columns and c != key]
    r = b.select(key, *[F.col(c).alias(f"__{c}" if c in both else c) for c in b.columns if c != key])
    out = a.join(r, key)
    for c in both:
        same = F.assert_true(F.col(c).eqNullSafe(F.col(f"__{c}")), f"the two sides differ in {c}")
        out = out.withColumn(c, F.when(same.isNull(), F.col(c))).drop(f"__{c}")
    return out


def key_mismatches(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two tables has, and which."""
    l = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    r = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    return l.join(r, list(keys), "full").where("__a IS NULL OR __b IS NULL").select(*keys, F.when(F.col("__a").isNull(), "second").otherwise("first").alias("only_in"))


def instance_key(object_id: Column, place: Column, frame: Column, pos: Column) -> Column:
    """What tells instances apart over frames: the id, else the place to four digits, else frame and position."""
    known = object_id.isNotNull() & (object_id.cast("string") != "")
    at = [F.when(~known & place.isNotNull(), F.round(F.get(place, F.lit(i)), 4) + 0.0) for i in range(3)]
    left = ~known & place.isNull()
    return F.struct(F.when(known, object_id.cast("string")).alias("id"), *[c.alias("xyz"[i]) for i, c in enumerate(at)], F.when(left, frame).alias("frame"), F.when(left, pos).alias("pos"))


def evidence(objects: DataFrame, keys: list[str], relevant: list[str], most: int, *order: Column) -> DataFrame:
    """The first objects of each group, those of relevant labels before all others; k is their place."""
    first = ~F.lower(F.trim("label")).isin([x.strip().lower() for x in relevant])
    return objects.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(first, *order))).where(F.col("k") <= most)
