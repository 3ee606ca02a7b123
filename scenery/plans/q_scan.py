"""Recurrences over a few long sequences: the whole table as three of them, one a return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.functions.geometry import tidy
from scenery.operators import scan
from scenery.plans.catalogue import query

_LONG = """WITH s AS (SELECT l_returnflag AS flag, l_orderkey * 8 + l_linenumber AS pos, l_discount AS reward, l_tax AS value, CASE WHEN l_partkey % 7 <> 0 THEN 1 ELSE 0 END AS mask FROM lineitem)"""


def _long(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    mask = F.when(F.col("l_partkey") % 7 != 0, 1).otherwise(0)
    return l.groupBy(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")).agg(F.min("l_discount").alias("reward"), F.min("l_tax").alias("value"), F.min(mask).alias("mask"))


_ONE = _LONG + ", o AS (SELECT flag, pos, min(reward) AS reward, min(value) AS value, min(mask) AS mask FROM s GROUP BY 1, 2)"


@query("w04_long_returns", _ONE + "SELECT flag, pos, round(sum(reward) OVER (PARTITION BY flag ORDER BY pos DESC ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS returns FROM o")
def long_returns(spark, sf):
    """What is still to come, over sequences of a third of the table."""
    out = scan.discounted(_long(spark, sf).withColumn("every", F.lit(1)), ["flag"], "pos", "reward", "every", 1.0)
    return out.select("flag", "pos", tidy(F.col("returns"), 4).alias("returns"))


@query("w05_long_resets", _ONE + """, g AS (SELECT *, sum(1 - mask) OVER (PARTITION BY flag ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM o)
SELECT flag, pos, round(sum(reward) OVER (PARTITION BY flag, coalesce(seg, 0) ORDER BY pos DESC ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS returns FROM g""")
def long_resets(spark, sf):
    """Undiscounted returns from the end, set to nought after each masked token, over long sequences."""
    out = scan.discounted(_long(spark, sf), ["flag"], "pos", "reward", "mask", 1.0)
    return out.select("flag", "pos", tidy(F.col("returns"), 4).alias("returns"))


@query("w06_long_gae", _ONE + """, k AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY pos) AS i FROM o WHERE mask = 1), n AS (SELECT *, lead(value) OVER (PARTITION BY flag ORDER BY i) AS nx FROM k), d AS (SELECT *, reward + 0.5 * coalesce(nx, 0) - value AS delta FROM n),
e AS (SELECT flag, i, list_sum(list_transform(list(delta) OVER (PARTITION BY flag ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING), lambda x, j: x * power(0.25, j - 1))) AS adv FROM d),
w AS (SELECT o.*, sum(mask) OVER (PARTITION BY flag ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM o)
SELECT w.flag, w.pos, round(coalesce(e.adv, 0.0), 6) + 0.0 AS advantage FROM w LEFT JOIN e ON e.flag = w.flag AND e.i = CASE WHEN mask = 1 THEN upto ELSE upto + 1 END""")
def long_gae(spark, sf):
    """Generalised advantages over long sequences; with a discount of 0.5 times 0.5 forty tokens hold every digit, which SQL sums."""
    out = scan.gae(_long(spark, sf), ["flag"], "pos", "reward", "value", "mask", 0.5, 0.5)
    return out.select("flag", "pos", tidy(F.col("advantage")).alias("advantage"))
