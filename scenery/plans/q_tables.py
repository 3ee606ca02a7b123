"""Smaller table operators: keys, orders, selections and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenery.functions import text
from scenery.functions.geometry import tidy
from scenery.operators.selection import percentile
from scenery.plans.catalogue import query
from scenery.plans.q_scene import objects
from scenery.sources.adapters import spark_view, with_views


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("j10_attribute_lookup", with_views("objects") + "SELECT o.frame_id, o.object_id, p.p_name, p.p_size FROM objects o LEFT JOIN part p ON p.p_partkey = o.object_id")
def attribute_lookup(spark, sf):
    """Attributes of an id in frame rows."""
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("object_id"), "p_name", "p_size")
    return objects(spark, sf).select("frame_id", "object_id").join(p, "object_id", "left")


@query("j02_frame_of_path", "WITH p AS (SELECT page_id, try_cast(nullif(regexp_extract(url, '(\\d+)(?:\\.[A-Za-z0-9]+)?$', 1), '') AS INT) AS f FROM pages) SELECT page_id, o_orderkey FROM p JOIN orders ON o_orderkey = f")
def frame_of_path(spark, sf):
    """Rows matched by the digits that end a path."""
    p = _table(spark, sf, "pages").select("page_id", text.frame_id(F.col("url")).cast("long").alias("o_orderkey"))
    return p.join(_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("page_id", "o_orderkey")


@query("s15_one_to_many", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def one_to_many(spark, sf):
    o = _table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    return o.select("o_custkey", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("orders"))


@query("s16_first_existing", "SELECT user_id, arg_min(event_id, (CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) * 1000000000 + event_id) AS event_id FROM events GROUP BY 1")
def first_existing(spark, sf):
    """The first of alternatives that exists, by preference."""
    e = _table(spark, sf, "events")
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct(rank, F.col("event_id"))).alias("event_id"))


@query("s10_alias_lookup", "WITH a AS (SELECT n_nationkey, unnest([lower(n_name), lower(substr(n_name, 1, 3))]) AS alias, unnest([0, 1]) AS k FROM nation), r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY k, n_nationkey) AS i FROM a) SELECT alias, n_nationkey FROM r WHERE i = 1")
def alias_lookup(spark, sf):
    """Several names a row, lower case; the first row that claims a name keeps it."""
    n = _table(spark, sf, "nation")
    a = n.select("n_nationkey", F.posexplode(F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3)))).alias("k", "alias"))
    return a.groupBy("alias").agg(F.min_by("n_nationkey", F.struct("k", "n_nationkey")).alias("n_nationkey"))


@query("s18_unit_scale", with_views("objects") + "SELECT object_id, round(CASE WHEN object_id % 2 = 0 THEN x ELSE coalesce(y, x) / 100 END, 6) + 0.0 AS x FROM objects")
def unit_scale(spark, sf):
    """One form in metres, else another in centimetres."""
    v = F.when(F.col("object_id") % 2 == 0, F.col("x")).otherwise(F.coalesce("y", "x") / 100)
    return objects(spark, sf).select("object_id", tidy(v).alias("x"))


@query("o04_numeric_then_name", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY try_cast(regexp_extract(p_name, '(\\d+)', 1) AS INT) NULLS FIRST, p_name, p_partkey) AS INT) AS place FROM part")
def numeric_then_name(spark, sf):
    """By number where a name has one, then by name."""
    w = Window.partitionBy("p_brand").orderBy(F.asc_nulls_first(F.regexp_extract("p_name", r"(\d+)", 1).try_cast("int")), "p_name", "p_partkey")
    return _table(spark, sf, "part").select("p_partkey", F.row_number().over(w).alias("place"))


@query("o10_seeded_order", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(concat('7|', l_linenumber, '|', l_partkey, '|', l_suppkey))) AS INT) AS place FROM lineitem")
def seeded_order(spark, sf):
    """A shuffle that depends on a seed and the row alone."""
    key = F.md5(F.concat_ws("|", F.lit("7"), "l_linenumber", "l_partkey", "l_suppkey"))
    w = Window.partitionBy("l_orderkey").orderBy(key)
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.row_number().over(w).alias("place"))


@query("u13_distinct_in_order", with_views("rollouts", rest="f AS (SELECT uid, response, min(pos) AS p FROM rollouts GROUP BY 1, 2)") + "SELECT uid, string_agg(response, ',' ORDER BY p) AS responses FROM f GROUP BY uid")
def distinct_in_order(spark, sf):
    r = spark_view(spark, sf, "rollouts").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "response"))).alias("s"))
    return r.select("uid", F.array_join(F.array_distinct("s.response"), ",").alias("responses"))


@query("u14_reindex", "SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS object_id, lower(replace(p_type, '-', ' ')) AS label, try_cast(p_size AS INT) AS segment FROM part WHERE p_size IS NOT NULL")
def reindex(spark, sf):
    """Groups numbered anew, labels normalised, whole-number segments kept."""
    p = _table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type", "p_size"))).alias("g"))
    p = p.select("p_brand", F.posexplode("g").alias("object_id", "v"))
    return p.select("p_brand", "object_id", text.normalise_label(F.col("v.p_type")).alias("label"), F.col("v.p_size").cast("int").alias("segment")).where("segment IS NOT NULL")


@query("a34_mask_points", with_views("objects") + "SELECT scene_id, count(*) AS n, round(avg(cx), 6) + 0.0 AS mx, round(quantile_cont(abs(cz), 0.95), 6) AS p95, CASE WHEN quantile_cont(abs(cz), 0.95) > 100 THEN 'millimetres' ELSE 'metres' END AS unit FROM objects WHERE visibility >= 0.5 GROUP BY 1")
def mask_points(spark, sf):
    """Number and centre of a mask's points, and the unit their depth suggests."""
    o = objects(spark, sf).where("visibility >= 0.5")
    p95 = percentile(o, ["scene_id"], F.abs("cz"), 0.95, "p95").select("scene_id", "p95")
    centres = o.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), tidy(F.avg("cx")).alias("mx"))
    return centres.join(p95, "scene_id").select("scene_id", "n", "mx", F.round("p95", 6).alias("p95"), F.when(F.col("p95") > 100, "millimetres").otherwise("metres").alias("unit"))


@query("p18_scene_selection", "WITH v AS (SELECT DISTINCT concat('scene', lpad(CAST(user_id % 40 AS VARCHAR), 4, '0'), '_00') AS scene_id FROM events) SELECT scene_id, ltrim(regexp_extract(scene_id, 'scene(\\d+)_', 1), '0') AS video FROM v WHERE CAST(regexp_extract(scene_id, 'scene(\\d+)_', 1) AS INT) % 2 = 1")
def scene_selection(spark, sf):
    """Scene ids and video ids, without leading zeros, and a selection by them."""
    e = _table(spark, sf, "events").select(F.concat(F.lit("scene"), F.lpad((F.col("user_id") % 40).cast("string"), 4, "0"), F.lit("_00")).alias("scene_id")).distinct()
    number = F.regexp_extract("scene_id", r"scene(\d+)_", 1)
    return e.where(number.cast("int") % 2 == 1).select("scene_id", F.ltrim(number, F.lit("0")).alias("video"))


@query("p20_positions", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 9 OR n_nationkey IN (1, 20)")
def positions(spark, sf):
    """Chosen columns and rows, by range and by list."""
    n = _table(spark, sf, "nation").select("n_nationkey", "n_name")
    listed = spark.createDataFrame([(1,), (20,)], "n_nationkey int")
    return n.where("n_nationkey BETWEEN 5 AND 9").unionByName(n.join(listed, "n_nationkey", "left_semi"))
