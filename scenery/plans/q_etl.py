"""Time joins, rules over requests, and reshaping of scene files."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.operators import hulls, lookup, rules
from scenery.plans.catalogue import query
from scenery.plans.q_scene import objects
from scenery.sources.adapters import spark_view, with_views


# The sixteen tasks by input mode.
TASKS = [
    (mode, task)
    for mode, tasks in {
        "scene": "object_counting object_size absolute_distance relative_distance relative_direction_hard room_size",
        "single_image": "single_image_relative_direction distance_cam_obj depth_order_obj_obj",
        "image_pair": "position_cam_cam elevation_cam_cam visibility_compare position_cam_obj position_cam_reg motion_camera attribute_measurement",
    }.items()
    for task in tasks.split()
]


def _events(spark, sf, kind):
    e = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type") == kind)
    return e.select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("ts"))


_TS = "c AS (SELECT event_id, round(epoch_us(ts)/1e6, 3) AS ts FROM events WHERE event_type = 'click'), v AS (SELECT event_id, round(epoch_us(ts)/1e6, 3) AS ts FROM events WHERE event_type = 'view')"


@query("j06_asof_nearest", f"WITH {_TS}, p AS (SELECT c.event_id, c.ts, v.ts AS vts, v.event_id AS payload, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.ts-c.ts), v.ts DESC, v.event_id DESC) AS k FROM c JOIN v ON abs(v.ts-c.ts) <= 300) SELECT event_id, ts, payload, vts AS payload_ts FROM p WHERE k = 1")
def asof_nearest(spark, sf):
    """The nearest view within 300 s of each click, the later of two equally near."""
    right = _events(spark, sf, "view").withColumnRenamed("event_id", "payload")
    return lookup.nearest_in_time(_events(spark, sf, "click"), right, 300.0).select("event_id", "ts", "payload", "payload_ts")


@query("j07_equal_times", f"WITH {_TS} SELECT DISTINCT c.ts FROM c JOIN v ON c.ts = v.ts")
def equal_times(spark, sf):
    return _events(spark, sf, "click").select("ts").intersect(_events(spark, sf, "view").select("ts"))


@query("w15_export_index", f"WITH {_TS}, n AS (SELECT event_id, ts, row_number() OVER (PARTITION BY floor(ts/86400) ORDER BY ts, event_id)-1 AS i FROM c) SELECT event_id, CAST(i AS INT) AS export_index FROM n WHERE event_id % 3 <> 0")
def export_index(spark, sf):
    """Positions counted before rows are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.floor(F.col("ts") / 86400)).orderBy("ts", "event_id")
    return _events(spark, sf, "click").withColumn("export_index", F.row_number().over(w) - 1).where("event_id % 3 <> 0").select("event_id", "export_index")


_SAME = "elevation_cam_cam invalid: the camera height relation between the two images is `same_level`, so there is no meaningful elevation change; `same_level` questions are not used as valid training samples."


@query("p14_answer_rules", with_views("poses") + f"SELECT a.scene_id, a.frame_id AS frame_1, b.frame_id AS frame_2, CASE WHEN abs(b.tz-a.tz) <= 0.15 THEN '{_SAME}' END AS error, CASE WHEN abs(b.tz-a.tz) <= 0.15 THEN 'rule' ELSE 'ok' END AS stage FROM poses a JOIN poses b ON a.scene_id=b.scene_id AND a.frame_id<b.frame_id")
def answer_rules(spark, sf):
    """Cameras on one level make no question; the stage that says so."""
    from scenery.plans.q_scene import elevation_cam_cam

    p = elevation_cam_cam(spark, sf).withColumn("error", rules.answer_rule(F.lit("elevation_cam_cam"), F.col("answer")))
    return p.select("scene_id", "frame_1", "frame_2", "error", rules.failure_stage(F.lit("INVALID_QUESTION_RULE"), F.col("error").isNull()).alias("stage"))


@query("p14_counted_answers", with_views("objects") + """, n AS (SELECT scene_id, label, count(*) FILTER (visibility >= 0.9) AS n FROM objects GROUP BY 1, 2)
SELECT scene_id, label, n AS answer, CASE WHEN n = 0 THEN concat('object_counting invalid: the answer is 0, which means the question targets a category that does not exist in the scene（target_category=', label, '）; zero-count questions are not used as valid training samples.') END AS error FROM n""")
def counted_answers(spark, sf):
    """A count of nothing makes no question; the message names the category."""
    n = objects(spark, sf).groupBy("scene_id", "label").agg(F.count_if(F.col("visibility") >= 0.9).alias("answer"))
    return n.select("scene_id", "label", "answer", rules.answer_rule(F.lit("object_counting"), F.col("answer").cast("string"), F.col("label")).alias("error"))


@query("a18_room_hull")
def room_hull(spark, sf):
    """Hull area of each scene's floor points; tested against hand-made shapes."""
    return hulls.room_area(objects(spark, sf).select("scene_id", "object_id", "x", "y", "z"), alpha=None, order="object_id")


#: Triangles whose circles hold no other point are the Delaunay triangulation: by brute force, for the few points of these scenes.
ALPHA = """fq AS (SELECT scene_id, quantile_cont(z, 0.4) AS p FROM objects GROUP BY 1), fl AS (SELECT o.* FROM objects o JOIN fq ON fq.scene_id = o.scene_id WHERE z < p + 0.1), fb AS (SELECT scene_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM fl GROUP BY 1),
ft AS (SELECT fl.scene_id, arg_min({'x': x, 'y': y}, object_id) AS s FROM fl JOIN fb ON fb.scene_id = fl.scene_id GROUP BY fl.scene_id, floor(x - mx), floor(y - my), floor(z - mz)),
fp AS (SELECT scene_id, x, y, row_number() OVER (PARTITION BY scene_id ORDER BY x, y) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM (SELECT DISTINCT scene_id, s.x AS x, s.y AS y FROM ft)),
t3 AS (SELECT a.scene_id, a.n, a.x AS ax, a.y AS ay, b.x - a.x AS px, b.y - a.y AS py, c.x - a.x AS qx, c.y - a.y AS qy, a.k AS ka, b.k AS kb, c.k AS kc FROM fp a JOIN fp b ON a.scene_id = b.scene_id AND b.k > a.k JOIN fp c ON c.scene_id = a.scene_id AND c.k > b.k),
t4 AS (SELECT *, px*qy - py*qx AS d FROM t3), t5 AS (SELECT *, ax + (qy*(px*px+py*py) - py*(qx*qx+qy*qy)) / (2*d) AS ux, ay + (px*(qx*qx+qy*qy) - qx*(px*px+py*py)) / (2*d) AS uy FROM t4 WHERE d <> 0),
t6 AS (SELECT *, (ax-ux)*(ax-ux) + (ay-uy)*(ay-uy) AS r2 FROM t5),
t7 AS (SELECT scene_id, abs(d)/2 AS area FROM t6 WHERE n < 4 OR (r2 < 1 AND NOT EXISTS (SELECT 1 FROM fp WHERE fp.scene_id = t6.scene_id AND k NOT IN (ka, kb, kc) AND (x-ux)*(x-ux) + (y-uy)*(y-uy) < r2))),
room AS (SELECT f.scene_id, coalesce(sum(area), 0.0) AS area FROM (SELECT DISTINCT scene_id FROM fp) f LEFT JOIN t7 ON t7.scene_id = f.scene_id GROUP BY 1)"""


@query("a18_room_area", with_views("objects", rest=ALPHA) + "SELECT scene_id, round(area, 4) AS area FROM room")
def room_area(spark, sf):
    """Area of the alpha shape of each scene's floor points, here without the jitter, which SQL cannot repeat."""
    return hulls.room_area(objects(spark, sf).select("scene_id", "object_id", "x", "y", "z"), jitter=0.0, order="object_id")


@query("t06_room_size", with_views("objects", rest=ALPHA + ", h AS (SELECT scene_id, round(max(z1)-min(z0), 4) AS height FROM objects GROUP BY 1)") + "SELECT room.scene_id, concat(CAST(round(area, 2) AS VARCHAR), ' square meters') AS answer, height FROM room JOIN h ON h.scene_id = room.scene_id")
def room_size(spark, sf):
    """The floor's area, and the height of the box around a scene's objects."""
    o = objects(spark, sf)
    height = o.groupBy("scene_id").agg(F.round(F.max("z1") - F.min("z0"), 4).alias("height"))
    area = hulls.room_area(o.select("scene_id", "object_id", "x", "y", "z"), jitter=0.0, order="object_id")
    return area.join(height, "scene_id").select("scene_id", F.concat(F.round("area", 2).cast("string"), F.lit(" square meters")).alias("answer"), "height")


@query("j09_vertex_labels", "WITH v AS (SELECT l_orderkey AS vertex_id, l_partkey % 50 AS seg_id FROM lineitem), g AS (SELECT p_partkey % 50 AS seg_id, p_partkey AS group_pos, p_brand AS label FROM part), w AS (SELECT seg_id, arg_max(label, group_pos) AS label FROM g GROUP BY seg_id) SELECT v.vertex_id, max(w.label) AS label FROM v JOIN w ON v.seg_id = w.seg_id GROUP BY v.vertex_id")
def vertex_labels(spark, sf):
    """Vertices through segments to groups; the later group overwrites."""
    v = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("vertex_id"), (F.col("l_partkey") % 50).alias("seg_id"))
    g = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 50).alias("seg_id"), F.col("p_partkey").alias("group_pos"), F.col("p_brand").alias("label"))
    last = g.groupBy("seg_id").agg(F.max_by("label", "group_pos").alias("label"))
    return v.join(last, "seg_id").groupBy("vertex_id").agg(F.max("label").alias("label"))


@query("j15_zip_columns", with_views("rollouts") + "SELECT uid, pos, score, length FROM rollouts")
def zip_rows(spark, sf):
    """Two tables row by row; a column both have must agree."""
    r = spark_view(spark, sf, "rollouts").withColumn("row_id", F.concat_ws(":", "uid", "pos"))
    return lookup.zip_columns(r.select("row_id", "uid", "pos", "score"), r.select("row_id", "score", "length"), "row_id").select("uid", "pos", "score", "length")


@query("j21_skipped_labels", "SELECT DISTINCT p_brand AS label FROM part WHERE p_size IN (0, 1, 2, 3, 11, 13, 15, 16, 17, 20, 21, 22, 23, 26, 28, 29, 31, 34, 37, 38, 39, 40, 81)")
def skipped_labels(spark, sf):
    """Labels whose class is no object."""
    from scenery.sources.readers import INVALID_CLASSES

    return spark.read.parquet(f"{sf}/part.parquet").where(F.col("p_size").isin(*INVALID_CLASSES)).select(F.col("p_brand").alias("label")).distinct()


@query("s23_option_letters", "SELECT n_regionkey, string_agg(concat(chr(CAST(64 + k AS INT)), '. ', n_name), chr(10) ORDER BY k) AS options FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) GROUP BY n_regionkey")
def letters(spark, sf):
    """Lettered options."""
    from scenery.sources.readers import option_letters

    n = spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("o"))
    return n.select("n_regionkey", option_letters(F.col("o")).alias("options"))


@query("t19_catalogue", "SELECT * FROM (VALUES ('object_counting','scene'),('object_size','scene'),('absolute_distance','scene'),('relative_distance','scene'),('relative_direction_hard','scene'),('room_size','scene'),('single_image_relative_direction','single_image'),('distance_cam_obj','single_image'),('depth_order_obj_obj','single_image'),('position_cam_cam','image_pair'),('elevation_cam_cam','image_pair'),('visibility_compare','image_pair'),('position_cam_obj','image_pair'),('position_cam_reg','image_pair'),('motion_camera','image_pair'),('attribute_measurement','image_pair')) t(task, mode)")
def task_catalogue(spark, sf):
    """The tasks and their input modes."""
    return spark.createDataFrame([(t, m) for m, t in TASKS], "task string, mode string")
