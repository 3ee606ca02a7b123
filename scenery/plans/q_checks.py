"""Why requests are refused, and the remaining forms of geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.functions import geometry as g
from scenery.functions.geometry import tidy
from scenery.operators import checks, registries
from scenery.plans.catalogue import query
from scenery.plans.q_answers import _table
from scenery.plans.q_questions import OBJECT_NAMES, _picked, values
from scenery.plans.q_scene import _ROT, cameras, objects, unique
from scenery.sources.adapters import with_views


@query("p08_contract", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Missing `task_type`' WHEN o_orderkey % 11 = 0 THEN '`question` must be a string' WHEN o_orderkey % 7 = 0 THEN 'Missing `scene_id`' WHEN o_orderkey % 13 = 0 THEN '`image_path` must be a non-empty string when provided'
  WHEN o_orderkey % 3 = 1 AND o_custkey % 3 < 1 THEN 'depth requires `image_path`' WHEN o_orderkey % 3 = 2 AND o_custkey % 3 < 2 THEN 'depth requires two image inputs (`image_paths` or `image_path_1`/`image_path_2`)' END AS error FROM orders""")
def contract(spark, sf):
    """What a request must hold, then what its mode needs."""
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 3
    none = F.lit(None).cast("string")
    task = F.when(k % 5 == 0, " ").otherwise("depth")
    image = F.when(k % 13 == 0, " ").when(n >= 1, "a.jpg")
    mode = F.when(k % 3 == 2, "image_pair").when(k % 3 == 1, "single_image").otherwise("basic")
    first = checks.input_contract(task, F.when(k % 11 == 0, none).otherwise("q?"), F.when(k % 7 == 0, "").otherwise("s"), image)
    images = F.when(n == 2, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    return _table(spark, sf, "orders").select("o_orderkey", F.coalesce(first, checks.mode_contract(task, mode, image, images, none, none)).alias("error"))


#: Questions with their labels, candidates and the reason why they have no answer, worked out by hand from the rules.
QUESTIONS = [
    ("absolute_distance", "q?", "object1_label=lamp,object2_label=sofa", None, None),
    ("absolute_distance", "q?", "object1_label=lamp,object2_label= Lamp", None, "absolute_distance invalid: `object1_label` and `object2_label` must refer to different objects"),
    ("single_image_relative_direction", "q?", "reference_label=bed,target_label=bed", None, "single_image_relative_direction invalid: `reference_label` and `target_label` must refer to different objects"),
    ("relative_direction_hard", "q?", "positioning_label=bed,orienting_label=sofa,querying_label=bed", None, checks.SAME_THREE),
    ("relative_direction_hard", "q?", "positioning_label=bed,orienting_label=null,querying_label=sofa", None, "relative_direction_hard invalid: failed to extract `orienting_label`"),
    ("relative_distance", "q?", "target_label=lamp", "sofa,lamp", checks.LISTED_TARGET),
    ("relative_distance", "Which among sofa, bed and lamp is closest to the lamp?", "target_label=bed", "sofa", checks.ASKED_TARGET),
    ("relative_distance", "Which of these (sofa; lamp) is closest?", "target_label=lamp", "sofa", checks.ASKED_TARGET),
    ("relative_distance", "q?", "target_label=lamp", "sofa,Sofa", checks.TWICE_LISTED),
    ("relative_distance", "q?", "target_label=lamp", "none", checks.EMPTY_LIST),
    ("relative_distance", "q?", "target_label=lamp", "sofa,bed", None),
    ("object_size", "q?", "object_label=unknown", None, "object_size invalid: failed to extract `object_label`"),
    ("room_size", "q?", "", None, None),
]


@query("p10_question_rules", "WITH " + values("q", "i, task, error", [(i, r[0], r[4]) for i, r in enumerate(QUESTIONS)]) + f" SELECT o_orderkey, task, error, error IS NULL AS is_valid FROM orders JOIN q ON i = o_orderkey % {len(QUESTIONS)}")
def question_rules(spark, sf):
    """The first rule a question's labels break."""
    pick = lambda k: F.get(F.array(*[F.lit(r[k]).cast("string") for r in QUESTIONS]), (F.col("o_orderkey") % len(QUESTIONS)).cast("int"))
    o = _table(spark, sf, "orders").select("o_orderkey", pick(0).alias("task"), pick(1).alias("question"), F.str_to_map(pick(2), F.lit(","), F.lit("=")).alias("labels"), F.split(pick(3), ",").alias("candidate_labels"))
    return checks.question_reason(o).select("o_orderkey", "task", "error", "is_valid")


_POOL_REQ = "c AS (SELECT scene_id, label, count(*) AS n FROM objects GROUP BY 1,2), m AS (SELECT scene_id, max(n) AS most FROM c GROUP BY 1), k AS (SELECT range AS k FROM range(12)), q AS (SELECT m.scene_id, most, concat('l', CAST(k AS VARCHAR)) AS label, concat('l', CAST((k * 5 + 1) % 12 AS VARCHAR)) AS other, CASE k % 3 WHEN 0 THEN 'object_counting' WHEN 1 THEN 'object_size' ELSE 'absolute_distance' END AS task FROM m, k)"


@query("p12_pool_rules", with_views("objects", rest=_POOL_REQ) + """SELECT q.scene_id, q.label, task, CASE task
  WHEN 'object_counting' THEN CASE WHEN most < 2 THEN 'object_counting invalid: no countable category has observed count >= 2 in the current input' WHEN a.n IS NULL THEN concat('object_counting invalid: `target_category` `', q.label, '` is not in the visible scene label pool') WHEN a.n < 2 THEN concat('object_counting invalid: `target_category` `', q.label, '` is not in the counting label pool') END
  WHEN 'object_size' THEN CASE WHEN coalesce(a.n, 0) <> 1 THEN concat('object_size invalid: `object_label` `', q.label, '` is not in the scene unique pool') END
  ELSE CASE WHEN coalesce(a.n, 0) <> 1 THEN concat('absolute_distance invalid: `object1_label` `', q.label, '` is not in the scene unique pool') WHEN coalesce(b.n, 0) <> 1 THEN concat('absolute_distance invalid: `object2_label` `', other, '` is not in the scene unique pool') END END AS error
FROM q LEFT JOIN c a ON a.scene_id = q.scene_id AND a.label = q.label LEFT JOIN c b ON b.scene_id = q.scene_id AND b.label = other""")
def pool_rules(spark, sf):
    """Requests against the counts of the scene's labels, a row of counts a scene."""
    counts = objects(spark, sf).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    by_scene = counts.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("counts"))
    q = by_scene.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    name = lambda i: F.concat(F.lit("l"), i.cast("string"))
    q = q.withColumns({"label": name(F.col("k")), "other": name((F.col("k") * 5 + 1) % 12), "task": F.get(F.array(*[F.lit(t) for t in ("object_counting", "object_size", "absolute_distance")]), F.col("k") % 3)})
    labels = F.create_map(*[x for f in ("target_category", "object_label", "object1_label") for x in (F.lit(f), F.col("label"))], F.lit("object2_label"), F.col("other"))
    none = F.array().cast("array<string>")
    return q.select("scene_id", "label", "task", checks.pool_rule(F.col("task"), labels, none, F.col("counts"), none).alias("error"))


@query("p13_image_rules", with_views("objects", rest="f AS (SELECT scene_id, label, coalesce(sum(CASE WHEN frame_id = 0 THEN 1 ELSE 0 END), 0) AS a, coalesce(sum(CASE WHEN frame_id = 1 THEN 1 ELSE 0 END), 0) AS b FROM objects WHERE visibility >= 0.1 GROUP BY 1,2)") + """SELECT scene_id, label, CASE WHEN a > 1 THEN concat('visibility_compare invalid: target `', label, '` is not unique in provided image #1 (', CAST(a AS VARCHAR), ' matches)') WHEN b > 1 THEN concat('visibility_compare invalid: target `', label, '` is not unique in provided image #2 (', CAST(b AS VARCHAR), ' matches)')
  WHEN a <> 1 AND b <> 1 THEN concat('visibility_compare invalid: target `', label, '` is not visible enough in the provided images') END AS error FROM f""")
def image_rules(spark, sf):
    """A label in a scene's first two images."""
    o = objects(spark, sf).where("visibility >= 0.1").groupBy("scene_id", "label").agg(F.count_if(F.col("frame_id") == 0).alias("a"), F.count_if(F.col("frame_id") == 1).alias("b"))
    return o.select("scene_id", "label", checks.image_rule(F.lit("visibility_compare"), F.lit("target"), F.col("label"), F.array("a", "b")).alias("error"))


@query("g08_frame_choice", with_views("objects") + "SELECT object_id, CASE WHEN object_id % 5 = 0 THEN 'world' ELSE 'camera' END AS frame, round(CASE WHEN object_id % 5 = 0 THEN 1 - x ELSE 2 - cx END, 6) + 0.0 AS dx FROM objects")
def frame_choice(spark, sf):
    """A vector between two objects in the camera's frame if both have finite places there, else in the world's."""
    k = F.col("object_id") % 10
    own = F.when(k == 5, F.array(F.lit(float("nan")), F.col("cy"), F.col("cz"))).when(k == 0, F.array("cx", "cy")).otherwise(F.array("cx", "cy", "cz"))
    two = [F.lit(2.0)] * 3
    d, frame = g.vector_between(own, F.array(*two), F.array("x", "y", "z"), F.array(*[F.lit(1.0)] * 3))
    return objects(spark, sf).select("object_id", frame.alias("frame"), tidy(d[0]).alias("dx"))


@query("g16_measures", with_views("objects") + """SELECT object_id, round(CASE WHEN object_id % 3 = 0 THEN greatest(abs(x1-x0), abs(y1-y0), abs(z1-z0)) WHEN object_id % 3 = 1 THEN 0.5 ELSE 1 END, 6) AS longest,
  round(CASE WHEN object_id % 3 = 0 THEN abs(x1-x0)*abs(y1-y0)*abs(z1-z0) WHEN object_id % 3 = 1 THEN 0.125 ELSE 1 END, 6) AS volume FROM objects""")
def measures(spark, sf):
    """Dimensions by the box, else by the size, else 1."""
    k = F.col("object_id") % 3
    box = F.when(k == 0, F.array(*[F.col(f"{c}{i}") for i in (0, 1) for c in "xyz"]))
    size = F.when(k == 1, F.array(*[F.lit(0.5)] * 3))
    dims = g.dimensions(box, size)
    return objects(spark, sf).select("object_id", F.round(F.array_max(dims), 6).alias("longest"), F.round(F.get(dims, F.lit(0)) * F.get(dims, F.lit(1)) * F.get(dims, F.lit(2)), 6).alias("volume"))


@query("g25_turned_cameras", with_views("poses", rest=_ROT + ", s AS (SELECT *, CASE WHEN -r7 >= -r6 AND -r7 >= r7 AND -r7 >= r6 THEN 'Up' WHEN -r6 >= r7 AND -r6 >= r6 THEN 'Left' WHEN r7 >= r6 THEN 'Down' ELSE 'Right' END AS sky FROM cam)") + """SELECT scene_id, frame_id, sky, CASE WHEN sky IN ('Up', 'Down') THEN 256 ELSE 192 END AS width, CASE WHEN sky IN ('Up', 'Down') THEN 200.0 ELSE 210.0 END AS fx,
  CASE sky WHEN 'Up' THEN 127.5 WHEN 'Left' THEN 191 - 95.25 WHEN 'Down' THEN 255 - 127.5 ELSE 95.25 END AS cx, CASE sky WHEN 'Up' THEN 95.25 WHEN 'Left' THEN 127.5 WHEN 'Down' THEN 191 - 95.25 ELSE 255 - 127.5 END AS cy,
  round(CASE sky WHEN 'Up' THEN r0 WHEN 'Left' THEN -r1 WHEN 'Down' THEN -r0 ELSE r1 END, 6) + 0.0 AS r0 FROM s""")
def turned(spark, sf):
    """Intrinsics and poses after turns that bring the sky up."""
    c = cameras(spark, sf)
    sky = g.sky_direction(F.col("r6"), F.col("r7"))
    k = g.turned_intrinsics(sky, F.lit(256), F.lit(192), F.lit(200.0), F.lit(210.0), F.lit(127.5), F.lit(95.25))
    r = g.turned_rotation(sky, [F.col(f"r{i}") for i in range(9)])
    return c.select("scene_id", "frame_id", sky.alias("sky"), k["width"].alias("width"), k["fx"].alias("fx"), k["cx"].alias("cx"), k["cy"].alias("cy"), tidy(r[0]).alias("r0"))


@query("g26_surface_points", with_views("objects", rest="s AS (SELECT unnest([-1.0, -1.0/3, 1.0/3, 1.0])::DOUBLE AS s)") + """SELECT DISTINCT object_id, round(round(a.s * (x1-x0)/2, 6) + x, 4) + 0.0 AS px, round(round(b.s * (y1-y0)/2, 6) + y, 4) + 0.0 AS py, round(round(c.s * (z1-z0)/2, 6) + z, 4) + 0.0 AS pz
FROM objects, s a, s b, s c WHERE abs(a.s) = 1 OR abs(b.s) = 1 OR abs(c.s) = 1""")
def surface(spark, sf):
    """Points of a grid of four steps on a box's faces, each once."""
    o = objects(spark, sf)
    p = g.surface_points([F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"], 4)
    out = o.select("object_id", "x", "y", "z", F.explode(p).alias("p"))
    return out.select("object_id", *[g.tidy(F.col(f"p.{c}") + F.col(c), 4).alias(f"p{c}") for c in "xyz"]).distinct()


@query("t05_asked_directions", with_views("objects", rest="counted AS (SELECT *, count(*) OVER (PARTITION BY scene_id, label) AS n FROM objects), uniq AS (SELECT * FROM counted WHERE n = 1), req AS (SELECT s AS scene_id, concat('l', CAST(k AS VARCHAR)) AS a, concat('l', CAST(k + 1 AS VARCHAR)) AS b FROM range(20) r(s), range(9) t(k))") + "SELECT r.scene_id, r.a, r.b, round(sqrt(power(x.x-y.x, 2) + power(x.y-y.y, 2) + power(x.z-y.z, 2)), 2) AS distance FROM req r JOIN uniq x ON x.scene_id = r.scene_id AND x.label = r.a JOIN uniq y ON y.scene_id = r.scene_id AND y.label = r.b")
def asked_distances(spark, sf):
    """Requests with named labels, each side an equal join: no pair is made that is not asked for."""
    u = unique(spark, sf).select("scene_id", "label", "x", "y", "z")
    req = spark.range(20).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8)))).select(F.col("id").alias("scene_id"), F.concat(F.lit("l"), F.col("k")).alias("a"), F.concat(F.lit("l"), F.col("k") + 1).alias("b"))
    side = lambda n: u.select("scene_id", F.col("label").alias(n), F.array("x", "y", "z").alias(f"p{n}"))
    both = req.join(side("a"), ["scene_id", "a"]).join(side("b"), ["scene_id", "b"])
    at = lambda n: [F.get(F.col(f"p{n}"), F.lit(i)) for i in range(3)]
    return both.select("scene_id", "a", "b", F.round(g.euclid(at("a"), at("b")), 2).alias("distance"))


@query("x02_registered_tasks", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'rejected' ELSE 'exact' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'shelf_height' WHEN 1 THEN 'shelf_height' WHEN 3 THEN 'object_size' END AS task FROM orders")
def registered(spark, sf):
    """Tasks, other names and refusals that a run registers count beside those that are there."""
    r = registries.Tasks().add_task("shelf_height", "scene").add_alias("heightofshelf", "shelf_height").add_refusal("shelfcolour")
    return _picked(spark, sf, ["Shelf Height", "height_of_shelf", "shelf colour", "object_size"], "name").withColumn("r", r.resolve(F.col("name"))).select("o_orderkey", "r.status", "r.task")


@query("x03_registered_extractors", "SELECT o_orderkey, CAST(o_orderkey % 100 AS VARCHAR) AS shelf FROM orders")
def extractors(spark, sf):
    """Tools, extractors and scores registered by name, as functions on columns or on batches."""
    r = registries.Registry("extractor")
    r.add("shelf_height", lambda rows: rows.withColumn("shelf", F.regexp_extract("question", r"shelf (\d+)", 1)))
    o = _table(spark, sf, "orders").withColumn("question", F.concat(F.lit("How high is shelf "), (F.col("o_orderkey") % 100).cast("string"), F.lit("?")))
    return r.run("shelf_height", o).select("o_orderkey", "shelf")


@query("x04_batch_scores", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END, 1) AS score FROM customer")
def batch_scores(spark, sf):
    """A score of one's own over batches of rows, in Arrow batches."""
    score = lambda pdf: (pdf["c_acctbal"] > 0).astype(float)
    return registries.scored(_table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), score).select("c_custkey", F.round("score", 1).alias("score"))


@query("x06_dispatch", "SELECT n_nationkey, n_nationkey * 2 AS doubled FROM nation")
def dispatched(spark, sf):
    """A function applied to every chunk of a batch, and the chunks put together."""
    double = lambda pdf: pdf.assign(doubled=pdf["n_nationkey"] * 2)
    return registries.dispatch(_table(spark, sf, "nation").select("n_nationkey"), double, "n_nationkey int, doubled int", 5)


NAMES = OBJECT_NAMES
