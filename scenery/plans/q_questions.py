"""Requests and questions: task names, labels, candidates and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.functions import fuzzy, text
from scenery.functions import geometry as g
from scenery.functions.vocabulary import GROUP_ALIASES, REGION_OBJECTS, REGION_PHRASES, REJECTED_TASKS, SUMMARY_ALIASES, TASK_ALIASES
from scenery.operators import questions, rules
from scenery.plans.catalogue import query
from scenery.plans.q_etl import TASKS
from scenery.plans.q_scene import _ROT, cameras, objects, sql_dir8
from scenery.sources.adapters import with_views

SUPPORTED = [t for _, t in TASKS]
#: Names as requests give them: exact, other names, parts, refused, empty and unknown ones.
TASK_REQUESTS = [*SUPPORTED, *sorted(TASK_ALIASES), "Object-Counting", " ROOM (size) ", "[Object]\tCounting", "【room】 SIZE", "room\u00a0size", "counting", "size", "direction", "position", "position_obj_obj", "positionregregx", "", "weather", "room_size_estimate"]
GROUP_REQUESTS = [*sorted(GROUP_ALIASES), *sorted(SUMMARY_ALIASES), "Scene ", "two images", "none", "", "multi-image"]


def values(name: str, columns: str, rows) -> str:
    """A table of constants as a common table expression."""
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _picked(spark, sf, options, name):
    """Every order with one of the options, by its key."""
    table = F.array(*[F.lit(x) for x in options])
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.get(table, (F.col("o_orderkey") % len(options)).cast("int")).alias(name))


def _asked(options, name):
    return values("opt", f"i, {name}", list(enumerate(options))) + f", asked AS (SELECT o_orderkey, {name} FROM orders JOIN opt ON i = o_orderkey % {len(options)})"


_KEY = r"regexp_replace(lower(name), '[\s\x0b\x1c-\x1f\x{85}\p{Z}_\[\]【】]+', '', 'g')"


@query("f04_task_resolution", "WITH " + _asked(TASK_REQUESTS, "name") + ", " + values("sup", "k, task", list(enumerate(SUPPORTED))) + ", " + values("ali", "a, task", TASK_ALIASES.items()) + ", " + values("rej", "r", [(r,) for r in REJECTED_TASKS]) + f""",
n AS (SELECT o_orderkey, name, {_KEY} AS key FROM asked),
c AS (SELECT n.*, EXISTS (SELECT 1 FROM rej WHERE contains(r, key) OR contains(key, r)) AS refused, (SELECT task FROM sup WHERE replace(task, '_', '') = key) AS exact,
  (SELECT task FROM ali WHERE a = key) AS alias, (SELECT arg_min(task, k) FROM sup WHERE contains(replace(task, '_', ''), key) OR contains(key, replace(task, '_', ''))) AS near FROM n)
SELECT o_orderkey, name, CASE WHEN key = '' THEN 'empty' WHEN refused THEN 'rejected' WHEN exact IS NOT NULL THEN 'exact' WHEN alias IS NOT NULL THEN 'alias' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'unsupported' END AS status,
  CASE WHEN key <> '' AND NOT refused THEN coalesce(exact, alias, near) END AS task FROM c""")
def task_resolution(spark, sf):
    """a request's task by its name, through all stages."""
    found = rules.resolve_task(F.col("name"), SUPPORTED)
    return _picked(spark, sf, TASK_REQUESTS, "name").withColumn("r", found).select("o_orderkey", "name", "r.status", "r.task")


@query("f05_alias_resolution", "WITH " + _asked(GROUP_REQUESTS, "name") + ", " + values("ga", "a, c", GROUP_ALIASES.items()) + ", " + values("sa", "a, c", SUMMARY_ALIASES.items()) + r""",
n AS (SELECT o_orderkey, name, regexp_replace(lower(name), '[^\p{L}\p{N}_]', '', 'g') AS key FROM asked)
SELECT o_orderkey, name, CASE WHEN key = '' THEN 'empty' WHEN ga.c IS NULL THEN 'unsupported' WHEN ga.c = key THEN 'exact' ELSE 'alias' END AS group_status, ga.c AS task_group,
  CASE WHEN key = '' THEN 'empty' WHEN sa.c IS NULL THEN 'unsupported' WHEN sa.c = key THEN 'exact' ELSE 'alias' END AS summary_status, sa.c AS summary_type FROM n LEFT JOIN ga ON ga.a = key LEFT JOIN sa ON sa.a = key""")
def alias_resolution(spark, sf):
    """names of task groups and of kinds of summary."""
    n = _picked(spark, sf, GROUP_REQUESTS, "name").withColumns({"g": rules.resolve_alias(F.col("name"), GROUP_ALIASES), "s": rules.resolve_alias(F.col("name"), SUMMARY_ALIASES)})
    return n.select("o_orderkey", "name", F.col("g.status").alias("group_status"), F.col("g.canonical").alias("task_group"), F.col("s.status").alias("summary_status"), F.col("s.canonical").alias("summary_type"))


#: What the labels of the scenes are called in questions.
OBJECT_NAMES = ["bed", "sofa", "toilet", "microwave", "printer", "dresser", "door", "washer", "piano", "basket"]
_NAMED = values("called", "label, name", [(f"l{i}", n) for i, n in enumerate(OBJECT_NAMES)])
_CLEAN = [t for t in questions.FIELDS if t not in ("relative_distance", "relative_direction_hard")]


def _pairs_of_names(spark, sf):
    """Orders with two or three different names of objects and a task."""
    name = F.array(*[F.lit(x) for x in OBJECT_NAMES])
    k = F.col("o_orderkey")
    n = len(OBJECT_NAMES)
    pick = lambda i: F.get(name, i.cast("int"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    task = F.get(F.array(*[F.lit(t) for t in questions.FIELDS]), (k % len(questions.FIELDS)).cast("int"))
    return o.select("o_orderkey", task.alias("task"), pick(k % n).alias("a"), pick((k + 3) % n).alias("b"), pick((k + 7) % n).alias("c"))


_NAMES_SQL = values("called", "i, name", list(enumerate(OBJECT_NAMES))) + ", " + values("tasks", "i, task", list(enumerate(questions.FIELDS))) + """,
p AS (SELECT o_orderkey, t.task, x.name AS a, y.name AS b, z.name AS c FROM orders JOIN tasks t ON t.i = o_orderkey % 12 JOIN called x ON x.i = o_orderkey % 10 JOIN called y ON y.i = (o_orderkey + 3) % 10 JOIN called z ON z.i = (o_orderkey + 7) % 10)"""


@query("f11_label_extraction", "WITH " + _NAMES_SQL + """
SELECT o_orderkey, task, CASE WHEN task IN ('absolute_distance', 'attribute_measurement', 'depth_order_obj_obj') THEN concat('object1_label=', a, ',object2_label=', b)
  WHEN task = 'single_image_relative_direction' THEN concat('reference_label=', b, ',target_label=', a)
  WHEN task = 'relative_direction_hard' THEN concat('orienting_label=', b, ',positioning_label=', a, ',querying_label=', c)
  WHEN task = 'object_counting' THEN concat('target_category=', a) WHEN task = 'object_size' THEN concat('object_label=', a) WHEN task = 'position_cam_reg' THEN concat('region_name=', a) ELSE concat('target_label=', a) END AS labels,
  CASE WHEN task = 'relative_distance' THEN concat(b, ',', c) END AS candidates FROM p""")
def label_extraction(spark, sf):
    """the labels a question names, by its wording or in the order of mention."""
    a, b, c = (F.col(x) for x in "abc")
    lit = F.lit
    q = (
        F.when(F.col("task").isin("absolute_distance", "attribute_measurement", "depth_order_obj_obj"), F.concat(lit("What is the distance between the "), a, lit(" and "), b, lit("?")))
        .when(F.col("task") == "single_image_relative_direction", F.concat(lit("Where is the "), a, lit(" relative to the "), b, lit("?")))
        .when(F.col("task") == "relative_direction_hard", F.concat(lit("Standing by the "), a, lit(" and facing the "), b, lit(", where is the "), c, lit("?")))
        .when(F.col("task") == "relative_distance", F.concat(lit("Which of these objects ("), b, lit(", "), c, lit(") is closest to the "), a, lit("?")))
        .when(F.col("task") == "position_cam_reg", F.concat(lit("Where is "), a, lit(" relative to me?")))
        .otherwise(F.concat(lit("How about the "), a, lit("?")))
    )
    rows = _pairs_of_names(spark, sf).withColumn("question", q).withColumn("pool", F.array(*[lit(x) for x in sorted(OBJECT_NAMES)]))
    out = questions.extract(rows, "o_orderkey", fuzzy.Names(OBJECT_NAMES))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], lit("="), e["value"]))), ",")
    return out.select("o_orderkey", "task", text.alias("labels"), F.array_join("candidate_labels", ",").alias("candidates"))


@query("f38_sanitised_labels", "WITH " + _NAMES_SQL + """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN 'null' ELSE a END AS target_label, CASE WHEN o_orderkey % 3 = 0 THEN b ELSE concat(b, ',', c) END AS candidates FROM p""")
def sanitised_labels(spark, sf):
    """extracted labels against the pool: unknown ones are null, lists lose repeats and unknown items."""
    k = F.col("o_orderkey")
    target = F.when(k % 4 == 0, "none").when(k % 4 == 1, "qqqqqqqq").otherwise(F.concat(F.lit("The "), F.initcap("a")))
    listed = F.when(k % 3 == 0, F.array(F.col("b"), F.lit("zzzzzzzz"), F.col("b"))).otherwise(F.array(F.col("b"), F.col("c"), F.col("b")))
    rows = _pairs_of_names(spark, sf).select("o_orderkey", F.create_map(F.lit("target_label"), target).alias("labels"), listed.alias("candidate_labels"), F.array(*[F.lit(x) for x in sorted(OBJECT_NAMES)]).alias("pool"))
    out = questions.sanitise(rows, "o_orderkey", fuzzy.Names(OBJECT_NAMES))
    return out.select("o_orderkey", F.element_at("labels", "target_label").alias("target_label"), F.array_join("candidate_labels", ",").alias("candidates"))


_POOL_TASKS = ["object_counting", "object_size", "distance_cam_obj", "position_cam_obj", "attribute_measurement", "visibility_compare"]


@query("f39_candidate_pools", with_views("objects", rest=values("tk", "task", [(t,) for t in _POOL_TASKS]) + """,
s AS (SELECT scene_id, label, count(*) AS n FROM objects GROUP BY 1,2), f AS (SELECT scene_id, frame_id, label, count(*) AS n, max(visibility) AS v FROM objects WHERE visibility >= 0.5 GROUP BY 1,2,3),
fr AS (SELECT DISTINCT scene_id, frame_id FROM objects), r AS (SELECT scene_id, frame_id AS frame_1, frame_id + 1 AS frame_2, task FROM fr, tk),
l AS (SELECT r.scene_id, r.frame_1, r.task, label, coalesce(max(n) FILTER (f.frame_id = frame_1), 0) AS n1, coalesce(max(n) FILTER (f.frame_id = frame_2), 0) AS n2, coalesce(max(v) FILTER (f.frame_id = frame_1), 0.0) AS v1, coalesce(max(v) FILTER (f.frame_id = frame_2), 0.0) AS v2
  FROM r JOIN f ON f.scene_id = r.scene_id AND f.frame_id IN (frame_1, frame_2) GROUP BY 1,2,3,4),
g AS (SELECT scene_id, frame_1, task, string_agg(label, ',' ORDER BY label) AS every, string_agg(label, ',' ORDER BY label) FILTER (n1 <= 1 AND n2 <= 1) AS clear, string_agg(label, ',' ORDER BY label) FILTER (n1 <= 1 AND n2 <= 1 AND abs(v1 - v2) >= 0.15) AS contrast,
  string_agg(label, ',' ORDER BY label) FILTER (n1 = 1 AND n2 = 1) AS shared, string_agg(label, ',' ORDER BY label) FILTER (n1 = 1) AS own_unique, string_agg(label, ',' ORDER BY label) FILTER (n1 > 0) AS own FROM l GROUP BY 1,2,3),
c AS (SELECT scene_id, string_agg(label, ',' ORDER BY label) FILTER (n = 1) AS u, string_agg(label, ',' ORDER BY label) FILTER (n > 1) AS m FROM s GROUP BY 1)""") + """
SELECT r.scene_id, r.frame_1, r.task, coalesce(CASE r.task WHEN 'object_counting' THEN m WHEN 'object_size' THEN u WHEN 'distance_cam_obj' THEN every WHEN 'position_cam_obj' THEN coalesce(own_unique, own) WHEN 'attribute_measurement' THEN clear ELSE coalesce(contrast, shared, clear) END, '') AS pool
FROM r LEFT JOIN g ON g.scene_id = r.scene_id AND g.frame_1 = r.frame_1 AND g.task = r.task LEFT JOIN c ON c.scene_id = r.scene_id""")
def candidate_pools(spark, sf):
    """the labels each task may name, for every frame and the next."""
    o = objects(spark, sf)
    scene = o.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    frame = o.where("visibility >= 0.5").groupBy("scene_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("visibility").alias("visibility"))
    r = o.select("scene_id", F.col("frame_id").alias("frame_1")).distinct().withColumns({"frame_2": F.col("frame_1") + 1, "reference": F.lit(1), "task": F.explode(F.array(*[F.lit(t) for t in _POOL_TASKS]))})
    return questions.candidate_pools(r, scene, frame).select("scene_id", "frame_1", "task", F.array_join("pool", ",").alias("pool"))


#: Regions as questions name them; every one is found by a phrase.
REGION_REQUESTS = ["sleeping area", "The Living Room", "washroom", "copy corner", "cooking-area", "foyer", "music area", "laundry room"]
_PHRASES = [(p, r) for r, own in REGION_PHRASES.items() for p in [r, *own]]


@query("f14_region_phrases", "WITH " + values("asked", "phrase", [(p,) for p in [*REGION_REQUESTS, "a sofa area near the door", "printing zone", "lamp", "wc", "bedroom"]]) + ", " + values("known", "p, region", _PHRASES) + r""",
n AS (SELECT phrase, trim(regexp_replace(lower(phrase), '[^a-z0-9]+', ' ', 'g')) AS t FROM asked),
x AS (SELECT phrase, t, (SELECT any_value(region) FROM known WHERE p = t) AS whole, (SELECT any_value(region) FROM known WHERE replace(p, ' ', '') = replace(t, ' ', '')) AS packed,
  (SELECT arg_max(region, length(p)) FROM known WHERE contains(concat(' ', t, ' '), concat(' ', p, ' ')) OR contains(p, t)) AS inside FROM n)
SELECT phrase, coalesce(whole, packed, inside) AS region FROM x""")
def region_phrases(spark, sf):
    """phrases that mean a region; of several the longest."""
    names = fuzzy.Names()
    asked = [*REGION_REQUESTS, "a sofa area near the door", "printing zone", "lamp", "wc", "bedroom"]
    return spark.createDataFrame([(p, names.phrase(p)) for p in asked], "phrase string, region string")


_ONTOLOGY = [(r, i, o) for r, own in REGION_OBJECTS.items() for i, o in enumerate(own)]
_ANCHORS = _NAMED + ", " + values("asked", "phrase, region", [(p, fuzzy.Names().phrase(p)) for p in REGION_REQUESTS]) + ", " + values("onto", "region, k, name", _ONTOLOGY) + """,
have AS (SELECT DISTINCT scene_id, name FROM objects JOIN called ON called.label = objects.label),
anchors AS (SELECT s.scene_id, asked.phrase, arg_min(have.name, k) AS anchor FROM (SELECT DISTINCT scene_id FROM have) s JOIN asked ON true LEFT JOIN onto ON onto.region = asked.region LEFT JOIN have ON have.scene_id = s.scene_id AND have.name = onto.name WHERE have.name IS NOT NULL GROUP BY 1,2)"""


def region_anchors_of(spark, sf):
    """Every scene with every region asked for: the object that stands for it, by distinct lists of labels."""
    called = F.create_map(*[F.lit(x) for i, n in enumerate(OBJECT_NAMES) for x in (f"l{i}", n)])
    have = objects(spark, sf).select("scene_id", F.try_element_at(called, F.col("label")).alias("name")).where("name IS NOT NULL")
    pools = have.groupBy("scene_id").agg(F.array_sort(F.collect_set("name")).alias("pool"))
    asked = pools.withColumn("phrase", F.explode(F.array(*[F.lit(p) for p in REGION_REQUESTS])))
    return fuzzy.resolve_pairs(asked, "phrase", "pool", "anchor", fuzzy.Names(OBJECT_NAMES), "region").drop("pool")


@query("f31_region_anchors", with_views("objects", rest=_ANCHORS) + "SELECT scene_id, phrase, anchor FROM anchors")
def region_anchors(spark, sf):
    """The first of a region's objects that the scene has. Regions that no own object stands for are left out, as SQL cannot say what is most similar."""
    own = F.create_map(*[F.lit(x) for p in REGION_REQUESTS for x in (p, ",".join(REGION_OBJECTS[fuzzy.Names().phrase(p)]))])
    found = region_anchors_of(spark, sf)
    return found.where(F.array_contains(F.split(F.element_at(own, F.col("phrase")), ","), F.col("anchor"))).select("scene_id", "phrase", "anchor")


@query("t14_position_cam_reg", with_views("objects", "poses", rest=_ROT + ", " + _ANCHORS + """,
reg AS (SELECT a.scene_id, a.phrase, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM anchors a JOIN called ON called.name = a.anchor JOIN objects o ON o.scene_id = a.scene_id AND o.label = called.label GROUP BY 1,2),
l AS (SELECT c.scene_id, c.frame_id, phrase, c.r0*(reg.x-tx)+c.r3*(reg.y-ty)+c.r6*(reg.z-tz) AS lx, c.r2*(reg.x-tx)+c.r5*(reg.y-ty)+c.r8*(reg.z-tz) AS lz FROM cam c JOIN reg ON c.scene_id = reg.scene_id)""") + "SELECT scene_id, frame_id, phrase, " + sql_dir8("lx", "lz") + " AS answer FROM l")
def position_cam_reg(spark, sf):
    """Direction from each camera of the region a question names: the mean place of the object that stands for it."""
    called = F.create_map(*[F.lit(x) for i, n in enumerate(OBJECT_NAMES) for x in (n, f"l{i}")])
    anchors = region_anchors(spark, sf).withColumn("label", F.try_element_at(called, F.col("anchor")))
    reg = anchors.join(objects(spark, sf).select("scene_id", "label", "x", "y", "z"), ["scene_id", "label"]).groupBy("scene_id", "phrase").agg(*[F.avg(c).alias(c) for c in "xyz"])
    p = cameras(spark, sf).join(reg, "scene_id")
    local = g.to_camera(g.col3(""), [F.col(f"r{i}") for i in range(9)], g.col3("t"))
    return p.select("scene_id", "frame_id", "phrase", g.dir8(local[0], local[2]).alias("answer"))


@query("t19_aliases", "WITH " + values("a", "alias, task", sorted(TASK_ALIASES.items())) + " SELECT alias, task FROM a")
def task_aliases(spark, sf):
    """Other names of the tasks."""
    return spark.createDataFrame(sorted(TASK_ALIASES.items()), "alias string, task string")


@query("t19_profiles", "WITH " + values("p", "task, mode, fields, scope", [(t, m, ",".join(questions.FIELDS.get(t, ())), questions.SCOPES.get(t, "")) for m, t in TASKS]) + " SELECT task, mode, fields, scope FROM p")
def task_profiles(spark, sf):
    """What each task reads: its mode, its labels and where its candidates come from."""
    return spark.createDataFrame([(t, m, ",".join(questions.FIELDS.get(t, ())), questions.SCOPES.get(t, "")) for m, t in TASKS], "task string, mode string, fields string, scope string")


@query("f12_image_references", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS image FROM orders""")
def image_references(spark, sf):
    """the image a question is asked from: named as `image 2`, in words, or by when it was taken."""
    asked = ["Where is it in image 2 and image 1?", "From Image_1, where?", "Where was I when taking image two?", "In the first image, where is the lamp?", "Where is it?"]
    return _picked(spark, sf, asked, "question").select("o_orderkey", text.image_asked(F.col("question")).alias("image"))


#: Tasks by their groups, blocked ones and one that nobody knows; every code, one that is none, and no code.
GATED = [*TASKS, ("image_pair", "position_obj_obj"), ("scene", "position_reg_reg"), ("multi_image", "weather"), (None, "unheard_of")]
CODES = [*rules.STAGES, "OTHER", ""]


def _failed(spark, sf):
    """Orders as failed requests: a task with its group by the order's key, a code by its customer's."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    tasks = F.array(*[F.struct(F.lit(g).cast("string").alias("task_group"), F.lit(t).alias("task")) for g, t in GATED])
    o = o.withColumn("t", F.get(tasks, (F.floor(F.col("o_orderkey") / 2) % len(GATED)).cast("int")))
    return o.select("o_orderkey", "t.task", "t.task_group", F.get(F.array(*[F.lit(c) for c in CODES]), (F.col("o_custkey") % len(CODES)).cast("int")).alias("code"))


_FAILED = values("gated", "i, task_group, task", [(i, g, t) for i, (g, t) in enumerate(GATED)]) + ", " + values("codes", "j, code", list(enumerate(CODES))) + f""",
failed AS (SELECT o_orderkey, task, task_group, code FROM orders JOIN gated ON i = (o_orderkey // 2) % {len(GATED)} JOIN codes ON j = o_custkey % {len(CODES)})"""


@query("t20_recovery_gate", "WITH " + _FAILED + """, r AS (SELECT *, CASE WHEN o_orderkey % 2 = 1 THEN 'disabled' WHEN task IN ('position_obj_obj', 'position_obj_reg', 'position_reg_reg') THEN 'task_type_hard_blocked'
  WHEN coalesce(task_group, '') NOT IN ('scene', 'single_image', 'image_pair') THEN concat('task_group_not_supported:', coalesce(task_group, ''))
  WHEN code NOT IN ('QUESTION_INVALID', 'INVALID_QUESTION_RULE', 'EXECUTION_FAILED', 'EMPTY_ANSWER', 'MISSING_DEPENDENCY', 'MISSING_TOOL') THEN concat('error_code_not_recoverable:', code) END AS reason FROM failed)
SELECT o_orderkey, task, code, reason IS NULL AS may_recover, reason FROM r""")
def recovery_gate(spark, sf):
    """Whether a failed request is tried again: switched on, its task not blocked, its group and its error code allowed; and why not."""
    o = _failed(spark, sf).withColumn("reason", rules.recovery(F.col("o_orderkey") % 2 == 0, F.col("task"), F.col("task_group"), F.col("code")))
    return o.select("o_orderkey", "task", "code", F.col("reason").isNull().alias("may_recover"), "reason")


@query("f34_failure_stages", "WITH " + _FAILED + """ SELECT o_orderkey, code, CASE WHEN o_orderkey % 5 = 0 THEN 'ok' WHEN code IN ('INVALID_INPUT', 'INVALID_SUMMARY_TYPE', 'UNSUPPORTED_TASK', 'TASK_DISABLED') THEN 'input' WHEN code = 'MISSING_DEPENDENCY' THEN 'dependency'
  WHEN code = 'QUESTION_INVALID' THEN 'validation' WHEN code = 'INVALID_QUESTION_RULE' THEN 'rule' WHEN code IN ('EXECUTION_FAILED', 'MISSING_TOOL') THEN 'execution' WHEN code = 'EMPTY_ANSWER' THEN 'answer' ELSE 'unknown' END AS stage FROM failed""")
def failure_stages(spark, sf):
    """the stage at which a request failed, by its code; ok where it is valid."""
    return _failed(spark, sf).select("o_orderkey", "code", rules.failure_stage(F.col("code"), F.col("o_orderkey") % 5 == 0).alias("stage"))
