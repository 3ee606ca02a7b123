"""Answers, hints, signatures and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.functions import rewards
from scenery.functions.geometry import tidy
from scenery.operators import answers, batch
from scenery.plans.catalogue import query
from scenery.plans.q_batch import _w, rollouts
from scenery.plans.q_etl import TASKS
from scenery.plans.q_questions import _asked, _picked, values


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Answers, truths and tasks with their scores, worked out by hand from the rules.
SCORED = [
    ("front-left", "Left front", "position_cam_obj", 1.0),
    ("front", "front-left", "position_cam_obj", 0.0),
    ("front", "front-left", "single_image_relative_direction", 0.1),
    ("front-left", "up-front-left", "single_image_relative_direction", 1.0),
    ("nowhere", "front", "relative_direction_hard", 0.0),
    ("clockwise", "right", "motion_camera", 1.0),
    ("counter clockwise", "left", "motion_camera", 1.0),
    ("three", "3", "object_counting", 1.0),
    ("4", "3", "object_counting", 0.3),
    ("5", "3", "object_counting", 0.1),
    ("9", "3", "object_counting", 0.0),
    ("many", "3", "object_counting", 0.0),
    ("2.0 meters", "2 meters", "absolute_distance", 1.0),
    ("1 meters", "2 meters", "distance_cam_obj", 1.0 / 11),
    ("no idea", "20 cm", "object_size", 0.0),
    ("12 square meters", "12", "room_size", 1.0),
    ("the Table.", "table", "relative_distance", 1.0),
    ("same level", "same_level", "elevation_cam_cam", 1.0),
    ("", "INVALID", "visibility_compare", 1.0),
    ("chair", "invalid question", "attribute_measurement", 0.0),
]


@query("r07_correctness", "WITH " + values("s", "i, answer, truth, task, score", [(i, *r) for i, r in enumerate(SCORED)]) + f" SELECT o_orderkey, answer, truth, task, round(score, 6) AS score FROM orders JOIN s ON i = o_orderkey % {len(SCORED)}")
def correctness(spark, sf):
    """Answers by the family of their task."""
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in SCORED]), (F.col("o_orderkey") % len(SCORED)).cast("int"))
    o = _table(spark, sf, "orders").select("o_orderkey", pick(0).alias("answer"), pick(1).alias("truth"), pick(2).alias("task"))
    return o.withColumn("score", F.round(answers.correctness(F.col("answer"), F.col("truth"), F.col("task")), 6))


@query("r13_round_router", "SELECT o_orderkey, round(0.1 + 0.9 * (o_custkey % 10) / 10.0, 6) AS overall FROM orders")
def round_router(spark, sf):
    """A batch of one round goes to that round's score."""
    o = _table(spark, sf, "orders").select("o_orderkey", F.lit(2).alias("round"), ((F.col("o_custkey") % 10) / 10.0).alias("content"))
    first = lambda b: b.withColumn("overall", rewards.first_round(F.lit(1.0), F.lit(1.0), F.col("content"), F.lit(True), F.lit(False)))
    second = lambda b: b.withColumn("overall", rewards.second_round(F.lit(1.0), F.col("content"), F.lit(False)))
    return answers.route(o, first, second).select("o_orderkey", F.round("overall", 6).alias("overall"))


#: Raw responses with their task and the answer that is made of them.
RECOVERED = [
    ("<answer> Image 1 </answer>", "visibility_compare", "image1"),
    ("thinking\nAnswer: second image", "visibility_compare", "image2"),
    ("<ANSWER>same height</ANSWER>", "elevation_cam_cam", "same_level"),
    ("<answer>Front Left.</answer>", "position_cam_obj", "front-left"),
    ("<answer>left_up</answer>", "motion_camera", "left-up"),
    ("<answer>counterclockwise</answer>", "motion_camera", "counterclockwise"),
    ("<answer>sideways</answer>", "position_cam_cam", "sideways"),
    ("<answer>cannot answer</answer>", "object_size", "invalid"),
    ("no tag here", "object_size", "invalid"),
    ("", "room_size", "invalid"),
    ("<answer>12   square  meters</answer>", "room_size", "12 square meters"),
]


@query("f29_recovered_answers", "WITH " + values("s", "i, task, normal", [(i, r[1], r[2]) for i, r in enumerate(RECOVERED)]) + f" SELECT o_orderkey, task, normal FROM orders JOIN s ON i = o_orderkey % {len(RECOVERED)}")
def recovered(spark, sf):
    """an answer taken from a response and brought to its normal form."""
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in RECOVERED]), (F.col("o_orderkey") % len(RECOVERED)).cast("int"))
    o = _table(spark, sf, "orders").select("o_orderkey", pick(0).alias("response"), pick(1).alias("task"))
    return o.select("o_orderkey", "task", answers.normal_answer(answers.recovered_answer(F.col("response")), F.col("task")).alias("normal"))


_HINTED = ["position_cam_obj", "motion_camera", "object_size", "single_image_relative_direction"]


@query("f26_answer_hints", "WITH " + values("h", "i, task, hint", [(i, t, answers.DIRECTION_HINTS.get(t, " In cm.")) for i, t in enumerate(_HINTED)]) + f" SELECT o_orderkey, task, concat('Where is item ', CAST(o_custkey AS VARCHAR), '?', hint) AS hinted FROM orders JOIN h ON i = o_orderkey % {len(_HINTED)}")
def hints(spark, sf):
    """a question's old hint is taken off and its task's is appended; orders of choices are in the tests."""
    o = _picked(spark, sf, _HINTED, "task").join(_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    old = F.when(F.col("o_orderkey") % 3 == 0, " Answer with exactly one of: a, b.").when(F.col("o_orderkey") % 3 == 1, " A concise answer is usually a short direction phrase. ").otherwise("")
    o = o.withColumns({"question": F.concat(F.lit("Where is item "), F.col("o_custkey").cast("string"), F.lit("?"), old), "truth": F.lit(None).cast("string"), "pair": F.lit(None).cast("array<string>")})
    return answers.with_hint(o, 1, {"object_size": " In cm."}).select("o_orderkey", "task", "hinted")


@query("f27_template_fill", "SELECT n_nationkey, concat('Scene ', n_name, ' has ', CAST(n_nationkey AS VARCHAR), ' objects; {other} stays; ', n_name, '.') AS prompt FROM nation")
def template(spark, sf):
    """a template's names replaced by columns."""
    return _table(spark, sf, "nation").select("n_nationkey", answers.fill("Scene {scene} has {n} objects; {other} stays; {scene}.", scene=F.col("n_name"), n=F.col("n_nationkey"), unused=F.col("n_regionkey")).alias("prompt"))


@query("f30_flatten", "SELECT n_nationkey AS key, n_name AS nation__name, n_regionkey AS nation__region__key FROM nation")
def flattened(spark, sf):
    """records as columns named by paths, there and back again."""
    n = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("nation"))
    return answers.flatten(answers.unflatten(answers.flatten(n, "__"), "__"), "__")


@query("f33_difficulty", """WITH c(task, mode, value, answers, hit, miss) AS (VALUES ('P', 'fixed', 0.9::DOUBLE, ['']::VARCHAR[], NULL::DOUBLE, NULL::DOUBLE), ('F', 'answer_in_set', NULL, ['1', '2'], 0.4, 1.3))
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0.9 WHEN 'F' THEN CASE WHEN o_custkey % 4 IN (1, 2) THEN 0.4 ELSE 1.0 END ELSE 0.5 END AS difficulty FROM orders""")
def difficulty(spark, sf):
    """a score by each task's configuration, within 0 and 1."""
    config = spark.createDataFrame([("P", "fixed", 0.9, [""], None, None), ("F", "answer_in_set", None, ["1", "2"], 0.4, 1.3)], "task string, mode string, value double, answers array<string>, hit double, miss double")
    o = _table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("task"), (F.col("o_custkey") % 4).cast("string").alias("answer"), F.lit(0.5).alias("default_score"))
    return answers.difficulty(o, config).select("o_orderkey", "difficulty")


#: Paths of images with the scene, the folder of metadata and the mode that follow from them.
PATHS = [
    ("/data/scans/scene0001_00/color/12.jpg", "scene0001_00", None, "single_image"),
    ("/data/metadata/scene0002_01.json", "scene0002_01", "/data/metadata", "single_image"),
    ("/data/x/train/Scene7/3.jpg|/data/x/train/Scene7/9.jpg", "Scene7", "/data/x/metadata", "image_pair"),
    ("/a/b/c.jpg|/a/scene9/d.jpg|/a/b/e.jpg", "scene9", None, "scene"),
    ("/a/b/c.jpg", "unknown", None, "single_image"),
]


@query("f36_path_inference", "WITH " + values("p", "i, scene, metadata, mode", [(i, s, m, k) for i, (_, s, m, k) in enumerate(PATHS)]) + f" SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'given' ELSE scene END AS scene, metadata, CASE WHEN o_orderkey % 4 = 1 THEN 'scene' ELSE mode END AS mode FROM orders JOIN p ON i = o_orderkey % {len(PATHS)}")
def path_inference(spark, sf):
    """what a request leaves out follows from its paths and its number of images."""
    o = _picked(spark, sf, [p[0] for p in PATHS], "paths").withColumn("paths", F.split("paths", r"\|"))
    k = F.col("o_orderkey")
    given = F.when(k % 7 == 0, " given ").otherwise("")
    none = F.lit(None).cast("string")
    group = F.when(k % 4 == 1, "scene")
    return o.select("o_orderkey", answers.scene_of(given, F.col("paths")).alias("scene"), answers.metadata_of(none, F.col("paths")).alias("metadata"), answers.prompt_mode(none, group, F.size("paths")).alias("mode"))


@query("f37_mask_types", "WITH m AS (SELECT p_brand, count(DISTINCT p_size) AS n, max(p_size) AS most, avg(CASE WHEN p_size > 40 THEN 1.0 ELSE 0.0 END) AS share FROM part GROUP BY 1) SELECT p_brand, CASE WHEN n <= 3 AND most <= 255 THEN 'likely_binary_or_anon_mask' WHEN n > 20 AND most > 10 THEN 'possible_instance_or_label_mask' WHEN share < 0.15 THEN 'likely_sparse_redaction_mask' ELSE 'uncertain' END AS mask_type FROM m")
def mask_types(spark, sf):
    """kinds of masks from the statistics of their values."""
    m = _table(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct("p_size").alias("n"), F.max("p_size").alias("most"), F.avg((F.col("p_size") > 40).cast("double")).alias("share"))
    return m.select("p_brand", answers.mask_type(F.col("n"), F.col("most"), F.col("share")).alias("mask_type"))


#: Responses of the first round with their format score, whether they ask several questions, and the question.
FORMATTED = [
    ("<observation>A room.</observation><question>Where is it?</question>", 1.0, "false", "Where is it?"),
    ("<question>Where is it?</question>\n", 0.5, "false", "Where is it?"),
    ("x <question>Where?</question>", 0.0, "false", "Where?"),
    ("<question>One?</question><question>Two?</question>", 0.0, "true", "One?"),
    ("<Observation> a </observation> < question >Q</ question >", 1.0, "false", "Q"),
    ("nothing", 0.0, "false", "Unknown"),
    ("<observation>a<question>Q?</question>", 0.0, "false", "Q?"),
]


@query("f16_observation_format", "WITH " + values("s", "i, format_score, multi, question", [(i, *r[1:]) for i, r in enumerate(FORMATTED)]) + f" SELECT o_orderkey, CAST(format_score AS DOUBLE) AS format_score, multi = 'true' AS is_multi_question, question FROM orders JOIN s ON i = o_orderkey % {len(FORMATTED)}")
def observation_format(spark, sf):
    """F16: observation and question tags of the first round."""
    o = _picked(spark, sf, [r[0] for r in FORMATTED], "response")
    found = answers.observation_format(F.col("response"))
    return o.select("o_orderkey", found["format_score"].alias("format_score"), found["is_multi_question"].alias("is_multi_question"), found["question"].alias("question"))


_SIGNED = ["object_size", "absolute_distance", "room_size", "position_cam_cam", "relative_distance"]


@query("f24_signatures", "WITH " + _asked(_SIGNED, "task") + """, o AS (SELECT a.o_orderkey, a.task, lower(o_orderpriority) AS p, o_custkey % 3 AS c FROM asked a JOIN orders o ON o.o_orderkey = a.o_orderkey),
x AS (SELECT *, trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) AS a, concat('box ', CAST(c AS VARCHAR)) AS b FROM o),
j AS (SELECT o_orderkey, task, CASE task WHEN 'object_size' THEN concat('{"object_label": "', a, '", "task_type": "object_size"}')
  WHEN 'absolute_distance' THEN concat('{"object_pair": ["', least(a, b), '", "', greatest(a, b), '"], "task_type": "absolute_distance"}')
  WHEN 'room_size' THEN '{"scene_scope": "room", "task_type": "room_size"}' WHEN 'position_cam_cam' THEN '{"reference_image": "image2", "target_image": "image1", "task_type": "position_cam_cam"}'
  ELSE concat('{"anchor": "', a, '", "candidate_labels": ["', b, '", "lamp"], "task_type": "relative_distance"}') END AS payload FROM x)
SELECT md5(payload) AS signature, min(o_orderkey) AS o_orderkey, count(*) AS duplicate_weight FROM j GROUP BY 1""")
def signatures(spark, sf):
    """F24 with W10: questions that ask the same fall together; the first stands for all."""
    o = _picked(spark, sf, _SIGNED, "task").join(_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey")
    a, b = F.upper("o_orderpriority"), F.concat(F.lit("Box-"), (F.col("o_custkey") % 3).cast("string"))
    labels = F.create_map(F.lit("object_label"), F.lit("none"), F.lit("target_label"), a, F.lit("object1_label"), a, F.lit("object2_label"), b)
    o = o.withColumns({"question": F.lit("From image 2, where is Image one?"), "labels": labels, "listed": F.array(F.lit("Lamp"), b, F.lit("null"))})
    o = answers.with_signature(o, "task", "question", "labels", "listed")
    return batch.dedup_first(o.select("signature", "o_orderkey"), ["signature"], "o_orderkey").select("signature", "o_orderkey", "duplicate_weight")


_LOSS = """k AS (SELECT uid, pos, value, reward, is_valid, score - 0.4 AS adv, reward - value AS d FROM rollouts), m AS (SELECT uid, avg(d) AS g FROM k WHERE is_valid GROUP BY uid),
c AS (SELECT k.*, coalesce(g, 0.0) * CAST(is_valid AS INT) AS g FROM k LEFT JOIN m ON m.uid = k.uid)"""


@query("r19_policy_losses", _w(_LOSS) + """SELECT uid, pos, round(-adv * reward * exp(greatest(ln(0.8), least(ln(1.2), d))), 6) + 0.0 AS cispo,
  round(CASE WHEN adv < 0 THEN least(greatest(-adv*exp(g), -adv*exp(greatest(ln(0.8), least(ln(1.2), g)))), -adv*3.0) ELSE greatest(-adv*exp(g), -adv*exp(greatest(ln(0.8), least(ln(1.2), g)))) END, 6) + 0.0 AS gspo FROM c""")
def policy_losses(spark, sf):
    """The losses with a sequence's ratio and with clipped weights."""
    r = rollouts(spark, sf).withColumn("adv", F.col("score") - 0.4)
    out = batch.policy_losses(r, "uid", "reward", "value", "adv", "is_valid")
    return out.select("uid", "pos", tidy(F.col("cispo")).alias("cispo"), tidy(F.col("gspo")).alias("gspo"))


@query("r20_value_loss", _w("k AS (SELECT uid, pos, score AS p, reward AS r, greatest(value - 0.03, least(value + 0.03, score)) AS c FROM rollouts)") + "SELECT uid, pos, round(greatest((p-r)*(p-r), (c-r)*(c-r)), 8) + 0.0 AS loss, (p-r)*(p-r) < (c-r)*(c-r) AS clipped FROM k")
def value_loss(spark, sf):
    """The larger of the plain and the clipped squared error."""
    loss, clipped = rewards.value_loss(F.col("score"), F.col("reward"), F.col("value"), 0.03)
    return rollouts(spark, sf).select("uid", "pos", tidy(loss, 8).alias("loss"), clipped.alias("clipped"))


@query("r15_list_compare", "SELECT o_orderkey, o_custkey % 3 = o_orderkey % 3 AS equal FROM orders")
def list_compare(spark, sf):
    """Lists are equal item by item."""
    k = lambda c: F.array(F.lit("a"), (F.col(c) % 3).cast("string"))
    return _table(spark, sf, "orders").select("o_orderkey", (k("o_custkey") == k("o_orderkey")).alias("equal"))


@query("r25_micro_batch_rows")
def micro_batches(spark, sf):
    """Rows in balanced micro-batches under a budget, heaviest first, and their way back; no SQL form, tested."""
    return batch.micro_batches(rollouts(spark, sf).select("uid", "pos", "length"), "uid", "length", "pos", 100)


TASK_NAMES = [t for _, t in TASKS]
