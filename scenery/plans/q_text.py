"""Text functions, answer scoring and request rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.functions import fuzzy, rewards, text
from scenery.operators import lookup, mentions, similar
from scenery.plans.catalogue import query
from scenery.sources.adapters import spark_view, with_views

# Answers synthesised from rollouts: well-formed, doubled, missing and foreign tags.
_ANS = """answers AS (SELECT uid, pos, length, task, is_valid, score, CASE WHEN pos % 5 = 0 THEN concat('no tag ', CAST(length AS STRING))
  WHEN pos % 5 = 1 THEN concat('I think <answer> ', CAST(length AS STRING), ' meters. </answer>') WHEN pos % 5 = 2 THEN concat('<answer>', CAST(length AS STRING), '</answer><answer>Front_Left</answer>')
  WHEN pos % 5 = 3 THEN concat('<think>x</think><answer>', 'Front-Left', '</answer>') ELSE '<answer>The  Same Level.</answer>' END AS response FROM rollouts)"""
_DIR = "dirs AS (SELECT uid, pos, CASE WHEN length % 4 = 0 THEN 'front-left' WHEN length % 4 = 1 THEN 'Up front left.' WHEN length % 4 = 2 THEN 'behind' ELSE 'none' END AS got, CASE WHEN pos % 3 = 0 THEN 'Left front' WHEN pos % 3 = 1 THEN 'up-front-left' ELSE 'back' END AS want FROM rollouts)"


def _sub(spark, sf, cte: str):
    r = spark_view(spark, sf, "rollouts")
    name = cte.split(" AS ", 1)[0]
    return spark.sql(f"SELECT * FROM ({cte.split(' AS ', 1)[1][1:-1].replace('FROM rollouts', 'FROM {r}')}) AS {name}", r=r)


def answers(spark, sf):
    return _sub(spark, sf, _ANS)


@query("f01_label_normalise", "SELECT DISTINCT p_name, trim(regexp_replace(replace(replace(lower(p_name),'_',' '),'-',' '), '\\s+', ' ', 'g')) AS label, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part")
def label_normalise(spark, sf):
    """F1 and F2."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct()
    return p.select("p_name", text.normalise_label(F.col("p_name")).alias("label"), text.compact_key(F.col("p_name")).alias("key"))


@query("f06_trigram_jaccard", "WITH p AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part), g AS (SELECT p_partkey, CASE WHEN length(a) < 3 THEN [a] ELSE list_distinct(list_transform(range(1, length(a)-1), lambda i: substr(a, CAST(i AS BIGINT), 3))) END AS x, CASE WHEN length(b) < 3 THEN [b] ELSE list_distinct(list_transform(range(1, length(b)-1), lambda i: substr(b, CAST(i AS BIGINT), 3))) END AS y FROM p) SELECT p_partkey, round(len(list_intersect(x,y)) * 1.0 / len(list_distinct(list_concat(x,y))), 6) AS jaccard FROM g")
def trigram_jaccard(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", F.round(text.jaccard(text.trigrams(F.col("p_name")), text.trigrams(F.col("p_type"))), 6).alias("jaccard"))


@query("f08_label_resolution")
def label_resolution(spark, sf):
    """F7 to F9 and J14 on distinct labels; no SQL form, tested by hand-made pairs."""
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_type")
    pool = ["standard brass", "small tin", "economy steel", "promo nickel", "large copper", "medium plated brass"]
    return fuzzy.resolve_labels(p, "p_type", pool).select("p_partkey", "p_type", "resolved")


@query("f13_frame_id", "SELECT DISTINCT url, try_cast(nullif(regexp_extract(url, '(\\d+)(?:\\.[A-Za-z0-9]+)?$', 1), '') AS INT) AS frame_id FROM pages")
def frame_ids(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("url").distinct()
    return p.select("url", text.frame_id(F.col("url")).alias("frame_id"))


@query("f15_answer_format", with_views("rollouts", rest=_ANS) + """,
t AS (SELECT *, regexp_extract_all(response, '(?is)<answer>\\s*(.*?)\\s*</answer>', 1) AS a, regexp_extract_all(response, '<\\s*/?\\s*([A-Za-z][A-Za-z0-9_-]*)[^>]*>', 1) AS g FROM answers)
SELECT uid, pos, CAST(len(a) AS INT) AS n_answers, CAST(len(list_filter(g, lambda x: lower(x) <> 'answer')) AS INT) AS other_tags,
  CASE WHEN len(a) > 1 OR len(list_filter(g, lambda x: lower(x) <> 'answer')) > 0 THEN -1.0 WHEN len(a) = 0 THEN 0.0 ELSE 1.0 END AS format_score, CASE WHEN len(a) = 1 THEN trim(a[1]) ELSE '' END AS answer FROM t""")
def answer_format(spark, sf):
    """F15 and F16."""
    a = answers(spark, sf)
    return a.select("uid", "pos", *[c.alias(k) for k, c in text.answer_format(F.col("response")).items()])


@query("f17_final_answer", with_views("rollouts", rest=_ANS) + """, t AS (SELECT uid, pos, regexp_extract_all(response, '(?s)<answer>(.+?)</answer>', 1) AS a FROM answers), f AS (SELECT uid, pos, CASE WHEN len(a) > 0 THEN trim(a[-1]) END AS answer FROM t)
SELECT uid, pos, answer, regexp_replace(regexp_replace(lower(trim(coalesce(answer,''))), '[.,;:!?]$', ''), '\\s+', ' ', 'g') AS normal FROM f""")
def final_answer(spark, sf):
    """F17, F18 and R14 without the symbolic part."""
    a = answers(spark, sf).withColumn("answer", text.final_answer(F.col("response")))
    return a.select("uid", "pos", "answer", text.normalise_answer(F.col("answer")).alias("normal"))


@query("f20_exact_answer", with_views("rollouts", rest=_ANS) + """, t AS (SELECT uid, pos, trim(regexp_replace(replace(replace(lower(regexp_replace(trim(regexp_extract(response, '<answer>(.*?)</answer>', 1)), '\\.+$', '')), '_', ' '), '-', ' '), '\\s+', ' ', 'g')) AS t FROM answers)
SELECT uid, pos, trim(regexp_replace(CASE WHEN t IN ('same level','samelevel') THEN 'same_level' ELSE t END, '^(the|an|a) ', '')) AS exact FROM t""")
def exact_answer(spark, sf):
    """F19, F20 and R6."""
    a = answers(spark, sf).withColumn("a", F.regexp_extract("response", "<answer>(.*?)</answer>", 1))
    return a.select("uid", "pos", text.exact_answer(F.col("a")).alias("exact"))


@query("r02_direction_rewards", with_views("rollouts", rest=_DIR) + """,
n AS (SELECT uid, pos, CASE got WHEN 'front-left' THEN ['front','left'] WHEN 'Up front left.' THEN ['front','left','up'] WHEN 'behind' THEN ['back'] ELSE [] END AS g, CASE want WHEN 'Left front' THEN ['front','left'] WHEN 'up-front-left' THEN ['front','left','up'] ELSE ['back'] END AS w FROM dirs)
SELECT uid, pos, array_to_string(g, '+') AS got, CASE WHEN g = w THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN len(g) = 0 THEN 0.0 WHEN g = w THEN 1.0 WHEN len(w) = 3 AND len(g) = 2 AND list_has_all(w, g) THEN 1.0 WHEN len(w) = 2 AND len(g) = 1 AND list_has_all(w, g) THEN 0.1 ELSE 0.0 END AS partial FROM n""")
def direction_rewards(spark, sf):
    """F21, R1 and R2."""
    d = _sub(spark, sf, _DIR).withColumns({"g": text.directions(F.col("got")), "w": text.directions(F.col("want"))})
    return d.select("uid", "pos", F.array_join("g", "+").alias("got"), rewards.direction_reward(F.col("g"), F.col("w")).alias("exact"), rewards.partial_direction_reward(F.col("g"), F.col("w")).alias("partial"))


_NUM = "SELECT uid, pos, CAST(length AS DOUBLE) AS pred, CAST(length + (pos % 4) AS DOUBLE) + 0.37 * (pos % 2) AS target FROM rollouts"


@query("r04_numeric_rewards", with_views("rollouts", rest=f"n AS ({_NUM})") + """, e AS (SELECT *, abs(pred-target) AS a, abs(pred-target)/greatest(target, 1e-9) AS r FROM n)
SELECT uid, pos, CASE WHEN a <= 1e-6 THEN 1.0 WHEN a <= 1 THEN 0.3 WHEN a <= 2 THEN 0.1 ELSE 0.0 END AS count_reward, round(list_sum(list_transform(range(11), lambda i: CASE WHEN r <= 1-(0.5+0.045*i) THEN 1.0 ELSE 0.0 END))/11, 6) AS accuracy FROM e""")
def numeric_rewards(spark, sf):
    """F22, R3, R4 and R5, on numbers read back from text."""
    n = spark.sql(_NUM.replace("FROM rollouts", "FROM {r}"), r=spark_view(spark, sf, "rollouts"))
    p = text.parse_number(F.concat(F.lit("about "), F.col("pred").cast("string"), F.lit(" meters")))
    return n.select("uid", "pos", rewards.count_reward(p, F.col("target")).alias("count_reward"), F.round(rewards.relative_accuracy(p, F.col("target")), 6).alias("accuracy"))


@query("r08_round_scores", with_views("rollouts", rest=_ANS) + """, f AS (SELECT uid, pos, is_valid, score, task, CASE WHEN pos % 5 IN (2,3) THEN -1.0 WHEN pos % 5 = 0 THEN 0.0 ELSE 1.0 END AS f FROM answers)
SELECT uid, pos, round(CASE WHEN is_valid AND f < 0 THEN -1.0 ELSE 0.1*f + 0.9*score END, 6) + 0.0 AS second_round,
  round(CASE WHEN pos % 7 = 0 THEN -1.0 ELSE greatest(f, 0.0)*0.1 + CASE WHEN NOT is_valid THEN 0.0 ELSE 1.0 END * CASE WHEN is_valid AND f > 0 THEN greatest(0.1, score) ELSE score END * 0.9 END, 6) + 0.0 AS first_round,
  CASE WHEN score <= 0.15 THEN 0.0 WHEN score <= 0.45 THEN 0.3 WHEN score <= 0.75 THEN 0.6 ELSE 1.0 END AS snapped FROM f""")
def round_scores(spark, sf):
    """The scores of both rounds and the snapped reason score."""
    a = answers(spark, sf).withColumn("f", text.answer_format(F.col("response"))["format_score"])
    fmt = rewards.format_factor(F.col("response"), F.col("f"), F.lit(1))
    valid = rewards.validity_factor(F.lit("object_size"), F.col("is_valid"), F.lit(""), F.lit(1))
    first = rewards.first_round(fmt, valid, F.col("score"), F.col("is_valid") & (F.col("f") > 0), F.col("pos") % 7 == 0)
    second = rewards.second_round(F.col("f"), F.col("score"), F.col("is_valid") & (F.col("f") < 0))
    return a.select("uid", "pos", (F.round(second, 6) + 0.0).alias("second_round"), (F.round(first, 6) + 0.0).alias("first_round"), rewards.snap(F.col("score")).alias("snapped"))


@query("r10_validity_factor", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN CASE WHEN o_custkey % 4 = 0 THEN 0.0 WHEN o_custkey % 4 = 1 THEN 0.5 ELSE 1.0 END WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 0.0 ELSE 1.0 END ELSE CASE WHEN o_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END END END AS factor FROM orders")
def validity(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey") % 3
    task = F.when(k == 0, "object_counting").when(k == 1, "elevation_cam_cam").otherwise("visibility_compare")
    truth = F.when(k == 0, (F.col("o_custkey") % 4).cast("string")).when(k == 1, F.when(F.col("o_custkey") % 2 == 0, "Same-Level").otherwise("higher")).otherwise(F.when(F.col("o_custkey") % 2 == 0, "same").otherwise("image1"))
    return o.select("o_orderkey", rewards.validity_factor(task, F.col("o_orderstatus") != "P", truth, text.first_integer(truth)).alias("factor"))


@query("r15_answer_compare", with_views("rollouts") + "SELECT uid, pos, abs(reward - value) < 0.001 AS numeric_equal, lower(trim(response)) = 'a' AS text_equal FROM rollouts")
def answer_compare(spark, sf):
    r = spark_view(spark, sf, "rollouts")
    return r.select("uid", "pos", (F.abs(F.col("reward") - F.col("value")) < 0.001).alias("numeric_equal"), (text.normalise_answer(F.col("response")) == "a").alias("text_equal"))


@query("r26_last_token_reward", with_views("rollouts") + "SELECT uid, pos, CASE WHEN pos = max(pos) OVER (PARTITION BY uid) THEN score ELSE 0.0 END AS placed FROM rollouts")
def last_token(spark, sf):
    from scenery.operators import batch

    r = batch.with_group(spark_view(spark, sf, "rollouts"), "uid", last=F.max("pos"))
    return r.select("uid", "pos", F.when(F.col("pos") == F.col("last"), F.col("score")).otherwise(0.0).alias("placed"))


_Q = """questions AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE concat('Where is it? ', text) END AS question, CASE WHEN conv_id % 2 = 0 THEN 'position_cam_obj' ELSE 'object_size' END AS task FROM conversations)"""


@query("p09_question_issues", f"WITH {_Q}" + """ SELECT conv_id, turn, concat_ws('|', CASE WHEN length(trim(question)) < 10 THEN 'Question is too short' END, CASE WHEN NOT contains(question,'?') THEN 'Question is missing a question mark' END,
  CASE WHEN contains(task,'position') AND NOT regexp_matches(lower(question), 'left|right|front|back|behind|where|direction') THEN 'Position task is missing direction-related wording' END) AS issues,
  round(greatest(0.2, least(1.0, 1.0 - 0.05*(turn%3) - 0.01*(CAST(length(trim(question)) < 10 AS INT) + CAST(NOT contains(question,'?') AS INT) + CAST(contains(task,'position') AND NOT regexp_matches(lower(question), 'left|right|front|back|behind|where|direction') AS INT)))), 6) AS confidence FROM questions""")
def question_issues(spark, sf):
    """P9 and F32."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    q = spark.sql("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE concat('Where is it? ', text) END AS question, CASE WHEN conv_id % 2 = 0 THEN 'position_cam_obj' ELSE 'object_size' END AS task FROM {c}", c=c)
    issues = text.question_issues(F.col("question"), F.col("task"))
    return q.select("conv_id", "turn", F.array_join(issues, "|").alias("issues"), F.round(text.confidence((F.col("turn") % 3).cast("int"), F.size(issues)), 6).alias("confidence"))


@query("p06_null_like", "SELECT DISTINCT l_returnflag, l_linestatus, lower(trim(l_returnflag)) IN ('','null','none','unknown','n/a') OR l_returnflag IS NULL AS blank, lower(trim(l_returnflag)) = lower(trim(l_linestatus)) AS same FROM lineitem")
def null_like(spark, sf):
    """P6 and P7."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus").distinct()
    return li.select("l_returnflag", "l_linestatus", lookup.is_null_like(F.col("l_returnflag")).alias("blank"), lookup.same_label(F.col("l_returnflag"), F.col("l_linestatus")).alias("same"))


@query("j11_canonical_labels", "WITH d(raw, canonical) AS (VALUES ('l0','chair'),('l1','table'),('l2','sofa')) SELECT vec_id, coalesce(canonical,'unknown') AS canonical FROM embeddings LEFT JOIN d ON raw = concat('l', label)")
def canonical(spark, sf):
    """Labels through a small dimension with a default."""
    d = spark.createDataFrame([("l0", "chair"), ("l1", "table"), ("l2", "sofa")], "raw string, canonical string")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.concat(F.lit("l"), F.col("label")).alias("label"))
    return lookup.canonical_labels(e, d).select("vec_id", "canonical")


@query("f25_json_field", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_field(spark, sf):
    """an optional field of a JSON text."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("f28_label_counts", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1,2) SELECT source, string_agg(concat(lang, ' x', CAST(n AS VARCHAR)), ', ' ORDER BY lang) AS line FROM c GROUP BY source")
def label_counts(spark, sf):
    """label counts as a line of text."""
    c = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat(x["lang"], F.lit(" x"), x["n"].cast("string"))), ", ")
    return c.groupBy("source").agg(line.alias("line"))


@query("x12_checkpoint_retention", "WITH s AS (SELECT o_orderkey AS step, o_totalprice AS score FROM orders), k AS (SELECT *, row_number() OVER (ORDER BY step DESC) AS r, row_number() OVER (ORDER BY score DESC, step) AS b FROM s) SELECT step FROM k WHERE r <= 2 OR b = 1")
def retention(spark, sf):
    """The latest two and the best."""
    s = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("score"))
    latest = s.orderBy(F.desc("step")).limit(2)
    best = s.orderBy(F.desc("score"), "step").limit(1)
    return latest.union(best).select("step").distinct()


_ITEM_WORDS = r"""pools AS (SELECT DISTINCT pool_id, label FROM (SELECT item_id % 16 AS pool_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS label FROM benchmark) WHERE length(label) >= 5),
said AS (SELECT conv_id, turn, lower(text) AS t, (conv_id * 7 + turn) % 16 AS pool_id FROM conversations)"""


@query("f10_text_mentions", "WITH " + _ITEM_WORDS + """
SELECT conv_id, turn, said.pool_id, coalesce(string_agg(label, ',' ORDER BY instr(t, label), label), '') AS named FROM said LEFT JOIN pools ON pools.pool_id = said.pool_id AND contains(t, label) GROUP BY conv_id, turn, said.pool_id, t""")
def text_mentions(spark, sf):
    """F10 on free text: which words of sixteen pools of benchmark items a turn of a conversation names, in order, by one automaton a pool."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    pools = read("benchmark").select((F.col("item_id") % 16).alias("pool_id"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("label")).where(F.length("label") >= 5).distinct()
    said = read("conversations").select("conv_id", "turn", "text", ((F.col("conv_id") * 7 + F.col("turn")) % 16).alias("pool_id"))
    return mentions.named(said, pools).select("conv_id", "turn", "pool_id", F.array_join("named", ",").alias("named"))


@query("j14_closest_words")
def closest_words(spark, sf):
    """Of every word of a turn of a conversation the closest word of the benchmark's items, at a ratio of 0.8; no SQL form, held against all pairs in the tests."""
    word = lambda t, name: spark.read.parquet(f"{sf}/{t}.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias(name)).where(F.length(name) >= 4).distinct()
    return similar.closest(word("conversations", "name"), word("benchmark", "other"), 0.8)


_SAID = """said AS (SELECT uid, pos, CASE WHEN pos % 4 = 0 THEN concat('  ', CAST(length AS STRING), '.5 meters') WHEN pos % 4 = 1 THEN concat('about -', CAST(length AS STRING), ' of 7') WHEN pos % 4 = 2 THEN CAST(length AS STRING) ELSE 'none at all' END AS answer FROM rollouts)"""


@query("f23_first_numbers", with_views("rollouts", rest=_SAID) + r"SELECT uid, pos, answer, try_cast(regexp_split_to_array(trim(answer), '\s+')[1] AS DOUBLE) AS first_number, try_cast(nullif(regexp_extract(answer, '(-?\d+)', 1), '') AS BIGINT) AS first_integer FROM said")
def first_numbers(spark, sf):
    """the first word of an answer as a number, and the first integer that stands in it."""
    return _sub(spark, sf, _SAID).select("uid", "pos", "answer", text.first_number(F.col("answer")).alias("first_number"), text.first_integer(F.col("answer")).alias("first_integer"))
