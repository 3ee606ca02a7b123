"""Batches of responses: advantages, metrics, schedules and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scenery.functions.geometry import tidy
from scenery.operators import batch, votes
from scenery.plans.catalogue import query
from scenery.plans.q_etl import TASKS
from scenery.session import scratch
from scenery.sources.adapters import spark_view, with_views
from scenery.streaming import scheduler

R = with_views("rollouts")


def rollouts(spark, sf):
    return spark_view(spark, sf, "rollouts")


def _w(rest: str) -> str:
    return with_views("rollouts", rest=rest)


@query("w01_grpo", _w("s AS (SELECT *, avg(score) OVER g AS m, stddev_samp(score) OVER g AS d, count(*) OVER g AS n FROM rollouts WINDOW g AS (PARTITION BY uid))") + "SELECT uid, pos, round((score-m)/(d+1e-6), 5) + 0.0 AS advantage FROM s WHERE n > 1")
def w_grpo(spark, sf):
    """Scores of a group on mean 0 and deviation 1."""
    return batch.grpo(rollouts(spark, sf)).select("uid", "pos", tidy(F.col("advantage"), 5).alias("advantage"))


@query("w02_rloo", _w("s AS (SELECT *, sum(score) OVER g AS t, count(*) OVER g AS n FROM rollouts WINDOW g AS (PARTITION BY uid))") + "SELECT uid, pos, round(score-(t-score)/(n-1), 6) + 0.0 AS advantage FROM s WHERE n > 1")
def w_rloo(spark, sf):
    return batch.rloo(rollouts(spark, sf)).select("uid", "pos", tidy(F.col("advantage")).alias("advantage"))


@query("w03_grpo_passk", _w("s AS (SELECT *, stddev_samp(score) OVER (PARTITION BY uid) AS d, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER g AS rn, lead(score) OVER g AS nx FROM rollouts WINDOW g AS (PARTITION BY uid ORDER BY score DESC, pos))") + "SELECT uid, pos, round(CASE WHEN rn = 1 THEN (score-nx)/(d+1e-6) ELSE score END, 5) + 0.0 AS advantage FROM s WHERE n > 1")
def w_passk(spark, sf):
    """W3 and O3."""
    return batch.pass_at_k(rollouts(spark, sf)).select("uid", "pos", tidy(F.col("advantage"), 5).alias("advantage"))


@query("w04_remax", _w("b AS (SELECT uid, avg(value) AS baseline, sum(reward) AS t FROM rollouts GROUP BY uid)") + "SELECT r.uid, pos, round(sum(reward) OVER (PARTITION BY r.uid ORDER BY pos DESC ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS returns, round(t - baseline, 6) + 0.0 AS advantage FROM rollouts r JOIN b ON r.uid = b.uid")
def w_remax(spark, sf):
    r = rollouts(spark, sf)
    return batch.remax(r, r.groupBy("uid").agg(F.avg("value").alias("baseline"))).select("uid", "pos", tidy(F.col("returns")).alias("returns"), tidy(F.col("advantage")).alias("advantage"))


@query("w05_reinforce_returns", _w("""m AS (SELECT uid, pos, reward, CAST(is_valid AS INT) AS mask FROM rollouts), l AS (SELECT uid, list(reward ORDER BY pos) AS r, list(mask ORDER BY pos) AS k FROM m GROUP BY uid),
  u AS (SELECT uid, r, k, unnest(range(1, len(r)+1)) AS pos FROM l)""") + """SELECT uid, CAST(pos AS INT) AS pos, round(list_sum(list_transform(range(CAST(pos AS BIGINT), len(r)+1), lambda j: r[j] * power(0.9, j-pos) * CASE WHEN list_contains(k[pos+1:j], 0) THEN 0.0 ELSE 1.0 END)), 9) + 0.0 AS returns FROM u""")
def w_returns(spark, sf):
    """Discounted returns, cut at masked tokens. At most seven tokens of hundredths: nine places hold every value."""
    r = rollouts(spark, sf).withColumn("mask", F.col("is_valid").cast("int"))
    s = batch.sequences(r, "uid", "pos", rewards="reward", mask="mask")
    out = s.select("uid", F.posexplode(batch.discounted("rewards", "mask", 0.9)).alias("i", "v"))
    return out.select("uid", (F.col("i") + 1).alias("pos"), tidy(F.col("v"), 9).alias("returns"))


@query("w06_gae", _w("""f AS (SELECT uid, pos, reward AS r, value AS v, is_valid AS m, row_number() OVER (PARTITION BY uid ORDER BY pos DESC) AS k FROM rollouts)""").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
g(uid, pos, k, nx, adv) AS (SELECT uid, pos, k, CASE WHEN m THEN v ELSE 0.0::DOUBLE END, CASE WHEN m THEN (r + 0.99::DOUBLE * 0.0 - v) + 0.99::DOUBLE * 0.95 * 0.0 ELSE 0.0::DOUBLE END FROM f WHERE k = 1
  UNION ALL SELECT f.uid, f.pos, f.k, CASE WHEN f.m THEN f.v ELSE g.nx END, CASE WHEN f.m THEN (f.r + 0.99::DOUBLE * g.nx - f.v) + 0.99::DOUBLE * 0.95 * g.adv ELSE g.adv END FROM g JOIN f ON f.uid = g.uid AND f.k = g.k + 1)
SELECT uid, pos, round(adv, 6) + 0.0 AS advantage FROM g""")
def w_gae(spark, sf):
    """Generalised advantages by a fold over each sequence."""
    r = rollouts(spark, sf).withColumn("mask", F.col("is_valid").cast("int"))
    s = batch.sequences(r, "uid", "pos", rewards="reward", values="value", mask="mask")
    out = s.select("uid", F.posexplode(batch.gae("rewards", "values", "mask", 0.99, 0.95)).alias("i", "v"))
    return out.select("uid", (F.col("i") + 1).alias("pos"), tidy(F.col("v")).alias("advantage"))


@query("w07_whiten", _w("k AS (SELECT sum(m) AS n, sum(score*m) AS x, sum(score*score*m) AS xx FROM (SELECT score, CAST(is_valid AS DOUBLE) AS m FROM rollouts)), s AS (SELECT x/(n+1e-8) AS mean, (xx - 2*x/(n+1e-8)*x + x/(n+1e-8)*x/(n+1e-8)*n)/(n+1e-8)*n/(n-1) AS var FROM k)") + "SELECT uid, pos, round((score-mean)/sqrt(var+1e-8), 5) + 0.0 AS white FROM rollouts, s")
def w_whiten(spark, sf):
    out = batch.whiten(rollouts(spark, sf).withColumn("white", F.col("score")), "white", "is_valid")
    return out.select("uid", "pos", tidy(F.col("white"), 5).alias("white"))


@query("w08_response_mask", _w("e AS (SELECT *, coalesce(sum(CASE WHEN length = 50 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM rollouts)") + "SELECT uid, pos, CASE WHEN ended = 0 THEN 1 ELSE 0 END AS mask FROM e")
def w_mask(spark, sf):
    """1 through the first end token (here a length of 50)."""
    s = batch.sequences(rollouts(spark, sf), "uid", "pos", ids="length").select("uid", F.posexplode(batch.response_mask("ids", 50)).alias("i", "mask"))
    return s.select("uid", (F.col("i") + 1).alias("pos"), "mask")


@query("w10_dedup_weight", R + "SELECT uid, response, min(pos) AS pos, count(*) AS duplicate_weight FROM rollouts GROUP BY uid, response")
def w_dedup(spark, sf):
    """The first of equal responses of a group, with its weight."""
    return batch.dedup_first(rollouts(spark, sf).select("uid", "response", "pos"), ["uid", "response"], "pos")


@query("w12_type_frequency", R + "SELECT task, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 9) AS frequency FROM rollouts GROUP BY task")
def w_frequency(spark, sf):
    c = rollouts(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return c.select("task", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9).alias("frequency"))


@query("w13_even_sample", _w("n AS (SELECT uid, pos, row_number() OVER (PARTITION BY uid ORDER BY pos)-1 AS i, count(*) OVER (PARTITION BY uid) AS n FROM rollouts)") + "SELECT uid, pos, CAST(i AS INT) AS sample_index FROM n WHERE n <= 3 OR i IN (0, CAST(round_even((n-1)/2.0, 0) AS BIGINT), n-1)")
def w_sample(spark, sf):
    """Three evenly spaced rows of each group, halves rounded to even."""
    return batch.even_sample(rollouts(spark, sf).select("uid", "pos"), "uid", "pos", 3).select("uid", "pos", "sample_index")


@query("w14_interleave", _w("s AS (SELECT uid, pos, is_valid, row_number() OVER (PARTITION BY uid, is_valid ORDER BY pos)-1 AS k FROM rollouts)") + "SELECT uid, pos, CAST(row_number() OVER (PARTITION BY uid ORDER BY k, is_valid DESC) AS INT) AS turn FROM s")
def w_interleave(spark, sf):
    """Real and padding rows of a group in turn."""
    k = F.row_number().over(Window.partitionBy("uid", "is_valid").orderBy("pos")) - 1
    s = rollouts(spark, sf).withColumn("k", k)
    return s.select("uid", "pos", F.row_number().over(Window.partitionBy("uid").orderBy("k", F.desc("is_valid"))).alias("turn"))


@query("p15_online_filter", _w("k AS (SELECT uid FROM rollouts GROUP BY uid HAVING avg(score) > 0.3333 AND avg(score) < 0.6123)") + "SELECT uid, pos, score FROM rollouts WHERE uid IN (SELECT uid FROM k)")
def p_online(spark, sf):
    """P15 and J16."""
    return batch.keep_between(rollouts(spark, sf), "uid", "score", 0.3333, 0.6123).select("uid", "pos", "score")


@query("p16_overlong", R + "SELECT uid, pos, length FROM rollouts WHERE length <= 40")
def p_overlong(spark, sf):
    return rollouts(spark, sf).where("length <= 40").select("uid", "pos", "length")


@query("a21_metric_means", R + "SELECT task, round(avg(coalesce(CASE WHEN is_valid THEN score END, 0)), 6) AS mean_score FROM rollouts GROUP BY task")
def a_means(spark, sf):
    """A metric that is missing counts as nought."""
    return rollouts(spark, sf).groupBy("task").agg(F.round(F.avg(F.coalesce(F.when(F.col("is_valid"), F.col("score")), F.lit(0.0))), 6).alias("mean_score"))


@query("a22_length_metrics", R + "SELECT round(avg(length), 6) AS mean_length, max(length) AS max_length, min(length) AS min_length, round(avg(CASE WHEN length = 50 THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio, round(1 - var_samp(reward-value)/(var_samp(reward)+1e-5), 5) AS explained FROM rollouts")
def a_lengths(spark, sf):
    """Lengths, clip ratio and explained variance."""
    explained = 1 - F.var_samp(F.col("reward") - F.col("value")) / (F.var_samp("reward") + 1e-5)
    return rollouts(spark, sf).agg(
        F.round(F.avg("length"), 6).alias("mean_length"), F.max("length").alias("max_length"), F.min("length").alias("min_length"), F.round(F.avg(F.when(F.col("length") == 50, 1.0).otherwise(0.0)), 6).alias("clip_ratio"), F.round(explained, 5).alias("explained")
    )


@query("a23_throughput", R + "SELECT task, sum(length)::BIGINT AS tokens, round(1000.0*sum(value)/sum(length), 6) AS ms_per_token, round(sum(length)/(sum(value)*8), 4) AS tokens_per_s FROM rollouts GROUP BY task")
def a_throughput(spark, sf):
    t, s = F.sum("length"), F.sum("value")
    return rollouts(spark, sf).groupBy("task").agg(t.cast("long").alias("tokens"), F.round(1000.0 * s / t, 6).alias("ms_per_token"), F.round(t / (s * 8), 4).alias("tokens_per_s"))


@query("a24_type_rewards", R + "SELECT task, count(*) AS n, round(avg(score), 6) AS mean_reward FROM rollouts WHERE pos <= 4 GROUP BY task")
def a_types(spark, sf):
    """Rewards by type without padding rows (here those after the fourth)."""
    return rollouts(spark, sf).where("pos <= 4").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_reward"))


@query("a25_type_counter", R + "SELECT task, count(*) AS total, count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid, round(count(*) FILTER (NOT is_valid) * 1.0 / count(*), 6) AS invalid_ratio FROM rollouts GROUP BY task")
def a_counter(spark, sf):
    """A25, A28 and A31."""
    v = F.count_if(F.col("is_valid"))
    n = F.count(F.lit(1))
    return rollouts(spark, sf).groupBy("task").agg(n.alias("total"), v.alias("valid"), (n - v).alias("invalid"), F.round((n - v) / n, 6).alias("invalid_ratio"))


@query("a26_diversity", _w("d AS (SELECT uid, count(DISTINCT response) AS k FROM rollouts GROUP BY uid)") + "SELECT round(avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END), 6) AS two_or_more, round(avg(CASE WHEN k >= 3 THEN 1.0 ELSE 0.0 END), 6) AS three_or_more FROM d")
def a_diversity(spark, sf):
    d = rollouts(spark, sf).groupBy("uid").agg(F.countDistinct("response").alias("k"))
    share = lambda k: F.round(F.avg(F.when(F.col("k") >= k, 1.0).otherwise(0.0)), 6)
    return d.agg(share(2).alias("two_or_more"), share(3).alias("three_or_more"))


@query("a29_majority_vote", _w("c AS (SELECT uid, response, count(*) AS n, min(pos) AS first FROM rollouts GROUP BY 1,2), r AS (SELECT *, sum(n) OVER (PARTITION BY uid) AS t, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS k FROM c)") + "SELECT uid, response AS answer, round(n*1.0/t, 6) AS score FROM r WHERE k = 1")
def a_majority(spark, sf):
    """A29 with exact equivalence: the most frequent response, the first seen of equals."""
    c = rollouts(spark, sf).groupBy("uid", "response").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = c.groupBy("uid").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "response")).alias("m"), F.sum("n").alias("t"))
    return best.select("uid", F.col("m.response").alias("answer"), F.round(F.col("m.n") / F.col("t"), 6).alias("score"))


# Forms of a number of quarters, with their SQL: a decimal, a fraction, a set fraction, a length, a sum of money; and two ways to say that there is none.
_FORMS = """v AS (SELECT uid, pos, CAST(length AS INT) % 4 AS k, CAST(length AS INT) % 7 AS form, score FROM rollouts),
a AS (SELECT uid, pos, CASE WHEN form = 6 THEN '' WHEN form = 5 THEN 'No object' WHEN form = 4 AND k > 1 THEN 'there is no match' ELSE CAST(k AS VARCHAR) END AS class,
  CASE WHEN form = 0 THEN concat('0.', lpad(CAST(25 * k AS VARCHAR), 2, '0')) WHEN form = 1 THEN concat(CAST(2 * k AS VARCHAR), '/8') WHEN form = 2 THEN concat(chr(92), 'frac{', CAST(k AS VARCHAR), '}{4}')
    WHEN form = 3 THEN concat(CAST(25 * k AS VARCHAR), 'e-2 meters') WHEN form = 4 AND k <= 1 THEN concat('$.', lpad(CAST(25 * k AS VARCHAR), 2, '0'), '$') WHEN form = 4 THEN 'there is no match' WHEN form = 5 THEN 'No object' ELSE '' END AS answer FROM v)"""


def equal_forms(spark, sf):
    """Responses that state a number of quarters in five forms, say that there is none, or are empty."""
    k = F.col("length").cast("int") % 4
    form = F.col("length").cast("int") % 7
    cents = F.lpad((25 * k).cast("string"), 2, "0")
    answer = (
        F.when(form == 0, F.concat(F.lit("0."), cents)).when(form == 1, F.concat(2 * k, F.lit("/8"))).when(form == 2, F.concat(F.lit("\\frac{"), k, F.lit("}{4}")))
        .when(form == 3, F.concat(25 * k, F.lit("e-2 meters"))).when((form == 4) & (k <= 1), F.concat(F.lit("$."), cents, F.lit("$")))
        .when(form == 4, "there is no match").when(form == 5, "No object").otherwise("")
    )
    return rollouts(spark, sf).select("uid", "pos", answer.alias("answer"))


@query("a29_equal_votes", _w(_FORMS + """, c AS (SELECT uid, CASE WHEN lower(answer) LIKE '%no %' THEN 'no' ELSE class END AS class, count(*) AS n, min(pos) AS first, arg_min(answer, pos) AS answer FROM a WHERE answer <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, first) AS k FROM c), t AS (SELECT uid, count(*) AS total FROM a GROUP BY 1)""") + "SELECT t.uid, coalesce(r.answer, '') AS answer, coalesce(r.n, 0) AS votes, round(coalesce(r.n, 0) * 1.0 / total, 6) AS score FROM t LEFT JOIN r ON r.uid = t.uid AND r.k = 1")
def a_equal_votes(spark, sf):
    """Votes over answers of equal value; the twin knows each answer's value, not its text."""
    return votes.majority(equal_forms(spark, sf), "uid", "pos", "answer").withColumn("score", F.round("score", 6))


# The tasks whose accuracy counts in full from a half on.
ACCURACY_TARGETS = {"absolute_distance": 0.5, "distance_cam_obj": 0.5, "room_size": 0.5}
_TASKS = "'" + "','".join(t for _, t in TASKS) + "'"
_SCHED = f"""q AS (SELECT uid, pos, [{_TASKS}][1 + task] AS task, is_valid, CASE WHEN length % 5 <> 0 THEN score END AS accuracy, CAST(length % 4 AS DOUBLE) AS duplicate_weight, length % 11 = 0 AS is_padding FROM rollouts),
l AS (SELECT * FROM q WHERE NOT is_padding), h AS (SELECT uid, arg_min(task, pos) AS task, greatest(1.0, arg_min(duplicate_weight, pos)) AS w, avg(CASE WHEN is_valid THEN accuracy ELSE 0 END) AS acc FROM l GROUP BY uid),
t AS (SELECT task, sum(w) AS n, sum(acc * w) AS a, sum(least(1.0, greatest(0.0, least(1.0, greatest(0.0, acc)) / CASE WHEN task IN ('absolute_distance','distance_cam_obj','room_size') THEN 0.5 ELSE 1.0 END)) * w) AS s FROM h WHERE acc IS NOT NULL GROUP BY 1)"""


def task_rows(spark, sf):
    name = F.element_at(F.array(*[F.lit(t) for _, t in TASKS]), F.col("task") + 1)
    return rollouts(spark, sf).withColumns({"task": name, "accuracy": F.when(F.col("length") % 5 != 0, F.col("score")), "duplicate_weight": (F.col("length") % 4).cast("double"), "is_padding": F.col("length") % 11 == 0})


def task_statistics(spark, sf):
    return batch.scheduler_statistics(task_rows(spark, sf), ACCURACY_TARGETS)


@query("a30_scheduler_stats", _w(_SCHED) + "SELECT task, n, round(a, 5) AS acc_sum, round(s, 5) AS scheduler_acc_sum FROM t")
def a_scheduler(spark, sf):
    """Accuracy of each question, weighted by how many it stands for, summed by task, as it is and remapped."""
    return task_statistics(spark, sf).select("task", "n", F.round("acc_sum", 5).alias("acc_sum"), F.round("scheduler_acc_sum", 5).alias("scheduler_acc_sum"))


def stream_files(rows: int, most: int = 2_000_000, at_once: int = 8) -> tuple[int, int]:
    """Files of each half of a stream, two at least and of about `most` rows, and how many make a micro-batch: half of them, up to `at_once`."""
    count = max(2, -(-rows // (2 * most)))
    return count, min(at_once, -(-count // 2))


@query("a30_stream_state", _w(_SCHED + ", k AS (SELECT task, count(*) AS total, count(*) FILTER (is_valid) AS valid FROM q GROUP BY 1), b AS (SELECT k.task, total, valid, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(s, 0) AS s FROM k LEFT JOIN t ON t.task = k.task)") + "SELECT task, total, valid, n, round(a, 5) AS acc_sum, round(s, 5) AS scheduler_acc_sum, round(greatest(0.05, 1 - (s + 0.35*2)/(n+2)), 6) AS weight FROM b")
def a_stream(spark, sf):
    """A25, A30 and R21 over a stream: files of whole questions in micro-batches, a stop in the middle, and on from the checkpoint."""
    rows = task_rows(spark, sf).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in scheduler.ROWS.split(", ")])
    source, out, checkpoint = (scratch(spark, f"scheduler-{k}") for k in ("in", "out", "state"))
    half = F.pmod(F.xxhash64(F.lit("half"), "uid"), F.lit(2))
    count, files = stream_files(spark.read.parquet(f"{sf}/lineitem.parquet").count())
    for k in range(2):
        rows.where(half == k).repartition(count, "uid").write.mode("append").parquet(source)
        scheduler.follow(spark, source, out, checkpoint, ACCURACY_TARGETS, buckets=16, files=files).awaitTermination()
    found = batch.sampling_weights(scheduler.statistics(spark, out))
    return found.select("task", "total", "valid", "n", F.round("acc_sum", 5).alias("acc_sum"), F.round("scheduler_acc_sum", 5).alias("scheduler_acc_sum"), F.round("weight", 6).alias("weight"))


@query("r21_scheduler_weights", _w(_SCHED + ", w AS (SELECT task, greatest(0.05, 1 - (s + 0.35*2)/(n+2)) AS w FROM t)") + "SELECT task, round(w, 6) AS weight, round(w/sum(w) OVER (), 6) AS probability FROM w")
def r_weights(spark, sf):
    """Smoothed sampling weights of the tasks and their probabilities."""
    return batch.sampling_weights(task_statistics(spark, sf)).select("task", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


_DRAW = """, w AS (SELECT task, greatest(0.05, 1 - (s + 0.35*2)/(n+2)) AS w FROM t), c AS (SELECT task, sum(w) OVER (ORDER BY task) / sum(w) OVER () AS high, (sum(w) OVER (ORDER BY task) - w) / sum(w) OVER () AS low FROM w),
d AS (SELECT o_orderkey, CAST(concat('0x', substr(md5(concat('7|', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM orders)"""


@query("r23_task_draw", _w(_SCHED + _DRAW) + "SELECT o_orderkey, task FROM d JOIN c ON u >= low AND u < high")
def r_draw(spark, sf):
    """A task for every request, drawn by a seeded hash from the weights."""
    requests = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return batch.draw(requests, "o_orderkey", batch.sampling_weights(task_statistics(spark, sf)), "task", 7)


@query("a32_selected_tasks", _w("f AS (SELECT uid, arg_min(task, pos) AS task FROM rollouts GROUP BY uid)") + "SELECT task, count(*) AS n FROM f GROUP BY task")
def a_selected(spark, sf):
    return rollouts(spark, sf).groupBy("uid").agg(F.min_by("task", "pos").alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("a33_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a_status(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a35_length_balance", _w("c AS (SELECT uid, CAST(floor((pos-1)/4) AS INT) AS part, sum(length) AS t FROM rollouts GROUP BY 1,2)") + "SELECT min(t)::BIGINT AS smallest, max(t)::BIGINT AS largest, round(avg(t), 6) AS mean FROM c")
def a_balance(spark, sf):
    c = rollouts(spark, sf).groupBy("uid", F.floor((F.col("pos") - 1) / 4).alias("part")).agg(F.sum("length").alias("t"))
    return c.agg(F.min("t").alias("smallest"), F.max("t").alias("largest"), F.round(F.avg("t"), 6).alias("mean"))


@query("a36_flops", R + "SELECT task, round((6.0*3e9*sum(length) + 12.0*36*128*16*sum(length*length)) / 1e12, 4) AS teraflops FROM rollouts GROUP BY task")
def a_flops(spark, sf):
    """A linear term and one in the squares of the lengths."""
    n, sq = F.sum("length"), F.sum(F.col("length") * F.col("length"))
    return rollouts(spark, sf).groupBy("task").agg(F.round((6.0 * 3e9 * n + 12.0 * 36 * 128 * 16 * sq) / 1e12, 4).alias("teraflops"))


@query("u07_repeat", R + "SELECT uid, pos, CAST(c AS INT) AS copy FROM rollouts, range(3) t(c)")
def u_repeat(spark, sf):
    return batch.repeat(rollouts(spark, sf).select("uid", "pos"), 3)


@query("u08_chunk", "SELECT n_nationkey, CAST(floor(n_nationkey/5) AS INT) AS part FROM nation")
def u_chunk(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", batch.chunk(F.col("n_nationkey"), 25, 5).alias("part"))


@query("u10_pad", "WITH k AS (SELECT count(*) AS c FROM nation) SELECT n_nationkey AS pos, n_name, false AS is_padding FROM nation UNION ALL SELECT c + n_nationkey, n_name, true FROM nation, k WHERE n_nationkey < (32 - c % 32) % 32")
def u_pad(spark, sf):
    """The rows padded to a multiple of 32 with the leading ones."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("pos"), "n_name")
    return batch.pad_to_divisor(n, "pos", n.count(), 32)


_GROUPS = "g AS (SELECT uid, dense_rank() OVER (ORDER BY uid) - 1 AS i FROM rollouts GROUP BY uid), k AS (SELECT count(*) AS c FROM g), f AS (SELECT r.uid, r.pos, r.score, i, c FROM rollouts r JOIN g ON g.uid = r.uid, k)"


@query("u11_group_padding", _w(_GROUPS) + "SELECT uid, pos, -1 AS copy, false AS is_padding, 1 AS weight, round(score, 6) AS score FROM f UNION ALL SELECT uid, pos, CAST(0 AS INT), true, 0, 0.0 FROM f WHERE i < ((-c % 96) + 96) % 96")
def u_groups(spark, sf):
    """Whole leading groups again until the number of groups divides by 32 workers and batches of 3; padding weighs and scores nothing."""
    out = batch.pad_groups(rollouts(spark, sf).select("uid", "pos", "score"), "uid", 32, 3, ["score"])
    return out.select("uid", "pos", "copy", "is_padding", "weight", F.round("score", 6).alias("score"))


@query("u09_reorder", R + "SELECT uid, pos, CAST(row_number() OVER (PARTITION BY uid ORDER BY length DESC, pos) AS INT) AS place FROM rollouts")
def u_reorder(spark, sf):
    """A permutation of each group by falling length, and its inverse."""
    return rollouts(spark, sf).select("uid", "pos", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("length"), "pos")).alias("place"))


@query("u12_fold", R + "SELECT uid, CAST(floor((pos-1)/2) AS BIGINT) AS part, string_agg(response, '' ORDER BY pos) AS folded FROM rollouts GROUP BY 1,2")
def u_fold(spark, sf):
    f = rollouts(spark, sf).groupBy("uid", F.floor((F.col("pos") - 1) / 2).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "response"))).alias("s"))
    return f.select("uid", "part", F.array_join(F.col("s.response"), "").alias("folded"))


@query("r24_length_partition")
def r_partition(spark, sf):
    """Largest differencing over the rows of a batch; the tests compare sums with an exhaustive search."""
    r = rollouts(spark, sf).select("uid", "pos", "length")
    return batch.balance(r, "uid", "length", "pos", 2).select("uid", "pos", "length", "part")


@query("r25_micro_batches", R + "SELECT uid, CAST(ceil(sum(length)/100.0) AS INT) AS n_micro FROM rollouts GROUP BY uid")
def r_micro(spark, sf):
    """Number of micro-batches that a budget of 100 tokens asks for."""
    return rollouts(spark, sf).groupBy("uid").agg(F.ceil(F.sum("length") / 100.0).cast("int").alias("n_micro"))


@query("r16_kl", R + """SELECT uid, pos, round(reward-value, 6) + 0.0 AS kl, round(abs(reward-value), 6) AS absolute, round(0.5*(reward-value)*(reward-value), 8) AS mse,
  round(greatest(-10.0, least(10.0, exp(greatest(-20.0, least(20.0, value-reward))) - (value-reward) - 1)), 8) + 0.0 AS low_var, round(score - 0.1*(reward-value), 6) + 0.0 AS penalised FROM rollouts""")
def r_kl(spark, sf):
    """Estimators of divergence from two log-probabilities, and the reward less its share."""
    from scenery.functions import rewards

    c = F.col
    kinds = {k: rewards.kl(c("reward"), c("value"), k) for k in ("kl", "abs", "mse", "low_var_kl")}
    return rollouts(spark, sf).select(
        "uid", "pos", tidy(kinds["kl"]).alias("kl"), F.round(kinds["abs"], 6).alias("absolute"), F.round(kinds["mse"], 8).alias("mse"), tidy(kinds["low_var_kl"], 8).alias("low_var"), tidy(c("score") - 0.1 * kinds["kl"]).alias("penalised")
    )


@query("r18_loss_averages", _w("s AS (SELECT uid, avg(reward) AS m FROM rollouts GROUP BY uid)") + "SELECT round((SELECT avg(reward) FROM rollouts), 8) AS token_mean, round((SELECT avg(m) FROM s), 8) AS sequence_mean")
def r_averages(spark, sf):
    """A mean over tokens, and over sequences' means, in one pass."""
    s = rollouts(spark, sf).groupBy("uid").agg(F.sum("reward").alias("t"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.round(F.sum("t") / F.sum("n"), 8).alias("token_mean"), F.round(F.avg(F.col("t") / F.col("n")), 8).alias("sequence_mean"))


@query("r19_policy_loss", _w("k AS (SELECT uid, pos, exp(greatest(-20.0, least(20.0, reward-value))) AS ratio, score - 0.4 AS adv FROM rollouts)") + """SELECT uid, pos, round(CASE WHEN adv < 0 THEN least(greatest(-adv*ratio, -adv*greatest(0.8, least(1.2, ratio))), -adv*3.0) ELSE greatest(-adv*ratio, -adv*greatest(0.8, least(1.2, ratio))) END, 6) + 0.0 AS loss,
  -adv*ratio < -adv*greatest(0.8, least(1.2, ratio)) AS clipped FROM k""")
def r_policy(spark, sf):
    """The clipped and doubly clipped loss of each token."""
    from scenery.functions import rewards

    k = rollouts(spark, sf).select("uid", "pos", F.col("reward"), F.col("value"), (F.col("score") - 0.4).alias("adv"))
    loss, clipped = rewards.policy_loss(F.col("reward"), F.col("value"), F.col("adv"))
    return k.select("uid", "pos", tidy(loss).alias("loss"), clipped.alias("clipped"))


@query("x05_registered_advantage", _w("s AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY uid) AS m FROM rollouts)") + "SELECT uid, pos, round(score - m, 6) + 0.0 AS advantage FROM s")
def registered_advantage(spark, sf):
    """An estimator that a user registers by name, here the lead over the group's median, is found and run like the others."""
    if "median_lead" not in batch.ADVANTAGES:

        @batch.register_advantage("median_lead")
        def median_lead(rows, key="uid", score="score"):
            return batch.with_group(rows, key, __m=F.median(score)).withColumn("advantage", F.col(score) - F.col("__m")).drop("__m")

    return batch.ADVANTAGES["median_lead"](rollouts(spark, sf)).select("uid", "pos", tidy(F.col("advantage")).alias("advantage"))
