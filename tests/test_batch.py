"""Batches, texts and rewards against plain loops and known cases."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from scenery.functions import fuzzy, rewards, text
from scenery.operators import batch, hulls
from scenery.sources.adapters import spark_view


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_pad_and_unpad(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, v string")
    for divisor, n in ((2, 4), (3, 3), (5, 5), (7, 7)):
        padded = batch.pad_to_divisor(rows, "pos", 3, divisor)
        got = [(r["pos"], r["v"]) for r in padded.orderBy("pos").collect()]
        assert got == [(i, "abc"[i % 3]) for i in range(n)]
        assert sorted(r["v"] for r in batch.unpad(padded).collect()) == ["a", "b", "c"]


def test_repeat_and_chunk(spark):
    rows = spark.createDataFrame([(1,), (2,)], "v int")
    got = batch.repeat(rows, 2).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: (r["v"], r["copy"]))] == [1, 1, 2, 2]
    assert [r["v"] for r in sorted(got, key=lambda r: (r["copy"], r["v"]))] == [1, 2, 1, 2]
    with pytest.raises(ValueError):
        batch.chunk(F.col("v"), 6, 5)


def test_group_padding():
    for n, size, world, per in product((1, 5, 96), (1, 4), (1, 8), (1, 3)):
        pad = batch.group_padding(n, size, world, per)
        assert ((n + pad) * size) % world == 0 and (n + pad) % per == 0


def test_advantages_of_a_group_add_up_to_nought(spark, sf):
    r = spark_view(spark, sf, "rollouts")
    worst = batch.grpo(r).groupBy("uid").agg(F.abs(F.sum("advantage")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-6
    assert set(batch.ADVANTAGES) >= {"grpo", "rloo", "grpo_passk"}
    with pytest.raises(ValueError):
        batch.register_advantage("grpo")(lambda rows: rows)


def test_gae_and_returns(spark):
    r, v, m = [1.0, 0.5, 2.0, 0.0], [0.1, 0.2, 0.3, 0.4], [1, 1, 0, 1]
    df = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<int>")
    nxt = adv = 0.0
    want = []
    for t in reversed(range(4)):
        step = r[t] + 0.9 * nxt - v[t] + 0.9 * 0.8 * adv
        if m[t]:
            nxt, adv = v[t], step
        want.append(adv)
    assert df.select(batch.gae("r", "v", "m", 0.9, 0.8).alias("x")).first()["x"] == pytest.approx(want[::-1])
    run, want = 0.0, []
    for t in reversed(range(4)):
        run = r[t] + 0.9 * run
        want.append(run)
        run *= m[t]
    assert df.select(batch.discounted("r", "m", 0.9).alias("x")).first()["x"] == pytest.approx(want[::-1])


def test_response_mask(spark):
    df = spark.createDataFrame([([5, 2, 7, 2],), ([1],), ([2, 2],)], "ids array<int>")
    assert [r[0] for r in df.select(batch.response_mask("ids", 2)).collect()] == [[1, 1, 0, 0], [1], [1, 0]]


def test_even_sample(spark):
    df = spark.range(10).selectExpr("'g' AS g", "id AS i").union(spark.range(2).selectExpr("'h' AS g", "id AS i"))
    got = batch.even_sample(df, "g", "i", 4).collect()
    assert sorted(r["i"] for r in got if r["g"] == "g") == [0, 3, 6, 9] and sum(r["g"] == "h" for r in got) == 2


@pytest.mark.parametrize("lengths", [[8, 7, 6, 5, 4], [1, 1, 1, 9], [3, 3, 3, 3, 3, 3], [10]])
def test_karmarkar_karp(lengths):
    parts = batch.karmarkar_karp(lengths, 2)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    spread = lambda ps: abs(sum(lengths[i] for i in ps[0]) - sum(lengths[i] for i in ps[1]))
    best = min(abs(sum(x if b else -x for x, b in zip(lengths, bits))) for bits in product((0, 1), repeat=len(lengths)))
    assert spread(parts) <= best + max(lengths) / 2
    if len(lengths) % 2 == 0:
        assert {len(p) for p in batch.karmarkar_karp(lengths, 2, equal_size=True)} == {len(lengths) // 2}


def test_small_batches_share_calls(spark):
    """Batches of any size, cut anywhere by Arrow, get the parts of their own lengths; no call a batch."""
    rows = [(None if u == 5 else u, p, (u * 7 + p * p * 5) % 50 + 1) for u in range(40) for p in range(1, 2 + u % 9)]
    df = spark.createDataFrame(rows, "uid int, pos int, length int").repartition(3)
    groups = {}
    for u, _, n in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(u, []).append(n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        two = batch.balance(df, "uid", "length", "pos", 2)
        micro = batch.micro_batches(df, "uid", "length", "pos", 100)
        got, got_micro = {(r["uid"], r["pos"]): r["part"] for r in two.collect()}, micro.collect()
        assert not batch.balance(df.where("false"), "uid", "length", "pos", 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for u, n in groups.items():
        assert [[p - 1 for p in range(1, len(n) + 1) if got[u, p] == k] for k in (0, 1)] == batch.karmarkar_karp(n, 2)
    assert {(r["uid"], r["pos"], r["length"]) for r in got_micro} == set(rows) and len(got_micro) == len(rows)
    assert all(r["origin"] == r["pos"] - 1 for r in got_micro)
    for df in (two, micro):
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("s", "want"),
    [("about 3.5 m", 3.5), ("1,200 cm", 1200.0), ("twenty one hundred", 2100.0), ("two thousand and five", 2005.0), ("forty-two", 42.0), ("none", None), ("", None), ("five apples six", 5.0)],
)
def test_parse_number(spark, s, want):
    assert one(spark, text.parse_number(F.lit(s))) == want


@pytest.mark.parametrize(
    ("s", "motion", "want"),
    [("Front_Left", False, ["front", "left"]), ("frontleft", False, ["front", "left"]), ("it is behind", False, ["back"]), ("leftover", False, []), ("counter clockwise", True, ["left"]), ("clockwise", True, ["right"]), ("above, ahead.", False, ["front", "up"]), (None, False, [])],
)
def test_directions(spark, s, motion, want):
    assert one(spark, text.directions(F.lit(s).cast("string"), motion)) == want


@pytest.mark.parametrize(("s", "want"), [(r"\boxed{1} then \boxed{42}", "42"), ("<answer> x </answer><answer>y</answer>", "y"), ("no", None), (" ", None), (r"<answer>a</answer> \boxed{b}", "b")])
def test_final_answer(spark, s, want):
    assert one(spark, text.final_answer(F.lit(s))) == want


def test_normalise_answer(spark):
    assert one(spark, text.normalise_answer(F.lit(" 42. "))) == "42" and one(spark, text.normalise_answer(F.lit(" A  b"))) == "a b"
    assert one(spark, text.exact_answer(F.lit("The Same-Level."))) == "same level"
    assert one(spark, text.exact_answer(F.lit("same level"))) == "same_level"


def test_answer_format(spark):
    f = lambda s: one(spark, text.answer_format(F.lit(s))["format_score"])
    assert (f("<answer>x</answer>"), f("x"), f("<answer>x</answer><answer>y</answer>"), f("<think>a</think><answer>x</answer>")) == (1.0, 0.0, -1.0, -1.0)


def test_rewards(spark):
    acc = lambda a, b: one(spark, rewards.relative_accuracy(F.lit(a).cast("double"), F.lit(b)))
    assert acc(10.0, 10.0) == 1.0 and acc(20.0, 10.0) == 0.0 and acc(None, 10.0) == 0.0 and acc(11.9, 10.0) == pytest.approx(7 / 11)
    assert [one(spark, rewards.count_reward(F.lit(a), F.lit(5.0))) for a in (5.0, 6.0, 7.0, 8.0)] == [1.0, 0.3, 0.1, 0.0]
    assert [one(spark, rewards.snap(F.lit(x))) for x in (0.1, 0.15, 0.5, 0.9)] == [0.0, 0.0, 0.6, 1.0]
    assert rewards.next_coefficient(1.0, 2.0, 1.0, 10.0, 1) == pytest.approx(1.02)


def test_fuzzy_labels():
    pool = ["coffee table", "office chair", "lamp"]
    assert fuzzy.resolve("Coffee-Table", pool) == "coffee table" and fuzzy.resolve("lamps", pool) == "lamp"
    assert fuzzy.resolve("the lamp there", pool) == "lamp" and fuzzy.resolve("ofice chair", pool) == "office chair" and fuzzy.resolve("zebra", pool) is None


def test_alpha_shape(spark):
    """A square of a grid, and the same with a far point whose triangles are too wide; triangles' circles hold no point."""
    import numpy as np

    grid = np.array([(x / 4, y / 4) for x in range(5) for y in range(5)], float)
    rng = np.random.default_rng(1)
    p = grid + rng.normal(0, 1e-3, grid.shape)
    assert hulls.alpha_area(p) == pytest.approx(1.0, abs=0.02) and hulls.alpha_area(np.vstack([p, [(9.0, 9.0)]])) == pytest.approx(1.0, abs=0.02)
    q = rng.normal(0, 1, (60, 2))
    tri = hulls.triangulate(q)
    circles = hulls._circles(q, tri)
    for t, (x, y, r2) in zip(tri, circles):
        assert (((q - (x, y)) ** 2).sum(axis=1)[np.setdiff1d(range(60), t)] > r2 * (1 - 1e-9)).all()
    assert hulls.alpha_area(q, 1e-6) == pytest.approx(hulls.area(hulls.convex_hull(q)))
    df = spark.createDataFrame([(1, float(x), float(y), 0.0) for x, y in grid], "scene_id int, x double, y double, z double")
    assert hulls.room_area(df).first()["area"] == pytest.approx(1.0, abs=0.02)


def test_hull(spark):
    import numpy as np

    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)], float)
    assert hulls.area(hulls.convex_hull(square)) == 4.0 and hulls.area(hulls.convex_hull(square[:2])) == 0.0
    df = spark.createDataFrame([("s", float(x), float(y), 0.0) for x, y in square] + [("s", 9.0, 9.0, 3.0)], "scene_id string, x double, y double, z double")
    assert hulls.room_area(df, alpha=None).first()["area"] == 4.0
