"""The similarity join against all pairs: every label and typos of each, at several cutoffs, with and without groups."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from scenery.functions.vocabulary import REGION_OBJECTS
from scenery.operators import similar

LABELS = sorted({y for own in REGION_OBJECTS.values() for y in own}) + ["coffee table", "night stand", "x", "", "aaaa", "aaab", "éclair", "日本", "TV Stand", "zebra crossing", "a b", "ab"]


def typos(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        w = list(rng.choice(LABELS))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "e", "qu", " ", "é"])
        yield "".join(w)


@pytest.mark.parametrize("cutoff", [0.2, 0.45, 0.6, 0.78, 0.8, 0.95, 1.0])
def test_as_all_pairs(spark, cutoff):
    names = [*LABELS, *typos(60), None]
    left, right = spark.createDataFrame([(x,) for x in names + names[:5]], "name string"), spark.createDataFrame([(x,) for x in [*LABELS, None, "bed"]], "other string")
    got = {(r["name"], r["other"]): r["ratio"] for r in similar.pairs(left, right, cutoff).collect()}
    want = {(x, y): r for x in set(names) - {None} for y in LABELS if (r := SequenceMatcher(None, y, x).ratio()) >= cutoff}
    assert got == want
    best = {r["name"]: r["other"] for r in similar.closest(left, right, cutoff).collect()}
    assert best == {x: f[0] for x in set(names) - {None} if (f := get_close_matches(x, sorted(set(LABELS)), n=1, cutoff=cutoff))}


def test_groups_stay_apart(spark):
    left = spark.createDataFrame([(1, "lampp"), (2, "lampp"), (3, ""), (None, "lamp")], "pool int, name string")
    right = spark.createDataFrame([(1, "lamp"), (2, "sofa"), (3, ""), (None, "lamp")], "pool int, other string")
    assert sorted((r["pool"], r["name"], r["other"]) for r in similar.pairs(left, right, 0.8, ["pool"]).collect()) == [(1, "lampp", "lamp"), (3, "", "")]


def test_few_candidates(spark):
    """At a high cutoff few of all pairs come as far as the ratio."""
    left = spark.createDataFrame([(x,) for x in set(typos(300, 9))], "name string")
    right = spark.createDataFrame([(x,) for x in LABELS], "other string")
    plan = similar.pairs(left, right, 0.8)
    n = left.count() * right.count()
    survivors = plan.count()
    assert 0 < survivors < n / 20


def test_refuses_odd_cutoffs(spark):
    rows = spark.createDataFrame([("a",)], "name string")
    for cutoff in (0, -1, 1.1, float("nan")):
        with pytest.raises(ValueError, match="cutoff"):
            similar.pairs(rows, rows.withColumnRenamed("name", "other"), cutoff)
