"""Names, questions, hints and micro-batches, held against cases worked out by hand."""

import hashlib
import random

import pytest

from scenery.functions import fuzzy
from scenery.operators import answers, batch, questions

POOL = ["coffee table", "lamp", "office chair", "sofa", "table"]


def test_names_by_stages():
    names = fuzzy.Names(POOL)
    assert names.among("Lamp.", POOL) == "lamp"  # as it stands, without marks
    assert names.among("coffee_table", POOL) == "coffee table"  # compact form
    assert names.among("chair", POOL) == "office chair"  # part of a candidate
    assert names.among("sofas", ["lamp", "sofa"]) == "sofa"
    assert names.among("offce chiar", ["lamp", "office chair"]) == "office chair"
    assert [names.among(x, POOL) for x in ("none", " N/A ", "", None, "error: no answer")] == ["null"] * 5
    assert names.among("Zebra", []) == "zebra" and names.among("zzz", ["lamp"]) == "null"


def test_similarity_of_names():
    names = fuzzy.Names()
    assert names.similarity("Sofa", "sofa ") == 1.0 and names.similarity("coffee table", "coffee-table") == 0.99
    assert names.similarity("", "x") == 0.0
    # The region's objects are nearer to it than other names of the same likeness.
    assert names.similarity("sleeping area", "bed") - fuzzy.Names(objects={}).similarity("sleeping area", "bed") == pytest.approx(0.15)


def test_regions():
    names = fuzzy.Names(POOL)
    assert names.phrase("the Sofa  Area!") == "living" and names.phrase("workstation") == "office" and names.phrase("desk lamp") is None
    assert names.is_abstract("corner room") and not names.is_abstract("lamp")
    assert names.region("lounge area", POOL) == "sofa"  # the region's first object that is there
    assert names.region("eating area", POOL) == "table" and names.region("lamp", POOL) == "lamp"
    assert names.region("the lamp zone", ["lamp"]) == "lamp"


def test_mentions_are_in_order():
    names = fuzzy.Names(POOL)
    assert names.mentions("Is the sofa closer than the lamp?", POOL) == ["sofa", "lamp"]
    assert names.mentions("Where is the offce chair?", ["office chair"]) == ["office chair"]
    assert names.mentions("  ", POOL) == [] and names.mentions("nothing of the kind", ["zebra"]) == []


def test_extraction(spark):
    rows = [
        (1, "object_counting", "How many lamps are there?"),
        (2, "absolute_distance", "How far is it between the lamp and the sofa?"),
        (3, "absolute_distance", "How far is the sofa from the lamp?"),
        (4, "relative_distance", "Which of these objects, the lamp, sofa or table, is nearest to the office chair?"),
        (5, "relative_direction_hard", "Stand at the lamp, facing the sofa, where is the office chair?"),
        (6, "position_cam_reg", "Where is the reading corner relative to the camera in image 2?"),
        (7, "object_size", "How big is it?"),
        (8, "room_size", "How big is the room?"),
    ]
    df = spark.createDataFrame([(*r, ["lamp", "office chair", "sofa"]) for r in rows], "id int, task string, question string, pool array<string>")
    got = {r["id"]: r for r in questions.extract(df, "id", fuzzy.Names(POOL)).collect()}
    assert got[1]["labels"] == {"target_category": "lamp"}
    assert got[2]["labels"] == {"object1_label": "lamp", "object2_label": "sofa"}
    assert got[3]["labels"] == {"object1_label": "sofa", "object2_label": "lamp"}
    assert got[4]["labels"] == {"target_label": "office chair"} and got[4]["candidate_labels"][:2] == ["lamp", "sofa"]
    assert got[5]["labels"] == {"positioning_label": "lamp", "orienting_label": "sofa", "querying_label": "office chair"}
    assert got[6]["labels"] == {"region_name": "reading corner"}
    assert got[7]["labels"] == {"object_label": "null"} and got[8]["labels"] is None and got[1]["candidate_labels"] is None


def test_hints_are_seeded(spark):
    seed = int(hashlib.md5(b"visibility_compare||Where?||image1|image2|same|neither").hexdigest()[:8], 16)
    order = ["image1", "image2", "same", "neither"]
    random.Random(seed).shuffle(order)
    assert answers.hint("visibility_compare", "Where?", None, None, 1, {}) == " A concise answer is usually one of: " + ", ".join(order) + "."
    two = answers.hint("motion_camera", "How?", "Left Front", None, 2, {})
    assert two.startswith(" A concise answer is usually a short camera-motion label, for example: ") and "left-front" in two and two.split(": ")[1].count(",") == 3
    assert answers.hint("motion_camera", "How?", "invalid", None, 2, {}) == answers.DIRECTION_HINTS["motion_camera"]
    pair = answers.hint("depth_order_obj_obj", "Which?", None, ["a", "b"], 1, {})
    assert pair.startswith(" Answer with exactly one of: ") and sorted(pair[29:-1].split(", ")) == ["a", "b", "same"]
    df = spark.createDataFrame([("Which? Answer with exactly one of: x, y.", "depth_order_obj_obj", None, ["a", "b"])], "question string, task string, truth string, pair array<string>")
    assert answers.with_hint(df, 1, {}).first()["hinted"] == "Which?" + pair


def test_micro_batches(spark):
    rows = [(1, k, n) for k, n in enumerate([50, 10, 40, 30, 20, 60])] + [(2, 0, 500)]
    got = batch.micro_batches(spark.createDataFrame(rows, "uid int, pos int, length int"), "uid", "length", "pos", 100).collect()
    one = sorted((r for r in got if r["uid"] == 1), key=lambda r: r["place"])
    sums, squares = {}, {}
    for r in one:
        sums[r["micro"]] = sums.get(r["micro"], 0) + r["length"]
        squares[r["micro"]] = squares.get(r["micro"], 0) + r["length"] ** 2
    assert len(sums) == 3 and max(sums.values()) - min(sums.values()) <= 10
    assert [squares[k] for k in sorted(squares)] == sorted(squares.values(), reverse=True)
    assert [r["micro"] for r in one] == sorted(r["micro"] for r in one) and sorted(r["origin"] for r in one) == list(range(6))
    assert [r["micro"] for r in got if r["uid"] == 2] == [0]


def test_rounds_are_routed(spark):
    df = spark.createDataFrame([(1,), (2,)], "round int")
    same = lambda b: b
    assert answers.route(df.where("round = 2"), None, same).count() == 1
    for bad in (df, df.where("false"), df.selectExpr("3 AS round")):
        with pytest.raises(ValueError):
            answers.route(bad, same, same)
