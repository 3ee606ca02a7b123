"""Task names, stages of failure, the gate before another try, and thinned floors, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenery.operators import hulls, rules


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("Object-Counting", "unsupported"), ("ROOM (size)", "unsupported"), ("[Object]\tCounting", "exact"), ("【room】 SIZE", "exact"), ("room _size", "exact"), ("room\x1csize", "exact"), ("the room size", "fuzzy"), ("[_]", "empty")],
)
def test_names_lose_white_space_underscores_and_square_brackets_only(spark, name, want):
    assert one(spark, rules.resolve_task(F.lit(name), ["object_counting", "room_size"])["status"]) == want


def test_stages(spark):
    want = {"INVALID_INPUT": "input", "INVALID_SUMMARY_TYPE": "input", "UNSUPPORTED_TASK": "input", "TASK_DISABLED": "input", "MISSING_DEPENDENCY": "dependency", "QUESTION_INVALID": "validation", "INVALID_QUESTION_RULE": "rule"}
    want |= {"EXECUTION_FAILED": "execution", "MISSING_TOOL": "execution", "EMPTY_ANSWER": "answer", "INVALID_ANSWER": "unknown", "": "unknown", " EMPTY_ANSWER ": "answer", None: "unknown"}
    got = spark.createDataFrame([(c,) for c in want], "code string").select("code", rules.failure_stage(F.col("code")).alias("s"), rules.failure_stage(F.col("code"), True).alias("ok")).collect()
    assert {r["code"]: r["s"] for r in got} == want and {r["ok"] for r in got} == {"ok"}


@pytest.mark.parametrize(
    ("task", "group", "code", "want"),
    [
        ("position_obj_reg", "image_pair", "EMPTY_ANSWER", "task_type_hard_blocked"),
        ("room_size", "multi_image", "EMPTY_ANSWER", "task_group_not_supported:multi_image"),
        ("weather", None, "OTHER", "task_group_not_supported:"),
        ("room_size", "scene", "UNSUPPORTED_TASK", "error_code_not_recoverable:UNSUPPORTED_TASK"),
        ("room_size", "scene", None, "error_code_not_recoverable:"),
        ("motion_camera", "image_pair", "MISSING_TOOL", None),
    ],
)
def test_gate(spark, task, group, code, want):
    s = lambda v: F.lit(v).cast("string")
    assert one(spark, rules.recovery(F.lit(True), s(task), s(group), s(code))) == want
    assert one(spark, rules.recovery(F.lit(False), s(task), s(group), s(code))) == "disabled"


def test_answers_that_make_no_question(spark):
    rule = lambda *a: one(spark, rules.answer_rule(*[F.lit(x).cast("string") for x in a]))
    assert rule("object_counting", "0") == "".join(rules.ZERO_COUNT)
    assert "（target_category=lamp）; zero" in rule("object_counting", "about 00 lamps", " lamp ")
    assert rule("object_counting", "10") is None and rule("object_counting", "none") is None and rule("room_size", "0") is None
    assert rule("elevation_cam_cam", " Same-Level ") == rules.SAME_LEVEL and rule("elevation_cam_cam", "higher") is None


def test_the_first_of_two_points_in_a_metre_stays(spark):
    """The second point of a voxel would move the corner; a voxel above it is another one."""
    corners = [(7, 0.0, 0.0, 0.0), (3, 0.9, 0.9, 0.0), (5, 4.0, 0.0, 0.0), (1, 4.0, 1.2, 0.0), (2, 0.0, 1.2, 0.0), (9, 4.0, 1.2, 0.05)]
    df = spark.createDataFrame([("s", *c) for c in corners], "scene_id string, id int, x double, y double, z double")
    got = hulls.room_area(df, alpha=1e-6, jitter=0.0, order="id").first()["area"]
    kept = np.array([(0.9, 0.9), (4, 0), (4, 1.2), (0, 1.2)])
    assert got == pytest.approx(hulls.area(hulls.convex_hull(kept)), abs=1e-4)
    assert hulls.room_area(df, alpha=None, order="id").first()["area"] == pytest.approx(4.8)
