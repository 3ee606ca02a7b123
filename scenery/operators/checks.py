"""Why a request or its question has no deterministic answer: contract, fields, pools and images, each as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.operators.lookup import is_null_like, same_label
from scenery.operators.questions import FIELDS

# Messages of the rules; {} stands for the task, then for what the rule found.
NO_TASK, NO_QUESTION, NO_SCENE = "Missing `task_type`", "`question` must be a string", "Missing `scene_id`"
EMPTY_IMAGE = "`image_path` must be a non-empty string when provided"
ONE_IMAGE = "{} requires `image_path`"
TWO_IMAGES = "{} requires two image inputs (`image_paths` or `image_path_1`/`image_path_2`)"
LISTED_TARGET = "relative_distance invalid: `candidate_labels` contains `target_label`, so the target cannot appear in the candidate list"
ASKED_TARGET = "relative_distance invalid: the candidate list in the question text contains `target_label`, so the target cannot appear in the candidate list"
EMPTY_LIST = "relative_distance invalid: `candidate_labels` cannot be empty"
TWICE_LISTED = "relative_distance invalid: `candidate_labels` contains duplicate candidates"
SAME_LABELS = "{} invalid: `{}` and `{}` must refer to different objects"
SAME_THREE = "relative_direction_hard invalid: positioning/orienting/querying contain duplicate objects, so the relation is not well-defined"
UNDETECTED = "{} invalid: target object `{}` was not detected in the input image, so relative direction cannot be computed"
UNEXTRACTED = "{} invalid: failed to extract `{}`"
# Tasks whose two labels must differ.
DIFFERENT = {
    "absolute_distance": ("object1_label", "object2_label"),
    "depth_order_obj_obj": ("object1_label", "object2_label"),
    "attribute_measurement": ("object1_label", "object2_label"),
    "single_image_relative_direction": ("reference_label", "target_label"),
}


def say(message: str, *parts: Column) -> Column:
    """A message with its {} filled in order."""
    pieces = message.split("{}")
    out = [F.lit(pieces[0])]
    for p, rest in zip(parts, pieces[1:], strict=True):
        out += [p, F.lit(rest)]
    return F.concat(*out)


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def input_contract(task: Column, question: Column, scene: Column, image: Column) -> Column:
    """What every request must hold."""
    return F.when(blank(task), NO_TASK).when(blank(question), NO_QUESTION).when(blank(scene), NO_SCENE).when(image.isNotNull() & (F.trim(image) == ""), EMPTY_IMAGE)


def mode_contract(task: Column, mode: Column, image: Column, images: Column, image_1: Column, image_2: Column) -> Column:
    """The images that a task's mode needs: one path, or two as a list or one by one."""
    two = (F.coalesce(F.size(images), F.lit(0)) >= 2) | (~blank(image_1) & ~blank(image_2))
    return F.when((mode == "single_image") & blank(image), say(ONE_IMAGE, task)).when((mode == "image_pair") & ~two, say(TWO_IMAGES, task))


def asked_candidates(question: Column) -> Column:
    """Items of the lists a question holds: after `among`, and between its first parentheses."""
    q = F.lower(F.coalesce(question, F.lit("")))
    among = F.when(F.concat(F.lit(" "), q, F.lit(" ")).contains(" among "), F.regexp_extract(q, r"among(.*)$", 1))
    inside = F.nullif(F.regexp_extract(q, r"\(([^)]+)\)", 1), F.lit(""))
    parts = lambda s: F.transform(F.split(F.regexp_replace(s, r" and | or |;", ","), ","), lambda x: F.btrim(x, F.lit(" .?!:")))
    none = F.array().cast("array<string>")
    return F.filter(F.concat(F.coalesce(parts(among), none), F.coalesce(parts(inside), none)), lambda x: x != "")


def distance_rule(task: Column, target: Column, listed: Column, question: Column) -> Column:
    """A relative distance's target must be none of its candidates, neither listed nor asked."""
    known = task.contains("relative_distance") & (F.coalesce(target, F.lit("")) != "")
    asked = F.array_contains(asked_candidates(question), F.lower(F.trim(target)))
    return F.when(known & F.coalesce(F.array_contains(listed, target), F.lit(False)), LISTED_TARGET).when(known & (F.lower(target) != "null") & asked, ASKED_TARGET)


def label_rule(task: Column, labels: Column) -> Column:
    """Labels that must differ: pairs, and the three of a relative direction."""
    at = lambda k: F.try_element_at(labels, F.lit(k))
    out = F.lit(None).cast("string")
    for t, (a, b) in DIFFERENT.items():
        out = F.when((task == t) & same_label(at(a), at(b)), say(SAME_LABELS, task, F.lit(a), F.lit(b))).otherwise(out)
    three = [F.when(~is_null_like(at(k)), F.lower(F.trim(at(k)))) for k in FIELDS["relative_direction_hard"]]
    given = F.array_compact(F.array(*three))
    return F.when((task == "relative_direction_hard") & (F.size(F.array_distinct(given)) < F.size(given)), SAME_THREE).otherwise(out)


def list_rule(task: Column, target: Column, listed: Column) -> Column:
    """Candidates of a relative distance: repeated ones, then none, then the target among them."""
    items = F.transform(F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: ~is_null_like(x)), lambda x: F.lower(F.trim(x)))
    reason = (
        F.when(F.size(F.array_distinct(items)) < F.size(items), TWICE_LISTED)
        .when((F.size(items) == 0) & (listed.isNull() | ~is_null_like(target)), EMPTY_LIST)
        .when(~is_null_like(target) & F.array_contains(items, F.lower(F.trim(target))), LISTED_TARGET)
    )
    return F.when(task == "relative_distance", reason)


def detection_rule(task: Column, label: Column, looked: Column, found: Column) -> Column:
    """A label that was looked for in an image and not found."""
    return F.when(looked & ~found & ~is_null_like(label), say(UNDETECTED, task, label))


def missing_rule(task: Column, labels: Column) -> Column:
    """The first of the task's fields that holds no label."""
    out = F.lit(None).cast("string")
    for t, fields in FIELDS.items():
        if t == "relative_distance":
            continue
        lost = F.coalesce(*[F.when(is_null_like(F.try_element_at(labels, F.lit(f))), say(UNEXTRACTED, task, F.lit(f))) for f in fields])
        out = F.when(task == t, lost).otherwise(out)
    return out


# Messages of pools; the task, the field and the label are filled in.
NONE_TO_COUNT = "object_counting invalid: no countable category has observed count >= 2 in the current input"
UNSEEN = "object_counting invalid: `target_category` `{}` is not in the visible scene label pool"
UNCOUNTED = "object_counting invalid: `target_category` `{}` is not in the counting label pool"
OUTSIDE = "{} invalid: `{}` `{}` is not in the {}"
UNIQUE_POOL, VISIBILITY_POOL, PAIR_POOL, REFERENCE_POOL = "scene unique pool", "visibility pool", "pair non-ambiguous pool", "selected reference-image unique pool"


def pool_rule(task: Column, labels: Column, listed: Column, counts: Column, pool: Column) -> Column:
    """The first label outside its pool. counts: the scene's labels with their numbers; pool: the task's pool of an image or a pair."""
    low = lambda k: F.lower(F.trim(F.coalesce(F.try_element_at(labels, F.lit(k)), F.lit(""))))
    n = lambda x: F.coalesce(F.try_element_at(counts, x), F.lit(0))
    out = F.lit(None).cast("string")
    for t in ("object_size", "absolute_distance", "relative_distance", "relative_direction_hard"):
        reasons = [F.when((low(f) != "") & (n(low(f)) != 1), say(OUTSIDE, F.lit(t), F.lit(f), low(f), F.lit(UNIQUE_POOL))) for f in FIELDS[t]]
        if t == "relative_distance":
            lost = F.get(F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & (n(x) != 1)), F.lit(0))
            reasons.append(F.when(lost.isNotNull(), say(OUTSIDE, F.lit(t), F.lit("candidate_label"), lost, F.lit(UNIQUE_POOL))))
        out = F.when(task == t, F.coalesce(*reasons)).otherwise(out)
    for t, name in (("visibility_compare", VISIBILITY_POOL), ("attribute_measurement", PAIR_POOL), ("position_cam_obj", REFERENCE_POOL)):
        reasons = [F.when((low(f) != "") & (F.size(pool) > 0) & ~F.array_contains(pool, low(f)), say(OUTSIDE, F.lit(t), F.lit(f), low(f), F.lit(name))) for f in FIELDS[t]]
        out = F.when(task == t, F.coalesce(*reasons)).otherwise(out)
    c = low("target_category")
    some = F.exists(F.map_values(counts), lambda x: x >= 2)
    counting = F.when(~some, NONE_TO_COUNT).when((c != "") & (n(c) == 0), say(UNSEEN, c)).when((c != "") & (n(c) < 2), say(UNCOUNTED, c))
    return F.when(task == "object_counting", counting).otherwise(out)


NOT_UNIQUE = "{} invalid: {} `{}` is not unique in provided image #{} ({} matches)"
NOT_VISIBLE = "{} invalid: {} `{}` is not visible enough in the provided images"


def image_rule(task: Column, role: Column, label: Column, counts: Column) -> Column:
    """counts: how often the label is seen in each image. More than once in one is ambiguous, once in none is not visible."""
    first = F.array_position(F.transform(counts, lambda x: x > 1), F.lit(True))
    return F.when(first > 0, say(NOT_UNIQUE, task, role, label, first.cast("string"), F.get(counts, (first - 1).cast("int")).cast("string"))).when(
        ~F.exists(counts, lambda x: x == 1), say(NOT_VISIBLE, task, role, label)
    )


def question_reason(rows: DataFrame, task: str = "task", question: str = "question", labels: str = "labels", listed: str = "candidate_labels") -> DataFrame:
    """Adds error and failed_rule by the rules of a question's labels, the first that applies."""
    from scenery.operators.rules import first_reason

    t, m, c = F.col(task), F.col(labels), F.col(listed)
    target = F.try_element_at(m, F.lit("target_label"))
    return first_reason(rows, distance=distance_rule(t, target, c, F.col(question)), labels=label_rule(t, m), listed=list_rule(t, target, c), missing=missing_rule(t, m))
