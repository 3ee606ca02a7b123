"""Requests, and the first reason why one has no deterministic answer.

Rules are columns that hold a reason or null; the first that applies wins, in the order
contract, pool, labels, images, answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.functions.vocabulary import REJECTED_TASKS, TASK_ALIASES

# Stages of failure by error code; codes after which a request may be tried again; groups that are; tasks that never are.
STAGES = {
    "INVALID_INPUT": "input",
    "INVALID_SUMMARY_TYPE": "input",
    "UNSUPPORTED_TASK": "input",
    "TASK_DISABLED": "input",
    "MISSING_DEPENDENCY": "dependency",
    "QUESTION_INVALID": "validation",
    "INVALID_QUESTION_RULE": "rule",
    "EXECUTION_FAILED": "execution",
    "MISSING_TOOL": "execution",
    "EMPTY_ANSWER": "answer",
}
RECOVERABLE_CODES = ("QUESTION_INVALID", "INVALID_QUESTION_RULE", "EXECUTION_FAILED", "EMPTY_ANSWER", "MISSING_DEPENDENCY", "MISSING_TOOL")
RECOVERY_GROUPS = ("scene", "single_image", "image_pair")
BLOCKED_TASKS = ("position_obj_obj", "position_obj_reg", "position_reg_reg")

# What an answer that makes no question is told; the category stands between the first two parts.
ZERO_COUNT = ("object_counting invalid: the answer is 0, which means the question targets a category that does not exist in the scene", "; zero-count questions are not used as valid training samples.")
CATEGORY_HINT = ("（target_category=", "）")
SAME_LEVEL = "elevation_cam_cam invalid: the camera height relation between the two images is `same_level`, so there is no meaningful elevation change; `same_level` questions are not used as valid training samples."


def answer_rule(task: Column, answer: Column, category: Column | None = None) -> Column:
    """Why an answer makes no valid question: a count whose first integer is 0, or cameras on one level; null where it does."""
    token = F.regexp_replace(F.translate(F.lower(F.trim(answer)), "- ", "__"), "_+", "_")
    named = F.trim(F.coalesce(category if category is not None else F.lit(""), F.lit("")))
    hint = F.when(named == "", "").otherwise(F.concat(F.lit(CATEGORY_HINT[0]), named, F.lit(CATEGORY_HINT[1])))
    none = F.regexp_extract(answer, r"(-?\d+)", 1).rlike("^-?0+$")
    task = F.trim(task)
    return F.when((task == "object_counting") & none, F.concat(F.lit(ZERO_COUNT[0]), hint, F.lit(ZERO_COUNT[1]))).when((task == "elevation_cam_cam") & (token == "same_level"), SAME_LEVEL)


def first_reason(rows: DataFrame, **reasons: Column) -> DataFrame:
    """Adds error, the first reason that applies, failed_rule, its name, and is_valid."""
    found = F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("rule"), c.alias("error"))) for k, c in reasons.items()])
    return rows.withColumn("__r", found).withColumns({"failed_rule": F.col("__r.rule"), "error": F.col("__r.error"), "is_valid": F.col("__r").isNull()}).drop("__r")


def failure_stage(code: Column, is_valid: Column | bool = False) -> Column:
    """Where a request failed: ok where it did not, unknown for a code that has no stage."""
    names = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return F.when(is_valid if isinstance(is_valid, Column) else F.lit(is_valid), "ok").otherwise(F.coalesce(F.try_element_at(names, F.trim(code)), F.lit("unknown")))


def recovery(switched_on: Column, task: Column, group: Column, code: Column, groups: tuple[str, ...] = RECOVERY_GROUPS, codes: tuple[str, ...] = RECOVERABLE_CODES) -> Column:
    """Why a failed request is not tried again: disabled, a blocked task, a group or an error code that is not allowed, by the first that applies; null where it is."""
    group, code = F.coalesce(group, F.lit("")), F.coalesce(code, F.lit(""))
    return (
        F.when(~switched_on, "disabled")
        .when(task.isin(*BLOCKED_TASKS), "task_type_hard_blocked")
        .when(~group.isin(*groups), F.concat(F.lit("task_group_not_supported:"), group))
        .when(~code.isin(*codes), F.concat(F.lit("error_code_not_recoverable:"), code))
    )


def resolve_task(name: Column, supported: list[str], aliases: dict[str, str] = TASK_ALIASES, refused: tuple[str, ...] = REJECTED_TASKS) -> Column:
    """status and task of a name: empty, rejected, exact, alias, fuzzy or unsupported, by the first stage that applies.

    A name is refused when it is part of a refused one or holds one, before exact names are
    looked at; so a short name such as `position` is refused. fuzzy: the first supported
    task that the name is part of, or that is part of the name.
    """
    # White space, underscores and square brackets of either kind do not tell names apart; nothing else is dropped.
    key = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)[\s\x1c-\x1f_\[\]【】]+", ""))
    compact = [s.replace("_", "") for s in supported]
    meets = lambda x: x.contains(key) | key.contains(x)
    no = F.exists(F.array(*[F.lit(r) for r in refused]), meets) if refused else F.lit(False)
    lookup = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    exact, alias = lookup(dict(zip(compact, supported, strict=True))), lookup(aliases)
    near = F.get(F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in zip(compact, supported, strict=True)]), lambda x: meets(x["c"])), F.lit(0))["s"]
    task = F.when(no | (key == ""), None).otherwise(F.coalesce(exact, alias, near))
    status = F.when(key == "", "empty").when(no, "rejected").when(exact.isNotNull(), "exact").when(alias.isNotNull(), "alias").when(near.isNotNull(), "fuzzy").otherwise("unsupported")
    return F.struct(status.alias("status"), task.alias("task"))


def resolve_alias(name: Column, aliases: dict[str, str]) -> Column:
    """status (empty, exact, alias or unsupported) and canonical form of a name of a group or a summary."""
    key = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_]", "")
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), key)
    status = F.when(key == "", "empty").when(found.isNull(), "unsupported").when(found == key, "exact").otherwise("alias")
    return F.struct(status.alias("status"), found.alias("canonical"))
