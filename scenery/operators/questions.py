"""Questions: which labels they name, which labels they may name, and what is appended to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.functions.fuzzy import NULL, Names, resolve_pairs
from scenery.operators.lookup import ANCHORLESS
from scenery.session import written

# The fields of each task's labels.
FIELDS = {
    "object_counting": ("target_category",),
    "object_size": ("object_label",),
    "position_cam_obj": ("target_label",),
    "position_cam_reg": ("region_name",),
    "visibility_compare": ("target_label",),
    "distance_cam_obj": ("target_label",),
    "absolute_distance": ("object1_label", "object2_label"),
    "attribute_measurement": ("object1_label", "object2_label"),
    "depth_order_obj_obj": ("object1_label", "object2_label"),
    "single_image_relative_direction": ("reference_label", "target_label"),
    "relative_direction_hard": ("positioning_label", "orienting_label", "querying_label"),
    "relative_distance": ("target_label",),
}
# Wordings that place labels in a question.
SUBJECT = r"(?:where|(?:in\s+)?which\s+direction)\s+is\s+(.+?)\s+relative\s+to\s+(?:me|(?:the\s+)?camera)"
BETWEEN = r"between\s+(.+?)\s+and\s+(.+?)(?:[\?\.,]|$)"
RELATIVE = r"where\s+is\s+(.+?)\s+relative\s+to\s+(.+?)[\?\.,]?$"
FACING = r"(?:stand|standing)\s+(?:by|at|near)\s+(.+?)\s+(?:and|,)\s*(?:face|facing)\s+(.+?)\s*,?\s*where\s+is\s+(.+?)(?:[\?\.,]|$)"
CLOSEST = r"(?:closest|nearest)\s+to\s+(.+?)(?:[\?\.,]|$)"
LISTS = (
    r"\(([^)]*)\)",
    r"which\s+of\s+the(?:se)?\s+objects\s*,\s*(.+?)\s*,?\s*is\s+(?:closest|nearest)\s+to\s+",
    r"which\s+of\s+(.+?)\s*,?\s*is\s+(?:closest|nearest)\s+to\s+",
    r"out\s+of\s+these\s+objects\s*,?\s*(.+?)\s*,?\s*(?:which\s+one\s+)?is\s+(?:closest|nearest)\s+to\s+",
)


def _groups(q: Column, pattern: str, *order: int) -> Column:
    """The groups of a pattern's match, in the order asked for; null where it does not match."""
    return F.when(q.rlike(pattern), F.array(*[F.trim(F.regexp_extract(q, pattern, i)) for i in order]))


def spoken(task: Column, question: Column) -> Column:
    """Phrases that a question puts where its task's labels stand; null where its wording is another.

    For relative distances the target comes first, an empty one where there is none, then the items of the list.
    """
    q = F.lower(question)
    of = lambda *fields: task.isin([t for t, f in FIELDS.items() if f == fields and t != "relative_distance"])
    segment = F.coalesce(*[F.when(q.rlike(p), F.nullif(F.trim(F.regexp_extract(q, p, 1)), F.lit(""))) for p in LISTS], F.lit(""))
    items = F.filter(F.transform(F.split(segment, r",|\band\b|\bor\b|;"), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(task == "relative_distance", F.concat(F.array(F.trim(F.regexp_extract(q, CLOSEST, 1))), items))
        .when(of("object1_label", "object2_label"), _groups(q, BETWEEN, 1, 2))
        .when(of("reference_label", "target_label"), _groups(q, RELATIVE, 2, 1))
        .when(of("positioning_label", "orienting_label", "querying_label"), _groups(q, FACING, 1, 2, 3))
        .otherwise(_groups(q, SUBJECT, 1))
    )


def extract(rows: DataFrame, key: str, names: Names, task: str = "task", question: str = "question", pool: str = "pool") -> DataFrame:
    """Adds labels, a map of the task's fields, and candidate_labels (for relative distances, else null).

    A label comes from the wording where it has one and from the question's mentions else; for
    tasks of one label it is the other way round. Labels that no candidate matches are `null`.
    Each distinct question of a task and pool is worked out once and joined back by a digest.
    """
    keyed = rows.withColumn("__asked", F.md5(F.to_json(F.struct(F.col(task), F.col(question), F.col(pool)))))
    distinct = keyed.groupBy("__asked").agg(F.first(task).alias(task), F.first(question).alias(question), F.first(pool).alias(pool))
    found = _extracted(written(distinct, "questions"), "__asked", names, task, question, pool)
    return keyed.join(found.select("__asked", "labels", "candidate_labels"), "__asked", "left").drop("__asked")


def _extracted(rows: DataFrame, key: str, names: Names, task: str, question: str, pool: str) -> DataFrame:
    said = rows.withColumn("__said", spoken(F.col(task), F.col(question)))
    long = said.select(key, task, F.col(pool).alias("__p"), F.posexplode("__said").alias("__i", "__raw"))
    region = F.col(task) == "position_cam_reg"
    found = resolve_pairs(long.where(~region), "__raw", "__p", "__x", names).unionByName(resolve_pairs(long.where(region), "__raw", "__p", "__x", names, "subject"))
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__f")).select(key, F.col("__f.__x").alias("__found"))
    out = resolve_pairs(said, question, pool, "__mentions", names, "mentions").join(found, key, "left")
    at = lambda a, i: F.coalesce(F.get(F.col(a), F.lit(i)), F.lit(NULL))
    wording = F.col("__said").isNotNull()

    def field(t: str, i: int) -> Column:
        if t == "relative_distance":
            return at("__found", 0)
        if len(FIELDS[t]) == 1:
            return F.when(at("__mentions", 0) != NULL, at("__mentions", 0)).otherwise(at("__found", 0))
        return F.when(wording, at("__found", i)).otherwise(at("__mentions", i))

    labels = F.lit(None).cast("map<string,string>")
    for t, fields in FIELDS.items():
        labels = F.when(F.col(task) == t, F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(f), field(t, i))])).otherwise(labels)
    listed = F.array_distinct(F.filter(F.slice("__found", F.lit(2), F.greatest(F.size("__found") - 1, F.lit(0))), lambda x: x != NULL))
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.slice("__mentions", 1, 3))
    return out.withColumns({"labels": labels, "candidate_labels": F.when(F.col(task) == "relative_distance", listed)}).drop("__said", "__mentions", "__found")


def sanitise(rows: DataFrame, key: str, names: Names, labels: str = "labels", listed: str = "candidate_labels", pool: str = "pool") -> DataFrame:
    """Labels as candidates, `null` where no usable one is meant; lists without repeats. An empty pool changes nothing."""
    usable = lambda c: ~c.isin(*ANCHORLESS, "", NULL)
    long = rows.select(key, F.col(pool).alias("__p"), F.explode(F.map_entries(labels)).alias("e")).select(key, "__p", F.col("e.key").alias("__k"), F.col("e.value").alias("__raw"), F.lit(0).alias("__i"))
    more = rows.select(key, F.col(pool).alias("__p"), F.posexplode(listed).alias("__i", "__raw")).withColumn("__k", F.lit(None).cast("string"))
    found = resolve_pairs(long.unionByName(more), "__raw", "__p", "__x", names)
    good = F.when(F.array_contains(F.col("__p"), F.col("__x")) & usable(F.col("__x")), F.col("__x"))
    found = found.withColumn("__x", good).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("__k").isNotNull(), F.struct("__k", F.coalesce("__x", F.lit(NULL)))))).alias("__labels"),
        F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("__k").isNull() & F.col("__x").isNotNull(), F.struct("__i", "__x")))).getField("__x")).alias("__list"),
    )
    out = rows.join(found, key, "left")
    some = F.coalesce(F.size(pool) > 0, F.lit(False))
    return out.withColumns(
        {labels: F.when(some, F.coalesce("__labels", labels)).otherwise(F.col(labels)), listed: F.when(some & F.col(listed).isNotNull(), F.coalesce("__list", F.array().cast("array<string>"))).otherwise(F.col(listed))}
    ).drop("__labels", "__list")


# Where a task takes its candidates from.
SCOPES = {
    "object_counting": "scene_repeated",
    "object_size": "scene_unique",
    "absolute_distance": "scene_unique",
    "relative_distance": "scene_unique",
    "relative_direction_hard": "scene_unique",
    "single_image_relative_direction": "frame_only",
    "depth_order_obj_obj": "frame_only",
    "distance_cam_obj": "frame_only",
    "position_cam_obj": "reference_unique",
    "position_cam_reg": "reference_unique",
    "attribute_measurement": "pair_unambiguous",
    "visibility_compare": "pair_visibility",
}


def candidate_pools(requests: DataFrame, scene_counts: DataFrame, frame_counts: DataFrame, task: str = "task") -> DataFrame:
    """Adds pool, the sorted labels a request's task may name.

    requests: scene_id, frame_1, frame_2 (null for none), reference (1 or 2). scene_counts: scene_id,
    label, n. frame_counts: scene_id, frame_id, label, n, visibility (the best). Counts come down to
    one row per scene or frame first, so a request is joined with at most three rows.
    """
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("label"))))
    scene = scene_counts.groupBy("scene_id").agg(names(F.col("n") == 1).alias("s_unique"), names(F.col("n") > 1).alias("s_repeated"), names(F.lit(True)).alias("s_all"))
    seen = frame_counts.groupBy("scene_id", "frame_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("n", "visibility")))).alias("m"))
    out = requests.join(scene, "scene_id", "left")
    for k in (1, 2):
        out = out.join(seen.select("scene_id", F.col("frame_id").alias(f"frame_{k}"), F.col("m").alias(f"m{k}")), ["scene_id", f"frame_{k}"], "left")
    empty = F.create_map().cast("map<string,struct<n:bigint,visibility:double>>")
    m = {k: F.coalesce(F.col(f"m{k}"), empty) for k in (1, 2)}
    n = lambda k, x: F.coalesce(F.try_element_at(m[k], x)["n"], F.lit(0))
    v = lambda k, x: F.coalesce(F.try_element_at(m[k], x)["visibility"], F.lit(0.0))
    every = F.array_sort(F.array_union(F.map_keys(m[1]), F.map_keys(m[2])))
    clear = F.filter(every, lambda x: (n(1, x) <= 1) & (n(2, x) <= 1))
    contrast = F.filter(clear, lambda x: F.abs(v(1, x) - v(2, x)) >= 0.15)
    shared = F.filter(every, lambda x: (n(1, x) == 1) & (n(2, x) == 1))
    own = F.when(F.col("reference") == 2, m[2]).otherwise(m[1])
    unique = F.array_sort(F.map_keys(F.map_filter(own, lambda _, x: x["n"] == 1)))
    pick = lambda *pools: F.coalesce(*[F.when(F.size(p) > 0, p) for p in pools], F.array().cast("array<string>"))
    pools = {
        "scene_repeated": F.col("s_repeated"),
        "scene_unique": F.col("s_unique"),
        "reference_unique": pick(unique, F.array_sort(F.map_keys(own))),
        "pair_unambiguous": clear,
        "pair_visibility": pick(contrast, shared, clear),
        "frame_only": every,
    }
    by_task = pick(every, F.col("s_all"))
    for t, scope in SCOPES.items():
        by_task = F.when(F.col(task) == t, pools[scope]).otherwise(by_task)
    return out.withColumn("pool", F.coalesce(by_task, F.array().cast("array<string>"))).drop("s_unique", "s_repeated", "s_all", "m1", "m2")
