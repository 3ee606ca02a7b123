"""Texts of the first round's prompts, from the labels a scene, frame or pair shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.operators import context
from scenery.plans.catalogue import query
from scenery.plans.q_scene import FUNIQUE, objects
from scenery.sources.adapters import with_views

_C = "c AS (SELECT scene_id, label, count(*) AS n FROM objects WHERE label NOT IN ('wall','otherprop','ceiling','otherfurniture') GROUP BY 1,2)"


@query("f40_scene_context", with_views("objects", rest=_C) + """SELECT scene_id, concat('Visible labels: ', string_agg(concat(label, CASE WHEN n = 1 THEN ' (unique)' ELSE concat(' (x', CAST(n AS VARCHAR), ')') END), ', ' ORDER BY label), '.',
  chr(10), 'Unique labels: ', coalesce(string_agg(label, ', ' ORDER BY label) FILTER (n = 1), 'none'), '.', chr(10), 'Repeated labels: ', coalesce(string_agg(label, ', ' ORDER BY label) FILTER (n > 1), 'none'), '.') AS context FROM c GROUP BY 1""")
def scene_context(spark, sf):
    """what a prompt says of a scene's labels, from one row per scene and label."""
    counts = objects(spark, sf).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return context.label_context(counts, "scene_id").select("scene_id", "context")


@query("f40_example_labels", with_views("objects", rest=FUNIQUE + ", p AS (SELECT scene_id, frame_id, label, row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY md5(concat('3|', scene_id, '|', frame_id, '|', label))) AS k FROM uniq)") + "SELECT scene_id, frame_id, concat('Where is the ', max(label) FILTER (k = 1), ' relative to the ', max(label) FILTER (k = 2), '?') AS example FROM p GROUP BY 1,2 HAVING count(*) >= 2")
def example_labels(spark, sf):
    """an example question of two labels of a frame, drawn by a seeded hash."""
    seen = objects(spark, sf).where("visibility >= 0.5").groupBy("scene_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return context.examples(seen, ["scene_id", "frame_id"], "Where is the {1} relative to the {2}?", 2, 3).select("scene_id", "frame_id", "example")
