"""Visibility by each frame's own depth image: points, poses and images derived from one table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scenery.functions import geometry as g
from scenery.operators import occlusion
from scenery.plans.catalogue import query
from scenery.plans.q_io import png
from scenery.plans.q_scene import objects
from scenery.sources.adapters import spark_view, with_views

COLUMNS, ROWS = 16, 12


def points(spark, sf):
    """A lattice of 27 points in every object's box."""
    lattice = F.array(*[F.struct(*[(F.col(c) + s * (F.col(f"{c}1") - F.col(f"{c}0")) / 2).alias(c) for c, s in zip("xyz", at, strict=True)]) for at in np.ndindex(3, 3, 3) for at in [tuple(float(k - 1) for k in at)]])
    return objects(spark, sf).select("scene_id", "object_id", F.explode(lattice).alias("p")).select("scene_id", "object_id", "p.*")


def cameras(spark, sf):
    """Five cameras a scene, each the least of the poses dealt to it, number by number."""
    p = spark_view(spark, sf, "poses").groupBy("scene_id", (F.floor(F.col("vec_id") / 20) % 5).alias("frame_id")).agg(*[F.min(c).alias(c) for c in ("ax", "ay", "az", "tx", "ty", "tz")])
    r = g.rotation(F.col("ax"), F.col("ay"), F.col("az"))
    fixed = {"fx": 525.0, "fy": 525.0, "cx": 320.0, "cy": 240.0, "width": 640.0, "height": 480.0}
    return p.select("scene_id", "frame_id", "tx", "ty", "tz", *[m.alias(f"r{i}") for i, m in enumerate(r)], *[F.lit(v).alias(k) for k, v in fixed.items()])


def images(spark, sf):
    """A 16-bit grey PNG for each camera, in millimetres: every object writes a cell, the nearest stays, empty ones are 0."""
    o = objects(spark, sf)
    depth = F.floor((F.abs("x") + F.abs("y")) * 1000).cast("int")
    cells = o.groupBy("scene_id", "frame_id", (F.floor("u0") % COLUMNS).cast("int").alias("u"), (F.floor("v0") % ROWS).cast("int").alias("v")).agg(F.min(depth).alias("depth"))
    by_frame = cells.groupBy("scene_id", "frame_id").agg(F.collect_list(F.struct("u", "v", "depth")).alias("cells"))

    def drawn(batches):
        for batch in batches:
            out = []
            for cells in batch.column("cells").to_pylist():
                raster = [[0] * COLUMNS for _ in range(ROWS)]
                for c in cells:
                    raster[c["v"]][c["u"]] = c["depth"]
                out.append(png(raster))
            yield pa.RecordBatch.from_arrays([batch.column("scene_id"), batch.column("frame_id"), pa.array(out, pa.binary())], names=["scene_id", "frame_id", "image"])

    return by_frame.mapInArrow(drawn, "scene_id long, frame_id long, image binary")


#: The image as rows; every pixel against its own cell.
_SEEN = """shot AS (SELECT scene_id, CAST(floor(vec_id / 20) AS BIGINT) % 5 AS frame_id, min(ax) AS ax, min(ay) AS ay, min(az) AS az, min(tx) AS tx, min(ty) AS ty, min(tz) AS tz FROM poses GROUP BY 1, 2),
nrm AS (SELECT *, ax/th AS nx, ay/th AS ny, az/th AS nz, sin(th) AS s, cos(th) AS c, 1-cos(th) AS w FROM (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS th FROM shot)),
cam AS (SELECT scene_id, frame_id, tx, ty, tz, c+nx*nx*w AS r0, nx*ny*w-nz*s AS r1, nx*nz*w+ny*s AS r2, ny*nx*w+nz*s AS r3, c+ny*ny*w AS r4, ny*nz*w-nx*s AS r5, nz*nx*w-ny*s AS r6, nz*ny*w+nx*s AS r7, c+nz*nz*w AS r8 FROM nrm),
cell AS (SELECT scene_id, frame_id, CAST(floor(u0) AS INT) % 16 AS i, CAST(floor(v0) AS INT) % 12 AS j, min(CAST(floor((abs(x)+abs(y))*1000) AS INT)) AS depth FROM objects GROUP BY 1, 2, 3, 4),
pt AS (SELECT scene_id, object_id, x + a*(x1-x0)/2 AS x, y + b*(y1-y0)/2 AS y, z + d*(z1-z0)/2 AS z FROM objects, (VALUES (-1.0),(0.0),(1.0)) va(a), (VALUES (-1.0),(0.0),(1.0)) vb(b), (VALUES (-1.0),(0.0),(1.0)) vd(d)),
l AS (SELECT p.scene_id, object_id, frame_id, r0*(x-tx)+r3*(y-ty)+r6*(z-tz) AS lx, r1*(x-tx)+r4*(y-ty)+r7*(z-tz) AS ly, r2*(x-tx)+r5*(y-ty)+r8*(z-tz) AS lz FROM pt p JOIN cam c ON p.scene_id = c.scene_id),
px AS (SELECT *, 525.0*lx/lz+320.0 AS u, 525.0*ly/lz+240.0 AS v FROM l WHERE lz <> 0),
vis AS (SELECT px.*, lz > 0 AND depth > 0 AND (lz-depth/1000.0)/(depth/1000.0+1e-6) > 0.001 AS hidden FROM px LEFT JOIN cell ON cell.scene_id = px.scene_id AND cell.frame_id = px.frame_id AND i = CAST(trunc(trunc(u)/40) AS INT) AND j = CAST(trunc(trunc(v)/40) AS INT)
  WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480),
agg AS (SELECT scene_id, frame_id, object_id, count(*) FILTER (s) AS n_seen, coalesce(bool_or(hidden), false) AS occluded, min(u) FILTER (s) AS ul, max(u) FILTER (s) AS uh, min(v) FILTER (s) AS vl, max(v) FILTER (s) AS vh,
  min(lx) FILTER (s) AS xl, max(lx) FILTER (s) AS xh, min(ly) FILTER (s) AS yl, max(ly) FILTER (s) AS yh, min(lz) FILTER (s) AS zl, max(lz) FILTER (s) AS zh FROM (SELECT *, lz > 0 AND NOT coalesce(hidden, false) AS s FROM vis) GROUP BY 1, 2, 3),
seen AS (SELECT scene_id, frame_id, object_id, least(640, greatest(0, CAST(trunc(ul) AS BIGINT) - 2)) AS u0, least(480, greatest(0, CAST(trunc(vl) AS BIGINT) - 2)) AS v0, least(640, CAST(trunc(uh + 0.5) AS BIGINT) + 2) AS u1, least(480, CAST(trunc(vh + 0.5) AS BIGINT) + 2) AS v1,
  round_even(n_seen / 27.0, 4) AS visibility, round((xl+xh)/2, 4) + 0.0 AS centre_x, round((yl+yh)/2, 4) + 0.0 AS centre_y, round((zl+zh)/2, 4) + 0.0 AS centre_z, true AS truncated, occluded FROM agg WHERE n_seen > 0)"""


@query("g28_depth_visibility", with_views("objects", "poses", rest=_SEEN) + "SELECT * FROM seen")
def depth_visibility(spark, sf):
    """Boxes, shares and centres of what each camera sees, by its own depth image."""
    seen = occlusion.seen_instances(points(spark, sf), cameras(spark, sf), images(spark, sf))
    return seen.withColumns({f"centre_{c}": g.tidy(F.col(f"centre_{c}"), 4) for c in "xyz"})


@query("a15_first_seen", with_views("objects", "poses", rest=_SEEN) + "SELECT o.scene_id, o.object_id, coalesce(CAST(min(s.frame_id) AS VARCHAR), '-1') AS first_frame FROM objects o LEFT JOIN seen s ON s.scene_id = o.scene_id AND s.object_id = o.object_id AND s.visibility >= 0.1 AND (SELECT count(*) FROM cam WHERE cam.scene_id = s.scene_id AND cam.frame_id < s.frame_id) % 2 = 0 GROUP BY 1, 2")
def first_seen(spark, sf):
    """Of every second camera the first that sees a tenth of an object, by its own depth image."""
    p, c = points(spark, sf), cameras(spark, sf)
    return occlusion.first_seen(occlusion.seen_instances(p, c, images(spark, sf)), p, c, every=2)
