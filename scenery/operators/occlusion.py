"""What each frame sees of each instance, tested against the frame's own depth image.

Points are projected where Spark holds them; only those that fall into an image travel on.
A frame's pixels and its image meet in a cogrouped Arrow map, where every pixel is compared
with its own cell, and come out as one partial row per instance. A scene of many points is
dealt into parts by a hash of the point, its images being sent to each part, so that no task
holds more than some POINTS_PER_TASK pixels of a frame; partial rows add up afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenery.functions import geometry as g
from scenery.sources.readers import decode_png

POINTS_PER_TASK = 200_000

# Relative error beyond which a point is hidden, what keeps a depth from vanishing, the box's margin, and the least share seen.
HIDDEN = 0.001
EPSILON = 1e-6
MARGIN = 2
SEEN = 0.1

_PARTIAL = "n_seen long, truncated boolean, occluded boolean, u_low double, u_high double, v_low double, v_high double, x_low double, x_high double, y_low double, y_high double, z_low double, z_high double"


def in_image(points: DataFrame, cameras: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Pixels (u, v) of the points of a scene in each of its frames, with their place in the camera's frame (lx, ly, lz).

    A point behind the camera whose pixel lies in the image comes out too: it marks its instance as truncated, and is not seen.
    cameras: scene, frame, r0 to r8, tx, ty, tz, fx, fy, cx, cy, width, height.
    """
    p = points.join(cameras, scene)
    local = g.to_camera(g.col3(""), [F.col(f"r{i}") for i in range(9)], g.col3("t"))
    p = p.withColumns({"lx": local[0], "ly": local[1], "lz": local[2]}).where("lz <> 0")
    p = p.withColumns({"u": F.col("fx") * F.col("lx") / F.col("lz") + F.col("cx"), "v": F.col("fy") * F.col("ly") / F.col("lz") + F.col("cy")})
    return p.where("u >= 0 AND u < width AND v >= 0 AND v < height")


def _hidden(pixels: pa.Table, image: np.ndarray | None, scale: float) -> np.ndarray:
    """Which pixels lie behind their cell of the depth image; cells of depth 0 hide nothing, nor does a missing image."""
    z = pixels.column("lz").to_numpy()
    if image is None:
        return np.zeros(len(z), bool)
    u, v, width, height = (pixels.column(c).to_numpy() for c in ("u", "v", "width", "height"))
    rows, columns = image.shape
    # An image's cells cover whole pixels: the pixel is cut to an integer before it is scaled, and again after.
    at_u, at_v = (u.astype(np.int64) / (width / columns)).astype(np.int64), (v.astype(np.int64) / (height / rows)).astype(np.int64)
    depth = image[np.minimum(at_v, rows - 1), np.minimum(at_u, columns - 1)] / scale
    return (at_u < columns) & (at_v < rows) & (depth > 0) & ((z - depth) / (depth + EPSILON) > HIDDEN)


def _tested(scene: str, frame: str, instance: str, scale: float, schema: pa.Schema):
    def one(pixels: pa.Table, images: pa.Table) -> pa.Table:
        if not pixels.num_rows:
            return schema.empty_table()
        image = decode_png(images.column("image")[0].as_py()) if images.num_rows and images.column("image")[0].is_valid else None
        ahead = pixels.column("lz").to_numpy() > 0
        hidden = ahead & _hidden(pixels, image, scale)
        seen = ahead & ~hidden
        coded = pixels.column(instance).combine_chunks().dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        out = {scene: pa.repeat(pixels.column(scene)[0], n), frame: pa.repeat(pixels.column(frame)[0], n), instance: coded.dictionary}
        out |= {"n_seen": np.bincount(code[seen], minlength=n), "truncated": np.ones(n, bool), "occluded": np.bincount(code[hidden], minlength=n) > 0}
        for name, column in (("u", "u"), ("v", "v"), ("x", "lx"), ("y", "ly"), ("z", "lz")):
            values = pixels.column(column).to_numpy()
            for end, fill, pick in (("low", np.inf, np.minimum), ("high", -np.inf, np.maximum)):
                found = np.full(n, fill)
                pick.at(found, code[seen], values[seen])
                out[f"{name}_{end}"] = found
        return pa.table([pa.array(out[f.name], f.type) if isinstance(out[f.name], np.ndarray) else out[f.name].cast(f.type) for f in schema], schema=schema)

    return one


def seen_instances(points: DataFrame, cameras: DataFrame, images: DataFrame, scene: str = "scene_id", frame: str = "frame_id", instance: str = "object_id", depth_scale: float = 1000.0) -> DataFrame:
    """One row per frame and instance of which a point is seen.

    u0, v0, u1, v1: the pixels' bounds with a margin of two, clamped to the image; visibility:
    the share of the instance's points, to four digits; centre_x to centre_z: the middle of the
    seen points' bounds in the camera's frame; truncated: a point falls into the image; occluded:
    a point is hidden. points: scene, instance, x, y, z. images: scene, frame, image, a grey PNG
    of any size; without one nothing is hidden.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = points.sparkSession
    counts = points.groupBy(scene, instance).agg(F.count(F.lit(1)).alias("n_points"))
    parts = counts.groupBy(scene).agg(F.ceil(F.sum("n_points") / POINTS_PER_TASK).cast("int").alias("parts"))
    own = points.select(scene, instance, "x", "y", "z").join(parts, scene).withColumn("part", F.pmod(F.xxhash64("x", "y", "z"), "parts").cast("int")).drop("parts")
    pixels = in_image(own, cameras, scene).select(scene, frame, "part", instance, "u", "v", "lx", "ly", "lz", "width", "height")
    copies = images.select(scene, frame, "image").join(parts, scene).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = [scene, frame, "part"]
    kinds = spark.createDataFrame([], pixels.select(scene, frame, instance).schema).selectExpr("*", *[f"cast(null as {kind}) as {name}" for name, kind in (c.split(" ") for c in _PARTIAL.split(", "))]).schema
    partial = pixels.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(_tested(scene, frame, instance, depth_scale, to_arrow_schema(kinds)), kinds)
    ends = [f(f"{c}_{e}").alias(f"{c}_{e}") for c in "uvxyz" for e, f in (("low", F.min), ("high", F.max))]
    found = partial.groupBy(scene, frame, instance).agg(F.sum("n_seen").alias("n_seen"), F.max("truncated").alias("truncated"), F.max("occluded").alias("occluded"), *ends).where("n_seen > 0")
    found = found.join(counts, [scene, instance]).join(cameras.select(scene, frame, "width", "height"), [scene, frame])

    def low(c: str, most: str):
        return F.least(F.col(most).cast("long"), F.greatest(F.lit(0), F.col(f"{c}_low").cast("long") - MARGIN)).cast("long")

    def high(c: str, most: str):
        return F.least(F.col(most).cast("long"), (F.col(f"{c}_high") + 0.5).cast("long") + MARGIN).cast("long")

    middles = [((F.col(f"{c}_low") + F.col(f"{c}_high")) / 2).alias(f"centre_{c}") for c in "xyz"]
    return found.select(
        scene, frame, instance, low("u", "width").alias("u0"), low("v", "height").alias("v0"), high("u", "width").alias("u1"), high("v", "height").alias("v1"),
        F.bround(F.col("n_seen") / F.col("n_points"), 4).alias("visibility"), *middles, "truncated", "occluded",
    )


def first_seen(seen: DataFrame, points: DataFrame, cameras: DataFrame, every: int = 20, least: float = SEEN, scene: str = "scene_id", frame: str = "frame_id", instance: str = "object_id") -> DataFrame:
    """Of every so many frames of a scene the first that sees a share of an instance, as text; `-1` where none does."""
    place = F.row_number().over(Window.partitionBy(scene).orderBy(frame)) - 1
    looked = cameras.select(scene, frame).withColumn("place", place).where(F.col("place") % every == 0).select(scene, frame)
    first = seen.where(F.col("visibility") >= least).join(looked, [scene, frame]).groupBy(scene, instance).agg(F.min(frame).alias("first"))
    every_one = points.select(scene, instance).distinct()
    return every_one.join(first, [scene, instance], "left").select(scene, instance, F.coalesce(F.col("first").cast("string"), F.lit("-1")).alias("first_frame"))
