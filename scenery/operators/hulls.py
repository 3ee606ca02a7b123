"""Room areas from point sets: hulls of a scene's bounded voxels, alpha shapes in tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenery.operators.selection import percentile
from scenery.session import written


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, by the monotone chain."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def triangulate(points: np.ndarray) -> np.ndarray:
    """The Delaunay triangulation of distinct points in the plane, as rows of three places; by insertion, point after point.

    A point takes away the triangles whose circles hold it and joins their outline. The work is at most quadratic.
    """
    n = len(points)
    if n < 3:
        return np.empty((0, 3), int)
    middle, span = points.mean(axis=0), max(np.ptp(points, axis=0).max(), 1e-9)
    far = middle + 1e4 * span * np.array([(-1.0, -1.0), (1.0, -1.0), (0.0, 1.5)])
    p = np.vstack([points, far])
    tri, circles = np.array([[n, n + 1, n + 2]]), _circles(p, np.array([[n, n + 1, n + 2]]))
    for k in range(n):
        inside = ((circles[:, :2] - p[k]) ** 2).sum(axis=1) < circles[:, 2] * (1 + 1e-12)
        edges = np.sort(np.concatenate([tri[inside][:, [0, 1]], tri[inside][:, [1, 2]], tri[inside][:, [2, 0]]]), axis=1)
        own, times = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([own[times == 1], np.full((times == 1).sum(), k)])
        tri = np.vstack([tri[~inside], new])
        circles = np.vstack([circles[~inside], _circles(p, new)])
    return tri[(tri < n).all(axis=1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Centre and squared radius of each triangle's circle; boundless for flat ones."""
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        x, y = (v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d
    flat = d == 0
    return np.column_stack([np.where(flat, 0.0, a[:, 0] + x), np.where(flat, 0.0, a[:, 1] + y), np.where(flat, np.inf, x * x + y * y)])


def alpha_area(points: np.ndarray, alpha: float = 1.0, owned=None) -> float:
    """Area of the triangles whose circle is narrower than 1 / alpha; of fewer than four points their hull's.

    owned: which of the circles' centres count, by their x and y.
    """
    if len(points) < 4 and owned is None:
        return area(convex_hull(points))
    tri = triangulate(points)
    if not len(tri):
        return 0.0
    tri = np.sort(tri, axis=1)  # of points in order, so that a triangle's centre is the same wherever it is found
    circles = _circles(points, tri)
    kept = circles[:, 2] < 1 / alpha**2
    if owned is not None:
        kept &= owned(circles[:, 0], circles[:, 1])
    u, v = points[tri[kept, 1]] - points[tri[kept, 0]], points[tri[kept, 2]] - points[tri[kept, 0]]
    return float(np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]).sum() / 2)


#: A tile's side, in reaches of the circle.
TILE = 8


def alpha_areas(points: DataFrame, scene: str, alpha: float, tile: float = TILE) -> DataFrame:
    """scene and area: the alpha shape of each scene's distinct points (x, y), worked out tile by tile.

    A circle narrower than its reach, 1 / alpha, lies within that reach of its centre, with its
    triangle and whatever point might break it. So a tile with a halo of one reach finds just
    the triangles whose circle is centred in it, and a scene's are those of its tiles, each
    once. A point goes to four tiles at most. Scenes of fewer than four points are hulls.
    """
    reach = 1 / alpha
    side = tile * reach
    kind = dict(points.dtypes)[scene]
    flat = points.select(scene, "x", "y").distinct()
    counts = flat.groupBy(scene).agg(F.count(F.lit(1)).alias("n"))
    tiles = [F.explode(F.sequence(F.floor((F.col(c) - reach * 1.001) / side), F.floor((F.col(c) + reach * 1.001) / side))).alias(t) for c, t in (("x", "i"), ("y", "j"))]
    dealt = flat.select("*", tiles[0]).select("*", tiles[1])

    def of_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        p = pdf[["x", "y"]].sort_values(["x", "y"]).to_numpy(float)
        found = alpha_area(p, alpha, lambda x, y: (np.floor(x / side) == i) & (np.floor(y / side) == j))
        return pd.DataFrame({scene: [pdf[scene].iloc[0]], "area": [found]})

    def of_few(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({scene: [pdf[scene].iloc[0]], "area": [area(convex_hull(pdf[["x", "y"]].to_numpy(float)))]})

    shape = f"{scene} {kind}, area double"
    parts = dealt.groupBy(scene, "i", "j").applyInPandas(of_tile, shape).groupBy(scene).agg(F.sum("area").alias("tiled"))
    few = flat.join(counts.where("n < 4"), scene, "left_semi").groupBy(scene).applyInPandas(of_few, shape).withColumnRenamed("area", "hull")
    return counts.join(parts, scene, "left").join(few, scene, "left").select(scene, F.coalesce("hull", "tiled", F.lit(0.0)).alias("area"))


def room_area(points: DataFrame, scene: str = "scene_id", voxel: float | None = None, alpha: float | None = 1.0, jitter: float = 0.001, seed: int = 42, order: str | None = None) -> DataFrame:
    """Area of each scene's floor points: their alpha shape, or their hull where alpha is None.

    The first point of every voxel stays, first by `order` or else by x, y and z. Voxels start
    at the floor points' least coordinates; for the alpha shape they are cubes of a metre, for
    the hull squares of five centimetres. A small seeded jitter, in the order of the points,
    keeps points of a grid from lying on one circle. The shape is worked out in tiles.
    """
    axes = "xy" if alpha is None else "xyz"
    side = voxel or (0.05 if alpha is None else 1.0)
    floor = percentile(points, [scene], F.col("z"), 0.4, "__p").drop("n")
    low = points.join(floor, scene).where(F.col("z") < F.col("__p") + 0.1)
    bounds = low.groupBy(scene).agg(*[F.min(c).alias(f"__{c}") for c in axes])
    first = F.struct(*([order] if order else []), "x", "y", "z")
    cells = [F.floor((F.col(c) - F.col(f"__{c}")) / side).alias(f"__c{c}") for c in axes]
    thin = low.join(bounds, scene).groupBy(scene, *cells).agg(F.min(first).alias("q"))

    kind = dict(points.dtypes)[scene]
    thin = thin.select(scene, *([F.col(f"q.{order}").alias("__order")] if order else []), "q.x", "q.y", "q.z")
    if alpha is not None:
        if jitter:
            place = F.row_number().over(Window.partitionBy(scene).orderBy(*(["__order"] if order else []), "x", "y", "z")) - 1
            moved = thin.withColumn("__k", place).mapInPandas(_moved(scene, jitter, seed), f"{scene} {kind}, x double, y double")
            thin = written(moved, "room-points")  # each place is moved once
        found = alpha_areas(thin, scene, alpha)
        return found.select(scene, F.round("area", 4).alias("area"))

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({scene: [pdf[scene].iloc[0]], "area": [round(area(convex_hull(pdf[["x", "y"]].to_numpy(float))), 4)]})

    return thin.groupBy(scene).applyInPandas(hull, f"{scene} {kind}, area double")


def _moved(scene: str, jitter: float, seed: int):
    """Adds to the k-th point of a scene the k-th pair of a seeded sequence of normal numbers, drawn block by block."""
    block = 1 << 16

    def run(batches):
        drawn: dict[int, np.ndarray] = {}
        for pdf in batches:
            k = pdf["__k"].to_numpy()
            noise = np.zeros((len(k), 2))
            for b in np.unique(k // block).tolist():
                if b not in drawn:
                    rng = np.random.RandomState(seed)
                    for _ in range(b):
                        rng.normal(0, jitter, (block, 2))
                    drawn = {b: rng.normal(0, jitter, (block, 2))}
                own = k // block == b
                noise[own] = drawn[b][k[own] % block]
            yield pd.DataFrame({scene: pdf[scene], "x": pdf["x"] + noise[:, 0], "y": pdf["y"] + noise[:, 1]})

    return run
