"""Visibility against depth images of any size, in parts, with missing images and cells."""

import numpy as np

from scenery.operators import occlusion
from scenery.plans.q_io import png

EYE = {f"r{i}": float(i % 4 == 0) for i in range(9)}
CAMERA = {"tx": 0.0, "ty": 0.0, "tz": 0.0, "fx": 100.0, "fy": 100.0, "cx": 50.0, "cy": 40.0, "width": 100.0, "height": 80.0, **EYE}


def by_hand(points, frames, images):
    """Point by point, as one would on paper."""
    out = {}
    for scene, frame in frames:
        raster = images.get((scene, frame))
        for obj in {o for s, o, *_ in points if s == scene}:
            own = [p[2:] for p in points if p[:2] == (scene, obj)]
            seen, occluded = [], False
            for x, y, z in own:
                if z <= 0:
                    continue
                u, v = 100 * x / z + 50, 100 * y / z + 40
                if not (0 <= u < 100 and 0 <= v < 80):
                    continue
                if raster is not None:
                    d = raster[int(int(v) / (80 / len(raster)))][int(int(u) / (100 / len(raster[0])))] / 1000
                    if d > 0 and (z - d) / (d + 1e-6) > 0.001:
                        occluded = True
                        continue
                seen.append((u, v, x, y, z))
            if seen:
                us, vs = [s[0] for s in seen], [s[1] for s in seen]
                box = (min(100, max(0, int(min(us)) - 2)), min(80, max(0, int(min(vs)) - 2)), min(100, int(max(us) + 0.5) + 2), min(80, int(max(vs) + 0.5) + 2))
                middle = tuple((min(s[k] for s in seen) + max(s[k] for s in seen)) / 2 for k in (2, 3, 4))
                out[scene, frame, obj] = (*box, round(len(seen) / len(own), 4), *middle, True, occluded)
    return out


def scene(spark, images, seed=3):
    rng = np.random.default_rng(seed)
    points = [(s, f"o{k % 7}", *map(float, p)) for s in (1, 2) for k, p in enumerate(rng.normal(0, 1, (400, 3)) + (0, 0, 2))]
    frames = [(s, f) for s in (1, 2) for f in (10, 20, 30)]
    p = spark.createDataFrame(points, "scene_id long, object_id string, x double, y double, z double").repartition(3)
    c = spark.createDataFrame([{"scene_id": s, "frame_id": f, **CAMERA} for s, f in frames])
    i = spark.createDataFrame([(s, f, bytearray(png(r))) for (s, f), r in images.items()], "scene_id long, frame_id long, image binary")
    return points, frames, p, c, i


def test_points_are_hidden_by_their_own_cell(spark, monkeypatch):
    rng = np.random.default_rng(1)
    images = {(1, 10): rng.integers(0, 4000, (8, 10)).tolist(), (1, 20): rng.integers(1000, 3000, (80, 100)).tolist(), (2, 10): rng.integers(0, 3000, (3, 7)).tolist(), (2, 30): [[0] * 4] * 4}
    points, frames, p, c, i = scene(spark, images)
    want = by_hand(points, frames, images)
    assert any(w[-1] for w in want.values()) and (1, 30, "o1") in want
    for most in (200_000, 60):  # whole frames, and frames in seven parts
        monkeypatch.setattr(occlusion, "POINTS_PER_TASK", most)
        got = {tuple(r)[:3]: tuple(r)[3:] for r in occlusion.seen_instances(p, c, i).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            np.testing.assert_allclose(np.array(got[k], float), np.array(w, float), atol=1e-9)


def test_first_of_every_other_frame(spark):
    points, frames, p, c, i = scene(spark, {(1, 10): [[1]], (2, 10): [[1]], (2, 30): [[1]]})
    seen = occlusion.seen_instances(p, c, i)
    got = {tuple(r)[:2]: r["first_frame"] for r in occlusion.first_seen(seen, p, c, every=2).collect()}
    assert {v for (s, _), v in got.items() if s == 1} == {"30"} and {v for (s, _), v in got.items() if s == 2} == {"-1"}
    assert len(got) == 14


def test_no_points(spark):
    _, _, p, c, i = scene(spark, {(1, 10): [[1]]})
    assert occlusion.seen_instances(p.where("false"), c, i).count() == 0
