"""Nearest objects by grids, against all pairs: clusters, outliers, equal places, ties, and a large group."""

import numpy as np
import pandas as pd
import pytest

from scenery.operators import nearest


def by_hand(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g and all(v is not None and np.isfinite(v) for v in r[2:])), key=lambda r: r[1])
        p = np.array([r[2:] for r in own], float)
        for i, r in enumerate(own):
            d = np.sqrt((p[:, 0] - p[i, 0]) ** 2 + (p[:, 1] - p[i, 1]) ** 2 + (p[:, 2] - p[i, 2]) ** 2)
            best = min(((round(float(v), 2), own[j][1]) for j, v in enumerate(d) if j != i), default=None)
            if best:
                out[g, r[1]] = (best[1], best[0])
    return out


def groups():
    rng = np.random.default_rng(4)
    rows, n = [], iter(range(10**6))
    add = lambda g, points: rows.extend((g, next(n), *map(float, p)) for p in points)
    add("even", rng.uniform(0, 10, (300, 3)))
    add("clustered", np.concatenate([c + rng.normal(0, 0.02, (60, 3)) for c in rng.uniform(-50, 50, (5, 3))] + [np.array([(1000.0, 0, 0), (-1000.0, 5, 5)])]))
    add("one place", [(1, 2, 3)] * 40)
    add("places", np.repeat(rng.uniform(-1, 1, (30, 3)), 3, axis=0))
    add("lattice", np.array(list(np.ndindex(6, 6, 6)), float))
    add("near ties", rng.integers(0, 40, (200, 3)) * 0.004)
    add("line", [(2.0**k, 0, 0) for k in range(20)])
    add("alone", [(0, 0, 0)])
    add("two", [(0, 0, 0), (0.001, 0, -1e3)])
    rows += [("even", next(n), None, 1.0, 1.0), ("even", next(n), float("nan"), 1.0, 1.0), ("even", next(n), float("inf"), 0.0, 0.0), ("even", next(n), -0.0, 0.0, 0.0), ("even", next(n), 0.0, 0.0, 0.0)]
    return rows


@pytest.mark.parametrize("direct", [0, 100])
def test_as_all_pairs(spark, direct):
    rows = groups()
    got = nearest.nearest(spark.createDataFrame(rows, "grp string, id long, x double, y double, z double").repartition(3), ["grp"], "id", direct=direct).collect()
    assert {(r["grp"], r["id"]): (r["near"], r["distance"]) for r in got} == by_hand(rows) and len(got) == len(by_hand(rows))


def test_no_objects(spark):
    assert nearest.nearest(spark.createDataFrame([], "grp string, id long, x double, y double, z double"), ["grp"], "id").count() == 0


def test_a_hundred_thousand_objects_of_one_scene(spark):
    """All pairs would be ten thousand million; a few hundred objects are held against all."""
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(0, 100, (50_000, 3)), (50, 50, 50) + rng.normal(0, 0.5, (50_000, 3))])
    rows = spark.createDataFrame(pd.DataFrame({"scene": 1, "id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = {r["id"]: (r["near"], r["distance"]) for r in nearest.nearest(rows, ["scene"], "id").collect()}
    assert len(got) == len(p)
    for i in rng.integers(0, len(p), 300).tolist():
        d = np.sqrt((p[:, 0] - p[i, 0]) ** 2 + (p[:, 1] - p[i, 1]) ** 2 + (p[:, 2] - p[i, 2]) ** 2)
        d[i] = np.inf
        assert got[i][1] == round(float(d.min()), 2) and abs(d[got[i][0]] - got[i][1]) < 0.00501
