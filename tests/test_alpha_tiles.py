"""Alpha shapes in tiles against the whole triangulation, whatever the tiles; the seeded jitter."""

import numpy as np
import pandas as pd
import pytest

from scenery.operators import hulls


def scenes():
    rng = np.random.default_rng(6)
    ring = rng.normal(0, 0.15, (400, 2)) + 12 * np.stack([np.cos(t := rng.uniform(0, 6.28, 400)), np.sin(t)], 1)
    return {1: rng.uniform(-20, 20, (900, 2)), 2: ring, 3: np.array([(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)]), 4: rng.uniform(0, 3, (60, 2)) + 1000, 5: np.array([(1.0, 1.0)]), 6: rng.uniform(0, 100, (200, 2)), 7: np.stack([np.arange(9.0), np.zeros(9)], 1)}


@pytest.mark.parametrize("tile", [2, 3.7, 8, 1000])
@pytest.mark.parametrize("alpha", [1.0, 0.3])
def test_area_does_not_depend_on_tiles(spark, tile, alpha):
    own = scenes()
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"s": k, "x": p[:, 0], "y": p[:, 1]}) for k, p in own.items()])).repartition(3)
    got = {r["s"]: r["area"] for r in hulls.alpha_areas(df.union(df), "s", alpha, tile).collect()}
    assert got == {k: pytest.approx(hulls.alpha_area(p[np.lexsort(p.T[::-1])], alpha), rel=1e-9, abs=1e-9) for k, p in own.items()}
    assert got[1] > 100 and got[3] == 40.5 and got[5] == 0 and got[7] == 0


def test_jitter_follows_the_order_of_the_points(spark, monkeypatch):
    """The k-th kept point moves by the k-th draw of the seed."""
    rng = np.random.default_rng(2)
    p = rng.permutation([(i, j) for i in range(8) for j in range(8)]).astype(float)
    df = spark.createDataFrame([("s", k, *map(float, q), 0.0) for k, q in enumerate(p)], "s string, id int, x double, y double, z double").repartition(4)
    want = hulls.alpha_area(p + np.random.RandomState(42).normal(0, 0.001, p.shape))
    assert hulls.room_area(df, "s", order="id").first()["area"] == pytest.approx(want, abs=6e-5)
