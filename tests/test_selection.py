"""Percentiles by selection equal numpy's on groups of every shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenery.operators.selection import percentile

RNG = np.random.RandomState(5)
GROUPS = {
    "even": RNG.uniform(-5, 5, 3000),
    "ties": RNG.randint(0, 3, 3000).astype(float),
    "one": np.array([2.5]),
    "two": np.array([1.0, 4.0]),
    "same": np.full(2000, 7.0),
    "wide": np.concatenate([10.0 ** RNG.uniform(-300, 300, 1500), -(10.0 ** RNG.uniform(-300, 300, 1500))]),
    "ends": np.concatenate([np.full(900, -1.7e308), np.full(900, 1.7e308), [-math.inf, math.inf, 0.0]]),
    "close": 1 + np.arange(2000) * 2.0**-52,
    "hot": RNG.normal(0, 1, 60_000),
}


@pytest.mark.parametrize("share", [0.0, 0.4, 0.95])
def test_equals_numpy(spark, share):
    rows = [(k, float(v), 1) for k, vs in GROUPS.items() for v in vs] + [("even", None, 2), ("nothing", None, 3), (None, 3.0, 4), ("nan", math.nan, 5), ("nan", 1.0, 6)]
    df = spark.createDataFrame(rows, "g string, v double, low int").repartition(6)
    got = {r["g"]: (r["n"], r["p"]) for r in percentile(df, ["g"], F.col("v"), share, "p", few=50).collect()}
    assert set(got) == {*GROUPS, "nothing", "nan", None}
    for k, vs in GROUPS.items():
        s, at = np.sort(vs), share * (len(vs) - 1)
        a, b, part = s[math.floor(at)], s[min(math.floor(at) + 1, len(s) - 1)], at - math.floor(at)
        want = a if part == 0 else a * (1 - part) + b * part
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(want, rel=1e-15, abs=0), k
    assert got["nothing"] == (0, None) and got[None] == (1, 3.0) and math.isnan(got["nan"][1])


def test_empty_table_and_no_keys(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert percentile(empty, ["g"], F.col("v"), 0.5).count() == 0
    rows = spark.range(1001).select(F.col("id").alias("v"))
    assert percentile(rows, [], F.col("v"), 0.25, few=10).collect()[0]["percentile"] == 250.0
    with pytest.raises(ValueError):
        percentile(rows, [], F.col("v"), 1.5)
