"""Scans of affine maps against the step-by-step fold: buckets of any size, nulls as keys, a million tokens."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenery.operators import scan


def gae_by_fold(r, v, m, gamma, lam):
    nxt, adv, out = 0.0, 0.0, []
    for i in reversed(range(len(r))):
        if m[i]:
            adv = (r[i] + gamma * nxt - v[i]) + gamma * lam * adv
            nxt = v[i]
        out.append(adv)
    return out[::-1]


def returns_by_fold(r, m, gamma):
    run, out = 0.0, []
    for i in reversed(range(len(r))):
        run = r[i] + gamma * run
        out.append(run)
        run *= m[i]
    return out[::-1]


@pytest.mark.parametrize("size", [1, 3, 64, 4096])
def test_as_the_fold(spark, size):
    rng = np.random.default_rng(size)
    frames = []
    for key, n in (("a", 300), (None, 70), ("b", 1), ("c", 129)):
        frames.append(pd.DataFrame({"k": [key] * n, "pos": np.sort(rng.choice(5 * n + 1, n, False)) - n, "r": rng.normal(size=n), "v": rng.normal(size=n), "m": rng.integers(0, 2, n), "state_next": "own"}))
    every = pd.concat(frames)
    df = spark.createDataFrame(every.sample(frac=1, random_state=1), "k string, pos long, r double, v double, m int, __row string".replace("__row", "note")).repartition(3)
    got = scan.gae(df, ["k"], "pos", "r", "v", "m", 0.97, 0.9, size).toPandas()
    back = scan.discounted(df, ["k"], "pos", "r", "m", 0.97, size).toPandas()
    sums = scan.running_sum(df, ["k"], "pos", "r", "total", size).toPandas()
    for f in frames:
        of = lambda t: (t[t["k"].isna()] if f["k"].iloc[0] is None else t[t["k"] == f["k"].iloc[0]]).sort_values("pos")  # noqa: B023, E731
        r, v, m = (f[c].tolist() for c in "rvm")
        np.testing.assert_allclose(of(got)["advantage"], gae_by_fold(r, v, m, 0.97, 0.9), atol=1e-10)
        np.testing.assert_allclose(of(back)["returns"], returns_by_fold(r, m, 0.97), atol=1e-10)
        np.testing.assert_allclose(of(sums)["total"], np.cumsum(r), atol=1e-10)
        assert of(got)["note"].eq("own").all()


def test_batches_cut_anywhere():
    """A segment that goes on over several batches is one."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n = 200
    columns = {f"__{k}": rng.uniform(-1, 1, n) for k in scan.MAP} | {"__first": rng.random(n) < 0.05}
    columns["__first"][0] = True
    table = pa.table({k: pa.array(v) for k, v in columns.items()})
    whole = pa.Table.from_batches(list(scan._streamed(table.to_batches())))
    for most in (1, 7, 64):
        cut = pa.Table.from_batches(list(scan._streamed(table.to_batches(max_chunksize=most))))
        for k in scan.MAP:
            np.testing.assert_allclose(cut[f"__{k}"].to_numpy(), whole[f"__{k}"].to_numpy(), atol=1e-12)


def test_a_million_tokens_of_one_sequence(spark):
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select(F.lit("one").alias("k"), F.col("id").alias("pos"), ((F.col("id") * 7919 % 101) / 100).alias("r"), ((F.col("id") * 104729 % 97) / 97).alias("v"), (F.col("id") % 11 != 0).cast("int").alias("m"))
    got = scan.gae(df, ["k"], "pos", "r", "v", "m", 0.99, 0.95).select("pos", "advantage").toPandas().sort_values("pos")
    i = np.arange(n)
    np.testing.assert_allclose(got["advantage"], gae_by_fold((i * 7919 % 101) / 100, (i * 104729 % 97) / 97, i % 11 != 0, 0.99, 0.95), atol=1e-8)


def test_no_rows(spark):
    assert scan.gae(spark.createDataFrame([], "k int, pos int, r double, v double, m int"), ["k"], "pos", "r", "v", "m", 0.9, 0.9).count() == 0
