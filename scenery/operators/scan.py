"""Recurrences along sequences of any length: segmented scans of affine maps.

A step takes the state (next, run) to (p next + q, a run + b next + c). Such maps compose to
one of their kind, and composing is associative, so a sequence need not be walked from end to
end: its positions are dealt into buckets, each bucket's maps are composed from its first
step on, the buckets' whole maps, one row each, are composed along the sequence, and what
comes before a bucket is joined back to its rows. A sequence of a million tokens is a few
hundred buckets in as many tasks; only their maps meet in one, as a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenery.session import written

SIZE = 4096
MAP = ("p", "q", "a", "b", "c")


def composed(second: tuple, first: tuple) -> tuple:
    """The map that takes the first step and then the second."""
    p2, q2, a2, b2, c2 = second
    p1, q1, a1, b1, c1 = first
    return p2 * p1, p2 * q1 + q2, a2 * a1, a2 * b1 + b2 * p1, a2 * c1 + b2 * q1 + c2


def scanned(maps: tuple, starts: np.ndarray) -> tuple:
    """Of every step the map from the start of its segment up to it, by doubling: log n rounds of whole arrays."""
    n = len(starts)
    since = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    d = 1
    while d <= since.max(initial=0):
        at = np.flatnonzero(since >= d)
        new = composed(tuple(m[at] for m in maps), tuple(m[at - d] for m in maps))
        maps = tuple(m.copy() for m in maps)
        for m, v in zip(maps, new, strict=True):
            m[at] = v
        d *= 2
    return maps


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces maps by those from the start of their segment; one that goes on over batches takes what it has along."""
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("__first").to_numpy(zero_copy_only=False).copy()
        maps = tuple(batch.column(f"__{k}").to_numpy().astype(float) for k in MAP)
        goes_on, starts[0] = not starts[0], True
        maps = scanned(maps, starts)
        if goes_on:
            n = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else len(starts)
            head = composed(tuple(m[:n] for m in maps), carried)
            for m, v in zip(maps, head, strict=True):
                m[:n] = v
        carried = tuple(float(m[-1]) for m in maps)
        columns = {name: batch.column(name) for name in batch.schema.names} | {f"__{k}": pa.array(m) for k, m in zip(MAP, maps, strict=True)}
        yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)


def _along(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Maps from the start of each group: the window deals and sorts the rows, the stream follows in its order."""
    marked = rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)
    return marked.mapInArrow(_streamed, marked.schema).drop("__first")


def states(rows: DataFrame, keys: list[str], position: str, maps: dict[str, Column], backward: bool = False, size: int = SIZE) -> DataFrame:
    """Adds state_next and state_run, the state after each step, from (0, 0) on.

    maps: p, q, a, b and c of every step; what is left out is p = a = 1 and 0 for the others.
    Positions are whole numbers, each once in a sequence, one behind the other or with gaps;
    backward: the last comes first. Rows keep all columns.
    """
    o = F.col(position).cast("long")
    along = -o if backward else o
    given = {k: maps.get(k, F.lit(1.0 if k in "pa" else 0.0)).cast("double") for k in MAP}
    own = rows.select(F.struct("*").alias("__row"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], along.alias("__o"), *[v.alias(f"__{k}") for k, v in given.items()])
    by = [f"__k{i}" for i in range(len(keys))]
    own = own.withColumn("__bucket", F.floor(F.col("__o") / size))
    local = written(_along(own, [*by, "__bucket"], "__o"), "scan-local")
    whole = local.groupBy(*by, "__bucket").agg(F.max_by(F.struct(*[f"__{k}" for k in MAP]), "__o").alias("m")).select(*by, "__bucket", "m.*")
    upto = written(_along(whole, by, "__bucket"), "scan-buckets")
    # What a bucket's last state is, the next bucket starts from; one row a bucket.
    before = Window.partitionBy(*by).orderBy("__bucket")
    carry = upto.select(*by, "__bucket", F.coalesce(F.lag("__q").over(before), F.lit(0.0)).alias("__next"), F.coalesce(F.lag("__c").over(before), F.lit(0.0)).alias("__run"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    both = local.alias("l").join(carry.alias("r"), [*same, F.col("l.__bucket") == F.col("r.__bucket")])
    state_next = F.col("__p") * F.col("__next") + F.col("__q")
    state_run = F.col("__a") * F.col("__run") + F.col("__b") * F.col("__next") + F.col("__c")
    return both.select(*[F.col("__row")[c].alias(c) for c in rows.columns], state_next.alias("state_next"), state_run.alias("state_run"))


def gae(rows: DataFrame, keys: list[str], position: str, reward: str, value: str, mask: str, gamma: float, lam: float, size: int = SIZE) -> DataFrame:
    """Adds advantage, the generalised advantage of every token; masked tokens pass the state on."""
    live = F.col(mask).cast("int") == 1
    r, v = F.col(reward).cast("double"), F.col(value).cast("double")
    step = {"p": F.when(live, 0.0).otherwise(1.0), "q": F.when(live, v).otherwise(0.0), "a": F.when(live, gamma * lam).otherwise(1.0), "b": F.when(live, gamma).otherwise(0.0), "c": F.when(live, r - v).otherwise(0.0)}
    return states(rows, keys, position, step, True, size).withColumnRenamed("state_run", "advantage").drop("state_next")


def discounted(rows: DataFrame, keys: list[str], position: str, reward: str, mask: str, gamma: float, size: int = SIZE) -> DataFrame:
    """Adds returns, the discounted return of every token from the end, set to nought after each masked one."""
    m, r = F.col(mask).cast("double"), F.col(reward).cast("double")
    step = {"p": m * gamma, "q": m * r, "a": F.lit(0.0), "b": F.lit(gamma), "c": r}
    return states(rows, keys, position, step, True, size).withColumnRenamed("state_run", "returns").drop("state_next")


def running_sum(rows: DataFrame, keys: list[str], position: str, value: str, into: str, size: int = SIZE) -> DataFrame:
    """Adds the sum of a value up to each position of a sequence."""
    return states(rows, keys, position, {"c": F.col(value)}, False, size).withColumnRenamed("state_run", into).drop("state_next")
