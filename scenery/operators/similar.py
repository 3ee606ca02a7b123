"""Similarity join of names: all pairs whose sequence ratio reaches a cutoff, without comparing all pairs.

Twice the letters that two names share, counted with repeats, over their lengths is never
below the sequence ratio. A name is therefore a set of letters, each with the number of its
occurrence; two names that reach the cutoff c share at least c / (2 - c) of the longer one's
set, so they share one of its rarest letters: each side puts only that prefix of its letters,
in one fixed order from rare to frequent, into an inverted index. Pairs that meet there pass
filters on lengths, on the letters behind the one they meet in, and the bound itself, all in
columns; the ratio is worked out in Arrow batches for the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters from frequent to rare; any order gives the same pairs, this one the fewest candidates. Others are rarer still.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def letters(name: Column) -> Column:
    """A name's letters with the number of their occurrence, as texts that sort the rarest first: later occurrences, then letters that are not listed, then by place."""
    each = F.filter(F.split(name, ""), lambda c: c != "")
    number = lambda n: F.lpad(n.cast("string"), 9, "0")
    later = lambda c, i: number(F.lit(999_999_999) - F.size(F.filter(F.slice(each, 1, i + 1), lambda x: x == c)))
    place = lambda c: number(F.when(F.instr(F.lit(FREQUENT), c) > 0, F.lit(99) - F.instr(F.lit(FREQUENT), c)).otherwise(0))
    return F.sort_array(F.transform(each, lambda c, i: F.concat(later(c, i), place(c), c)))


def _prefix(own: Column, cutoff: float) -> Column:
    """The letters of which one at least stands in every name that reaches the cutoff."""
    n = F.size(own)
    needed = F.greatest(F.lit(1), F.ceil(n * F.lit(cutoff / (2 - cutoff)) - 1e-9)).cast("int")
    return F.slice(own, F.lit(1), F.greatest(n - needed + 1, F.lit(0)))


def _ratios(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known, other = batch.column("other").to_pylist(), batch.column("name").to_pylist()
        # The candidate comes first: the ratio is not symmetric.
        ratio = [SequenceMatcher(None, x, y).ratio() for x, y in zip(known, other, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio, pa.float64())], names=[*batch.schema.names, "ratio"])


def pairs(names: DataFrame, others: DataFrame, cutoff: float, keys: list[str] | None = None, name: str = "name", other: str = "other") -> DataFrame:
    """keys, name, other and ratio: every name with every other of its group whose ratio is the cutoff or more.

    Two empty names are equal. Nulls are in no pair; repeated names are compared once. The
    cutoff is above 0 and at most 1.
    """
    if not 0 < cutoff <= 1 or math.isnan(cutoff):
        raise ValueError("the cutoff is above 0 and at most 1")
    keys = keys or []
    left = names.where(F.col(name).isNotNull()).select(*keys, F.col(name).alias("name")).distinct().withColumn("a", letters(F.col("name")))
    right = others.where(F.col(other).isNotNull()).select(*keys, F.col(other).alias("other")).distinct().withColumn("b", letters(F.col("other")))
    one, two = (rows.select("*", F.posexplode(_prefix(F.col(c), cutoff)).alias(f"at_{c}", "letter")) for rows, c in ((left, "a"), (right, "b")))
    shared, n, m = F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b")
    met = one.join(two, [*keys, "letter"]).where((n >= m * (cutoff / (2 - cutoff)) - 1e-9) & (m >= n * (cutoff / (2 - cutoff)) - 1e-9))
    # From their first common letter on, two names share no more than either has left.
    met = met.where(2.0 * F.least(n - F.col("at_a"), m - F.col("at_b")) >= cutoff * (n + m) - 1e-9)
    met = met.where(2.0 * shared >= cutoff * (n + m) - 1e-9).select(*keys, "name", "other").distinct()
    empty = left.where("name = ''").join(right.where("other = ''").select(*keys, "other"), keys) if keys else left.where("name = ''").join(right.where("other = ''").select("other"), F.col("name") == F.col("other"))
    met = met.unionByName(empty.select(*keys, "name", "other"))
    kinds = met.selectExpr("*", "cast(0 as double) as ratio").schema
    return met.mapInArrow(_ratios, kinds).where(F.col("ratio") >= cutoff)


def closest(names: DataFrame, others: DataFrame, cutoff: float, keys: list[str] | None = None, name: str = "name", other: str = "other") -> DataFrame:
    """Of each name the other with the highest ratio, of equal ones the last in order; names without one have no row."""
    keys = keys or []
    found = pairs(names, others, cutoff, keys, name, other).groupBy(*keys, "name").agg(F.max(F.struct("ratio", "other")).alias("best"))
    return found.select(*keys, F.col("name").alias(name), F.col("best.other").alias(other), F.col("best.ratio").alias("ratio"))
