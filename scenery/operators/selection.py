"""Exact percentiles of groups of any size: the two order statistics are found by narrowing bins.

A built-in exact percentile holds all values of a group in one buffer. Here a group is only
counted: its range is cut into bins, whose numbers, least and greatest values are partial
aggregates, and the bin that holds the rank sought becomes the next range. Rounds cut evenly
and by the logarithm in turn, so that values of any spread separate. What is left of a group
when its bin holds no more than `few` values is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.session import written

BINS = 1024
FEW = 10_000
LARGEST = 1.7976931348623157e308


def _even(v: Column, low: Column, high: Column) -> Column:
    """Share of the way from low to high, halved first: the range of doubles is wider than a double."""
    cut = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c)) / 2
    return (cut(v) - cut(low)) / (cut(high) - cut(low))


def _scale(v: Column) -> Column:
    """Grows with v, by the logarithm on either side of 0; the least double's logarithm is above -746."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.least(F.abs(v), F.lit(LARGEST))) + 746))


def _bin(v: Column, low: Column, high: Column, even: bool) -> Column:
    """The bin of a value; the least and the greatest value have bins of their own, so that every round separates them."""
    share = _even(v, low, high) if even else _even(_scale(v), _scale(low), _scale(high))
    inner = 1 + F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(F.nullif(share, F.lit(float("nan"))), F.lit(0.0)) * BINS))).cast("int")
    return F.when(v == low, 0).when(v == high, BINS + 1).otherwise(inner)


def percentile(rows: DataFrame, keys: list[str], value: Column, share: float, out: str = "percentile", few: int = FEW) -> DataFrame:
    """One row per group: its keys, `n`, the number of its values, and the percentile at `share`, from 0 to 1.

    Between two values it interpolates linearly. Nulls are no values; a group without values has
    n = 0 and null, one with a NaN has NaN. Null keys are a group. Other columns are not read.
    The largest group costs no task more than its share: rows meet the groups' ranges, one row a
    group, and only bin counts and brackets of at most `few` values are shuffled.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"a share is from 0 to 1: {share}")
    keyed = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    live = rows.select(*keyed, value.cast("double").alias("v"))
    number = F.isnotnull("v") & ~F.isnan("v")
    real = F.when(number, F.col("v"))
    groups = live.groupBy(*ks).agg(
        F.count("v").alias("n"), F.count_if(F.isnan("v")).alias("nans"), F.min(real).alias("low"), F.max(real).alias("high")
    )
    rank = F.floor(share * (F.col("n") - 1))
    groups = written(groups.withColumns({"rank": rank, "part": share * (F.col("n") - 1) - rank}), "percentile-groups")

    # A group is at a range: `before` values lie below it, `inside` in it. It is over when `a` and `b` are known.
    same = F.col("low") == F.col("high")
    state = groups.where("n > 0 AND nans = 0").select(
        *ks, "n", "rank", "part", "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"),
        F.when(same, F.col("low")).alias("a"), F.when(same, F.col("low")).alias("b"),
    )
    state, done, sorted_out, turn = written(state, "percentile-state"), [], [], 0
    rest = live.where(number)
    while True:
        over = F.col("a").isNotNull()
        done.append(state.where(over).select(*ks, "part", "a", "b"))
        small = state.where(~over & (F.col("inside") <= few))
        large = state.where(~over & (F.col("inside") > few))
        sorted_out.append(_sorted(_within(rest, small, ks), ks))
        if large.isEmpty():
            break
        rest = written(_within(rest, large, ks).select(*ks, "v"), "percentile-rest")
        state = written(_narrowed(_within(rest, large, ks), large, ks, even=turn % 2 == 0), "percentile-state")
        turn += 1
    found = reduce(DataFrame.unionByName, done + sorted_out)
    found = found.select(*ks, F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("p"))
    g, f = groups.alias("g"), found.alias("f")
    joined = g.join(f, _equal(ks, "g", "f"), "left")
    result = F.when(F.col("g.nans") > 0, F.lit(float("nan"))).otherwise(F.col("f.p"))
    return joined.select(*[F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)], F.col("g.n").alias("n"), result.alias(out))


def _equal(ks: list[str], left: str, right: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in ks], F.lit(True))


def _within(rest: DataFrame, state: DataFrame, ks: list[str]) -> DataFrame:
    """The values inside their groups' ranges, with the ranges."""
    joined = rest.alias("r").join(state.alias("s"), _equal(ks, "r", "s") & F.col("r.v").between(F.col("s.low"), F.col("s.high")))
    return joined.select(*[F.col(f"r.{k}") for k in ks], "r.v", "s.low", "s.high", "s.rank", "s.part", "s.before", "s.inside")


def _sorted(rows: DataFrame, ks: list[str]) -> DataFrame:
    """The two values sought in brackets of few values."""
    v = rows.groupBy(*ks).agg(F.sort_array(F.collect_list("v")).alias("v"), F.first(F.col("rank") - F.col("before")).alias("at"), F.first("part").alias("part"))
    return v.select(*ks, "part", F.get("v", F.col("at").cast("int")).alias("a"), F.coalesce(F.get("v", (F.col("at") + 1).cast("int")), F.get("v", F.col("at").cast("int"))).alias("b"))


def _narrowed(rows: DataFrame, state: DataFrame, ks: list[str], even: bool) -> DataFrame:
    """Every group at the bin that holds its rank; both values are known where the bin holds one value or its last is sought."""
    bins = rows.groupBy(*ks, _bin(F.col("v"), F.col("low"), F.col("high"), even).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    # At most BINS + 2 short rows a group: folded in one array.
    whole = bins.groupBy(*ks).agg(F.sort_array(F.collect_list(F.struct("bin", "c", "lo", "hi"))).alias("bins"))
    joined = state.alias("s").join(whole.alias("w"), _equal(ks, "s", "w")).select("s.*", "w.bins")
    sums = F.aggregate(
        "bins",
        F.struct(F.col("before").alias("upto"), F.lit(None).cast("struct<before:bigint,c:bigint,lo:double,hi:double>").alias("own"), F.lit(None).cast("double").alias("next")),
        lambda t, x: F.struct(
            (t["upto"] + x["c"]).alias("upto"),
            F.when(t["own"].isNotNull(), t["own"]).when(t["upto"] + x["c"] > F.col("rank"), F.struct(t["upto"].alias("before"), x["c"].alias("c"), x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("own"),
            F.when(t["next"].isNotNull(), t["next"]).when(t["own"].isNotNull(), x["lo"]).alias("next"),
        ),
    )
    at = joined.withColumn("t", sums).select(*ks, "n", "rank", "part", "t.own.*", F.col("t.next").alias("next"))
    last = F.col("rank") == F.col("before") + F.col("c") - 1
    one = F.col("lo") == F.col("hi")
    a = F.when(last, F.col("hi")).when(one, F.col("lo"))
    b = F.when(last, F.coalesce("next", "hi")).when(one, F.col("lo"))
    return at.select(*ks, "n", "rank", "part", F.col("lo").alias("low"), F.col("hi").alias("high"), "before", F.col("c").alias("inside"), a.alias("a"), b.alias("b"))
