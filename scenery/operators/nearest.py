"""The nearest other object of every object, by grids of rising cell size instead of all pairs.

Objects at one place are one place. A place looks into the 27 cells around it, which hold
everything nearer than a cell's side; if what it finds is nearer than that, it is settled,
else it goes on with cells of twice the side. The first side of a group is the largest at
which no cell is crowded. A place that is still open has nobody within the side before, so
a cell holds a bounded number of open places: every stage compares a bounded number of
pairs per object, however the objects cluster, and there are as many stages as doublings
from the first side to the group's extent. Every stage is an equi-join on cells and a
written table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenery.functions import geometry as g
from scenery.session import written

#: Places in a cell up to which a grid serves as a group's first; groups of so few places compare all pairs.
CROWD = 8
DIRECT = 100
AXES = ("x", "y", "z")


def _cells(side: Column) -> list[Column]:
    return [F.floor(F.col(a) / side).cast("long").alias(f"c{a}") for a in AXES]


def _looked_at(rows: DataFrame, side: Column) -> DataFrame:
    """A row for each of the 27 cells around each row's place."""
    for c, a in zip(_cells(side), AXES, strict=True):
        rows = rows.withColumn(f"c{a}", c).withColumn(f"c{a}", F.explode(F.sequence(F.col(f"c{a}") - 1, F.col(f"c{a}") + 1)))
    return rows


def _best(pairs: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """Of each place the nearest other one, by the rounded distance and then by the order of its first object."""
    d = F.round(g.euclid([F.col(a) for a in AXES], [F.col(f"{a}_2") for a in AXES]), digits)
    apart = (F.col("x") != F.col("x_2")) | (F.col("y") != F.col("y_2")) | (F.col("z") != F.col("z_2"))
    return pairs.groupBy(*keys, *AXES).agg(F.min(F.when(apart, F.struct(d.alias("d"), F.col("first_2").alias("pos")))).alias("near"))


def _of_few(own: DataFrame, keys: list[str], order: str, digits: int) -> DataFrame:
    """Groups of a bounded size: all pairs."""
    d = F.round(g.euclid([F.col(a) for a in AXES], [F.col(f"{a}_2") for a in AXES]), digits)
    there = own.select(*keys, F.col("pos").alias("pos_2"), *[F.col(a).alias(f"{a}_2") for a in AXES])
    best = own.join(there, keys).where("pos <> pos_2").groupBy(*keys, "pos").agg(F.min(F.struct(d.alias("d"), F.col("pos_2").alias("pos"))).alias("best"))
    return best.select(*keys, F.col("pos").alias(order), F.col("best.pos").alias("near"), F.col("best.d").alias("distance"))


def nearest(objects: DataFrame, keys: list[str], order: str, digits: int = 2, direct: int = DIRECT) -> DataFrame:
    """keys, order, near and distance: the object nearest to each other one of its group.

    Distances are rounded before they are compared; of equal ones the first in `order` wins.
    A group's only object has none, and no row. Places must be finite; objects without one
    have no row.
    """
    known = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")) for a in AXES]
    own = objects.select(*keys, F.col(order).alias("pos"), *[(F.col(a).cast("double") + 0.0).alias(a) for a in AXES]).where(known[0] & known[1] & known[2])
    if (own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0) <= direct:
        return _of_few(own, keys, order, digits)
    # The two first objects of a place: to each the nearest at its own place is the first of the others.
    least = own.groupBy(*keys, *AXES).agg(F.min("pos").alias("first"))
    second = own.join(least, [*keys, *AXES]).where("pos <> first").groupBy(*keys, *AXES).agg(F.min("pos").alias("second"))
    places = least.join(second, [*keys, *AXES], "left")
    ends = [f(a).alias(f"{e}{a}") for a in AXES for e, f in (("l", F.min), ("h", F.max))]
    groups = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends)
    groups = groups.select(*keys, "n", F.greatest(*[F.col(f"h{a}") - F.col(f"l{a}") for a in AXES]).alias("extent"))
    top = groups.where(F.col("n") > direct).agg(F.max("extent").alias("e")).first()["e"]
    if top is not None:
        places, groups = written(places, "nearest-places"), written(groups, "nearest-groups")
    other = lambda rows: rows.select(*[c for c in rows.columns if c not in (*AXES, "first", "second")], *[F.col(a).alias(f"{a}_2") for a in AXES], F.col("first").alias("first_2"))
    few = places.join(groups.where(F.col("n") <= direct).select(*keys), keys) if top is not None else places
    settled = [_best(few.join(other(few), keys), keys, digits)]
    if top is not None:
        unit = 10.0**-digits
        levels = max(0, math.ceil(math.log2(max(top, unit) / unit)))
        settled += _by_grids(places, groups.where(F.col("n") > direct), keys, digits, unit, levels, other)
    near = settled[0]
    for s in settled[1:]:
        near = near.unionByName(s)
    rows = own.join(places.select(*keys, *AXES, "first", "second"), [*keys, *AXES]).join(near, [*keys, *AXES], "left")
    mate = F.when(F.col("pos") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    here = F.when(mate.isNotNull(), F.struct(F.lit(0.0).alias("d"), mate.alias("pos")))
    found = rows.select(*keys, F.col("pos").alias(order), F.least("near", here).alias("best")).where("best IS NOT NULL")
    return found.select(*keys, order, F.col("best.pos").alias("near"), F.col("best.d").alias("distance"))


def _by_grids(places: DataFrame, groups: DataFrame, keys: list[str], digits: int, unit: float, levels: int, other) -> list[DataFrame]:
    """Each stage's settled places; a stage writes what it finds, settled or open."""
    side = lambda level: F.lit(unit) * F.pow(F.lit(2.0), level)
    mine = places.join(groups.select(*keys, "extent"), keys)
    spread = mine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    crowds = spread.groupBy(*keys, "level", *_cells(side(F.col("level")))).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "level").agg(F.max("n").alias("n"))
    # A group's finest grid serves where all are crowded.
    start = crowds.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("n") <= CROWD, F.col("level"))), F.lit(0)).alias("start"))
    mine = written(mine.join(start, keys), "nearest-started")
    open_ = mine.select(*keys, *AXES, "extent", "start")
    out, stage = [], 0
    while True:
        level = F.col("start") + stage
        asked = _looked_at(open_, side(level))
        there = other(mine.join(open_.select(*keys).distinct(), keys, "left_semi").select(*keys, *_cells(side(level)), *AXES, "first"))
        pairs = asked.join(there, [*keys, "cx", "cy", "cz"], "left")
        found = _best(pairs.where(F.col("first_2").isNotNull()), keys, digits)
        found = open_.join(found, [*keys, *AXES], "left").withColumn("done", (side(level) >= F.col("extent") + unit) | F.coalesce(F.col("near.d") < side(level), F.lit(False)))
        found = written(found, f"nearest-stage-{stage}")
        out.append(found.where("done").select(*keys, *AXES, "near"))
        open_ = found.where("NOT done").drop("near", "done")
        if open_.isEmpty():
            return out
        stage += 1
