"""Points in intervals: an equi-join over a tree of time, and counts by a sweep. Neither makes a row for each unit of a long interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Children of a node of the tree, and its levels above the leaves: 16**6 hours are 1,900 years.
FAN, LEVELS = 16, 6


def _run(low: Column, high: Column, level: int) -> Column:
    """Nodes low to high of a level, none where high is below low."""
    nodes = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(nodes, lambda x: F.struct(F.lit(level).alias("level"), x.alias("node")))


def cover(low: Column, high: Column, unit: int) -> Column:
    """The nodes (level, node) that cover the units from that of ``low`` to that of ``high``: each unit once, few nodes a level."""
    first, last = F.floor(low / unit).cast("bigint"), F.floor(high / unit).cast("bigint")
    parts = []
    for level in range(LEVELS + 1):
        size, above = FAN**level, FAN ** (level + 1)
        a, b = F.ceil(first / size).cast("bigint"), F.floor((last + 1) / size).cast("bigint") - 1  # nodes wholly inside
        if level == LEVELS:
            parts.append(_run(a, b, level))
            continue
        up_a, up_b = F.ceil(first / above).cast("bigint"), F.floor((last + 1) / above).cast("bigint") - 1
        some = up_a <= up_b  # a node above is wholly inside: what it covers isn't named here
        parts.append(_run(a, F.when(some, FAN * up_a - 1).otherwise(b), level))
        parts.append(_run(F.when(some, FAN * (up_b + 1)), b, level))
    return F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<struct<level:int,node:bigint>>")) for p in parts)))


def ancestors(at: Column, unit: int) -> Column:
    """The node of each level that holds a point."""
    return F.array(*(F.struct(F.lit(n).alias("level"), F.floor(at / (unit * FAN**n)).cast("bigint").alias("node")) for n in range(LEVELS + 1)))


def stab(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, by: list[str], unit: int) -> DataFrame:
    """Points with the ranges of equal ``by`` that hold them, both ends included; each pair once.

    A range stands once for each node of its cover (at most ``2 * (FAN - 1)`` a level), a point once a level, whatever the range's length.
    """
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_n", F.explode(cover(F.col(low), F.col(high), unit)))
    placed = points.withColumn("_n", F.explode(ancestors(F.col(at), unit)))
    flat = lambda df: df.withColumn("_level", F.col("_n.level")).withColumn("_node", F.col("_n.node")).drop("_n")
    met = flat(placed).join(flat(spread), [*by, "_level", "_node"])
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("_level", "_node")


def count_within(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, by: list[str], key: list[str], unit: int) -> DataFrame:
    """(key, by, n, last): how many points of equal ``by`` a range holds, and the last of them. No pair of a point and a range is made.

    A sweep: points and both ends of the ranges are ordered within a unit of time, where running counts are taken; over the units
    run the sums of their counts. The order within a unit and that of the units are windows of their own, so a ``by`` with very many points is
    many tasks, and one with very many units sends a row for each.
    """
    end = lambda c, side: ranges.select(*by, *key, F.col(c).alias("_t"), F.lit(side).alias("_side"))
    ends = end(low, 0).unionByName(end(high, 2))
    events = points.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side")).unionByName(ends, allowMissingColumns=True)
    events = events.withColumn("_unit", F.floor(F.col("_t") / unit))
    point = F.when(F.col("_side") == 1, F.col("_t"))
    units = events.groupBy(*by, "_unit").agg(F.count(point).alias("_k"), F.max(point).alias("_m"))
    before = Window.partitionBy(*by).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(*by, "_unit", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.max("_m").over(before).alias("_last"))
    inside = Window.partitionBy(*by, "_unit").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("_in", F.count(point).over(inside)).withColumn("_m", F.max(point).over(inside)).where("_side <> 1")
    same = reduce(lambda a, b: a & b, (F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}")) for c in [*by, "_unit"]))
    told = swept.alias("s").join(units.alias("u"), same).select("s.*", "u._before", "u._last")
    total = F.col("_before") + F.col("_in")
    ends_of = told.groupBy(*by, *key).agg(
        (F.max(F.when(F.col("_side") == 2, total)) - F.max(F.when(F.col("_side") == 0, total))).alias("n"),
        F.max(F.when(F.col("_side") == 2, F.greatest("_m", "_last"))).alias("last"),
    )
    return ends_of.where("n > 0")
