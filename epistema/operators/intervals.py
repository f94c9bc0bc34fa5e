"""Closed intervals: coalescing, subtraction and overlap, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coalesce(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of intervals that share a point, within each key: keys, start, end. Neighbours that only adjoin stay apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.select(*keys, start, end).withColumn("__new", new).withColumn("__island", island)
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def subtract(df: DataFrame, holes: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What is left of coalesced intervals outside ``holes`` of the same key: keys, start, end."""
    rows = df.select(*keys, start, end, F.lit(1).alias("__sign")).unionByName(holes.select(*keys, start, end, F.lit(-1).alias("__sign")))
    return signed(rows, keys, "__sign", start, end)


def signed(rows: DataFrame, keys: list[str], sign: str, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals covered by rows of positive sign and by none of negative sign: keys, start, end.

    A sweep: unions of the positive ones, then points at which one of them or a hole begins or ends, in order,
    with the number of holes open. Every step is grouped or windowed within the keys, so rows that are
    partitioned by some of them are not shuffled again.
    """
    rows = rows.withColumn("__p", F.col(sign) > 0)
    spans = coalesce(rows.select(*keys, "__p", start, end), [*keys, "__p"], start, end)
    point = lambda at, island, hole: F.struct(at.alias("at"), island.alias("island"), hole.alias("hole"))
    none = F.lit(None).cast("long")
    s, e = F.col(start), F.col(end)
    points = F.when(F.col("__p"), F.array(point(s, e, F.lit(0)), point(e + 1, none, F.lit(0)))).otherwise(F.array(point(s, none, F.lit(1)), point(e + 1, none, F.lit(-1))))
    at = spans.select(*keys, F.explode(points).alias("x")).groupBy(*keys, F.col("x.at").alias("at")).agg(F.max("x.island").alias("island"), F.sum("x.hole").alias("hole"))
    order = Window.partitionBy(*keys).orderBy("at")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("reach", F.last("island", ignorenulls=True).over(until)).withColumn("open", F.sum("hole").over(until)).withColumn("next", F.lead("at").over(order))
    return at.filter("open = 0 and reach >= at and next is not null").select(*keys, F.col("at").alias(start), (F.col("next") - 1).alias(end))


def overlapping(df: DataFrame, group: list[str], member: str, start: str = "start", end: str = "end") -> DataFrame:
    """Members of a group that share a point with another member of it.

    Intervals of one member must be apart, as coalesced ones are. Then an earlier row that reaches
    a row's start, or a later one that starts before its end, is another member's, and one pass in
    order of start finds both.
    """
    marked = df.withColumn("__clash", clashes(group, start, end, member))
    return marked.filter("__clash").select(*group, member).distinct()


def clashes(group: list[str], start: str, end: str, member: str):
    order = Window.partitionBy(*group).orderBy(start, member)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before >= F.col(start), F.lit(False)) | F.coalesce(F.lead(start).over(order) <= F.col(end), F.lit(False))
