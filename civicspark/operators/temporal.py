"""Joins on time that Spark has no operator for: as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(targets: DataFrame, series: DataFrame, key: str, target: str, at: str, value: str, forward: bool = True) -> DataFrame:
    """key, target, hit_at, hit: for each distinct (key, target) the first point of the series at or after
    the target (forward) or the last at or before it. Targets without such a point have nulls.

    Targets and points are merged into one ordered list by key, and each target takes the newest
    point before it in that list: one shuffle and a running frame. Only distinct targets take part,
    so a key has as many rows as it has days, however many rows ask for them.
    """
    asked = targets.select(F.col(key), F.col(target).alias("__t")).where("__t is not null").distinct()
    points = series.select(F.col(key), F.col(at).alias("__t"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("__p"))
    merged = asked.withColumn("__p", F.lit(None).cast(points.schema["__p"].dataType)).unionByName(points)
    when = F.col("__t").desc() if forward else F.col("__t").asc()
    frame = Window.partitionBy(key).orderBy(when, F.col("__p").isNull().asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = merged.withColumn("__hit", F.last("__p", ignorenulls=True).over(frame)).where(F.col("__p").isNull())
    return hit.select(key, F.col("__t").alias(target), F.col("__hit.at").alias("hit_at"), F.col("__hit.v").alias("hit"))


def range_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs of one key with -before <= right_at - left_at <= after, in days.

    Days are cut into buckets as wide as the window, so each right row meets two of them and the join
    is an equality join on key and bucket with the exact condition behind it.
    """
    width = before + after + 1
    cell = lambda day: F.floor(day / width)
    day = F.unix_date(right_at)
    spread = right.withColumn("__b", F.explode(F.sequence(cell(day - after), cell(day + before))))
    bucketed = left.withColumn("__b", cell(F.unix_date(left_at)))
    gap = F.datediff(right_at, left_at)
    return bucketed.join(spread, [key, "__b"]).withColumn("gap", gap).where(F.col("gap").between(-before, after)).drop("__b")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, start, end, parts: intervals that overlap or touch become one. Equal intervals are counted first,
    so a hot key's window has as many rows as it has distinct intervals."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = df.groupBy(key, start, end).agg(F.count("*").alias("__n"))
    cut = counted.withColumn("__new", fresh).withColumn("__island", island)
    return cut.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("__n").alias("parts")).drop("__island")
