"""Joins and alignment on the session calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, take: list[str], by: tuple[str, ...] = (), strict: bool = False, after: bool = False, slot: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the ``take`` columns of the nearest right row at or before (after) it.

    Both sides are laid in one order and the last known right row is carried on:
    one shuffle and sort, no pairs.  Without ``by`` there is one order for all,
    so it is for calendars and other dimensions.  strict: the same key does not count.

    ``slot`` (of ``on``, in the same order, such as its hour) splits a key's rows: a
    slot begins with the last right row of the slots before it, found from one row
    for each key and slot, so no task sees all rows of a frequent key.
    """
    keys = [F.col(b) for b in by] or [F.lit(0)]
    extra = [c for c in left.columns if c not in by and c != on]
    rows = left.select(*by, on, F.lit(0 if strict else 2).alias("__side"), F.lit(True).alias("__left"), F.struct(*([F.col(c) for c in extra] or [F.lit(0).alias("__none")])).alias("__l"))
    more = right.select(*by, on, F.lit(1).alias("__side"), F.lit(False).alias("__left"), F.struct(*take).alias("__r"))
    both = rows.unionByName(more, allowMissingColumns=True)
    order = [F.col(on).desc() if after else F.col(on), F.col("__side")]
    if slot is not None:
        both = both.withColumn("__slot", slot(F.col(on)))
        nearest, at = (F.min_by, F.col("__slot").desc()) if after else (F.max_by, F.col("__slot"))
        ends = both.groupBy(*by, "__slot").agg(nearest("__r", F.when(~F.col("__left"), F.col(on))).alias("__r"))
        carried = ends.withColumn("__r", F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))).where(F.col("__r").isNotNull())
        both = both.withColumn("__begins", F.lit(1)).unionByName(carried.withColumns({"__begins": F.lit(0), "__left": F.lit(False)}), allowMissingColumns=True)
        keys, order = [*keys, F.col("__slot")], [F.col("__begins"), *order]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__left")
    return done.select(*by, on, *[F.col(f"__l.{c}").alias(c) for c in extra], *[F.col(f"__r.{c}").alias(c) for c in take])


def fill_forward(source: DataFrame, days: DataFrame, values: list[str], limit: int, on: str = "date") -> DataFrame:
    """Values of a sparse source on the sessions, carried at most ``limit`` rows of the union of both calendars."""
    union = source.select(on, *values).join(days.select(on).distinct().withColumn("__session", F.lit(True)), on, "full_outer")
    w = Window.orderBy(on).rowsBetween(-limit, 0)
    return union.select(on, "__session", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]).where("__session").drop("__session")


def overlap(start: Column, end: Column, first: Column, last: Column, embargo: int = 0) -> Column:
    """Whether an interval sample must leave a training set: it meets the test span, or begins in the embargo after it."""
    return ((start <= last) & (end >= first)) | ((start > last) & (start <= last + embargo))


def in_all(rows: DataFrame, member: str, key: str, n: int) -> DataFrame:
    """Keys that occur with all ``n`` members."""
    return rows.groupBy(key).agg(F.countDistinct(member).alias("n")).where(F.col("n") == n).select(key)


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
