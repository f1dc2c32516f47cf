"""Order-dependent selections, each with an explicit order: first of a key, last n, top n, numbering and running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return top_n(df, keys, 1, *order)


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key. Spark keeps n per key and task before it shuffles (window group limit)."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth_") <= n).drop("nth_")


def first_distinct(df: DataFrame, keys: list[str], values: list[str], n: int, *order: str) -> DataFrame:
    """The first n distinct values of each key with their number nth from 1, each value at its first place in the given order of columns.

    Values meet as one row each before they are ranked, and a task hands on no more than n of a key, so a hot key costs no task more than that.
    """
    first = df.groupBy(*keys, *values).agg(F.min(F.struct(*order)).alias("first_"))
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy("first_", *values))
    return first.withColumn("nth", ranked).filter(F.col("nth") <= n).drop("first_")


def last_n(df: DataFrame, keys: list[str], n: int, at: str, *ties: str) -> DataFrame:
    """The newest n rows of each key; ties go to the greater tie column."""
    return top_n(df, keys, n, F.desc(at), *(F.desc(t) for t in ties))


def sequential_id(prefix: str, keys: list[str], *order: Column | str, width: int = 3) -> Column:
    """Like F-001, by order within the keys. Number within groups: a numbering over a whole table is one task's work."""
    return F.format_string(f"{prefix}-%0{width}d", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def seen_before(flag: Column, keys: list[str], *order: Column | str) -> Column:
    """Whether flag held in any earlier row of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(flag).over(w), F.lit(False))


def budgeted(df: DataFrame, priority: str, limit: int, reserve_from: int, reserve_to: int, *order: Column | str) -> DataFrame:
    """At most limit rows by priority; rows of the reserve band stop once more than half the limit is taken by better ones.

    Each band is cut by a top-n before anything meets, so no task sees more than limit rows of a band.
    """
    head = df.filter(F.col(priority) < reserve_from).orderBy(priority, *order).limit(limit)
    band = df.filter(F.col(priority).between(reserve_from, reserve_to)).orderBy(priority, *order).limit(limit // 2 + 1)
    tail = df.filter(F.col(priority) > reserve_to).orderBy(priority, *order).limit(limit)
    n_head = head.agg(F.count(F.lit(1)).alias("n_head"))
    w = Window.orderBy(priority, *order)
    reserved = band.withColumn("nth_", F.row_number().over(w)).join(F.broadcast(n_head)).filter(F.col("nth_") <= F.greatest(F.lit(0), F.lit(limit // 2 + 1) - F.col("n_head"))).drop("nth_", "n_head")
    return head.unionByName(reserved).unionByName(tail).orderBy(priority, *order).limit(limit)
