"""Scans along an episode's time whose state depends on all that came before, with an episode cut into stretches that tasks share.

An episode is no task's group here. Stretches of its time are; what passes from one to the next is a row for each, and only those rows meet in one order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a stretch carry these names beside the caller's.
STRETCH = "_stretch"


def numbered(rows: DataFrame, at: Column, width: int, order: list[str], carried: dict[str, Column]) -> DataFrame:
    """rows with their stretch of time, k (1, 2, ... along each episode), and `previous`: the columns `carried` of the row before, null for the first.

    at: a whole number that the order begins with; order: columns by which rows of an episode are told apart.
    """
    state = F.struct(*[c.alias(n) for n, c in carried.items()])
    cut = rows.withColumn(STRETCH, F.floor(at / width)).withColumn("_state", state)
    inside = Window.partitionBy("episode", STRETCH).orderBy(*order)
    cut = cut.withColumn("_n", F.row_number().over(inside).cast("long")).withColumn("_lag", F.lag("_state").over(inside))
    line = Window.partitionBy("episode").orderBy(STRETCH)
    ends = cut.groupBy("episode", STRETCH).agg(F.count("*").alias("_size"), F.max_by("_state", "_n").alias("_last"))
    ends = ends.select("episode", STRETCH, F.coalesce(F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(line).alias("_entry"))
    both = cut.join(ends, ["episode", STRETCH])
    return both.withColumn("k", F.col("_before") + F.col("_n")).withColumn("previous", F.when(F.col("_n") == 1, F.col("_entry")).otherwise(F.col("_lag"))).drop("_state", "_n", "_lag", "_before", "_entry")


def upto(rows: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """queries (episode, id, at) with n: how many of rows (episode, at) have a time up to theirs."""
    marks = rows.select("episode", F.col("at"), F.lit(0).alias("_kind"), F.lit(None).cast(queries.schema["id"].dataType).alias("id"))
    marks = marks.unionByName(queries.select("episode", "at", F.lit(1).alias("_kind"), "id")).withColumn(STRETCH, F.floor(F.col("at") / width))
    row = (F.col("_kind") == 0).cast("long")
    inside = Window.partitionBy("episode", STRETCH).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_n", F.sum(row).over(inside))
    line = Window.partitionBy("episode").orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    before = marks.groupBy("episode", STRETCH).agg(F.sum(row).alias("_size")).select("episode", STRETCH, F.coalesce(F.sum("_size").over(line), F.lit(0)).alias("_before"))
    return marks.filter("_kind = 1").join(before, ["episode", STRETCH]).select("episode", "id", (F.col("_before") + F.col("_n")).alias("n"))


def following(rows: DataFrame, mark: Column) -> DataFrame:
    """rows (episode, k, and their stretch) with `next_mark`: the least k behind theirs for which mark holds, null if none."""
    inside = Window.partitionBy("episode", STRETCH).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_k", F.when(mark, F.col("k")))
    own = own.withColumn("_next", F.last("_k", ignorenulls=True).over(inside))
    first = own.groupBy("episode", STRETCH).agg(F.min("_k").alias("_first"))
    line = Window.partitionBy("episode").orderBy(F.desc(STRETCH)).rowsBetween(Window.unboundedPreceding, -1)
    later = first.select("episode", STRETCH, F.last("_first", ignorenulls=True).over(line).alias("_later"))
    return own.join(later, ["episode", STRETCH]).withColumn("next_mark", F.coalesce("_next", "_later")).drop("_k", "_next", "_later")


def running(rows: DataFrame, mark: Column, name: str) -> DataFrame:
    """rows (episode, k, and their stretch) with how many rows up to theirs have the mark."""
    one = mark.cast("long")
    inside = Window.partitionBy("episode", STRETCH).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("episode").orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("episode", STRETCH).agg(F.sum(one).alias("_size")).select("episode", STRETCH, F.coalesce(F.sum("_size").over(line), F.lit(0)).alias("_before"))
    return rows.withColumn("_n", F.sum(one).over(inside)).join(sums, ["episode", STRETCH]).withColumn(name, F.col("_before") + F.col("_n")).drop("_n", "_before")


def reached(roots: DataFrame, links: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(episode, k): roots and all that links (episode, k, to; at most one from each, forwards) lead to from them.

    Links are doubled: after t rounds each spans 2^t of the first, and what is reached in fewer steps is known, so that rounds
    grow with the logarithm of the longest way, and end when no link spans so much. keep(rows, name) stores what a round has made.
    """
    found, span = roots.select("episode", "k"), keep(links.select("episode", "k", "to"), "links")
    while not span.isEmpty():
        found = keep(found.unionByName(found.join(span, ["episode", "k"]).select("episode", F.col("to").alias("k"))), "reached")
        ahead = span.select("episode", F.col("k").alias("to"), F.col("to").alias("beyond"))
        span = keep(span.join(ahead, ["episode", "to"]).select("episode", "k", F.col("beyond").alias("to")), "links")
    return found.distinct()
