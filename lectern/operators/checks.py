"""Validators, gates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task holds at once where keys are counted.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows dealt by their key to as many tasks as n rows need, so that a task's memory doesn't grow with the table; sizes after compression, by which tasks are merged else, say little of it."""
    return rows.repartition(max(1, -(-n // TASK_ROWS)), key)


def issues(rows: DataFrame, key: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """key, code: a row for each rule (code, violated) that a row breaks."""
    found = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("code"))


def gate(name: str, value: Column, passed: Column) -> Column:
    """A struct gate, status, value: SKIPPED without a value, never a made-up zero."""
    status = F.when(value.isNull(), "SKIPPED").when(passed, "PASS").otherwise("FAIL")
    return F.struct(F.lit(name).alias("gate"), status.alias("status"), value.cast("string").alias("value"))


def gates(one: DataFrame, parts: list[Column]) -> DataFrame:
    """Rows of gates from a table of one row."""
    return one.select(F.inline(F.array(*parts)))


def stale(snapshot: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """key, state: same, stale, new or gone."""
    both = snapshot.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(now.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y")), key, "full_outer")
    return both.select(key, F.when(F.col("_x").isNull(), "new").when(F.col("_y").isNull(), "gone").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("stale").alias("state"))


def stratified(rows: DataFrame, strata: list[str], share: float, key: Column) -> DataFrame:
    """Of each stratum max(1, round(share * n)) rows, those that come first by key (a hash of the id gives a fixed random choice)."""
    w = Window.partitionBy(*strata)
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(key))
    return rows.withColumn("_r", rank).withColumn("_n", n).filter(F.col("_r") <= F.greatest(F.lit(1), F.bround(share * F.col("_n")))).drop("_r", "_n")


def hold_out_groups(rows: DataFrame, group: str, share: float, key: Column, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Adds split: test for max(1, min(groups - 1, round(share * groups))) groups, the first by key, else train; a group is never divided."""
    g = rows.select(group).distinct()
    n = g.count()  # one number
    chosen = g.orderBy(key, group).limit(max(1, min(n - 1, round(share * n)))).withColumn("_test", F.lit(True))
    return rows.join(chosen, group, "left").withColumn("split", F.when(F.col("_test"), names[1]).otherwise(names[0])).drop("_test")


def keep_first(first: DataFrame, second: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Union in which of equal keys a row of `first` wins, then the first by `order`."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*key).orderBy("_src", *order))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_src")


def first_source(sources: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row of the first source that has it; adds priority."""
    tagged = [s.withColumn("priority", F.lit(k).cast("long")) for k, s in enumerate(sources)]
    both = tagged[0]
    for s in tagged[1:]:
        both = both.unionByName(s)
    n = F.row_number().over(Window.partitionBy(*key).orderBy("priority", *order))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n")


def missing(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    """Keys without an output: what a resumed run has to do."""
    return wanted.select(*key).distinct().join(have.select(*key), key, "left_anti")
