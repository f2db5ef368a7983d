"""Splits and samples by groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.quantiles import quantiles
from lectern.operators.aggregates import value_bands
from lectern.operators.checks import hold_out_groups


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of parts, each with its name as split."""
    return reduce(DataFrame.unionByName, [d.withColumn("split", F.lit(name)) for name, d in parts.items()])


def three_way(rows: DataFrame, group: str, keys: tuple[Column, Column], shares: tuple[float, float] = (0.40, 0.50)) -> DataFrame:
    """Adds split: train, public or private. Of the groups a share is held out, by the first key, and of these a share is private, by the second. Three groups at least."""
    first = hold_out_groups(rows, group, shares[0], keys[0], ("train", "held"))
    second = hold_out_groups(first.filter("split = 'held'").drop("split"), group, shares[1], keys[1], ("public", "private"))
    return first.filter("split = 'train'").unionByName(second.select(*first.columns))


def by_counts(rows: DataFrame, group: str, key: Column, n_test: int, n_val: int) -> DataFrame:
    """Adds split: so many groups are test and val, the first by key, the others train."""
    order = rows.select(group).distinct().orderBy(key, group)
    picked = order.limit(n_test + n_val)  # as many rows as were asked for, so that one task numbers them
    named = picked.withColumn("_n", F.row_number().over(Window.orderBy(key, group))).select(group, F.when(F.col("_n") <= n_test, "test").otherwise("val").alias("_s"))
    return rows.join(named, group, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def disjoint_or_stratified(rows: DataFrame, group: str, label: str, share: float, group_key: Column, row_key: Column) -> DataFrame:
    """Adds split: test for max(1, round(share * groups)) groups; where that leaves no train group, max(1, round(share * n)) rows of each group and label instead."""
    n = rows.select(group).distinct().count()  # one number
    cut = max(1, round(n * share))
    if cut < n:
        chosen = rows.select(group).distinct().orderBy(group_key, group).limit(cut).withColumn("_t", F.lit(True))
        return rows.join(chosen, group, "left").withColumn("split", F.when(F.col("_t"), "test").otherwise("train")).drop("_t")
    w = Window.partitionBy(group, label)
    out = rows.withColumn("_r", F.row_number().over(w.orderBy(row_key))).withColumn("_n", F.count("*").over(w))
    return out.withColumn("split", F.when(F.col("_r") <= F.greatest(F.lit(1), F.bround(share * F.col("_n"))), "test").otherwise("train")).drop("_r", "_n")


def balanced_sample(rows: DataFrame, pred: str, value: str, n: int, key: Column, hidden: list[str], bands: int = 3) -> DataFrame:
    """At most n rows, max(1, n // (classes * bands)) of each class and band of a value at most, the first by key; without the columns that would tell the label. A null value counts as the median."""
    middle = quantiles(rows, value, [0.5])[0]
    pool = value_bands(rows.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(middle).cast("double"))), "_v", bands)
    cells = pool.agg((F.countDistinct(pred) * F.countDistinct("band")).alias("_c"))  # one row
    r = F.row_number().over(Window.partitionBy(pred, "band").orderBy(key))
    picked = pool.withColumn("_r", r).crossJoin(F.broadcast(cells)).filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_c"))))
    return picked.orderBy(key).limit(n).drop("_v", "_r", "_c", "band", *hidden)


def group_folds(rows: DataFrame, group: str, k: int = 5, most_groups: int = 100_000) -> DataFrame:
    """Adds fold: whole groups, largest first (ties by name), each to the fold with fewest rows so far.

    Each choice depends on all before it, so that the sizes of groups (episodes, programmes) are read in order on the driver; more than most_groups are refused.
    """
    counts = rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("g").cast("string")).limit(most_groups + 1).collect()
    if len(counts) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    load, of = [0] * k, []
    for r in counts:
        f = load.index(min(load))
        load[f] += r["n"]
        of.append((r["g"], f))
    folds = rows.sparkSession.createDataFrame(of, f"{group} {rows.schema[group].dataType.simpleString()}, fold long")
    return rows.join(folds, group)
