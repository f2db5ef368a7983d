"""Exact order statistics of a column without its values in one place.

A pass counts values by ranges, as many as BUCKETS for each rank that is sought, with the least and the largest value of each; the range that holds
a rank is parted in the next pass, until it holds one value. What meets anywhere is the counts of the ranges, however many values there are, and a pass parts
each range a thousandfold, so that a few passes do.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import stored

#: Ranges that a pass makes of one.
BUCKETS = 1024


def values_at(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0, in ascending order) of a table of one column of doubles, all finite; ranks are within the table."""
    name = values.columns[0]
    v = F.col(name)
    low, high = values.agg(F.min(v), F.max(v)).first()
    found: dict[int, float] = {}
    open_ = {(low, high): (0, sorted(set(ranks)))} if ranks and low is not None else {}  # (least, largest value) of ranges: values before, ranks sought
    while open_:
        done = [r for r in open_ if r[0] == r[1]]
        for r in done:
            found.update(dict.fromkeys(open_.pop(r)[1], r[0]))
        if not open_:
            break
        # Halves, so that the span of large numbers stays finite; the least numbers have none.
        share = lambda a, b: (v / 2 - a / 2) / (b / 2 - a / 2) if b / 2 > a / 2 else (v - a) / (b - a)
        place = lambda a, b: F.least(F.lit(BUCKETS - 1), F.floor(share(a, b) * BUCKETS)).cast("int")
        ranges = list(open_)
        inside = [(k, (v >= a) & (v <= b), place(a, b)) for k, (a, b) in enumerate(ranges)]
        which = F.coalesce(*[F.when(c, F.lit(k * BUCKETS) + p) for k, c, p in inside])
        counts = values.withColumn("_at", which).filter("_at IS NOT NULL").groupBy("_at").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()  # at most BUCKETS a range
        by_range: dict[int, list] = {}
        for row in sorted(counts, key=lambda r: r["_at"]):
            by_range.setdefault(row["_at"] // BUCKETS, []).append(row)
        parted: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for k, r in enumerate(ranges):
            before, sought = open_[r]
            for row in by_range[k]:
                mine = [x for x in sought if before <= x < before + row["n"]]
                if mine:
                    parted[row["low"], row["high"]] = (before, mine)
                before += row["n"]
        open_ = parted
    return found


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Quantiles of a column, interpolated between neighbours; nulls and what isn't finite are left out. None for each if nothing is left.

    Values are compared as doubles. The column is written once, and passes read it alone.
    """
    v = F.col(column).cast("double")
    values = stored(rows.select(v.alias("value")).filter(F.col("value").isNotNull() & (F.abs("value") < float("inf"))), "quantiles")
    n = values.count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    found = values_at(values, [k for x in at for k in (math.floor(x), math.ceil(x))])
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at]
