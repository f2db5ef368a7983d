"""Joins of intervals inside an episode.

Spark joins non-equal conditions by comparing all pairs of a key. Here intervals are dealt to time buckets,
so that only those near each other meet; a pair that shares several buckets is compared in the first of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(start: Column, end: Column, width: float) -> Column:
    """All buckets that a closed interval touches."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def touching(left: DataFrame, right: DataFrame, on: list[str], width: float, l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:  # noqa: E741
    """Pairs of rows with equal `on` whose closed intervals touch. Other column names must differ."""
    a = left.withColumn("_from", F.floor(F.col(l[0]) / width)).withColumn("_bucket", F.explode(buckets(F.col(l[0]), F.col(l[1]), width)))
    b = right.withColumn("_r_from", F.floor(F.col(r[0]) / width)).withColumn("_bucket", F.explode(buckets(F.col(r[0]), F.col(r[1]), width)))
    pairs = a.join(b, [*on, "_bucket"]).filter(F.col("_bucket") == F.greatest("_from", "_r_from"))
    return pairs.filter((F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))).drop("_from", "_r_from", "_bucket")


def shared(l0: str, l1: str, r0: str, r1: str) -> Column:
    return F.least(l1, r1) - F.greatest(l0, r0)


def best(pairs: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first pair of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return pairs.withColumn("_n", n).filter("_n = 1").drop("_n")


def assign_words(words: DataFrame, segments: DataFrame, width: float = 300, closed: bool = False) -> DataFrame:
    """word_key columns, speaker_id and method of every word.

    words: episode, turn, idx, start_ds, end_ds; segments: episode, speaker_id, start_ds, end_ds. The segment that
    holds the word's middle (before its end, or with closed up to it), else that with the largest overlap, else -1.
    Ties: smallest (start, speaker).
    """
    seg = segments.select("episode", F.col("speaker_id").alias("seg_speaker"), F.col("start_ds").alias("r_start"), F.col("end_ds").alias("r_end"))
    pairs = touching(words, seg, ["episode"], width, ("start_ds", "end_ds"))
    twice = F.col("start_ds") + F.col("end_ds")
    inside = (2 * F.col("r_start") <= twice) & ((twice <= 2 * F.col("r_end")) if closed else (twice < 2 * F.col("r_end")))
    lap = shared("start_ds", "end_ds", "r_start", "r_end")
    pairs = pairs.withColumn("_in", inside).withColumn("_lap", lap).filter("_in OR _lap > 0")
    key = ["episode", "turn", "idx"]
    top = best(pairs, key, F.col("_in").desc(), F.when(F.col("_in"), 0).otherwise(-F.col("_lap")), F.col("r_start"), F.col("seg_speaker"))
    top = top.select(*key, "seg_speaker", F.when(F.col("_in"), "midpoint").otherwise("max_overlap").alias("_method"))
    out = words.join(top, key, "left")
    return out.select(*key, "word", F.coalesce("seg_speaker", F.lit(-1)).cast("long").alias("speaker_id"), F.coalesce("_method", F.lit("unassigned")).alias("method"))


def best_match(left: DataFrame, right: DataFrame, key: list[str], width: float) -> DataFrame:
    """Rows of left (episode, key, start, end) with the right row (r_key, r_start, r_end) of largest overlap above zero; others drop out."""
    pairs = touching(left, right, ["episode"], width).withColumn("overlap", shared("start", "end", "r_start", "r_end")).filter("overlap > 0")
    return best(pairs, ["episode", *key], F.col("overlap").desc(), F.col("r_start"), F.col("r_key"))


def weighted_overlap(left: DataFrame, right: DataFrame, key: list[str], width: float) -> DataFrame:
    """Mean of right's confidence weighted by overlap with each left row; null without any."""
    pairs = touching(left, right, ["episode"], width).withColumn("_lap", shared("start", "end", "r_start", "r_end")).filter("_lap > 0")
    means = pairs.groupBy("episode", *key).agg((F.sum(F.col("confidence") * F.col("_lap")) / F.sum("_lap")).alias("mean"))
    return left.join(means, ["episode", *key], "left")


def containing(left: DataFrame, right: DataFrame, key: list[str], slack: float, width: float) -> DataFrame:
    """The first right row (by start) of the same episode and speaker that holds left's middle, give or take slack; null if none."""
    wide = right.withColumn("r_start", F.col("r_start") - slack).withColumn("r_end", F.col("r_end") + slack)
    pairs = touching(left, wide, ["episode", "speaker_id"], width)
    middle = (F.col("start") + F.col("end")) / 2
    pairs = pairs.filter((F.col("r_start") <= middle) & (middle <= F.col("r_end")))
    top = best(pairs, ["episode", *key], F.col("r_start"), F.col("r_key")).select("episode", *key, "r_key")
    return left.join(top, ["episode", *key], "left")


def _upto(*order) -> Window:
    return Window.partitionBy("episode").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def as_of_backward(rows: DataFrame, slack: float) -> DataFrame:
    """For each row (episode, turn, speaker_id, start, end) p_turn: of another speaker's rows the one that ended last by start + slack.

    Two values are carried along the order of time, for any number of speakers: the end that came last, and the last end before
    it of another speaker. One of the two answers every start, and no pairs of rows arise. Ties: the largest turn.
    """
    kind = rows.schema["end"].dataType
    ends = rows.select("episode", F.struct(F.col("end").alias("e"), F.col("turn").alias("t"), F.col("speaker_id").alias("s")).alias("last"))
    line = Window.partitionBy("episode").orderBy("last.e", "last.t")
    before = F.lag("last").over(line)
    ends = ends.withColumn("_switch", F.when(before["s"] != F.col("last.s"), before))
    ends = ends.withColumn("other", F.last("_switch", ignorenulls=True).over(_upto("last.e", "last.t"))).drop("_switch")
    marks = ends.select("episode", F.col("last.e").cast(kind).alias("at"), F.lit(0).alias("kind"), F.struct("last", "other").alias("ended"), F.lit(None).cast("long").alias("who"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"))
    starts = rows.select("episode", (F.col("start") + slack).cast(kind).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["ended"].dataType).alias("ended"), F.col("speaker_id").alias("who"), "turn")
    both = marks.unionByName(starts).withColumn("_now", F.last("ended", ignorenulls=True).over(_upto("at", "kind", "ended.last.t", "turn")))
    found = F.when(F.col("_now.last.s") != F.col("who"), F.col("_now.last")).otherwise(F.col("_now.other"))
    return both.filter("kind = 1").select("episode", "turn", F.col("who").alias("speaker_id"), found["t"].alias("p_turn"))


def nearest_segment(points: DataFrame, segments: DataFrame, key: list[str], width: float) -> DataFrame:
    """speaker_id of the segment (episode, speaker_id, r_start, r_end) that holds each point (episode, key, at), else of that with the nearest end.

    Of segments that hold a point the first by (start, speaker); ties of distance likewise. Around other points only the last end before and
    the first start behind can be nearest: both are carried along one order of time. Null where an episode has no segment.
    """
    spans = segments.select("episode", "speaker_id", "r_start", "r_end")
    inside = touching(points.withColumn("start", F.col("at")).withColumn("end", F.col("at")), spans, ["episode"], width)
    held = best(inside, ["episode", *key], F.col("r_start"), F.col("speaker_id")).select("episode", *key, F.col("speaker_id").alias("_held"))
    mark = F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("speaker_id").alias("who"))
    none = F.lit(None).cast(spans.select(mark.alias("m")).schema["m"].dataType)
    blank = [F.lit(None).cast(points.schema[k].dataType).alias(k) for k in key]
    ends = spans.select("episode", *blank, F.col("r_end").alias("at"), F.lit(0).alias("kind"), mark.alias("over"), none.alias("next"))
    begins = spans.select("episode", *blank, F.col("r_start").alias("at"), F.lit(2).alias("kind"), none.alias("over"), mark.alias("next"))
    line = points.select("episode", *key, "at", F.lit(1).alias("kind"), none.alias("over"), none.alias("next")).unionByName(ends).unionByName(begins)
    by = Window.partitionBy("episode").orderBy("at", "kind", F.col("over.start").desc(), F.col("over.who").desc(), "next.who")
    line = line.withColumn("over", F.last("over", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # The following start is what comes last in the opposite order: a frame that grows costs one step a row, one that shrinks all that is left.
    back = Window.partitionBy("episode").orderBy(F.desc("at"), F.desc("kind"), F.col("over.start"), F.col("over.who"), F.desc("next.who"))
    line = line.withColumn("next", F.last("next", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 1")
    near = F.when(F.col("next").isNull() | (F.col("at") - F.col("over.end") <= F.col("next.start") - F.col("at")), F.col("over.who")).otherwise(F.col("next.who"))
    out = line.select("episode", *key, near.alias("_near")).join(held, ["episode", *key], "left")
    return out.select("episode", *key, F.coalesce("_held", "_near").alias("speaker_id"))
