"""Thresholds, factorial conditions and noise curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.aggregates import ratio

THRESHOLDS = tuple(round(0.30 + 0.05 * k, 2) for k in range(9))


def calibrate(rows: DataFrame, truth: str, score: str, thresholds=THRESHOLDS) -> DataFrame:
    """threshold, f1, accuracy of each candidate, in one pass over rows (every row meets a fixed list of thresholds)."""
    t = F.col(truth) == 1
    parts = []
    for x in thresholds:
        p = F.col(score) >= x
        tp, fp, fn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p)
        parts.append(F.struct(F.lit(float(x)).alias("threshold"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.avg((t == p).cast("double")).alias("accuracy")))
    return rows.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


def best_threshold(candidates: DataFrame) -> DataFrame:
    """The best by (f1, accuracy, closeness to 0.5); one row."""
    return candidates.orderBy(F.col("f1").desc(), F.col("accuracy").desc(), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def factorial(rows: DataFrame, factors: dict[str, dict[str, Column]], measure: Column) -> DataFrame:
    """A row for each combination of factor levels: its share of rows for which measure holds; levels are columns renamed to their factor."""
    combos = reduce(lambda acc, f: [{**a, f: lv} for a in acc for lv in factors[f]], factors, [{}])
    parts = [rows.select(*[factors[f][lv].alias(f) for f, lv in c.items()]).agg(*[F.lit(lv).alias(f"{f}_level") for f, lv in c.items()], F.avg(measure.cast("double")).alias("share")) for c in combos]
    return reduce(DataFrame.unionByName, parts)


def set_f1(rows: DataFrame, by: list[str], gold: str, pred: str, labels: list[str], *more: Column) -> DataFrame:
    """by, n, macro_f1 over labels, exact: of rows with sets of labels (arrays) gold and pred. more: other aggregates of the same pass."""
    parts = []
    for x in labels:
        g, p = F.array_contains(gold, x), F.array_contains(pred, x)
        tp, fp, fn = F.count_if(g & p), F.count_if(~g & p), F.count_if(g & ~p)
        parts.append(ratio(2 * tp, 2 * tp + fp + fn))
    same = F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(pred))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (reduce(lambda a, b: a + b, parts) / len(labels)).alias("macro_f1"), F.avg(same.cast("double")).alias("exact"), *more)


# Which text and which speaker each condition reads.
CONDITIONS = {"oracle": ("gold", "gold"), "diarization_corruption": ("gold", "pred"), "asr_corruption": ("pred", "gold"), "full_pipeline": ("pred", "pred")}


def error_propagation(rows: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """condition, by, n, macro_f1, exact, speaker_accuracy of the four CONDITIONS.

    rows: gold_labels, labels_gold_text, labels_pred_text (arrays: what a classifier says of either text), gold_speaker, pred_speaker, and by (a target, a role). One scan:
    each row becomes one for each condition.
    """
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"labels_{text}_text").alias("_p"), (F.col("gold_speaker") == F.col(f"{who}_speaker")).cast("double").alias("_s")) for c, (text, who) in CONDITIONS.items()]))
    wide = rows.select(*by, "gold_labels", each)
    f1 = set_f1(wide, ["condition", *by], "gold_labels", "_p", labels)
    return f1.join(wide.groupBy("condition", *by).agg(F.avg("_s").alias("speaker_accuracy")), ["condition", *by])


NOISE_LEVELS = (5, 15, 25, 35, 45, 55, 65)  # fixed values


def noise_limit(curve: DataFrame, slack: float = 0.03) -> DataFrame:
    """One row: limit, the greatest achieved_wer whose macro_f1 is within slack of the best of a curve (level, achieved_wer, macro_f1)."""
    top = curve.agg(F.max("macro_f1").alias("_top"))  # one row
    return curve.crossJoin(F.broadcast(top)).filter(F.col("macro_f1") >= F.col("_top") - slack).agg(F.max("achieved_wer").alias("limit"))


def lexicon_label(text: Column, positive: list[str], negative: list[str]) -> Column:
    """positive or negative by which list has more words inside the text (lower case), null if neither."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = lambda words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words], F.lit(0))
    score = n(positive) - n(negative)
    return F.when(score > 0, "positive").when(score < 0, "negative")


def condition_scores(gold: DataFrame, sources: dict[str, DataFrame], positive: list[str], negative: list[str]) -> DataFrame:
    """condition, n_gold, wer, coverage, n, accuracy, f1_positive of texts by segment against gold (segment_id, text, polarity).

    sources: (segment_id, text) by condition; a missing segment is an empty text. Texts that the lexicon doesn't settle aren't counted in accuracy; coverage: share
    with a word error rate under 1.
    """
    from lectern.functions.text import wer

    parts = []
    for name, d in sources.items():
        hyp = d.select("segment_id", F.col("text").alias("_h")).dropDuplicates(["segment_id"])
        parts.append(gold.join(hyp, "segment_id", "left").select(F.lit(name).alias("condition"), "polarity", F.coalesce("_h", F.lit("")).alias("h"), F.col("text").alias("r")))
    rows = reduce(DataFrame.unionByName, parts).withColumn("w", wer(F.col("r"), F.col("h"))).withColumn("p", lexicon_label(F.col("h"), positive, negative))
    t, p = F.col("polarity") == "positive", F.col("p") == "positive"
    some = F.col("p").isNotNull()
    tp, fp, fn = F.count_if(some & t & p), F.count_if(some & ~t & p), F.count_if(some & t & ~p)
    return rows.groupBy("condition").agg(F.count("*").alias("n_gold"), F.avg("w").alias("wer"), F.avg((F.col("w") < 1).cast("double")).alias("coverage"), F.count("p").alias("n"), ratio(F.count_if(F.col("p") == F.col("polarity")), F.count("p")).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_positive"))


def reproduced(published: DataFrame, again: DataFrame, key: list[str]) -> DataFrame:
    """One row on predictions (key, truth, pred) made again: n published, missing and extra keys, equal predictions, accuracies of both over common keys, and whether all is as published.

    A key that one side has several times is counted as `repeated`, and compared by its first prediction in order.
    """
    once = lambda d, name: d.groupBy(*key).agg(F.min("pred").alias(name), F.min("truth").alias(f"truth_{name}"), F.count("*").alias(f"n_{name}"))
    both = once(published, "a").join(once(again, "b"), key, "full")
    common = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    right = lambda c: ratio(F.count_if(common & F.col(c).eqNullSafe(F.col("truth_a"))), F.count_if(common))
    out = both.agg(
        F.count("n_a").alias("n"), F.count_if(F.col("n_b").isNull()).alias("missing"), F.count_if(F.col("n_a").isNull()).alias("extra"), F.count_if((F.coalesce("n_a", F.lit(1)) > 1) | (F.coalesce("n_b", F.lit(1)) > 1)).alias("repeated"),
        F.count_if(common & F.col("a").eqNullSafe(F.col("b"))).alias("equal"), right("a").alias("accuracy_published"), right("b").alias("accuracy_again"),
    )
    return out.withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0) & (F.col("equal") == F.col("n")))
