"""Votes, stance scores, rollups and evaluation metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import stance_label
from lectern.operators.quantiles import quantiles

CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}  # fixed values

#: Aggregators by name: from (positive, negative, turns) sums to a label column; more can be registered.
AGGREGATORS: dict[str, Callable[[Column, Column, Column], Column]] = {}


def register_aggregator(name: str, fn: Callable[[Column, Column, Column], Column]) -> None:
    AGGREGATORS[name] = fn


def majority_vote(rows: DataFrame, key: list[str], label: str, order: list[str]) -> DataFrame:
    """key, label, agreement: the most frequent label, ties to the one met first in `order`."""
    counted = rows.groupBy(*key, label).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*key)
    top = F.row_number().over(w.orderBy(F.col("_n").desc(), "_first"))
    return counted.withColumn("_r", top).withColumn("_all", F.sum("_n").over(w)).filter("_r = 1").select(*key, label, (F.col("_n") / F.col("_all")).alias("agreement"))


def net_polarity(pos: Column, neg: Column) -> Column:
    return F.when(pos + neg != 0, (pos - neg) / (pos + neg)).otherwise(F.lit(0.0))


def weight(kind: str | None, words: Column, confidence: Column) -> Column:
    c = F.coalesce(F.create_map(*[F.lit(x) for p in CONFIDENCE_WEIGHT.items() for x in p])[confidence], F.lit(0.7))
    return {"none": F.lit(1.0), "words": words.cast("double"), "confidence": c, "both": words * c}[kind or "none"]


def stance(rows: DataFrame, key: list[str], label: str = "label", w: Column | None = None) -> DataFrame:
    """key, n_turns, positive, negative, polar_share, score."""
    w = F.lit(1.0) if w is None else w
    side = lambda x: F.sum(F.when(F.col(label) == x, w).otherwise(0.0))
    polar = F.avg(F.col(label).isin("positive", "negative").cast("double"))
    out = rows.groupBy(*key).agg(F.count("*").alias("n_turns"), side("positive").alias("positive"), side("negative").alias("negative"), polar.alias("polar_share"))
    return out.withColumn("score", net_polarity(F.col("positive"), F.col("negative")))


def majority_verdict(pos: Column, neg: Column, turns: Column) -> Column:
    """Neutral if under 15 % are polar, mixed if the lesser side has half of the greater one."""
    return F.when((pos + neg) / F.greatest(turns, F.lit(1)) < 0.15, "neutral").when((pos > 0) & (neg > 0) & (F.least(pos, neg) / F.greatest(pos, neg) >= 0.5), "mixed").when(pos > neg, "positive").otherwise("negative")


register_aggregator("majority_vote", majority_verdict)

FLOOR, BAND = 0.15, 0.34  # fixed values: share of polar turns under which a speaker is neutral, score under which one is mixed
RULES = ("unweighted", "word_weighted", "dur_weighted", "top_k", "hard_vote")


def aggregated(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, n_turns and agg_<name> of all five ways to a speaker's label, and of those registered; rows: label, n_words, confidence. One pass."""
    pos, neg = F.col("label") == "positive", F.col("label") == "negative"
    weights = {"net_polarity": "none", "word_weighted": "words", "conf_weighted": "confidence", "word_conf_weighted": "both"}
    sums = []
    for name, kind in weights.items():
        w = weight(kind, F.col("n_words"), F.col("confidence"))
        sums += [F.sum(F.when(pos, w).otherwise(0.0)).alias(f"_p_{name}"), F.sum(F.when(neg, w).otherwise(0.0)).alias(f"_n_{name}")]
    one = rows.groupBy(*key).agg(F.count("*").alias("n_turns"), F.count_if(pos).alias("_pos"), F.count_if(neg).alias("_neg"), *sums)
    share = (F.col("_pos") + F.col("_neg")) / F.col("n_turns")
    out = [fn(F.col("_pos"), F.col("_neg"), F.col("n_turns")).alias(f"agg_{name}") for name, fn in AGGREGATORS.items()]
    out += [stance_label(share, net_polarity(F.col(f"_p_{name}"), F.col(f"_n_{name}")), FLOOR, BAND).alias(f"agg_{name}") for name in weights]
    return one.select(*key, "n_turns", *out)


def rule_scores(rows: DataFrame, key: list[str], k: int = 5, tie: str = "turn") -> DataFrame:
    """key, n_turns, polar_share and a score for each of RULES; rows: p_positive, p_negative, pred, n_words, dur_sec. top_k: the k turns of strongest opinion alone."""
    p, n = F.col("p_positive"), F.col("p_negative")
    hard = lambda x: (F.col("pred") == x).cast("double")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.abs(p - n).desc(), tie))
    rows = rows.withColumn("_r", rank)
    top = F.when(F.col("_r") <= k, 1.0).otherwise(0.0)
    sides = {"unweighted": (p, n), "word_weighted": (p * F.col("n_words"), n * F.col("n_words")), "dur_weighted": (p * F.col("dur_sec"), n * F.col("dur_sec")), "top_k": (p * top, n * top), "hard_vote": (hard("positive"), hard("negative"))}
    sums = [x for name, (a, b) in sides.items() for x in (F.sum(a).alias(f"_p_{name}"), F.sum(b).alias(f"_n_{name}"))]
    one = rows.groupBy(*key).agg(F.count("*").alias("n_turns"), F.avg((F.col("pred") != "neutral").cast("double")).alias("polar_share"), *sums)
    return one.select(*key, "n_turns", "polar_share", *[F.when(F.col(f"_p_{r}") + F.col(f"_n_{r}") > 0, net_polarity(F.col(f"_p_{r}"), F.col(f"_n_{r}"))).otherwise(0.0).alias(r) for r in RULES])


def compared_rules(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, rule, units, exact_acc, direction_acc, stance_corr, macro_f1 of each of RULES against judge_label and judge_stance_score; units: of rule_scores().

    Macro-F1 counts the labels that occur in truth or prediction.
    """
    by = by or []
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), stance_label(F.col("polar_share"), F.col(r), FLOOR, BAND).alias("pred"), F.col(r).alias("score")) for r in RULES]))
    rows = units.select(*by, F.col("judge_label").alias("truth"), "judge_stance_score", each)
    side = lambda c: F.when(F.col(c).isin("positive", "negative"), F.col(c)).otherwise("neither")
    same = lambda a, b: F.avg((a == b).cast("double"))
    ok = (F.count("*") > 2) & (F.stddev_pop("score") > 0) & (F.stddev_pop("judge_stance_score") > 0)
    base = rows.groupBy(*by, "rule").agg(F.count("*").alias("units"), same(F.col("truth"), F.col("pred")).alias("exact_acc"), same(side("truth"), side("pred")).alias("direction_acc"), F.when(ok, F.corr("score", "judge_stance_score")).alias("stance_corr"))
    f1 = scores(rows, ["negative", "mixed", "neutral", "positive"], [*by, "rule"]).select(*by, "rule", "macro_f1")
    return base.join(f1, [*by, "rule"])


def chosen_rule(compared: DataFrame) -> DataFrame:
    """The rule of greatest macro-F1, of equals the first of RULES; one row."""
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    return compared.orderBy(F.col("macro_f1").desc(), order).limit(1)


def top_k_stance(rows: DataFrame, key: list[str], k: int, pos: str, neg: str, tie: str) -> DataFrame:
    """key, score: mean of pos - neg over the k rows where they differ most."""
    gap = F.col(pos) - F.col(neg)
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.abs(gap).desc(), tie))
    return rows.withColumn("_n", n).filter(F.col("_n") <= k).groupBy(*key).agg(F.avg(gap).alias("score"))


# Evaluation over (truth, pred); classes: fixed list of labels.


def confusion(rows: DataFrame, classes: list, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """truth, a column pred_<class> for each class, support: a row for each class, zeros filled in."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(c,) for c in classes], rows.select(truth).schema)
    counts = rows.groupBy(truth).agg(*[F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in classes], F.count("*").alias("support"))
    out = F.broadcast(all_).join(counts, truth, "left")
    return out.select(truth, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != truth])


def class_counts(rows: DataFrame, classes: list, by: list[str] | None = None, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """by, class, tp, fp, fn, support in one pass."""
    sums = []
    for c in classes:
        t, p = F.col(truth) == c, F.col(pred) == c
        sums.append(F.struct(F.lit(c).alias("class"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("support")))
    return rows.groupBy(*(by or [])).agg(F.array(*sums).alias("_c")).select(*(by or []), F.inline("_c"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def per_class(rows: DataFrame, classes: list, by: list[str] | None = None) -> DataFrame:
    c = class_counts(rows, classes, by)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*(by or []), "class", "support", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def scores(rows: DataFrame, classes: list, by: list[str] | None = None) -> DataFrame:
    """by, units, accuracy, macro_f1; of slices the classes that they have count."""
    f1 = per_class(rows, classes, by)
    c = class_counts(rows, classes, by)
    seen = c.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0).select(*(by or []), "class") if by else c.select("class")
    macro = f1.join(seen, [*(by or []), "class"]).groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"))
    units = rows.groupBy(*(by or [])).agg(F.count("*").alias("units"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))
    return units.join(macro, by) if by else units.crossJoin(F.broadcast(macro))  # each has one row


def cohen_kappa(rows: DataFrame, classes: list, a: str = "truth", b: str = "pred") -> DataFrame:
    """n, observed, expected, kappa; where agreement by chance is sure, 1 if all agree, else 0."""
    parts = rows.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("observed"), *[F.avg((F.col(x) == c).cast("double")).alias(f"{x}_{c}") for x in (a, b) for c in classes])
    expected = sum((F.col(f"{a}_{c}") * F.col(f"{b}_{c}") for c in classes), F.lit(0.0))
    out = parts.select("n", "observed", expected.alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") == 1, F.when(F.col("observed") == 1, 1.0).otherwise(0.0)).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def multilabel(rows: DataFrame, n: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """macro_f1 and subset_accuracy of arrays of 0/1 of length n."""
    per = []
    for i in range(n):
        t, p = F.get(F.col(truth), F.lit(i)) == 1, F.get(F.col(pred), F.lit(i)) == 1
        per.append(ratio(2 * F.count_if(t & p), 2 * F.count_if(t & p) + F.count_if(~t & p) + F.count_if(t & ~p)))
    same = F.avg((F.col(truth) == F.col(pred)).cast("double"))
    return rows.agg((sum(per, F.lit(0.0)) / n).alias("macro_f1"), same.alias("subset_accuracy"))


def guarded_corr(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation; null if there are two rows or fewer, or one side is constant."""
    ok = (F.count("*") > 2) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return rows.agg(F.when(ok, F.corr(x, y)).alias("correlation"))


def class_weights(rows: DataFrame, label: str, n_classes: int) -> DataFrame:
    """label, n, class_weight = all / (classes * count)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("_t") / (n_classes * F.greatest(F.col("n"), F.lit(1)))).alias("class_weight"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, share of a's rows."""
    c = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def value_bands(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Adds band 0..n-1 by quantile edges of the values (interpolated; equal edges merge downward)."""
    cuts = quantiles(rows, column, [k / n for k in range(1, n)])
    above = [F.when(F.col(column) > c, 1).otherwise(0) for c in cuts if c is not None]
    return rows.withColumn("band", sum(above, F.lit(0)).cast("long"))


def binary_metrics(rows: DataFrame, truth: Column, pred: Column) -> DataFrame:
    tp, tn, fp, fn = (F.count_if(x) for x in (truth & pred, ~truth & ~pred, ~truth & pred, truth & ~pred))
    c = rows.agg(tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def both_classes(rows: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """One row: n, accuracy, and precision, recall and F1 of the positive and of the negative class; 0 where there is nothing to divide by."""
    c = binary_metrics(rows, truth, pred)
    p, r = ratio(F.col("tn"), F.col("tn") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return c.select(
        n.alias("n"), ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), F.col("precision").alias("precision_positive"), F.col("recall").alias("recall_positive"), F.col("f1").alias("f1_positive"),
        p.alias("precision_negative"), r.alias("recall_negative"), ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fn") + F.col("fp")).alias("f1_negative"),
    )


def pass_agreement(votes: DataFrame, key: list[str], label: str, order: list[str]) -> DataFrame:
    """One row: turns with several votes, and the mean share of votes that agree with the majority of theirs."""
    n = votes.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    return majority_vote(votes, key, label, order).join(n, key).agg(F.count("*").alias("turns"), F.avg("agreement").alias("mean_agreement"))


def agreement_counts(turns: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """key, judged, agree, verdict_matches from turns (judge_label, pred) and verdicts (judge_label, verdict)."""
    counts = turns.groupBy(*key).agg(F.count("judge_label").alias("judged"), F.count_if(F.col("judge_label") == F.col("pred")).alias("agree"))
    same = verdicts.select(*key, F.coalesce(F.col("judge_label") == F.col("verdict"), F.lit(False)).alias("verdict_matches"))
    return counts.join(same, key, "left").withColumn("verdict_matches", F.coalesce("verdict_matches", F.lit(False)))


def confidence_by(rows: DataFrame, level: str, value: str, low: float) -> DataFrame:
    """level, n, mean of a value, and its rows' share under `low`."""
    return rows.groupBy(level).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) < low).cast("double")).alias("low_share"))


def prediction_records(turns: DataFrame, key: list[str], thin: int = 3) -> DataFrame:
    """key, n_turns, n_words, polar_share, pred_counts (a map), thin: under so many turns."""
    per = turns.groupBy(*key, "pred").agg(F.count("*").alias("_n"), F.sum("n_words").alias("_w"))
    out = per.groupBy(*key).agg(F.sum("_n").alias("n_turns"), F.sum("_w").alias("n_words"), (F.sum(F.when(F.col("pred") != "neutral", F.col("_n")).otherwise(0)) / F.sum("_n")).alias("polar_share"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred", "_n")))).alias("pred_counts"))
    return out.withColumn("thin", F.col("n_turns") < thin)


def with_dropped(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the inner join, a row with how many rows of left have no partner)."""
    return left.join(right, key), left.join(right.select(*key), key, "left_anti").agg(F.count("*").alias("dropped"))


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.0) -> DataFrame:
    """episode, total, missed, false_alarm, confusion, error: diarization error rate of segments (episode, start, end, label), overlaps counted.

    Time is cut at every end of a segment (and, with a collar, around every end of the reference, which is left out half a collar to both sides).
    Between two cuts the numbers of speakers say what is missed and what is false; speakers are mapped one to one so that they share most time. A
    speaker's copies of the same instant count once. The mapping is solved for an episode at a time over its few speakers.
    """
    return diarization_errors(reference, hypothesis, (collar,)).drop("collar")


def diarization_errors(reference: DataFrame, hypothesis: DataFrame, collars: tuple[float, ...] = (0.0, 0.25)) -> DataFrame:
    """diarization_error with each collar, a row each: collar, and its columns. The published figures have both of these.

    An episode goes to Python once, with plain columns, for all collars.
    """
    side = lambda rows, k: rows.filter("end > start").select("episode", "start", "end", F.lit(k).alias("side"), F.col("label").cast("string").alias("label"))
    spans = side(reference, 0).unionByName(side(hypothesis, 1))

    def run(pdf):
        import pandas as pd

        out = [(pdf["episode"].iloc[0], c, *_episode_error(pdf, c)) for c in collars]
        return pd.DataFrame(out, columns=["episode", "collar", "total", "missed", "false_alarm", "confusion", "error"])

    found = spans.groupBy("episode").applyInPandas(run, "episode long, collar double, total double, missed double, false_alarm double, confusion double, error double")
    return found.select("episode", "total", "missed", "false_alarm", "confusion", "error", "collar")


def _episode_error(pdf, collar: float) -> tuple[float, float, float, float, float]:
    """Sweep over one episode's cuts (its speakers' open segments are all that is held), then the best mapping."""
    from collections import Counter

    marks = []
    for start, end, k, label in zip(pdf["start"].tolist(), pdf["end"].tolist(), pdf["side"].tolist(), pdf["label"].tolist(), strict=True):
        marks += [(start, (k, label), 1), (end, (k, label), -1)]
        if collar and k == 0:
            marks += [(x + y * collar / 2, (-1, ""), -y) for x in (start, end) for y in (-1, 1)]
    marks.sort(key=lambda m: m[0])
    open_: Counter = Counter()
    shared: Counter = Counter()
    total = missed = false = least = 0.0
    for n, (at, who, d) in enumerate(marks):
        open_[who] += d
        if n + 1 == len(marks):
            break
        if marks[n + 1][0] == at:
            continue
        length = float(marks[n + 1][0]) - float(at)
        here = [k for k, m in open_.items() if m > 0]
        if any(s == -1 for s, _ in here):
            continue
        ref, hyp = [x for s, x in here if s == 0], [x for s, x in here if s == 1]
        total += length * len(ref)
        missed += length * max(0, len(ref) - len(hyp))
        false += length * max(0, len(hyp) - len(ref))
        least += length * min(len(ref), len(hyp))
        for a in ref:
            for b in hyp:
                shared[a, b] += length
    confusion = least - best_mapping(shared)
    error = (missed + false + confusion) / total if total else float(bool(false))
    return total, missed, false, confusion, error


def best_mapping(shared: dict[tuple[str, str], float]) -> float:
    """Greatest sum of shared time of a one-to-one mapping: shortest augmenting paths over prices, a speaker at a time."""
    rows, cols = sorted({a for a, _ in shared}), sorted({b for _, b in shared})
    if len(rows) > len(cols):
        return best_mapping({(b, a): x for (a, b), x in shared.items()})
    cost = [[-shared.get((a, b), 0.0) for b in cols] for a in rows]
    taken: dict[int, int] = {}  # column to row
    row_price, col_price = [0.0] * len(rows), [0.0] * len(cols)
    for start in range(len(rows)):
        dist, came, done = [float("inf")] * len(cols), [-1] * len(cols), [False] * len(cols)
        row, last, path = start, -1, 0.0
        while True:
            for c in range(len(cols)):
                step = path + cost[row][c] - row_price[row] - col_price[c]
                if not done[c] and step < dist[c] - 1e-12:
                    dist[c], came[c] = step, last
            last = min((c for c in range(len(cols)) if not done[c]), key=dist.__getitem__)
            done[last], path = True, dist[last]
            if last not in taken:
                break
            row = taken[last]
        row_price[start] += path
        for c in range(len(cols)):
            if done[c] and c != last:
                row_price[taken[c]] += path - dist[c]
                col_price[c] -= path - dist[c]
        while last != -1:  # turn the path around
            before = came[last]
            taken[last] = start if before == -1 else taken[before]
            last = before
    return sum(shared.get((rows[r], cols[c]), 0.0) for c, r in taken.items())
