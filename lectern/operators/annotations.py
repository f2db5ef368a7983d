"""Annotated utterances: drafts, validation, gold labels, judge votes, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import HIDDEN, nfc, nfc_casefold

# What annotations may say.
TARGETS = ("MARKET", "SECTOR", "COMPANY", "REGULATOR", "MACRO_INDICATOR")
POLARITIES = ("positive", "negative")
ROLES = ("host", "panellist", "remote_guest", "audience", "non_speech")
STATUSES = ("labelled", "non_evaluative", "out_of_scope", "review_required")
LABEL = "struct<target_text: string, target_type: string, polarity: string, confidence: double>"
#: Schema of annotated utterances.
ANNOTATED = (
    "episode_id string, utterance_id string, speaker_id long, role_tag string, role_review_required boolean, start_sec double, end_sec double, text_verbatim string, text_normalized string,"
    f"labels array<{LABEL}>, annotation_status string, human_verified boolean"
)


def drafts(rows: DataFrame) -> DataFrame:
    """Unlabelled annotations of utterances (episode_id, utterance_id, speaker_id, start_sec, end_sec, text_verbatim, text_normalized)."""
    return rows.select(
        "episode_id", "utterance_id", "speaker_id", F.lit("non_speech").alias("role_tag"), F.lit(True).alias("role_review_required"), "start_sec", "end_sec", "text_verbatim", "text_normalized",
        F.array().cast(f"array<{LABEL}>").alias("labels"), F.lit("review_required").alias("annotation_status"), F.lit(False).alias("human_verified"),
    )


def status(rows: DataFrame) -> Column:
    """The stated status, else labelled if there are labels, else review_required."""
    return F.coalesce(rows["annotation_status"], F.when(F.size("labels") > 0, "labelled").otherwise("review_required"))


def issues(rows: DataFrame) -> DataFrame:
    """episode_id, utterance_id, code: every rule that an annotated utterance breaks, once for each label that does."""
    labels = F.coalesce("labels", F.array().cast(f"array<{LABEL}>"))
    rows = rows.withColumn("labels", labels)
    rows = rows.withColumn("_status", status(rows)).withColumn("_text", F.coalesce("text_verbatim", F.lit(""))).withColumn("_composed", nfc(F.col("_text")))
    rows = rows.withColumn("_hay", nfc_casefold(F.concat_ws("\n", F.coalesce("text_normalized", F.lit("")), "_text")))
    t = F.col("_text")
    plain = [
        ("EMPTY_TRANSCRIPT", F.trim(t) == ""), ("NOT_NFC", F.col("_composed") != t), ("BIDI_OR_ZERO_WIDTH", t.rlike(HIDDEN)), ("DIGIT_NOT_WORD", t.rlike("[0-9০-৯]")),
        ("BAD_SPEAKER", F.coalesce("speaker_id", F.lit(-1)) < 0), ("BAD_ROLE", ~F.coalesce(F.col("role_tag").isin(*ROLES), F.lit(False))), ("ROLE_REVIEW_UNRESOLVED", F.coalesce("role_review_required", F.lit(False))),
        ("BAD_TIME", F.coalesce("end_sec", F.lit(0.0)) <= F.coalesce("start_sec", F.lit(0.0))), ("BAD_ANNOTATION_STATUS", ~F.col("_status").isin(*STATUSES)),
        ("MISSING_LABEL", (F.col("_status") == "labelled") & (F.size("labels") == 0)), ("LABEL_ON_EXCLUDED_UTTERANCE", F.col("_status").isin("non_evaluative", "out_of_scope") & (F.size("labels") > 0)),
        ("UNRESOLVED_REVIEW", F.col("_status") == "review_required"), ("NOT_HUMAN_VERIFIED", ~F.coalesce("human_verified", F.lit(False))),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in plain]), lambda x: x.isNotNull())
    base = rows.select("episode_id", "utterance_id", F.explode(found).alias("code"))

    one = rows.select("episode_id", "utterance_id", "_hay", F.posexplode("labels").alias("_at", "_l"))
    one = one.withColumn("_span", nfc_casefold(F.trim(F.coalesce("_l.target_text", F.lit("")))))
    first = F.first(F.struct("_l.target_type", "_l.polarity")).over(Window.partitionBy("episode_id", "utterance_id", "_span").orderBy("_at"))
    one = one.withColumn("_first", first)
    empty = F.coalesce("_l.target_text", F.lit("")) == ""
    other = ~F.col("_first.target_type").eqNullSafe(F.col("_l.target_type"))
    rules = [
        ("BAD_TARGET", ~F.coalesce(F.col("_l.target_type").isin(*TARGETS), F.lit(False))), ("BAD_POLARITY", ~F.coalesce(F.col("_l.polarity").isin(*POLARITIES), F.lit(False))), ("MISSING_TARGET_SPAN", empty),
        ("TARGET_SPAN_NOT_IN_TEXT", ~empty & ~F.contains(F.col("_hay"), nfc_casefold(F.coalesce("_l.target_text", F.lit(""))))), ("CONFLICTING_TARGET_TYPE", other),
        ("CONTRADICTORY_POLARITY", ~other & ~F.col("_first.polarity").eqNullSafe(F.col("_l.polarity"))),
    ]
    per = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]), lambda x: x.isNotNull())
    return base.unionByName(one.select("episode_id", "utterance_id", F.explode(per).alias("code")))


def gold_labels(rows: DataFrame) -> DataFrame:
    """Labels of episodes in which no utterance breaks a rule, one row each."""
    bad = issues(rows).select("episode_id").distinct()
    good = rows.join(bad, "episode_id", "left_anti")
    return good.select("episode_id", "utterance_id", F.col("text_verbatim").alias("text"), F.posexplode("labels").alias("label_index", "_l")).select("episode_id", "utterance_id", "text", "label_index", "_l.*")


def multilabel_examples(labels: DataFrame) -> DataFrame:
    """utterance_id, text, a 0/1 vector over targets and polarities, and how many rows made it."""
    names = [(t, p) for t in TARGETS for p in POLARITIES]
    bits = [F.max(((F.col("target_type") == t) & (F.col("polarity") == p)).cast("int")) for t, p in names]
    return labels.groupBy("utterance_id").agg(F.min_by("text", "label_index").alias("text"), F.array(*bits).alias("vector"), F.count("*").alias("n_rows"))


def attach_votes(turns: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes (speaker_key, index, ord, label) on real turns (speaker_key, index, turn_id): invented indices drop out, of repeated ones the first counts."""
    n = F.row_number().over(Window.partitionBy("speaker_key", "index").orderBy("ord"))
    return turns.join(votes.withColumn("_n", n).filter("_n = 1").drop("_n", "ord"), ["speaker_key", "index"])


def overridden(rows: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """rows (local_path, episode_id, ...) with true/false values of overrides (key, ...), by path, else by episode."""
    kept = F.create_map(*[x for c in columns for x in (F.lit(c), F.lower(F.trim(F.col(c).cast("string"))))])
    o = overrides.select("key", kept.alias("_o"))
    a, b = o.select(F.col("key").alias("local_path"), F.col("_o").alias("_by_path")), o.select(F.col("key").alias("episode_id"), F.col("_o").alias("_by_episode"))
    both = rows.join(a, "local_path", "left").join(b, "episode_id", "left")
    use = F.coalesce("_by_path", "_by_episode")
    new = [F.when(use[c].isin("true", "false"), use[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return both.select(*new)


def noun_recovery(pairs: DataFrame, entities: list[tuple[str, str]]) -> DataFrame:
    """target_type, support, recall of names of pairs (reference, hypothesis) in any case; entities: (name, target_type)."""
    ref, hyp = nfc_casefold(F.col("reference")), nfc_casefold(F.col("hypothesis"))
    rows = pairs.select(ref.alias("r"), hyp.alias("h"))
    cases = F.array(*[F.struct(F.lit(t).alias("target_type"), F.contains("r", F.lit(n.casefold())).alias("there"), F.contains("h", F.lit(n.casefold())).alias("recovered")) for n, t in entities])
    found = rows.select(F.inline(cases)).filter("there")
    return found.groupBy("target_type").agg(F.count("*").alias("support"), F.avg(F.col("recovered").cast("double")).alias("recall"))


def tier(gold: DataFrame, weak: DataFrame) -> DataFrame:
    """Of each episode the gold rows if there are any, else the weak ones; adds label_tier."""
    g = gold.withColumn("label_tier", F.lit("gold"))
    w = weak.join(gold.select("episode_id").distinct(), "episode_id", "left_anti").withColumn("label_tier", F.lit("weak"))
    return g.unionByName(w)


def valid_gold(rows: DataFrame) -> DataFrame:
    """Annotated rows (with is_gold_tier) of episodes that are gold as a whole: stated so on every row, and no rule broken by any. A null isn't stated."""
    bad = rows.filter(~F.coalesce("is_gold_tier", F.lit(False))).select("episode_id").union(issues(rows).select("episode_id")).distinct()
    return rows.join(bad, "episode_id", "left_anti")


def episode_tiers(annotated: DataFrame, weak: DataFrame) -> DataFrame:
    """episode_id, label_tier: gold where the annotation is valid gold, else weak where there are weak labels; other episodes have none."""
    return tier(valid_gold(annotated).select("episode_id").distinct(), weak.select("episode_id").distinct())
