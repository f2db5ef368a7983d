"""Weak labels, review queues, gates and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import edit_rate, nfc_casefold, segment_confidence
from lectern.operators.annotations import POLARITIES, ROLES, TARGETS
from lectern.operators.checks import gate, gates, keep_first, stratified

LEAST_CONFIDENCE, LEAST_ACCURACY, SAMPLE_SHARE = 0.85, 0.85, 0.10  # fixed values: of weak labels, of their audit; what the audit reads of each stratum
FEWEST_LABELLED = 5  # fixed value: labelled utterances of an episode of the first tier
EDIT_FLOOR, EDIT_CEILING = 0.05, 0.40  # fixed values: edit rates under and over which a correction is looked at


def valid_weak(rows: DataFrame) -> DataFrame:
    """Weak results (text, labels array<struct<target_text, target_type, polarity, confidence>>, annotation_status, review_required) with what holds of them.

    labels keeps those of a known target and polarity whose span stands in the text, of each span (in any case) the surest, the first of equals.
    status: labelled with labels; without, as stated if that is non_evaluative or out_of_scope, else review_required. review_required, and flags say why.
    """
    text = F.coalesce("text", F.lit(""))
    fits = lambda x: x["target_type"].isin(*TARGETS) & x["polarity"].isin(*POLARITIES) & (F.coalesce(x["target_text"], F.lit("")) != "") & ((text == "") | F.contains(text, x["target_text"]))
    named = lambda x: F.struct(F.lower(F.trim(x["target_text"])).alias("span"), x["target_text"].alias("target_text"), x["target_type"].alias("target_type"), x["polarity"].alias("polarity"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"))
    rows = rows.withColumn("_l", F.transform(F.filter(F.coalesce("labels", F.array().cast(rows.schema["labels"].dataType)), lambda x: F.coalesce(fits(x), F.lit(False))), named))
    best = F.filter("_l", lambda x, i: ~F.exists(F.transform("_l", lambda y, j: (y["span"] == x["span"]) & ((y["confidence"] > x["confidence"]) | ((y["confidence"] == x["confidence"]) & (j < i)))), lambda z: z))
    unlike = F.exists("_l", lambda x: F.exists("_l", lambda y: (y["span"] == x["span"]) & ((y["target_type"] != x["target_type"]) | (y["polarity"] != x["polarity"]))))
    rows = rows.withColumn("_best", best).withColumn("_unlike", unlike)
    some, settled = F.size("_best") > 0, F.coalesce(F.col("annotation_status").isin("non_evaluative", "out_of_scope"), F.lit(False))
    status = F.when(some, "labelled").when(settled, F.col("annotation_status")).otherwise("review_required")
    clash = some & settled
    unsure = F.exists("_best", lambda x: x["confidence"] < LEAST_CONFIDENCE)
    flags = F.filter(F.array(F.when(clash, F.lit("status_label_conflict")), F.when(F.col("_unlike"), F.lit("conflicting_label_resolved_by_confidence"))), lambda x: x.isNotNull())
    review = F.coalesce("review_required", F.lit(False)) | (status == "review_required") | clash | F.col("_unlike") | unsure
    return rows.select(*[c for c in rows.columns if c not in ("labels", "annotation_status", "review_required", "_l", "_best", "_unlike")], F.transform("_best", lambda x: x.dropFields("span")).alias("labels"), status.alias("annotation_status"), review.alias("review_required"), flags.alias("validation_flags"))


def review_queue(rows: DataFrame, key: Column, strata: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """Rows (row_id, review_required) to be reviewed, with review_kind: forced, else stratified_audit, a tenth of each stratum by key; what earlier reviews (row_id, human_verified, approved) said is carried over."""
    forced = rows.filter("review_required").withColumn("review_kind", F.lit("forced"))
    sampled = stratified(rows, strata, SAMPLE_SHARE, key).withColumn("review_kind", F.lit("stratified_audit"))
    queue = keep_first(forced, sampled, ["row_id"], ["row_id"])
    no = F.lit(False)
    if earlier is None:
        return queue.withColumn("human_verified", no).withColumn("approved", no)
    said = earlier.select("row_id", truth(F.col("human_verified")).alias("human_verified"), truth(F.col("approved")).alias("approved")).dropDuplicates(["row_id"])
    return queue.join(said, "row_id", "left").withColumn("human_verified", F.coalesce("human_verified", no)).withColumn("approved", F.coalesce("approved", no))


def truth(value: Column) -> Column:
    """1, true and yes, as files have them."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def weak_audit(queue: DataFrame) -> DataFrame:
    """One row: n_review, accuracy (null until all of the audit is verified) and status: PASS from LEAST_ACCURACY on, else PENDING."""
    mine = F.col("review_kind") == "stratified_audit"
    one = queue.agg(F.count_if(mine).alias("n_review"), F.count_if(mine & F.col("human_verified")).alias("_v"), F.avg(F.when(mine & F.col("human_verified"), F.col("approved").cast("double"))).alias("_a"))
    done = (F.col("n_review") > 0) & (F.col("n_review") == F.col("_v"))
    accuracy = F.when(done, F.col("_a"))
    return one.select("n_review", accuracy.alias("accuracy"), F.when(F.coalesce(accuracy >= LEAST_ACCURACY, F.lit(False)), "PASS").otherwise("PENDING").alias("status"))


def weak_training(rows: DataFrame, queue: DataFrame) -> DataFrame:
    """Weak rows to learn from: surely labelled, not up for review, and not turned down in a review."""
    down = queue.filter("human_verified AND NOT approved").select("row_id")
    return rows.filter(~F.col("review_required") & (F.col("confidence") >= LEAST_CONFIDENCE)).join(down, "row_id", "left_anti")


def episode_errors(utterances: DataFrame, speakers: DataFrame) -> DataFrame:
    """episode, code, n: what keeps episodes out of the first tier: bad targets and polarities, empty texts, bad roles, no speakers, too few labelled utterances."""
    t, p = F.col("target"), F.col("polarity")
    per = [("BAD_TARGET", ~F.coalesce(t.isin(*TARGETS, "OTHER"), F.lit(False))), ("BAD_POLARITY", (F.coalesce(p, F.lit("")) != "") & ~p.isin(*POLARITIES)), ("EMPTY_TRANSCRIPT", F.coalesce("text_verbatim", F.lit("")) == "")]
    found = utterances.select("episode", F.explode(F.filter(F.array(*[F.when(bad, F.lit(c)) for c, bad in per]), lambda x: x.isNotNull())).alias("code"))
    roles = speakers.filter(~F.coalesce(F.col("role_tag").isin(*ROLES, "unknown"), F.lit(False))).select("episode", F.lit("BAD_ROLE").alias("code"))
    none = utterances.select("episode").distinct().join(speakers.select("episode"), "episode", "left_anti").withColumn("code", F.lit("NO_SPEAKERS"))
    few = utterances.groupBy("episode").agg(F.count_if(F.coalesce(p.isin(*POLARITIES), F.lit(False))).alias("k")).filter(F.col("k") < FEWEST_LABELLED).select("episode", F.lit("TOO_FEW_LABELLED").alias("code"))
    every = reduce(DataFrame.unionByName, [found, roles, none, few])
    return every.groupBy("episode", "code").agg(F.count("*").alias("n"))


def annotation_summary(utterances: DataFrame, gold: DataFrame, errors: DataFrame) -> DataFrame:
    """episode, n_utterances, n_labelled, is_gold_tier, validation_errors."""
    base = utterances.groupBy("episode").agg(F.count("*").alias("n_utterances"), F.count_if(F.coalesce(F.col("polarity").isin(*POLARITIES), F.lit(False))).alias("n_labelled"))
    wrong = errors.groupBy("episode").agg(F.sum("n").alias("validation_errors"))
    out = base.join(wrong, "episode", "left").join(gold.select("episode", F.lit(True).alias("is_gold_tier")).distinct(), "episode", "left")
    return out.select("episode", "n_utterances", "n_labelled", F.coalesce("is_gold_tier", F.lit(False)).alias("is_gold_tier"), F.coalesce("validation_errors", F.lit(0)).alias("validation_errors"))


# Gates.


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of)


def measures(registry: DataFrame, gold: DataFrame, fused: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row of all that submission_gates() looks at.

    registry: episode, duration_flag, programme, has_remote_guest; gold: utterances as annotated, with synthetic; fused: episode, unassigned_words;
    metrics: a row (or none) of weak_status, weak_accuracy, wer, der, kappa, f1_gap, private_f1, ntp_rows, ntp_limit, noun_recall, classifier.
    """
    kept = registry.filter(~F.col("duration_flag").eqNullSafe(F.lit("rejected")))
    a = kept.agg(F.count("*").alias("episodes"), F.countDistinct("programme").alias("programmes"), F.count_if(truth(F.col("has_remote_guest"))).alias("remote"))
    text, status = F.trim(F.coalesce("text_verbatim", F.lit(""))), F.col("annotation_status")
    resolved = F.coalesce(status.isin("labelled", "non_evaluative", "out_of_scope"), F.lit(False))
    b = gold.agg(
        F.count("*").alias("gold"), F.count_if(F.coalesce("synthetic", F.lit(False))).alias("synthetic"), F.count_if(text == "").alias("empty"), F.count_if(F.coalesce("speaker_id", F.lit(-1)) < 0).alias("speakerless"),
        F.count_if(~F.coalesce(F.col("role_tag").isin(*ROLES), F.lit(False)) | F.coalesce("role_review_required", F.lit(False))).alias("roles"), F.count_if(~resolved).alias("open"),
        F.count_if(F.coalesce(status == "labelled", F.lit(False)) & (F.greatest(F.size("labels"), F.lit(0)) == 0)).alias("bare"), F.array_distinct(F.flatten(F.collect_set(F.filter(F.transform("labels", lambda x: x["target_type"]), lambda x: x.isin(*TARGETS))))).alias("covered"),
        F.coalesce(F.sum(F.size(F.filter(F.coalesce("labels", F.array().cast(gold.schema["labels"].dataType)), lambda x: ~F.coalesce(x["polarity"].isin(*POLARITIES), F.lit(False))))), F.lit(0)).alias("neutral"),
    )
    c = fused.agg(F.coalesce(F.sum("unassigned_words"), F.lit(0)).alias("unassigned"))
    d = metrics.agg(*[F.first(x).alias(x) for x in metrics.columns])
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # a row each


def submission_gates(one: DataFrame, programme: str | None = None) -> DataFrame:
    """gate, status, value from measures(): PASS, FAIL, or SKIPPED where nothing was measured. programme: for a study of that one alone. Thresholds are fixed values."""
    c, gold = F.col, F.col("gold") > 0
    if_gold = lambda value: F.when(gold, value)
    scope = gate("single_programme_scope", c("programmes"), c("programmes") == 1) if programme else gate("programme_count", c("programmes"), c("programmes") >= 4)
    parts = [
        gate("episode_count", c("episodes"), c("episodes") >= 8), scope, gate("remote_guest_episodes", c("remote"), c("remote") >= 2), gate("no_synthetic_gold", c("synthetic"), c("synthetic") == 0),
        gate("layer1_no_empty_transcript", c("empty"), gold & (c("empty") == 0)), gate("layer2_no_missing_speaker", c("speakerless"), gold & (c("speakerless") == 0)), gate("layer2_roles_resolved", c("roles"), gold & (c("roles") == 0)),
        gate("layer3_resolved_or_excluded", c("open") + c("bare"), gold & (c("open") + c("bare") == 0)), gate("economic_topic_coverage", if_gold(F.size("covered")), F.size("covered") >= 4), gate("no_neutral_class", c("neutral"), c("neutral") == 0),
        gate("fusion_no_unassigned_words", c("unassigned"), c("unassigned") == 0), measured("wer_measured", if_gold(F.lit(1)), c("wer")), gate("wer_target", c("wer"), c("wer") <= 0.30),
        measured("der_measured_0.25_collar", if_gold(F.lit(1)), c("der")), gate("der_target", c("der"), c("der") <= 0.20), gate("annotation_kappa", c("kappa"), c("kappa") >= 0.80), gate("public_private_f1_gap", c("f1_gap"), c("f1_gap") <= 0.03),
        gate("sentiment_private_macro_f1", c("private_f1"), c("private_f1") >= 0.70), gate("ntp_curve", F.when(c("classifier"), c("ntp_rows")), c("ntp_rows") > 0),
        gate("wer_at_or_below_ntp", F.when(c("ntp_limit").isNotNull(), c("wer")), c("wer") <= c("ntp_limit")), measured("proper_noun_recovery_measured", if_gold(F.lit(1)), c("noun_recall")),
    ]
    weak = gates(one.filter("weak_status IS NOT NULL"), [F.struct(F.lit("weak_label_stratified_audit").alias("gate"), F.when(c("weak_status") == "PASS", "PASS").otherwise("FAIL").alias("status"), c("weak_accuracy").cast("string").alias("value"))])
    return gates(one, parts).unionByName(weak)


def measured(name: str, due: Column, value: Column) -> Column:
    """A gate that passes if there is a value, and is skipped where none is due."""
    status = F.when(due.isNull(), "SKIPPED").when(value.isNotNull(), "PASS").otherwise("FAIL")
    return F.struct(F.lit(name).alias("gate"), status.alias("status"), value.cast("string").alias("value"))


def gate_summary(rows: DataFrame) -> DataFrame:
    """One row: gates of each status, and submittable: there are gates and all pass."""
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(F.count("*").alias("gates"), *[n(s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIPPED")], ((F.count("*") > 0) & (F.count("*") == n("PASS"))).alias("submittable"))


def readiness(episodes: DataFrame, utterances: DataFrame, known_gaps: DataFrame, expected: int | None = None, least_assigned: float = 0.5) -> DataFrame:
    """check, status, value of a corpus: PASS, FAIL, or GAP where all that is missing is accounted for.

    episodes: episode, words, unassigned_words, audio_path, provider, diarization_rows, asr_rows, fused_rows, draft_rows; utterances: key, normalized_text;
    known_gaps: episode.
    """
    none = F.coalesce("audio_path", F.lit("")) == ""
    known = known_gaps.select("episode", F.lit(True).alias("_known")).dropDuplicates(["episode"])
    e = episodes.join(known, "episode", "left").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("w"), F.coalesce(F.sum("unassigned_words"), F.lit(0)).alias("u"), F.count_if(none).alias("silent"), F.count_if(none & F.col("_known").isNull()).alias("unknown"),
        *[F.count_if(F.col(f"{s}_rows") > 0).alias(s) for s in ("diarization", "asr", "fused", "draft")], F.count_if(F.coalesce("provider", F.lit("")) == "").alias("unprovided"),
    )
    u = utterances.agg(F.count("*").alias("m"), F.count_if(F.coalesce("normalized_text", F.lit("")) == "").alias("empty"), (F.count("*") - F.countDistinct("key")).alias("twice"))
    one = e.crossJoin(u)  # a row each
    c, rate = F.col, F.when(F.col("w") > 0, 1 - F.col("u") / F.col("w")).otherwise(F.lit(0.0))
    of = lambda x: F.concat_ws("/", x, c("n"))
    check = lambda name, ok, value: F.struct(F.lit(name).alias("check"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), value.cast("string").alias("value"))
    audio = F.when(c("silent") == 0, "PASS").when(c("unknown") == 0, "GAP").otherwise("FAIL")
    parts = [check("episode_count", c("n") == expected, c("n"))] if expected is not None else []
    parts += [
        check("fused_utterances", c("m") > 0, c("m")), check("speaker_assignment", rate >= least_assigned, F.round(rate, 6)), F.struct(F.lit("audio_availability").alias("check"), audio.alias("status"), of(c("n") - c("silent")).alias("value")),
        check("diarization_outputs", c("diarization") == c("n"), of(c("diarization"))), check("asr_outputs", c("asr") == c("n"), of(c("asr"))), check("fusion_outputs", c("fused") == c("n"), of(c("fused"))),
        check("annotation_drafts", c("draft") == c("n"), of(c("draft"))), check("nonempty_transcripts", c("empty") == 0, c("empty")), check("unique_result_keys", c("twice") == 0, c("twice")), check("diarization_provenance", c("unprovided") == 0, c("unprovided")),
    ]
    return one.select(F.inline(F.array(*parts)))


def ready(checks: DataFrame) -> DataFrame:
    """One row: ready, if no check fails."""
    return checks.agg((F.count_if(F.col("status") == "FAIL") == 0).alias("ready"))


# Corrections of recognised text.


def routed(segments: DataFrame, cache: DataFrame, threshold: float) -> DataFrame:
    """Segments (episode, segment, text, words, confidence) with route: cached (cache: key, corrected), pass (sure enough) or submit, and the corrected text that is known."""
    key = F.concat_ws("::", "episode", F.col("segment").cast("string"), F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 12))
    rows = segments.withColumn("key", key).join(cache.select("key", "corrected").dropDuplicates(["key"]), "key", "left")
    sure = segment_confidence(F.col("words"), F.col("confidence")) >= threshold
    route = F.when(F.col("corrected").isNotNull(), "cached").when(sure, "pass").otherwise("submit")
    return rows.withColumn("route", route).withColumn("corrected", F.coalesce("corrected", F.when(F.col("route") == "pass", F.col("text"))))


def correction_stats(rows: DataFrame) -> DataFrame:
    """One row from routed segments whose corrections are in: segments by route, mean edit rate, and corrections that change very much or nearly nothing."""
    rate = edit_rate(F.coalesce("text", F.lit("")), F.coalesce("corrected", "text", F.lit("")))
    rows = rows.select("route", rate.alias("_r"))
    n = lambda r: F.count_if(F.col("route") == r)
    sent, r = F.col("route") == "submit", F.col("_r")
    return rows.agg(F.count("*").alias("n_segments"), n("submit").alias("n_submitted"), n("pass").alias("n_skipped_high_conf"), (n("submit") + n("cached")).alias("n_corrected"), F.round(F.coalesce(F.avg(r), F.lit(0.0)), 4).alias("mean_edit_rate"), F.count_if(r > EDIT_CEILING).alias("flagged_over"), F.count_if(sent & (r < EDIT_FLOOR)).alias("flagged_under"))


def evidence(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """quotes (turn_id, quote) with outcome: found in the turn's text or else its raw text (composed, spaces collapsed, case kept), elided, or missing (no such turn); empty quotes drop out."""
    from lectern.functions.text import collapse, nfc

    clean = lambda c: collapse(nfc(F.coalesce(c, F.lit(""))))
    q = quotes.withColumn("_q", clean(F.col("quote"))).filter("_q != ''")
    t = turns.select("turn_id", clean(F.col("text")).alias("_t"), clean(F.col("text_raw")).alias("_raw"))
    both = q.join(t, "turn_id", "left")
    out = F.when(F.col("_t").isNull(), "missing").when(F.contains("_t", "_q") | F.contains("_raw", "_q"), "found").otherwise("elided")
    return both.select(*quotes.columns, out.alias("outcome"))


def evidence_rates(outcomes: DataFrame) -> DataFrame:
    """One row: total, found, elided, missing, and the rate found."""
    n = lambda x: F.count_if(F.col("outcome") == x)
    return outcomes.agg(F.count("*").alias("total"), n("found").alias("found"), n("elided").alias("elided"), n("missing").alias("missing"), share(n("found"), F.count("*")).alias("rate"))


def span_key(utterance: Column, span: Column) -> Column:
    """utterance::span, whatever the span's case."""
    return F.concat_ws("::", utterance.cast("string"), nfc_casefold(F.trim(F.coalesce(span, F.lit("")))))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels of two annotators (utterance_id, target_text, label) side by side by span_key: key, label_a, label_b, __NONE__ where one has none; of a key's labels the least counts."""
    one = lambda d, name: d.groupBy(span_key(F.col("utterance_id"), F.col("target_text")).alias("key")).agg(F.min("label").alias(name))
    none = F.lit("__NONE__")
    return one(a, "label_a").join(one(b, "label_b"), "key", "full_outer").select("key", F.coalesce("label_a", none).alias("label_a"), F.coalesce("label_b", none).alias("label_b"))
