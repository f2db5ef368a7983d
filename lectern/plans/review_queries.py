"""Weak labels, review, gates, audits, corrections and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import annotations as N
from lectern.operators import experiments as X
from lectern.operators import review as R
from lectern.plans.base import query
from lectern.plans.catalog import UTT, table, utterances
from lectern.session import stored

TYPE = "CASE {} % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'SECTOR' WHEN 2 THEN 'COMPANY' ELSE 'PLANET' END"
SIDE = "CASE {} % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END"

# Weak results: each turn's lines are an order's, its text the priority's words.
WEAK = f"""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS k, l_partkey % 3 AS s, {TYPE.format('l_suppkey')} AS t, {SIDE.format('l_partkey')} AS p, round(l_discount * 10, 2) AS c FROM lineitem),
o AS (SELECT o_orderkey AS id, lower(o_orderpriority) AS x, CASE o_orderkey % 4 WHEN 0 THEN 'non_evaluative' WHEN 1 THEN 'labelled' ELSE NULL END AS st FROM orders),
v AS (SELECT l.id, k, CASE s WHEN 0 THEN 'low' WHEN 1 THEN 'urgent' ELSE 'high' END AS span, t, p, c, x FROM l JOIN o ON o.id = l.id), w AS (SELECT * FROM v WHERE t <> 'PLANET' AND p <> 'neutral' AND contains(x, span)),
b AS (SELECT *, row_number() OVER (PARTITION BY id, span ORDER BY c DESC, k, t, p) AS r, min(t || p) OVER (PARTITION BY id, span) <> max(t || p) OVER (PARTITION BY id, span) AS u FROM w),
g AS (SELECT id, count(*) FILTER (r = 1) AS n, bool_or(u) AS u, bool_or(r = 1 AND c < 0.85) AS low, string_agg(CASE WHEN r = 1 THEN span || ':' || t || ':' || p END, ',' ORDER BY k, span, t, p) AS labels FROM b GROUP BY 1),
z AS (SELECT o.id, coalesce(n, 0) AS n, coalesce(labels, '') AS labels, coalesce(u, false) AS u, coalesce(low, false) AS low, st, CASE WHEN n > 0 THEN 'labelled' WHEN st = 'non_evaluative' THEN st ELSE 'review_required' END AS status FROM o LEFT JOIN g ON g.id = o.id)"""


def weak_results(spark, sf):
    spans = F.when(F.col("l_partkey") % 3 == 0, "low").when(F.col("l_partkey") % 3 == 1, "urgent").otherwise("high")
    k, s = F.col("l_suppkey") % 4, F.col("l_partkey") % 3
    kind = F.when(k == 0, "MARKET").when(k == 1, "SECTOR").when(k == 2, "COMPANY").otherwise("PLANET")
    side = F.when(s == 0, "positive").when(s == 1, "negative").otherwise("neutral")
    one = F.struct("l_linenumber", spans.alias("target_text"), kind.alias("target_type"), side.alias("polarity"), F.round(F.col("l_discount") * 10, 2).cast("double").alias("confidence"))
    labels = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("l_linenumber")).alias("labels"))
    st = F.when(F.col("o_orderkey") % 4 == 0, "non_evaluative").when(F.col("o_orderkey") % 4 == 1, "labelled")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lower("o_orderpriority").alias("text"), st.alias("annotation_status"), F.lit(False).alias("review_required"))
    return o.join(labels, "id", "left")


@query("weak_validation", WEAK + """ SELECT id, labels, status AS annotation_status, (status = 'review_required' OR coalesce(n > 0 AND st = 'non_evaluative', false) OR u OR low) AS review_required,
  concat_ws(',', CASE WHEN n > 0 AND st = 'non_evaluative' THEN 'status_label_conflict' END, CASE WHEN u THEN 'conflicting_label_resolved_by_confidence' END) AS flags FROM z""")
def weak_validation(spark, sf):
    out = R.valid_weak(weak_results(spark, sf))
    labels = F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["target_text"], x["target_type"], x["polarity"])), ",")
    return out.select("id", labels.alias("labels"), "annotation_status", "review_required", F.array_join("validation_flags", ",").alias("flags"))


# Weak rows of documents: target by source, polarity by label; earlier reviews of every other one.
ROWS = """WITH a AS (SELECT d.doc_id AS row_id, source AS target_type, lang AS polarity, d.doc_id % 9 = 0 AS review_required, 0.80 + (d.doc_id % 20) / 100.0 AS confidence FROM documents d),
s AS (SELECT *, row_number() OVER (PARTITION BY target_type, polarity ORDER BY md5(row_id::VARCHAR), row_id) AS r, count(*) OVER (PARTITION BY target_type, polarity) AS n FROM a),
q AS (SELECT *, CASE WHEN review_required THEN 'forced' ELSE 'stratified_audit' END AS review_kind, row_id % 2 = 0 AS human_verified, row_id % 2 = 0 AND row_id % 12 <> 0 AS approved FROM s WHERE review_required OR r <= greatest(1, round_even(0.1 * n, 0)))"""


def _weak_rows(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(i.alias("row_id"), F.col("source").alias("target_type"), F.col("lang").alias("polarity"), (i % 9 == 0).alias("review_required"), (0.80 + (i % 20) / 100.0).alias("confidence"))


def _queue(spark, sf, all_=False):
    rows = _weak_rows(spark, sf)
    i = F.col("row_id")
    yes = F.when(i % 2 == 0, "TRUE").otherwise("no") if not all_ else F.lit("1")
    earlier = rows.select("row_id", yes.alias("human_verified"), F.when(i % 12 != 0, "yes").otherwise("0").alias("approved")).filter("row_id % 2 = 0" if not all_ else "true")
    return R.review_queue(rows, F.struct(F.md5(i.cast("string").cast("binary")), i), ["target_type", "polarity"], earlier)


@query("review_carry_over", ROWS + " SELECT row_id, review_kind, human_verified, approved FROM q")
def review_carry_over(spark, sf):
    return _queue(spark, sf).select("row_id", "review_kind", "human_verified", "approved")


@query("weak_audit", ROWS + """ SELECT 'half' AS reviewed, count(*) FILTER (review_kind = 'stratified_audit') AS n_review, NULL::DOUBLE AS accuracy, 'PENDING' AS status FROM q
UNION ALL SELECT 'all', count(*), round(avg((row_id % 12 <> 0)::INT), 6), CASE WHEN avg((row_id % 12 <> 0)::INT) >= 0.85 THEN 'PASS' ELSE 'PENDING' END FROM q WHERE review_kind = 'stratified_audit'""")
def weak_audit(spark, sf):
    half = R.weak_audit(_queue(spark, sf)).select(F.lit("half").alias("reviewed"), "*")
    return half.unionByName(R.weak_audit(_queue(spark, sf, True)).select(F.lit("all").alias("reviewed"), "*")).withColumn("accuracy", F.round("accuracy", 6))


@query("weak_training", ROWS + " SELECT row_id FROM a WHERE NOT review_required AND confidence >= 0.85 AND row_id NOT IN (SELECT row_id FROM q WHERE human_verified AND NOT approved)")
def weak_training(spark, sf):
    return R.weak_training(_weak_rows(spark, sf), _queue(spark, sf)).select("row_id")


ANN = "WITH " + UTT + """, an AS (SELECT episode, turn, text, CASE turn % 6 WHEN 5 THEN 'PLANET' ELSE 'MARKET' END AS target, CASE turn % 3 WHEN 0 THEN 'positive' WHEN 1 THEN '' ELSE 'neutral' END AS polarity FROM utt),
er AS (SELECT episode, unnest([CASE WHEN target = 'PLANET' THEN 'BAD_TARGET' END, CASE WHEN polarity = 'neutral' THEN 'BAD_POLARITY' END, CASE WHEN text = '' THEN 'EMPTY_TRANSCRIPT' END]) AS code FROM an
  UNION ALL SELECT DISTINCT episode, CASE WHEN episode % 5 = 0 THEN 'NO_SPEAKERS' WHEN episode % 5 = 1 THEN 'BAD_ROLE' END FROM an
  UNION ALL SELECT episode, CASE WHEN count(*) FILTER (polarity = 'positive') < 5 THEN 'TOO_FEW_LABELLED' END FROM an GROUP BY 1),
ec AS (SELECT episode, code, count(*) AS n FROM er WHERE code IS NOT NULL GROUP BY 1, 2)"""


def _annotated(spark, sf):
    t = F.col("turn")
    u = utterances(spark, sf).select("episode", F.col("text").alias("text_verbatim"), F.when(t % 6 == 5, "PLANET").otherwise("MARKET").alias("target"), F.when(t % 3 == 0, "positive").when(t % 3 == 1, "").otherwise("neutral").alias("polarity"))
    e = F.col("episode")
    return u, u.select("episode").distinct().filter(e % 5 != 0).select("episode", F.when(e % 5 == 1, "king").otherwise("host").alias("role_tag"))


@query("episode_errors", ANN + " SELECT episode, code, n FROM ec")
def episode_errors(spark, sf):
    return R.episode_errors(*_annotated(spark, sf))


@query("annotation_summary", ANN + """ SELECT a.episode, count(*) AS n_utterances, count(*) FILTER (polarity = 'positive') AS n_labelled, a.episode % 2 = 0 AS is_gold_tier, coalesce((SELECT sum(n) FROM ec WHERE ec.episode = a.episode), 0)::BIGINT AS validation_errors FROM an a GROUP BY a.episode""")
def annotation_summary(spark, sf):
    u, speakers = _annotated(spark, sf)
    return R.annotation_summary(u, u.select("episode").filter("episode % 2 = 0"), R.episode_errors(u, speakers))


GATES = """WITH r AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS p, count(*) FILTER (c_custkey % 50 = 0) AS remote FROM customer WHERE c_custkey % 3 <> 0),
g AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t, role, turn % 4 AS k FROM conversations), c AS (SELECT count(*) FILTER (t = '') AS e, count(*) FILTER (role = 'system') AS sp, count(*) FILTER (k = 3) AS ro, count(*) FILTER (k = 2) AS op FROM g),
u AS (SELECT coalesce(sum(n), 0) AS w FROM (SELECT count(*) AS n FROM conversations WHERE role = 'system'))
SELECT unnest(['episode_count', 'programme_count', 'remote_guest_episodes', 'no_synthetic_gold', 'layer1_no_empty_transcript', 'layer2_no_missing_speaker', 'layer2_roles_resolved', 'layer3_resolved_or_excluded', 'economic_topic_coverage', 'no_neutral_class', 'fusion_no_unassigned_words',
  'wer_measured', 'wer_target', 'der_measured_0.25_collar', 'der_target', 'annotation_kappa', 'public_private_f1_gap', 'sentiment_private_macro_f1', 'ntp_curve', 'wer_at_or_below_ntp', 'proper_noun_recovery_measured', 'weak_label_stratified_audit']) AS gate,
 unnest([CASE WHEN n >= 8 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN p >= 4 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN remote >= 2 THEN 'PASS' ELSE 'FAIL' END, 'PASS', CASE WHEN e = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN sp = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN ro = 0 THEN 'PASS' ELSE 'FAIL' END,
  CASE WHEN op = 0 THEN 'PASS' ELSE 'FAIL' END, 'FAIL', 'PASS', CASE WHEN w = 0 THEN 'PASS' ELSE 'FAIL' END, 'PASS', 'PASS', 'FAIL', 'SKIPPED', 'FAIL', 'SKIPPED', 'SKIPPED', 'SKIPPED', 'PASS', 'PASS', 'PASS']) AS status FROM r, c, u"""


def _gates(spark, sf):
    reg = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode"), F.when(F.col("c_custkey") % 3 == 0, "rejected").otherwise("ok").alias("duration_flag"), F.col("c_mktsegment").alias("programme"), F.when(F.col("c_custkey") % 50 == 0, "Yes").otherwise("0").alias("has_remote_guest"))
    k = F.col("turn") % 4
    label = F.array(F.struct(F.lit("x").alias("target_text"), F.when(k == 0, "MARKET").otherwise("SECTOR").alias("target_type"), F.lit("positive").alias("polarity"), F.lit(None).cast("double").alias("confidence"))).cast(f"array<{N.LABEL}>")
    gold = utterances(spark, sf).select(F.col("text").alias("text_verbatim"), "speaker_id", F.when(k == 3, "king").otherwise("host").alias("role_tag"), F.lit(False).alias("role_review_required"), F.when(k == 2, "review_required").otherwise("labelled").alias("annotation_status"), label.alias("labels"), F.lit(False).alias("synthetic"))
    fused = table(spark, sf, "conversations").filter("role = 'system'").groupBy(F.col("conv_id").alias("episode")).agg(F.count("*").alias("unassigned_words"))
    metrics = spark.createDataFrame([("PASS", 0.9, 0.12, None, 0.5, None, None, 7, 0.2, 0.8, None)], "weak_status string, weak_accuracy double, wer double, der double, kappa double, f1_gap double, private_f1 double, ntp_rows long, ntp_limit double, noun_recall double, classifier boolean")
    return R.submission_gates(R.measures(reg, gold, fused, metrics))


@query("submission_gates", GATES)
def submission_gates(spark, sf):
    return _gates(spark, sf).select("gate", "status")


@query("gate_summary", f"WITH g AS ({GATES}) SELECT count(*) AS gates, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status <> 'PASS') = 0 AS submittable FROM g")
def gate_summary(spark, sf):
    return R.gate_summary(_gates(spark, sf))


READY = """WITH e AS (SELECT c_custkey AS ep, coalesce(sum(o_orderkey % 7), 0)::BIGINT AS w, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 7 ELSE 0 END), 0)::BIGINT AS u, c_custkey % 10 = 0 AS silent, count(o_orderkey) FILTER (o_orderstatus = 'F') AS d, count(o_orderkey) FILTER (o_orderstatus = 'O') AS a, count(*) AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT count(*) AS n, 1 - sum(u) / sum(w) AS rate, count(*) FILTER (silent) AS si, count(*) FILTER (d > 0) AS d, count(*) FILTER (a > 0) AS a, count(*) FILTER (f > 0) AS f FROM e), t AS (SELECT count(*) AS m FROM documents)
SELECT unnest(['episode_count', 'fused_utterances', 'speaker_assignment', 'audio_availability', 'diarization_outputs', 'asr_outputs', 'fusion_outputs', 'annotation_drafts', 'nonempty_transcripts', 'unique_result_keys', 'diarization_provenance']) AS check,
  unnest([CASE WHEN n = 1500 THEN 'PASS' ELSE 'FAIL' END, 'PASS', CASE WHEN rate >= 0.5 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN si = 0 THEN 'PASS' ELSE 'GAP' END, CASE WHEN d = n THEN 'PASS' ELSE 'FAIL' END, CASE WHEN a = n THEN 'PASS' ELSE 'FAIL' END, 'PASS', 'PASS', 'PASS', 'PASS', 'PASS']) AS status FROM s, t"""


def _readiness(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    e = table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("episode")).agg(
        F.coalesce(F.sum(k % 7), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "P", k % 7).otherwise(0)), F.lit(0)).alias("unassigned_words"), n("F").alias("diarization_rows"), n("O").alias("asr_rows"), F.count("*").alias("fused_rows"), F.count("*").alias("draft_rows"),
    ).withColumn("provider", F.lit("pyannote")).withColumn("audio_path", F.when(F.col("episode") % 10 != 0, "a.wav"))
    u = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.lit("x").alias("normalized_text"))
    gaps = table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("episode"))
    return R.readiness(e, u, gaps, 1500)


@query("readiness_audit", READY)
def readiness_audit(spark, sf):
    return _readiness(spark, sf).select("check", "status")


@query("corpus_ready", f"WITH c AS ({READY}) SELECT count(*) FILTER (status = 'FAIL') = 0 AS ready FROM c")
def corpus_ready(spark, sf):
    return R.ready(_readiness(spark, sf))


ROUTE = "WITH " + UTT + r""", c AS (SELECT *, episode || '::' || turn || '::' || substr(sha1(text), 1, 12) AS key, CASE WHEN turn % 3 = 0 THEN 0.9 ELSE 0.5 END AS conf FROM utt)"""


def _routed(spark, sf):
    u = utterances(spark, sf)
    conf = F.when(F.col("turn") % 3 == 0, 0.9).otherwise(0.5)
    s = u.select("episode", F.col("turn").alias("segment"), "text", F.array().cast("array<struct<prob: double>>").alias("words"), conf.alias("confidence"))
    key = F.concat_ws("::", "episode", F.col("segment").cast("string"), F.substring(F.sha1("text"), 1, 12))
    cache = s.filter("segment % 5 = 1").select(key.alias("key"), F.concat(F.col("text"), F.lit(" .")).alias("corrected"))
    return R.routed(s, cache, 0.85)


@query("correction_routes", ROUTE + " SELECT episode, turn AS segment, CASE WHEN turn % 5 = 1 THEN 'cached' WHEN conf >= 0.85 THEN 'pass' ELSE 'submit' END AS route, CASE WHEN turn % 5 = 1 THEN text || ' .' WHEN conf >= 0.85 THEN text END AS corrected FROM c")
def correction_routes(spark, sf):
    return _routed(spark, sf).select("episode", "segment", "route", "corrected")


@query("correction_stats", ROUTE + """ SELECT count(*) AS n_segments, count(*) FILTER (turn % 5 <> 1 AND conf < 0.85) AS n_submitted, count(*) FILTER (turn % 5 <> 1 AND conf >= 0.85) AS n_skipped_high_conf, count(*) FILTER (turn % 5 = 1 OR conf < 0.85) AS n_corrected,
  round(avg(CASE WHEN turn % 5 = 1 THEN CASE WHEN n_words = 0 THEN 1 ELSE 1.0 / (n_words + 1) END ELSE 0 END), 4) AS mean_edit_rate, count(*) FILTER (turn % 5 = 1 AND CASE WHEN n_words = 0 THEN 1 ELSE 1.0 / (n_words + 1) END > 0.4) AS flagged_over, count(*) FILTER (turn % 5 <> 1 AND conf < 0.85) AS flagged_under FROM c""")
def correction_stats(spark, sf):
    return R.correction_stats(_routed(spark, sf))


@query("evidence_outcomes", """
WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nfc_normalize(split_part(trim(d.text), ' ', 1)) WHEN 1 THEN 'no such words here' WHEN 2 THEN '  ' ELSE 'RAW' END AS q, doc_id % 7 = 0 AS gone, text FROM documents d)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN gone THEN 'missing' WHEN doc_id % 4 = 1 THEN 'elided' ELSE 'found' END AS outcome FROM q WHERE trim(q) <> '') GROUP BY 1""")
def evidence_outcomes(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "text")
    quote = F.when(i % 4 == 0, F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).when(i % 4 == 1, "no such words here").when(i % 4 == 2, "  ").otherwise("RAW")
    turns = d.filter(i % 7 != 0).select(i.alias("turn_id"), "text", F.concat(F.col("text"), F.lit(" RAW")).alias("text_raw"))
    return R.evidence(d.select(i.alias("turn_id"), quote.alias("quote")), turns).groupBy("outcome").agg(F.count("*").alias("n"))


@query("aligned_labels", """
WITH a AS (SELECT o_orderkey::VARCHAR || '::' || lower(o_orderpriority) AS key, o_orderstatus AS x FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey::VARCHAR || '::' || lower(o_orderpriority) AS key, 'F' AS y FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(a.key, b.key) AS key, coalesce(x, '__NONE__') AS label_a, coalesce(y, '__NONE__') AS label_b FROM a FULL OUTER JOIN b ON a.key = b.key""")
def aligned_labels(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    a = o.filter(k % 3 != 0).select(k.alias("utterance_id"), F.col("o_orderpriority").alias("target_text"), F.col("o_orderstatus").alias("label"))
    b = o.filter(k % 2 == 0).select(k.alias("utterance_id"), F.upper("o_orderpriority").alias("target_text"), F.lit("F").alias("label"))
    return R.aligned(a, b)


# Experiments.

PROP = "WITH " + UTT + """, r AS (SELECT *, CASE WHEN n_words % 2 = 0 THEN 'up' ELSE 'down' END AS g, CASE WHEN (n_words + turn) % 3 = 0 THEN 'up' ELSE 'down' END AS h, speaker_id AS gs, CASE WHEN turn % 4 = 0 THEN 9 ELSE speaker_id END AS ps FROM utt),
w AS (SELECT 'oracle' AS condition, role, g, g AS p, true AS s FROM r UNION ALL SELECT 'diarization_corruption', role, g, g, gs = ps FROM r UNION ALL SELECT 'asr_corruption', role, g, h, true FROM r UNION ALL SELECT 'full_pipeline', role, g, h, gs = ps FROM r),
f AS (SELECT condition, role, l, CASE WHEN count(*) FILTER (g = l OR p = l) > 0 THEN 2.0 * count(*) FILTER (g = l AND p = l) / (count(*) FILTER (g = l) + count(*) FILTER (p = l)) ELSE 0 END AS f FROM w, (SELECT unnest(['up', 'down']) AS l) GROUP BY 1, 2, 3)
SELECT a.condition, a.role, a.n, round(b.f, 6)::DOUBLE AS macro_f1, a.exact, a.speaker_accuracy FROM (SELECT condition, role, count(*) AS n, round(avg((g = p)::INT), 6) AS exact, round(avg(s::INT), 6) AS speaker_accuracy FROM w GROUP BY 1, 2) a JOIN (SELECT condition, role, avg(f) AS f FROM f GROUP BY 1, 2) b ON b.condition = a.condition AND b.role = a.role"""


@query("error_propagation", PROP)
def error_propagation(spark, sf):
    n, t = F.col("n_words"), F.col("turn")
    one = lambda up: F.array(F.when(up, "up").otherwise("down"))
    rows = utterances(spark, sf).select("role", one(n % 2 == 0).alias("gold_labels"), one(n % 2 == 0).alias("labels_gold_text"), one((n + t) % 3 == 0).alias("labels_pred_text"), F.col("speaker_id").alias("gold_speaker"), F.when(t % 4 == 0, 9).otherwise(F.col("speaker_id")).alias("pred_speaker"))
    out = X.error_propagation(rows, ["role"], ["up", "down"])
    return out.select("condition", "role", "n", *[F.round(c, 6).alias(c) for c in ("macro_f1", "exact", "speaker_accuracy")])


def noise_points(spark, sf, levels=X.NOISE_LEVELS):
    """level, achieved_wer, macro_f1 of a word list's verdict on noisy turns against that on clean ones."""
    u = utterances(spark, sf).filter("n_words > 0").select(F.concat_ws(":", "episode", "turn").alias("k"), T.tokens(F.lower("text")).alias("ts"))
    rows = u.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    noisy = T.inject_noise(F.col("ts"), F.concat_ws(":", "k", F.col("level").cast("string")), F.col("level"))
    rows = rows.withColumn("clean", F.array_join("ts", " ")).withColumn("noisy", F.array_join(noisy, " "))
    verdict = lambda c: F.array(F.when(T.tokens(F.col(c)).getItem(0) < "m", "early").otherwise("late"))
    rows = rows.select("level", T.wer(F.col("clean"), F.col("noisy")).alias("w"), verdict("clean").alias("g"), verdict("noisy").alias("p"))
    return X.set_f1(rows, ["level"], "g", "p", ["early", "late"], F.avg("w").alias("achieved_wer")).select("level", "achieved_wer", "macro_f1")


@query("noise_curve")
def noise_curve(spark, sf):
    """Word error rate that each level of noise achieves, and what it costs in F1; tests follow its course."""
    return noise_points(spark, sf).select("level", F.round("achieved_wer", 6).alias("achieved_wer"), F.round("macro_f1", 6).alias("macro_f1"))


@query("noise_limit", "WITH c AS (SELECT n_name, n_nationkey / 25.0 AS w, 1 - (n_nationkey * 7 % 25) / 500.0 AS f FROM nation) SELECT round(max(w), 6)::DOUBLE AS limit FROM c WHERE f >= (SELECT max(f) FROM c) - 0.03")
def noise_limit(spark, sf):
    k = F.col("n_nationkey")
    return X.noise_limit(table(spark, sf, "nation").select((k / 25.0).alias("achieved_wer"), (1 - (k * 7 % 25) / 500.0).alias("macro_f1"))).select(F.round("limit", 6).alias("limit"))


@query("condition_scores", """
WITH g AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'profit is up' WHEN 1 THEN 'prices fall' ELSE 'profit and loss' END AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS p FROM orders),
h AS (SELECT 'gold' AS condition, id, t, t AS h, p FROM g UNION ALL SELECT 'asr', id, t, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN 'profit' ELSE t END, p FROM g),
s AS (SELECT condition, p, t, h, (contains(h, 'profit')::INT + contains(h, 'up')::INT) - (contains(h, 'loss')::INT + contains(h, 'fall')::INT) AS x FROM h),
v AS (SELECT *, CASE WHEN x > 0 THEN 'positive' WHEN x < 0 THEN 'negative' END AS l, CASE WHEN h = '' THEN 1.0 WHEN h = t THEN 0.0 WHEN contains(t, 'profit') THEN 2.0 / 3 ELSE 1.0 END AS w FROM s)
SELECT condition, count(*) AS n_gold, round(avg(w), 6)::DOUBLE AS wer, round(avg((w < 1)::INT), 6) AS coverage, count(l) AS n, round(avg((l = p)::INT), 6) AS accuracy,
  round(2.0 * count(*) FILTER (l = 'positive' AND p = 'positive') / (count(*) FILTER (l = 'positive') + count(*) FILTER (l IS NOT NULL AND p = 'positive')), 6)::DOUBLE AS f1_positive FROM v GROUP BY 1""")
def condition_scores(spark, sf):
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, "profit is up").when(k % 3 == 1, "prices fall").otherwise("profit and loss")
    g = table(spark, sf, "orders").select(k.alias("segment_id"), t.alias("text"), F.when(k % 2 == 0, "positive").otherwise("negative").alias("polarity"))
    asr = g.filter("segment_id % 5 != 0").select("segment_id", F.when(F.col("segment_id") % 5 == 1, "profit").otherwise(F.col("text")).alias("text"))
    out = X.condition_scores(g, {"gold": g.select("segment_id", "text"), "asr": asr}, ["profit", "up"], ["loss", "fall"])
    return out.select("condition", "n_gold", F.round("wer", 6).alias("wer"), F.round("coverage", 6).alias("coverage"), "n", F.round("accuracy", 6).alias("accuracy"), F.round("f1_positive", 6).alias("f1_positive"))


@query("measured_noise_limit")
def measured_noise_limit(spark, sf):
    """The greatest error rate that the measured curve bears; tests take it from the curve's rows."""
    return X.noise_limit(stored(noise_points(spark, sf), "curve")).select(F.round("limit", 6).alias("limit"))


@query("predictions_reproduced", """
WITH p AS (SELECT doc_id, quality AS truth, 1 - toxic AS pred FROM labels), a AS (SELECT doc_id, truth, CASE WHEN doc_id % 17 = 0 THEN 1 - pred ELSE pred END AS pred FROM p WHERE doc_id % 23 <> 0 UNION ALL SELECT -1 - doc_id, truth, pred FROM p WHERE doc_id % 29 = 0),
j AS (SELECT p.doc_id AS x, a.doc_id AS y, p.pred AS a, a.pred AS b, p.truth AS t FROM p FULL JOIN a ON a.doc_id = p.doc_id)
SELECT count(x) AS n, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (x IS NULL) AS extra, 0 AS repeated, count(*) FILTER (a = b) AS equal,
  round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND a = t) / count(*) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS accuracy_published, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND b = t) / count(*) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS accuracy_again, false AS same FROM j""")
def predictions_reproduced(spark, sf):
    """Predictions of all labels against a run that lost some, changed some and made some of its own."""
    p = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred"))
    again = p.filter("doc_id % 23 != 0").withColumn("pred", F.when(F.col("doc_id") % 17 == 0, 1 - F.col("pred")).otherwise(F.col("pred")))
    again = again.unionByName(p.filter("doc_id % 29 = 0").withColumn("doc_id", -1 - F.col("doc_id")))
    out = X.reproduced(p, again, ["doc_id"])
    return out.withColumn("accuracy_published", F.round("accuracy_published", 6)).withColumn("accuracy_again", F.round("accuracy_again", 6))
