"""Turns, speakers, episodes and stages of the corpus that the catalog makes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.quantiles import quantiles
from lectern.operators import aggregates as A
from lectern.operators import audio, corpus
from lectern.operators import splits as S
from lectern.plans.aggregate_queries import LAB, labelled
from lectern.plans.base import query
from lectern.plans.catalog import JUD, UTT, WORDS, judged, segments, table, utterances, words
from lectern.sources import files

# Turns with loops: of every fifth one the first word five times more.
TURNS = UTT + r""",
tn AS (SELECT *, CASE WHEN turn % 5 = 4 THEN repeat(split_part(text, ' ', 1) || ' ', 5) || text ELSE text END AS raw FROM utt),
tk AS (SELECT *, list_filter(regexp_split_to_array(raw, '\s+'), lambda x: x <> '') AS ws FROM tn),
cl AS (SELECT *, list_filter(ws, lambda x, i: NOT (i > 2 AND x = ws[i - 1] AND x = ws[i - 2])) AS cs FROM tk),
ex AS (SELECT episode, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM tk),
rn AS (SELECT episode, turn, w, i - row_number() OVER (PARTITION BY episode, turn, w ORDER BY i) AS k FROM ex),
lr AS (SELECT episode, turn, max(n) AS m FROM (SELECT episode, turn, w, k, count(*) AS n FROM rn GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
fl AS (SELECT cl.*, len(cs)::BIGINT AS nw, array_to_string(cs, ' ') AS clean, coalesce(m, 0) >= 4 OR (len(ws) >= 20 AND len(list_distinct(ws)) * 1.0 / len(ws) < 0.35) AS loop FROM cl LEFT JOIN lr ON lr.episode = cl.episode AND lr.turn = cl.turn)"""


def turns(spark, sf):
    u = utterances(spark, sf)
    again = F.concat(F.repeat(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" ")), 5), F.col("text"))
    return u.withColumn("text", F.when(F.col("turn") % 5 == 4, again).otherwise(F.col("text")))


@query("turn_flags", "WITH " + TURNS + " SELECT episode, turn, nw AS n_words, loop, nw < 5 AS too_short, NOT loop AND nw >= 5 AS usable, NOT loop AND nw >= 6 AS supervised FROM fl")
def turn_flags(spark, sf):
    return corpus.flagged_turns(turns(spark, sf)).select("episode", "turn", "n_words", "loop", "too_short", "usable", "supervised")


@query("speaker_units", "WITH " + TURNS + """
SELECT episode, speaker_id, count(*) AS n_turns, count(*) FILTER (NOT loop AND nw >= 5) AS n_usable_turns, sum(nw)::BIGINT AS n_words, coalesce(sum(nw) FILTER (NOT loop AND nw >= 5), 0)::BIGINT AS n_clean_words, round(sum(end_sec - start_sec), 1) AS dur_sec,
  count(*) FILTER (loop) AS n_loop_turns, round(avg(1.0 / (1 + turn)), 4) AS mean_asr_confidence, round(sum(nw) * 1.0 / count(*), 1)::DOUBLE AS mean_words_per_turn,
  bool_and(episode % 3 <> 0) AND speaker_id <> -1 AND coalesce(sum(nw) FILTER (NOT loop AND nw >= 5), 0) >= 150 AS judgeable,
  md5(coalesce(string_agg(CASE WHEN NOT loop AND nw >= 5 THEN clean END, chr(10) || chr(10) ORDER BY turn), '')) AS script FROM fl GROUP BY 1, 2""")
def speaker_units(spark, sf):
    rows = corpus.flagged_turns(turns(spark, sf)).withColumn("dur_sec", F.col("end_sec") - F.col("start_sec")).withColumn("asr_confidence", 1.0 / (1 + F.col("turn"))).withColumn("trusted", F.col("episode") % 3 != 0)
    out = corpus.speaker_units(rows).withColumn("script", F.md5(F.col("script").cast("binary")))
    return out.drop("turn_ids", "trusted")


@query("episode_quality", "WITH " + TURNS + r"""
SELECT episode, count(*) AS utterances, count(*) FILTER (trim(raw) <> '' AND loop) AS repetition_loops, count(*) FILTER (regexp_matches(trim(raw), '^[\x{09be}-\x{09c4}]')) AS leading_truncations, count(*) FILTER (len(ws) BETWEEN 1 AND 3) AS too_short FROM fl GROUP BY 1""")
def episode_quality(spark, sf):
    return corpus.episode_quality(turns(spark, sf))


@query("eligible_episodes", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 600 AND 5400")
def eligible_episodes(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.duration_flag(F.col("n_chars")).alias("duration_flag"))
    return corpus.eligible(rows).select("doc_id")


@query("episode_rows", "WITH " + UTT + r""",
e AS (SELECT episode, count(DISTINCT CASE WHEN speaker_id >= 0 THEN speaker_id END) AS sp, count(*) AS u, sum(n_words)::BIGINT AS w, greatest(0, round_even(max(end_sec), 0))::BIGINT AS d, 1 - sum(CASE WHEN speaker_id < 0 THEN n_words ELSE 0 END) * 1.0 / sum(n_words) AS rate FROM utt GROUP BY 1)
SELECT 'c' || episode % 7 AS "Roll", episode AS "Episode", 'talk' AS "Programme", CASE WHEN d >= 3600 THEN printf('%02d:', d // 3600) ELSE '' END || printf('%02d:%02d', d % 3600 // 60, d % 60) AS "Duration", sp AS "Speakers", u AS "Utterances", w AS "Words",
  printf('%.2f', round(rate * 100, 2)) || '%' AS "Assigned", CASE WHEN episode % 2 = 0 THEN 'pyannote' ELSE 'unknown' END AS "Diarization", 'small' AS "ASR model", CASE WHEN episode % 5 = 0 THEN 'Missing' ELSE 'Available' END AS "Audio" FROM e""")
def episode_rows(spark, sf):
    loose = F.sum(F.when(F.col("speaker_id") < 0, F.col("n_words")).otherwise(0))
    e = utterances(spark, sf).groupBy("episode").agg(F.countDistinct(F.when(F.col("speaker_id") >= 0, F.col("speaker_id"))).alias("speakers"), F.count("*").alias("utterances"), F.sum("n_words").alias("words"), F.max("end_sec").alias("duration_sec"), (1 - loose / F.sum("n_words")).alias("assignment_rate"))
    e = e.select("*", F.concat(F.lit("c"), F.col("episode") % 7).alias("collection"), F.lit("talk").alias("programme"), F.when(F.col("episode") % 2 == 0, "pyannote").alias("provider"), F.lit("models/small").alias("model"), F.when(F.col("episode") % 5 != 0, "a.wav").alias("audio_path"))
    return corpus.episode_rows(e)


@query("asr_audit", "WITH " + UTT + "," + WORDS + " SELECT episode, count(DISTINCT turn) AS segments, count(*) AS words, count(*) FILTER (idx % 7 <> 0) AS timestamped_words FROM word GROUP BY 1")
def asr_audit(spark, sf):
    w = words(spark, sf)
    one = F.struct(F.when(F.col("idx") % 7 != 0, F.col("start_ds")).alias("start"), F.col("end_ds").alias("end"), "word")
    return corpus.asr_audit(w.groupBy("episode", "turn").agg(F.collect_list(one).alias("words")))


@query("fusion_stats", "WITH " + UTT + "," + WORDS + " SELECT w.episode, count(*) AS n_words, count(DISTINCT w.turn) AS n_utterances, count(*) FILTER (speaker_id < 0) AS unassigned_words, count(*) FILTER (idx % 10 = 0) AS coarse_tokens FROM word w JOIN utt u ON u.episode = w.episode AND u.turn = w.turn GROUP BY 1")
def fusion_stats(spark, sf):
    u = utterances(spark, sf).select("episode", "turn", "speaker_id")
    return corpus.fusion_stats(words(spark, sf).join(u, ["episode", "turn"]).withColumn("utterance_id", F.col("turn")).withColumn("coarse", F.col("idx") % 10 == 0))


STAGES = "WITH s AS (SELECT c_custkey AS episode, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


def _stages(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("episode"), "o_orderstatus")
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode"))
    return corpus.stage_rows(e, {"diarization": o.filter("o_orderstatus = 'F'"), "asr": o.filter("o_orderstatus = 'O'"), "fused": o.filter("o_orderstatus = 'P'")})


@query("stage_rows", STAGES + " SELECT episode, f AS diarization_rows, o AS asr_rows, p AS fused_rows, CASE WHEN f > 0 THEN 'Ready' ELSE 'Missing' END AS diarization_state, CASE WHEN o > 0 THEN 'Ready' ELSE 'Missing' END AS asr_state, CASE WHEN p > 0 THEN 'Ready' ELSE 'Missing' END AS fused_state FROM s")
def stage_rows(spark, sf):
    return _stages(spark, sf)


@query("stage_summary", STAGES + " SELECT 'diarization' AS stage, count(*) FILTER (f > 0) AS ready, count(*) AS episodes FROM s UNION ALL SELECT 'asr', count(*) FILTER (o > 0), count(*) FROM s UNION ALL SELECT 'fused', count(*) FILTER (p > 0), count(*) FROM s")
def stage_summary(spark, sf):
    return corpus.stage_summary(_stages(spark, sf), ["diarization", "asr", "fused"])


REG = """WITH r AS (SELECT doc_id, source AS programme, n_chars AS d, CASE WHEN n_chars < 600 OR n_chars > 5400 THEN 'rejected' WHEN n_chars < 1800 THEN 'short' WHEN n_chars > 3600 THEN 'long' ELSE 'ok' END AS flag, doc_id % 400 = 0 AS remote, doc_id % 90 = 0 AS market FROM documents)"""


def _registry(spark, sf):
    n = F.col("n_chars")
    flag = T.duration_flag(n)
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("programme"), n.alias("duration_sec"), flag.alias("duration_flag"), F.when(flag == "rejected", F.when(n < 600, "too short").otherwise("too long")).alias("rejection_reason"), (F.col("doc_id") % 400 == 0).alias("has_remote_guest"), (F.col("doc_id") % 90 == 0).alias("covers_market_news"))


@query("diversity_audit", REG + """, e AS (SELECT * FROM r WHERE flag <> 'rejected'),
a AS (SELECT count(*) AS n, count(DISTINCT programme) AS p, count(*) FILTER (remote) AS rg, count(*) FILTER (market) AS mn, count(*) FILTER (d BETWEEN 1800 AND 3600) AS iw, round(avg(d) / 60, 2) AS mean, round(min(d) / 60.0, 2)::DOUBLE AS low, round(max(d) / 60.0, 2)::DOUBLE AS high FROM e)
SELECT n AS n_episodes, p AS n_programmes, rg AS n_remote_guest, mn AS n_market_news, iw AS in_window, mean AS mean_duration_min, low AS min_duration_min, high AS max_duration_min,
  len(list_filter([n < 8, n > 12, p < 4, rg < 2, mn < 1, iw <> n], lambda x: x))::BIGINT AS n_gaps FROM a""")
def diversity_audit(spark, sf):
    return corpus.diversity(_registry(spark, sf)).withColumn("n_gaps", F.size("gaps").cast("long")).drop("gaps")


@query("registry_summary", REG + """ SELECT count(*) AS total, count(*) FILTER (flag = 'ok') AS ok, count(*) FILTER (flag = 'short') AS short, count(*) FILTER (flag = 'long') AS long, count(*) FILTER (flag = 'rejected') AS rejected,
  array_to_string(list_sort(list_distinct(list(CASE WHEN flag = 'rejected' THEN CASE WHEN d < 600 THEN 'too short' ELSE 'too long' END END))), ',') AS rejection_reasons,
  (SELECT CASE WHEN count(*) < 8 OR count(DISTINCT programme) < 4 THEN 'SMOKE' WHEN count(*) < 16 THEN 'PIPELINE-LOW-N' ELSE 'PIPELINE' END FROM r WHERE flag <> 'rejected') AS run_mode FROM r""")
def registry_summary(spark, sf):
    r = _registry(spark, sf)
    mode = corpus.eligible(r).agg(corpus.run_mode(F.count("*"), F.countDistinct("programme")).alias("run_mode"))  # one row
    return corpus.registry_summary(r).withColumn("rejection_reasons", F.array_join("rejection_reasons", ",")).crossJoin(mode)


@query("replaced_chunks", "WITH " + UTT + "," + WORDS + """,
c AS (SELECT episode, start_ds // 280 AS chunk, start_ds % 280 AS s, end_ds - start_ds // 280 * 280 AS e, turn, idx, word, 1.0 / (1 + (start_ds // 280) % 5) AS prob FROM word),
l AS (SELECT episode, chunk FROM c GROUP BY 1, 2 HAVING avg(prob) < 0.3),
d AS (SELECT c.* FROM c JOIN l ON l.episode = c.episode AND l.chunk = c.chunk WHERE c.episode % 2 = 0)
SELECT episode, turn, idx, chunk * 280 + s AS start, chunk * 280 + e AS end, word FROM c WHERE (episode, chunk) NOT IN (SELECT (episode, chunk) FROM d)
UNION ALL SELECT episode, turn, idx, chunk * 280 + s + 1, chunk * 280 + e + 1, '<' || word FROM d""")
def replaced_chunks(spark, sf):
    """Words by chunks of 28 s in their own time; chunks of low probability are decoded again in every other episode."""
    chunk = F.floor(F.col("start_ds") / 280)
    rows = words(spark, sf).select("episode", "turn", F.col("idx").cast("long").alias("idx"), chunk.alias("chunk"), (chunk * 280).alias("chunk_start"), (F.col("start_ds") - chunk * 280).alias("start"), (F.col("end_ds") - chunk * 280).alias("end"), "word", (1.0 / (1 + chunk % 5)).alias("prob"))
    again = rows.filter("episode % 2 = 0").withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1).withColumn("word", F.concat(F.lit("<"), "word"))
    return corpus.replaced_chunks(rows, again, 0.3).select("episode", "turn", "idx", "start", "end", "word")


@query("hysteresis_islands", """
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN value >= 20 THEN 1 WHEN value < 5 THEN 0 END AS m FROM events),
f AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER w, 0) AS on_ FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, (on_ = 1 AND coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 0)::INT AS b FROM f),
h AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*) AS n FROM h WHERE on_ = 1 GROUP BY 1, 2""")
def hysteresis_islands(spark, sf):
    return corpus.hysteresis(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value"), 20, 5).select("user_id", "island", "n")


# Folders and recordings.


@query("stage_folders", """SELECT s_suppkey AS bundle, 'annotation_drafts' AS stage, CASE s_suppkey % 4 WHEN 0 THEN 'data/drafts' WHEN 1 THEN 'annotation_drafts' WHEN 2 THEN 'data/annotation_drafts' ELSE 'data/annotation_drafts' END AS folder FROM supplier
UNION ALL SELECT s_suppkey, 'fused', CASE WHEN s_suppkey % 2 = 0 THEN 'fused' ELSE 'data/fused' END FROM supplier""")
def stage_folders(spark, sf):
    have = {0: ["data/drafts", "drafts", "fused"], 1: ["drafts", "annotation_drafts", "data/fused"], 2: ["annotation_drafts", "data/annotation_drafts", "fused"], 3: ["fused_old"]}
    k = F.col("s_suppkey") % 4
    each = F.coalesce(*[F.when(k == x, F.array(*[F.lit(f) for f in fs])) for x, fs in have.items()])
    return files.stage_folders(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("bundle"), F.explode(each).alias("folder")), ["annotation_drafts", "fused"])


def cascade(spark, sf):
    """(episodes, recordings): conversations of seven collections, every ninth with the path of its recording, and airings as long as they are."""
    u = utterances(spark, sf).groupBy("episode").agg((F.max("end_ds") / 10.0).alias("end_sec"))
    own = F.when(F.col("episode") % 9 == 0, F.concat(F.lit("r/"), F.col("episode"), F.lit(".wav")))
    eps = u.select((F.col("episode") % 7).alias("collection"), "episode", own.alias("local_path"), F.when(F.col("episode") % 3 == 0, F.col("end_sec") + 1).otherwise(0.0).alias("duration_sec"), "end_sec")
    recs = table(spark, sf, "events").select((F.col("event_id") % 7).alias("collection"), F.concat(F.lit("r/"), F.col("event_id"), F.lit(".wav")).alias("path"), F.abs(F.coalesce("value", F.lit(0.0))).alias("duration"))
    return eps, recs


@query("resolved_recordings")
def resolved_recordings(spark, sf):
    """Each conversation's recording by the cascade of rules; a recording that an earlier one has is nobody else's."""
    eps, recs = cascade(spark, sf)
    return audio.resolved(eps, recs).select("collection", "episode", "path", "how")


@query("locked_recordings", """
WITH p AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > 0 AND abs(c_acctbal - s_acctbal) <= 20),
o AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY c_custkey) = 1)
SELECT c_custkey AS episode, s_suppkey AS path FROM o QUALIFY count(*) OVER (PARTITION BY s_suppkey) = 1""")
def locked_recordings(spark, sf):
    """Account balances as lengths: a match that is the only one of an episode, and of no other episode the only one."""
    e = table(spark, sf, "customer").select(F.col("c_nationkey").alias("collection"), F.col("c_custkey").alias("episode"), F.col("c_acctbal").alias("end_sec"))
    r = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("collection"), F.col("s_suppkey").alias("path"), F.col("s_acctbal").alias("duration"))
    return audio.locked(e, r, 20.0).select("episode", "path")


# Evaluation of speakers.

VOTED = LAB + """, prob AS (SELECT *, CASE label WHEN 'positive' THEN 0.7 WHEN 'negative' THEN 0.1 ELSE 0.3 END::DOUBLE AS pp, CASE label WHEN 'negative' THEN 0.8 WHEN 'positive' THEN 0.2 ELSE 0.3 END::DOUBLE AS pn FROM lab)"""


@query("aggregator_labels", "WITH " + LAB + """,
w AS (SELECT *, (label = 'positive')::INT AS p, (label = 'negative')::INT AS n, CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END::DOUBLE AS c FROM lab),
s AS (SELECT episode, speaker_id, count(*) AS t, sum(p) AS p, sum(n) AS n, sum(p) * 1.0::DOUBLE AS p0, sum(n) * 1.0::DOUBLE AS n0, sum(p * n_words)::DOUBLE AS p1, sum(n * n_words)::DOUBLE AS n1, sum(p * c) AS p2, sum(n * c) AS n2, sum(p * n_words * c) AS p3, sum(n * n_words * c) AS n3 FROM w GROUP BY 1, 2)
SELECT episode, speaker_id, t AS n_turns, CASE WHEN (p + n) * 1.0 / t < 0.15 THEN 'neutral' WHEN p > 0 AND n > 0 AND least(p, n) * 1.0 / greatest(p, n) >= 0.5 THEN 'mixed' WHEN p > n THEN 'positive' ELSE 'negative' END AS agg_majority_vote,
""" + ", ".join(f"CASE WHEN (p + n) * 1.0 / t < 0.15 THEN 'neutral' WHEN abs(CASE WHEN p{k} + n{k} <> 0 THEN (p{k} - n{k}) / (p{k} + n{k}) ELSE 0 END) < 0.34 THEN 'mixed' WHEN p{k} > n{k} THEN 'positive' ELSE 'negative' END AS agg_{name}" for k, name in enumerate(("net_polarity", "word_weighted", "conf_weighted", "word_conf_weighted"))) + " FROM s")
def aggregator_labels(spark, sf):
    out = A.aggregated(labelled(spark, sf), ["episode", "speaker_id"])
    return out.select("episode", "speaker_id", "n_turns", *[f"agg_{n}" for n in ("majority_vote", "net_polarity", "word_weighted", "conf_weighted", "word_conf_weighted")])


RULED = VOTED + """,
k AS (SELECT *, row_number() OVER (PARTITION BY episode, speaker_id ORDER BY abs(pp - pn) DESC, turn) AS r, end_sec - start_sec AS d FROM prob),
g AS (SELECT episode, speaker_id, count(*) AS n_turns, avg((label <> 'neutral')::INT) AS polar_share, sum(pp) AS a0, sum(pn) AS b0, sum(pp * n_words) AS a1, sum(pn * n_words) AS b1, sum(pp * d) AS a2, sum(pn * d) AS b2, sum(CASE WHEN r <= 5 THEN pp ELSE 0 END) AS a3, sum(CASE WHEN r <= 5 THEN pn ELSE 0 END) AS b3,
  sum((label = 'positive')::INT)::DOUBLE AS a4, sum((label = 'negative')::INT)::DOUBLE AS b4 FROM k GROUP BY 1, 2),
ru AS (SELECT episode, speaker_id, n_turns, polar_share, """ + ", ".join(f"CASE WHEN a{i} + b{i} > 0 THEN (a{i} - b{i}) / (a{i} + b{i}) ELSE 0.0 END::DOUBLE AS {name}" for i, name in enumerate(A.RULES)) + " FROM g)"


def _ruled(spark, sf):
    label = F.col("label")
    pos = F.when(label == "positive", 0.7).when(label == "negative", 0.1).otherwise(0.3)
    neg = F.when(label == "negative", 0.8).when(label == "positive", 0.2).otherwise(0.3)
    rows = labelled(spark, sf).withColumn("p_positive", pos).withColumn("p_negative", neg).withColumn("pred", label).withColumn("dur_sec", F.col("end_sec") - F.col("start_sec"))
    return A.rule_scores(rows, ["episode", "speaker_id"])


@query("rule_scores", "WITH " + RULED + " SELECT episode, speaker_id, n_turns, round(polar_share, 6) AS polar_share, " + ", ".join(f"round({r}, 5) AS {r}" for r in A.RULES) + " FROM ru")
def rule_scores(spark, sf):
    return _ruled(spark, sf).select("episode", "speaker_id", "n_turns", F.round("polar_share", 6).alias("polar_share"), *[F.round(r, 5).alias(r) for r in A.RULES])


COMPARED = "WITH " + RULED + """, j AS (SELECT *, CASE episode % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'mixed' WHEN 2 THEN 'positive' ELSE 'neutral' END AS truth, (episode % 7 - 3) / 3.0 AS js FROM ru),
u AS (""" + " UNION ALL ".join(f"SELECT '{r}' AS rule, truth, js, {r} AS x, CASE WHEN polar_share < 0.15 THEN 'neutral' WHEN abs({r}) < 0.34 THEN 'mixed' WHEN {r} > 0 THEN 'positive' ELSE 'negative' END AS pred FROM j" for r in A.RULES) + """),
c AS (SELECT rule, l, 2.0 * count(*) FILTER (truth = l AND pred = l) / nullif(count(*) FILTER (truth = l) + count(*) FILTER (pred = l), 0) AS f FROM u, (SELECT unnest(['negative', 'mixed', 'neutral', 'positive']) AS l) GROUP BY 1, 2), f AS (SELECT rule, round(avg(f), 6)::DOUBLE AS macro_f1 FROM c WHERE f IS NOT NULL GROUP BY 1),
a AS (SELECT rule, count(*) AS units, round(avg((truth = pred)::INT), 6) AS exact_acc, round(avg((CASE WHEN truth IN ('positive', 'negative') THEN truth ELSE 'neither' END = CASE WHEN pred IN ('positive', 'negative') THEN pred ELSE 'neither' END)::INT), 6) AS direction_acc, round(corr(x, js), 5) AS stance_corr FROM u GROUP BY 1),
z AS (SELECT a.*, macro_f1 FROM a JOIN f ON f.rule = a.rule)"""


def _compared(spark, sf):
    k = F.col("episode") % 4
    truth = F.when(k == 0, "negative").when(k == 1, "mixed").when(k == 2, "positive").otherwise("neutral")
    units = _ruled(spark, sf).withColumn("judge_label", truth).withColumn("judge_stance_score", (F.col("episode") % 7 - 3) / 3.0)
    out = A.compared_rules(units)
    return out.select("rule", "units", *[F.round(c, 6).alias(c) for c in ("exact_acc", "direction_acc")], F.round("stance_corr", 5).alias("stance_corr"), F.round("macro_f1", 6).alias("macro_f1"))


@query("rule_comparison", COMPARED + " SELECT * FROM z")
def rule_comparison(spark, sf):
    return _compared(spark, sf)


@query("rule_choice", COMPARED + " SELECT rule, macro_f1 FROM z ORDER BY macro_f1 DESC, list_position(['unweighted', 'word_weighted', 'dur_weighted', 'top_k', 'hard_vote'], rule) LIMIT 1")
def rule_choice(spark, sf):
    return A.chosen_rule(_compared(spark, sf)).select("rule", "macro_f1")


@query("both_classes", "WITH " + JUD + """, c AS (SELECT count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 0) AS tn, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn FROM jud)
SELECT tp + tn + fp + fn AS n, round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6)::DOUBLE AS accuracy, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision_positive, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall_positive, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1_positive,
  round(coalesce(tn * 1.0 / nullif(tn + fn, 0), 0), 6)::DOUBLE AS precision_negative, round(coalesce(tn * 1.0 / nullif(tn + fp, 0), 0), 6)::DOUBLE AS recall_negative, round(coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0), 6)::DOUBLE AS f1_negative FROM c""")
def both_classes(spark, sf):
    out = A.both_classes(judged(spark, sf), F.col("truth") == 1, F.col("pred") == 1)
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


VOTES = "WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem), c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT l_orderkey, max(n) AS m, sum(n) AS k FROM c GROUP BY 1)"


@query("pass_agreement", VOTES + " SELECT count(*) AS turns, round(avg(m / k), 6) AS mean_agreement FROM t WHERE k > 1")
def pass_agreement(spark, sf):
    return A.pass_agreement(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["l_linenumber"]).select("turns", F.round("mean_agreement", 6).alias("mean_agreement"))


@query("agreement_counts", """SELECT o_custkey, count(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END) AS judged, count(*) FILTER (o_orderkey % 3 > 0 AND o_orderstatus = CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'O' END) AS agree, bool_or(o_custkey % 2 = 0) AS verdict_matches FROM orders GROUP BY 1""")
def agreement_counts(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("judge_label"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O").alias("pred"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("positive").alias("judge_label"), F.when(F.col("c_custkey") % 2 == 0, "positive").alias("verdict"))
    return A.agreement_counts(o, v, ["o_custkey"])


@query("confidence_by_level", "WITH " + LAB + " SELECT confidence, count(*) AS n, round(avg(1.0 / (1 + turn)), 6) AS mean, round(avg((1.0 / (1 + turn) < 0.3)::INT), 6) AS low_share FROM lab GROUP BY 1")
def confidence_by_level(spark, sf):
    out = A.confidence_by(labelled(spark, sf).withColumn("asr", 1.0 / (1 + F.col("turn"))), "confidence", "asr", 0.3)
    return out.select("confidence", "n", F.round("mean", 6).alias("mean"), F.round("low_share", 6).alias("low_share"))


@query("prediction_counts", "WITH " + LAB + """, c AS (SELECT episode, speaker_id, label, count(*) AS n, sum(n_words) AS w FROM lab GROUP BY 1, 2, 3)
SELECT episode, speaker_id, sum(n)::BIGINT AS n_turns, sum(w)::BIGINT AS n_words, round(sum(CASE WHEN label <> 'neutral' THEN n ELSE 0 END) / sum(n), 6) AS polar_share, string_agg(label || '=' || n, ',' ORDER BY label) AS pred_counts, sum(n) < 3 AS thin FROM c GROUP BY 1, 2""")
def prediction_counts(spark, sf):
    out = A.prediction_records(labelled(spark, sf).withColumn("pred", F.col("label")), ["episode", "speaker_id"])
    counts = F.array_join(F.transform(F.map_entries("pred_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("pred_counts", counts).withColumn("polar_share", F.round("polar_share", 6))


@query("quartile_f1", """
WITH c AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents JOIN labels USING (doc_id)), b AS (SELECT (n_chars > q[1])::BIGINT + (n_chars > q[2])::BIGINT + (n_chars > q[3])::BIGINT AS band, quality AS t, 1 - toxic AS p FROM documents JOIN labels USING (doc_id), c),
f AS (SELECT band, l, 2.0 * count(*) FILTER (t = l AND p = l) / nullif(count(*) FILTER (t = l) + count(*) FILTER (p = l), 0) AS f FROM b, (SELECT unnest([0, 1]) AS l) GROUP BY 1, 2)
SELECT f.band, any_value(n) AS units, any_value(a) AS accuracy, round(avg(f), 6)::DOUBLE AS macro_f1 FROM f JOIN (SELECT band, count(*) AS n, round(avg((t = p)::INT), 6) AS a FROM b GROUP BY 1) x ON x.band = f.band WHERE f IS NOT NULL GROUP BY 1""")
def quartile_f1(spark, sf):
    out = A.scores(A.value_bands(judged(spark, sf), "n_chars", 4), [0, 1], ["band"])
    return out.select("band", "units", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("length_quartiles", "SELECT " + ", ".join(f"round(quantile_cont(n_chars, {p / 100}), 4) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", max(n_chars) AS longest, round(avg((n_chars > 512)::INT), 6) AS over_cap FROM documents")
def length_quartiles(spark, sf):
    docs = table(spark, sf, "documents")
    found = zip((50, 75, 90, 95, 99), quantiles(docs, "n_chars", [p / 100 for p in (50, 75, 90, 95, 99)]), strict=True)
    over = docs.agg(F.max("n_chars").alias("longest"), F.round(F.avg((F.col("n_chars") > 512).cast("double")), 6).alias("over_cap"))
    return over.select(*[F.round(F.lit(x).cast("double"), 4).alias(f"p{p}") for p, x in found], "longest", "over_cap")


@query("examples_by_confidence", "WITH " + JUD + """, r AS (SELECT doc_id, truth = pred AS correct, row_number() OVER (PARTITION BY truth = pred ORDER BY 1.0 / (1 + n_chars % 97) DESC, doc_id) AS rank FROM jud) SELECT doc_id, correct, rank FROM r WHERE rank <= 8""")
def examples_by_confidence(spark, sf):
    """The surest right and wrong predictions, eight of each."""
    rows = judged(spark, sf).withColumn("p", 1.0 / (1 + F.col("n_chars") % 97)).withColumn("correct", F.col("truth") == F.col("pred"))
    rank = F.row_number().over(Window.partitionBy("correct").orderBy(F.col("p").desc(), "doc_id")).cast("long")
    return rows.withColumn("rank", rank).filter("rank <= 8").select("doc_id", "correct", "rank")


@query("diarization_error")
def diarization_error(spark, sf):
    """Segments against the utterances that they were cut from, speakers renamed; tests compare with a table by hand."""
    ref = utterances(spark, sf).select("episode", F.col("start_ds").cast("double").alias("start"), F.col("end_ds").cast("double").alias("end"), F.col("speaker_id").alias("label"))
    hyp = segments(spark, sf).select("episode", F.col("start_ds").cast("double").alias("start"), F.col("end_ds").cast("double").alias("end"), (10 - F.col("speaker_id")).alias("label"))
    out = A.diarization_error(ref, hyp)
    return out.select("episode", *[F.round(c, 6).alias(c) for c in ("total", "missed", "false_alarm", "confusion", "error")])


@query("diarization_collars", "WITH " + UTT + "," + WORDS + """,
j AS (SELECT u.episode, u.end_ds - u.start_ds AS len, u.end_ds - g.end_ds AS gone, c.collar FROM utt u JOIN seg g ON g.episode = u.episode AND g.turn = u.turn, (SELECT unnest([0.0, 2.5])::DOUBLE AS collar) c WHERE u.end_ds > u.start_ds),
s AS (SELECT episode, collar, sum(greatest(len - collar, 0)) AS total, sum(CASE WHEN gone > 0 THEN greatest(gone - collar / 2, 0) ELSE 0 END) AS missed FROM j GROUP BY 1, 2)
SELECT episode, collar, round(total, 6) AS total, round(missed, 6) AS missed, 0.0 AS false_alarm, 0.0 AS confusion, round(CASE WHEN total > 0 THEN missed / total ELSE 0 END, 6) AS error FROM s""")
def diarization_collars(spark, sf):
    """With no collar and with a quarter of a second: what is cut off each utterance is missed but for half a collar at its end, and speakers are only renamed."""
    ref = utterances(spark, sf).select("episode", F.col("start_ds").cast("double").alias("start"), F.col("end_ds").cast("double").alias("end"), F.col("speaker_id").alias("label"))
    hyp = segments(spark, sf).select("episode", F.col("start_ds").cast("double").alias("start"), F.col("end_ds").cast("double").alias("end"), (10 - F.col("speaker_id")).alias("label"))
    return A.diarization_errors(ref, hyp, (0.0, 2.5)).select("episode", "collar", *[F.round(c, 6).alias(c) for c in ("total", "missed", "false_alarm", "confusion", "error")])


@query("dropped_rows", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS joined, count(*) FILTER (l.doc_id IS NULL) AS dropped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def dropped_rows(spark, sf):
    inner, dropped = A.with_dropped(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])
    return inner.agg(F.count("*").alias("joined")).crossJoin(dropped)  # a row each


# Splits and samples.

MD5 = "md5({}::VARCHAR)"


def _md5(column):
    return F.md5(F.col(column).cast("string").cast("binary"))


@query("split_concat", "SELECT 'train' AS split, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'test', count(*) FROM documents WHERE lang = 'fr'")
def split_concat(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.tagged({"train": d.filter("lang = 'en'"), "test": d.filter("lang = 'fr'")}).groupBy("split").agg(F.count("*").alias("n"))


@query("three_way_split", """
WITH g AS (SELECT DISTINCT source FROM documents), a AS (SELECT source, row_number() OVER (ORDER BY md5(source), source) AS r, count(*) OVER () AS n FROM g), h AS (SELECT source FROM a WHERE r <= greatest(1, least(n - 1, round_even(0.4 * n, 0)))),
b AS (SELECT source, row_number() OVER (ORDER BY md5(source || 'x'), source) AS r, count(*) OVER () AS n FROM h)
SELECT d.doc_id, CASE WHEN b.source IS NULL THEN 'train' WHEN r <= greatest(1, least(n - 1, round_even(0.5 * n, 0))) THEN 'private' ELSE 'public' END AS split FROM documents d LEFT JOIN b ON b.source = d.source""")
def three_way_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return S.three_way(d, "source", (_md5("source"), F.md5(F.concat("source", F.lit("x")).cast("binary")))).select("doc_id", "split")


@query("counted_split", "WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source), source) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN r <= 4 THEN 'test' WHEN r <= 7 THEN 'val' ELSE 'train' END AS split FROM documents d JOIN g ON g.source = d.source")
def counted_split(spark, sf):
    return S.by_counts(table(spark, sf, "documents").select("doc_id", "source"), "source", _md5("source"), 4, 3).select("doc_id", "split")


@query("disjoint_split", "WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN r <= greatest(1, round_even(0.2 * n, 0)) THEN 'test' ELSE 'train' END AS split FROM documents d JOIN g ON g.source = d.source")
def disjoint_split(spark, sf):
    return S.disjoint_or_stratified(table(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "lang", 0.2, _md5("source"), _md5("doc_id")).select("doc_id", "split")


@query("stratified_split", """WITH e AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE source = 'src1')
SELECT doc_id, CASE WHEN r <= greatest(1, round_even(0.2 * n, 0)) THEN 'test' ELSE 'train' END AS split FROM e""")
def stratified_split(spark, sf):
    """One group alone can't be divided by groups, so that it is divided inside its labels."""
    d = table(spark, sf, "documents").filter("source = 'src1'").select("doc_id", "source", "lang")
    return S.disjoint_or_stratified(d, "source", "lang", 0.2, _md5("source"), F.struct(_md5("doc_id"), F.col("doc_id"))).select("doc_id", "split")


@query("balanced_sample", """
WITH m AS (SELECT quantile_cont(n_chars, 0.5) AS h FROM documents), v AS (SELECT doc_id, lang, coalesce(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END, (SELECT quantile_cont(n_chars, 0.5) FROM documents WHERE doc_id % 11 <> 0))::DOUBLE AS v FROM documents),
q AS (SELECT quantile_cont(v, [1.0 / 3, 2.0 / 3]) AS q FROM v), b AS (SELECT doc_id, lang, (v > q[1])::INT + (v > q[2])::INT AS band FROM v, q),
n AS (SELECT greatest(1, floor(60 / (count(DISTINCT lang) * count(DISTINCT band)))) AS c FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY lang, band ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM b)
SELECT doc_id FROM r, n WHERE r <= c ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 60""")
def balanced_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("conf"), F.lit("secret").alias("label"))
    out = S.balanced_sample(d, "lang", "conf", 60, F.struct(_md5("doc_id"), F.col("doc_id")), ["label", "lang"])
    return out.select("doc_id")
