"""Interval, as-of, outer, semi and anti joins; deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import checks as C
from lectern.operators import intervals as I
from lectern.plans.base import query
from lectern.plans.catalog import AIR, UTT, WORDS, airings, segments, table, utterances, words

W = "WITH " + UTT + "," + WORDS
ASSIGN = W + """,
c AS (SELECT w.episode, w.turn, w.idx, w.word, s.speaker_id AS sp, 2 * s.start_ds <= w.start_ds + w.end_ds AND w.start_ds + w.end_ds < 2 * s.end_ds AS inn,
  least(w.end_ds, s.end_ds) - greatest(w.start_ds, s.start_ds) AS lap, s.start_ds AS ss FROM word w JOIN seg s ON s.episode = w.episode AND s.start_ds <= w.end_ds AND w.start_ds <= s.end_ds),
r AS (SELECT *, row_number() OVER (PARTITION BY episode, turn, idx ORDER BY inn DESC, CASE WHEN inn THEN 0 ELSE -lap END, ss, sp) AS n FROM c WHERE inn OR lap > 0)
"""


@query("assign_midpoint", ASSIGN + """
SELECT w.episode, w.turn, w.idx, w.word, coalesce(r.sp, -1) AS speaker_id, CASE WHEN r.n IS NULL THEN 'unassigned' WHEN r.inn THEN 'midpoint' ELSE 'max_overlap' END AS method
FROM word w LEFT JOIN r ON r.episode = w.episode AND r.turn = w.turn AND r.idx = w.idx AND r.n = 1""")
def assign_midpoint(spark, sf):
    return I.assign_words(words(spark, sf), segments(spark, sf)).withColumn("idx", F.col("idx").cast("long"))


BEST = W + """,
c AS (SELECT u.episode, u.turn, u.speaker_id, s.turn AS s_turn, s.speaker_id AS s_speaker, least(u.end_ds + 9, s.end_ds) - greatest(u.start_ds + 9, s.start_ds) AS lap, s.start_ds AS ss FROM utt u JOIN seg s ON s.episode = u.episode),
b AS (SELECT * FROM c WHERE lap > 0 QUALIFY row_number() OVER (PARTITION BY episode, turn ORDER BY lap DESC, ss, s_turn) = 1)
"""


def _matched(spark, sf):
    left = utterances(spark, sf).select("episode", "turn", "speaker_id", (F.col("start_ds") + 9).alias("start"), (F.col("end_ds") + 9).alias("end"))
    right = segments(spark, sf).select("episode", F.col("turn").alias("r_key"), F.col("speaker_id").alias("r_speaker"), F.col("start_ds").alias("r_start"), F.col("end_ds").alias("r_end"))
    return I.best_match(left, right, ["turn"], 300)


@query("best_time_match", BEST + "SELECT episode, turn, s_turn AS matched_turn, lap AS overlap FROM b")
def best_time_match(spark, sf):
    return _matched(spark, sf).select("episode", "turn", F.col("r_key").alias("matched_turn"), "overlap")


@query("attribution_accuracy", BEST + "SELECT count(*) AS matched, count(*) FILTER (speaker_id = s_speaker) AS correct, round(avg((speaker_id = s_speaker)::INT), 6) AS accuracy FROM b")
def attribution_accuracy(spark, sf):
    same = F.col("speaker_id") == F.col("r_speaker")
    return _matched(spark, sf).agg(F.count("*").alias("matched"), F.count_if(same).alias("correct"), F.round(F.avg(same.cast("double")), 6).alias("accuracy"))


@query("overlap_weighted_conf", W + """
SELECT u.episode, u.turn, round(sum((1.0 / (1 + s.turn)) * lap) / sum(lap), 6) AS confidence
FROM utt u LEFT JOIN LATERAL (SELECT s.turn, least(u.end_ds + 9, s.end_ds) - greatest(u.start_ds + 9, s.start_ds) AS lap FROM seg s WHERE s.episode = u.episode) s ON lap > 0 GROUP BY 1, 2""")
def overlap_weighted_conf(spark, sf):
    left = utterances(spark, sf).select("episode", "turn", (F.col("start_ds") + 9).alias("start"), (F.col("end_ds") + 9).alias("end"))
    right = segments(spark, sf).select("episode", F.col("start_ds").alias("r_start"), F.col("end_ds").alias("r_end"), (1.0 / (1 + F.col("turn"))).alias("confidence"))
    return I.weighted_overlap(left, right, ["turn"], 300).select("episode", "turn", F.round("mean", 6).alias("confidence"))


@query("turn_for_window", W + """,
c AS (SELECT u.episode, u.turn, s.turn AS st, s.start_ds AS ss FROM utt u JOIN seg s ON s.episode = u.episode AND s.speaker_id = u.speaker_id AND s.start_ds - 5 <= (u.start_ds + u.end_ds) / 2.0 AND (u.start_ds + u.end_ds) / 2.0 <= s.end_ds + 5),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY episode, turn ORDER BY ss, st) = 1)
SELECT u.episode, u.turn, b.st AS containing_turn FROM utt u LEFT JOIN b ON b.episode = u.episode AND b.turn = u.turn""")
def turn_for_window(spark, sf):
    left = utterances(spark, sf).select("episode", "turn", "speaker_id", F.col("start_ds").alias("start"), F.col("end_ds").alias("end"))
    right = segments(spark, sf).select("episode", "speaker_id", F.col("turn").alias("r_key"), F.col("start_ds").alias("r_start"), F.col("end_ds").alias("r_end"))
    return I.containing(left, right, ["turn"], 5, 300).select("episode", "turn", F.col("r_key").alias("containing_turn"))


@query("asof_backward", "WITH " + UTT + """
SELECT a.episode, a.turn, (SELECT arg_max(b.turn, b.end_ds * 100000 + b.turn) FROM utt b WHERE b.episode = a.episode AND b.speaker_id <> a.speaker_id AND b.end_ds <= a.start_ds) AS reply_to FROM utt a""")
def asof_backward(spark, sf):
    rows = utterances(spark, sf).select("episode", "turn", "speaker_id", F.col("start_ds").alias("start"), F.col("end_ds").alias("end"))
    return I.as_of_backward(rows, 0).select("episode", "turn", F.col("p_turn").alias("reply_to"))


@query("nearest_boundary", W + """,
c AS (SELECT w.episode, w.turn, w.idx, s.speaker_id AS sp, least(abs(w.start_ds + w.end_ds - 2 * s.start_ds), abs(w.start_ds + w.end_ds - 2 * s.end_ds)) AS d,
  2 * s.start_ds <= w.start_ds + w.end_ds AND w.start_ds + w.end_ds <= 2 * s.end_ds AS inn, s.start_ds AS ss FROM word w JOIN seg s ON s.episode = w.episode)
SELECT episode, turn, idx, sp AS speaker_id FROM c QUALIFY row_number() OVER (PARTITION BY episode, turn, idx ORDER BY inn DESC, CASE WHEN inn THEN 0 ELSE d END, ss, sp) = 1""")
def nearest_boundary(spark, sf):
    """Each word's segment, else the one whose end is nearest; times are doubled, so that middles are whole numbers."""
    s = segments(spark, sf).select("episode", "speaker_id", (2 * F.col("start_ds")).alias("r_start"), (2 * F.col("end_ds")).alias("r_end"))
    w = words(spark, sf).select("episode", "turn", F.col("idx").cast("long").alias("idx"), (F.col("start_ds") + F.col("end_ds")).alias("at"))
    return I.nearest_segment(w, s, ["turn", "idx"], 600)


@query("unambiguous_match", """
WITH p AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 1),
n AS (SELECT *, count(*) OVER (PARTITION BY c_custkey) AS a, count(*) OVER (PARTITION BY s_suppkey) AS b FROM p)
SELECT c_custkey, s_suppkey FROM n WHERE a = 1 AND b = 1""")
def unambiguous_match(spark, sf):
    """Pairs within one unit of each other that are unique on both sides; money is dealt to buckets as time is."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("start"), F.col("c_acctbal").alias("end"), F.col("c_acctbal").alias("a"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 2).alias("r_start"), (F.col("s_acctbal") + 2).alias("r_end"), F.col("s_acctbal").alias("b"))
    p = I.touching(c, s, ["nation"], 50).filter(F.abs(F.col("a") - F.col("b")) <= 1)
    one = F.count("*").over(Window.partitionBy("c_custkey")) + F.count("*").over(Window.partitionBy("s_suppkey"))
    return p.withColumn("n", one).filter("n = 2").select("c_custkey", "s_suppkey")


@query("annotator_alignment", """
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.toxic::VARCHAR, '__NONE__') AS a, coalesce(d.lang, '__MISSING__') AS b FROM labels l FULL OUTER JOIN documents d ON d.doc_id = l.doc_id""")
def annotator_alignment(spark, sf):
    a, b = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("a")), table(spark, sf, "documents").select("doc_id", F.col("lang").alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("a", F.lit("__NONE__")).alias("a"), F.coalesce("b", F.lit("__MISSING__")).alias("b"))


@query("metadata_lookup", "SELECT s_suppkey, n_name, coalesce(r_name, 'unknown') AS r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def metadata_lookup(spark, sf):
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    out = s.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return out.select("s_suppkey", "n_name", F.coalesce("r_name", F.lit("unknown")).alias("r_name"))


@query("transcript_dedup", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS kept_id FROM documents QUALIFY doc_id <> kept_id")
def transcript_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("kept_id"))
    return d.join(first, "h").filter("doc_id != kept_id").select("doc_id", "kept_id")


@query("missing_outputs", "SELECT DISTINCT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_outputs(spark, sf):
    return C.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("labelled_in_index", "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents")
def labelled_in_index(spark, sf):
    return table(spark, sf, "labels").select("doc_id").intersect(table(spark, sf, "documents").select("doc_id"))


@query("reproducibility_check", """
SELECT count(*) AS n, count(*) FILTER (o_totalprice IS NOT NULL) AS matched, (count(*) = count(DISTINCT (l_orderkey, l_linenumber))) AS unique_keys FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def reproducibility_check(spark, sf):
    lines, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    n = lines.count()
    j = C.dealt(lines, "l_orderkey", n).join(C.dealt(orders, "o_orderkey", n), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    keys = j.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count("o_totalprice").alias("m"))
    return keys.agg(F.sum("n").alias("n"), F.sum("m").alias("matched"), (F.sum("n") == F.count("*")).alias("unique_keys"))


@query("split_leakage", """
SELECT c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 2 INTERSECT SELECT c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey >= 2""")
def split_leakage(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.filter("n_regionkey < 2").select("c_mktsegment").intersect(c.filter("n_regionkey >= 2").select("c_mktsegment"))


@query("evidence_containment", """
WITH e AS (SELECT d.doc_id, l.doc_id AS ld, split_part(trim(d.text), ' ', 1) AS q, d.text FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
SELECT CASE WHEN text IS NULL THEN 'missing' WHEN contains(text, q) THEN 'found' ELSE 'miss' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def evidence_containment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = table(spark, sf, "labels").select("doc_id").join(d, "doc_id", "left").withColumn("q", F.split_part(F.trim("text"), F.lit(" "), F.lit(1)))
    return e.groupBy(F.when(F.col("text").isNull(), "missing").when(F.contains("text", "q"), "found").otherwise("miss").alias("outcome")).agg(F.count("*").alias("n"))


@query("segment_overlaps", "WITH " + AIR + """
SELECT a.event_id, b.event_id AS other_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms
FROM air a JOIN air b ON a.episode = b.episode AND a.event_id < b.event_id AND a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms""")
def segment_overlaps(spark, sf):
    a = airings(spark, sf).select("event_id", "episode", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    b = airings(spark, sf).select(F.col("event_id").alias("other_id"), "episode", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return I.touching(a, b, ["episode"], 600_000).filter("event_id < other_id").select("event_id", "other_id", I.shared("start", "end", "r_start", "r_end").alias("overlap_ms"))


@query("missing_by_status", "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def missing_by_status(spark, sf):
    """Customers without an output of one kind: some have it, some have others alone."""
    have = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return C.missing(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), have, ["key"])


@query("unambiguous_lengths", """
WITH e AS (SELECT event_id, user_id, floor(abs(coalesce(value, 0)))::BIGINT AS v FROM events), p AS (SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(a.v - b.v) <= 1),
n AS (SELECT *, count(*) OVER (PARTITION BY a) AS x, count(*) OVER (PARTITION BY b) AS y FROM p) SELECT a, b FROM n WHERE x = 1 AND y = 1""")
def unambiguous_lengths(spark, sf):
    """Even and odd events of a user whose lengths match each other's alone, in either direction."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).alias("v"))
    left = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("a"), "user_id", (F.col("v") - 1).alias("start"), (F.col("v") + 1).alias("end"))
    right = e.filter("event_id % 2 = 1").select(F.col("event_id").alias("b"), "user_id", F.col("v").alias("r_start"), F.col("v").alias("r_end"))
    p = I.touching(left, right, ["user_id"], 10)
    one = F.count("*").over(Window.partitionBy("a")) + F.count("*").over(Window.partitionBy("b"))
    return p.withColumn("n", one).filter("n = 2").select("a", "b")
