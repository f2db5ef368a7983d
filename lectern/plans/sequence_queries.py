"""Windows and sequences: turns, utterances, segments, chunks, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import sequences as Q
from lectern.plans.base import query
from lectern.plans.catalog import AIR, UTT, WORDS, airings, table, utterances, words


@query("prev_next_context", "WITH " + UTT + "SELECT episode, turn, coalesce(lag(text) OVER w, '') AS previous_text, coalesce(lead(text) OVER w, '') AS next_text FROM utt WINDOW w AS (PARTITION BY episode ORDER BY turn)")
def prev_next_context(spark, sf):
    return Q.neighbours(utterances(spark, sf)).select("episode", "turn", "previous_text", "next_text")


@query("numbered_ids", "WITH " + UTT + "SELECT episode, turn, episode || '_utt' || printf('%05d', row_number() OVER (PARTITION BY episode ORDER BY turn) - 1) AS number_id FROM utt")
def numbered_ids(spark, sf):
    return Q.numbered(utterances(spark, sf), "utt", 5).select("episode", "turn", "number_id")


@query("merge_turns", "WITH " + UTT + """,
f AS (SELECT *, CASE WHEN lag(speaker_id) OVER w IS NULL OR lag(speaker_id) OVER w <> speaker_id OR start_ds - lag(end_ds) OVER w > 20 THEN 1 ELSE 0 END AS f FROM utt WINDOW w AS (PARTITION BY episode ORDER BY start_ds, turn)),
g AS (SELECT *, sum(f) OVER (PARTITION BY episode ORDER BY start_ds, turn ROWS UNBOUNDED PRECEDING) - 1 AS turn_index FROM f)
SELECT episode, turn_index::BIGINT AS turn_index, any_value(speaker_id) AS speaker_id, min(start_ds) AS start, max(end_ds) AS end, count(*) AS n_windows, sum(n_words)::BIGINT AS n_words FROM g GROUP BY episode, turn_index""")
def merge_turns(spark, sf):
    rows = utterances(spark, sf).withColumn("start", F.col("start_ds")).withColumn("end", F.col("end_ds"))
    return Q.merge_turns(rows, 20)


@query("utterance_segmentation", "WITH RECURSIVE " + UTT + "," + WORDS + """,
n AS (SELECT w.episode, u.speaker_id AS sp, w.start_ds AS s, w.end_ds AS e, right(w.word, 1) IN ('।', '!', '?', '؟') AS z, row_number() OVER (PARTITION BY w.episode ORDER BY w.start_ds, w.end_ds, w.turn, w.idx) AS k FROM word w JOIN utt u ON u.episode = w.episode AND u.turn = w.turn),
r AS (SELECT episode, k, sp, s AS us, e AS pe, z, 0::BIGINT AS ui FROM n WHERE k = 1 UNION ALL
  SELECT episode, k, sp, CASE WHEN f THEN s ELSE us END, e, z, ui + f::BIGINT FROM (SELECT n.*, r.us, r.ui, (n.sp <> r.sp OR n.s - r.pe > 20 OR n.e - r.us > 280 OR r.z) AS f FROM r JOIN n ON n.episode = r.episode AND n.k = r.k + 1))
SELECT episode, any_value(sp) AS speaker_id, min(us) AS start, arg_max(pe, k) AS end, count(*) AS n_words, ui AS utterance_index FROM r GROUP BY episode, ui""")
def utterance_segmentation(spark, sf):
    u = utterances(spark, sf).select("episode", "turn", "speaker_id")
    w = words(spark, sf).join(u, ["episode", "turn"]).select("episode", "turn", "speaker_id", "idx", "word", F.col("start_ds").alias("start"), F.col("end_ds").alias("end"))
    return Q.segment_words(w)


@query("diar_postprocess", "WITH RECURSIVE " + AIR + """,
n AS (SELECT episode, speaker, start_ms AS s, end_ms AS e, row_number() OVER (PARTITION BY episode ORDER BY start_ms, end_ms, speaker) AS k FROM air),
r AS (SELECT episode, k, speaker, s, e, e > s AS ok, CASE WHEN e > s THEN e END AS line, CASE WHEN e > s THEN speaker END AS who FROM n WHERE k = 1 UNION ALL
  SELECT episode, k, speaker, s2, e, e > s2, CASE WHEN e > s2 THEN greatest(coalesce(line, e), e) ELSE line END, CASE WHEN e > s2 THEN speaker ELSE who END
  FROM (SELECT n.*, r.line, r.who, CASE WHEN r.line IS NOT NULL AND n.speaker <> r.who THEN greatest(n.s, r.line + 170) ELSE n.s END AS s2 FROM r JOIN n ON n.episode = r.episode AND n.k = r.k + 1)),
a AS (SELECT episode, speaker, s, e, k FROM r WHERE ok),
f AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR s - lag(e) OVER w > 3790 THEN 1 ELSE 0 END AS f FROM a WINDOW w AS (PARTITION BY episode ORDER BY s, e, speaker)),
g AS (SELECT *, sum(f) OVER (PARTITION BY episode ORDER BY s, e, speaker ROWS UNBOUNDED PRECEDING) AS run FROM f),
j AS (SELECT episode, run, any_value(speaker) AS speaker, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY 1, 2 HAVING max(e) - min(s) >= 750),
t AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY episode, speaker) AS total FROM j), l AS (SELECT * FROM t WHERE total >= 9000),
o AS (SELECT episode, speaker, row_number() OVER (PARTITION BY episode ORDER BY min(start_ms), speaker) - 1 AS speaker_no FROM l GROUP BY 1, 2)
SELECT l.episode, o.speaker_no::BIGINT AS speaker_no, start_ms, end_ms FROM l JOIN o ON o.episode = l.episode AND o.speaker = l.speaker""")
def diar_postprocess(spark, sf):
    return Q.clean_segments(airings(spark, sf).select("episode", "speaker", "start_ms", "end_ms"))


@query("first_appearance_ids", "WITH " + AIR + ", f AS (SELECT episode, speaker, min(start_ms) AS s FROM air GROUP BY 1, 2) SELECT episode, speaker, row_number() OVER (PARTITION BY episode ORDER BY s, speaker)::BIGINT - 1 AS speaker_no FROM f")
def first_appearance_ids(spark, sf):
    return Q.first_appearance(airings(spark, sf))


@query("chunk_windows", "WITH " + UTT + """,
k AS (SELECT episode, turn, start_sec, end_sec, unnest(range(ceil((end_sec - start_sec) / 28)::BIGINT)) AS chunk_index FROM utt WHERE end_sec > start_sec)
SELECT episode, turn, chunk_index, round(start_sec + 28 * chunk_index, 4) AS chunk_start, round(least(start_sec + 28 * chunk_index + 28, end_sec), 4) AS chunk_end FROM k""")
def chunk_windows(spark, sf):
    c = Q.chunk(utterances(spark, sf), 28)
    return c.select("episode", "turn", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("chunk_start", 4).alias("chunk_start"), F.round("chunk_end", 4).alias("chunk_end"))


@query("bucket_rms", """
WITH b AS (SELECT user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 8 // count(*) OVER (PARTITION BY user_id))::BIGINT AS bucket, value FROM events),
r AS (SELECT user_id, bucket, sqrt(avg(value * value)) AS rms FROM b GROUP BY 1, 2)
SELECT user_id, bucket, round(pow(rms / max(rms) OVER (PARTITION BY user_id), 0.62), 5) AS level FROM r""")
def bucket_rms(spark, sf):
    return Q.bucket_rms(table(spark, sf, "events"), 8, "user_id", ["ts", "event_id"], "value").withColumn("level", F.round("level", 5))


@query("padded_turns", "SELECT conv_id, least(count(*), 8) AS n_real, array_to_string(list(turn ORDER BY turn)[1:8], ',') AS turns FROM conversations GROUP BY conv_id")
def padded_turns(spark, sf):
    p = Q.padded_first(table(spark, sf, "conversations"), 8, ["conv_id"], "turn", "turn")
    return p.select("conv_id", "n_real", F.array_join(F.transform("padded", lambda x: x.cast("string")), ",").alias("turns"))


@query("value_islands", """
WITH h AS (SELECT user_id, ts, event_id, value > 50 AS hit, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
g AS (SELECT *, sum((hit AND NOT coalesce(was, false))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM h)
SELECT user_id, island::BIGINT AS island, count(*) AS n FROM g WHERE hit GROUP BY 1, 2""")
def value_islands(spark, sf):
    return Q.islands(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.coalesce(F.col("value") > 50, F.lit(False)))


@query("sessions", "WITH " + AIR + """,
f AS (SELECT episode, event_id, start_ms, CASE WHEN start_ms - lag(start_ms) OVER w < 1800000 THEN 0 ELSE 1 END AS f FROM air WINDOW w AS (PARTITION BY episode ORDER BY start_ms, event_id)),
g AS (SELECT *, sum(f) OVER (PARTITION BY episode ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT episode, min(start_ms) AS first_ms, max(start_ms) AS last_ms, count(*) AS n FROM g GROUP BY episode, s""")
def sessions(spark, sf):
    """Batch form of the streaming sessions: a gap of half an hour ends one."""
    w = Window.partitionBy("episode").orderBy("start_ms", "event_id")
    new = F.when(F.col("start_ms") - F.lag("start_ms").over(w) < 1_800_000, 0).otherwise(1)
    rows = airings(spark, sf).withColumn("_f", new).withColumn("_s", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("episode", "_s").agg(F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"), F.count("*").alias("n")).drop("_s")
