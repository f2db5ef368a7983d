"""The test tables as entities of this engine: utterances, words, segments, documents.

Times of conversations are made from their words, four tenths of a second each; they are counted in
tenths as whole numbers, so that every engine gets the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.functions.text import tokens, word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, turn, speaker_id (user 0, assistant 1, else -1), role, text, n_words, start_ds, end_ds, start_sec, end_sec."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode"), "turn", F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(-1).cast("long").alias("speaker_id"), "role", F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("n_words", word_count(F.col("text")))
    before = F.sum("n_words").over(Window.partitionBy("episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start_ds", F.coalesce(before, F.lit(0)) * 4).withColumn("end_ds", F.col("start_ds") + 4 * F.col("n_words"))
    return rows.withColumn("start_sec", F.col("start_ds") / 10).withColumn("end_sec", F.col("end_ds") / 10)


#: The same for DuckDB: table expression utt.
UTT = r"""
u0 AS (SELECT conv_id AS episode, turn, (CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END)::BIGINT AS speaker_id, role, coalesce(text, '') AS text,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::BIGINT AS n_words FROM conversations),
u1 AS (SELECT *, (coalesce(sum(n_words) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4)::BIGINT AS start_ds FROM u0),
utt AS (SELECT *, start_ds + 4 * n_words AS end_ds, start_ds / 10.0 AS start_sec, (start_ds + 4 * n_words) / 10.0 AS end_sec FROM u1)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, turn, idx, word, start_ds, end_ds: each word, three tenths late."""
    u = utterances(spark, sf_dir).select("episode", "turn", "start_ds", F.posexplode(tokens(F.col("text"))).alias("idx", "word"))
    return u.select("episode", "turn", "idx", "word", (F.col("start_ds") + 4 * F.col("idx") + 3).alias("start_ds"), (F.col("start_ds") + 4 * F.col("idx") + 7).alias("end_ds"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, turn, speaker_id, start_ds, end_ds: utterances that end a fifth of their words early."""
    u = utterances(spark, sf_dir)
    return u.select("episode", "turn", "speaker_id", "start_ds", (F.col("end_ds") - 4 * F.floor(F.col("n_words") / 5)).alias("end_ds"))


WORDS = r"""
w0 AS (SELECT episode, turn, start_ds AS s, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM utt),
w1 AS (SELECT episode, turn, s, unnest(ws) AS word, unnest(range(len(ws))) AS idx FROM w0),
word AS (SELECT episode, turn, idx, word, s + 4 * idx + 3 AS start_ds, s + 4 * idx + 7 AS end_ds FROM w1),
seg AS (SELECT episode, turn, speaker_id, start_ds, end_ds - 4 * (n_words // 5) AS end_ds FROM utt)"""


def airings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals: event_id, episode (user_id), speaker (event_type), start_ms, end_ms."""
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 1000")
    length = F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 1000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("episode"), F.col("event_type").alias("speaker"), ms.alias("start_ms"), (ms + length).alias("end_ms"), "value")


AIR = """
air AS (SELECT event_id, user_id AS episode, event_type AS speaker, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(abs(coalesce(value, 0.0)) * 1000)::BIGINT AS end_ms, value FROM events)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as two annotators: doc_id, truth (quality), pred (1 - toxic), with the document's lang, source and words."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred")).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


JUD = """
jud AS (SELECT l.doc_id, quality AS truth, 1 - toxic AS pred, lang, source, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
