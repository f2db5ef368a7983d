"""Annotations made from the test tables, folds, and the baseline classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import annotations as N
from lectern.operators import models as M
from lectern.operators import splits as S
from lectern.plans.base import query
from lectern.plans.catalog import UTT, table, utterances


@query("annotation_drafts", "WITH " + UTT + "SELECT episode::VARCHAR AS episode_id, turn::VARCHAR AS utterance_id, 'non_speech' AS role_tag, 'review_required' AS annotation_status FROM utt")
def annotation_drafts(spark, sf):
    return N.drafts(_fused(spark, sf)).select("episode_id", "utterance_id", "role_tag", "annotation_status")


def _fused(spark, sf):
    u = utterances(spark, sf)
    return u.select(F.col("episode").cast("string").alias("episode_id"), F.col("turn").cast("string").alias("utterance_id"), "speaker_id", "start_sec", "end_sec", F.col("text").alias("text_verbatim"), F.col("text").alias("text_normalized"))


@query("draft_issues", "WITH " + UTT + r""",
c AS (SELECT unnest([CASE WHEN trim(text) = '' THEN 'EMPTY_TRANSCRIPT' END, CASE WHEN nfc_normalize(text) <> text THEN 'NOT_NFC' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'DIGIT_NOT_WORD' END, CASE WHEN speaker_id < 0 THEN 'BAD_SPEAKER' END,
  'ROLE_REVIEW_UNRESOLVED', CASE WHEN end_sec <= start_sec THEN 'BAD_TIME' END, 'UNRESOLVED_REVIEW', 'NOT_HUMAN_VERIFIED']) AS code FROM utt)
SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code""")
def draft_issues(spark, sf):
    return N.issues(N.drafts(_fused(spark, sf))).groupBy("code").agg(F.count("*").alias("n"))


@query("noun_recovery", "WITH " + UTT + """,
p AS (SELECT lower(text) AS h, lower(coalesce(lag(text) OVER (PARTITION BY episode ORDER BY turn), '')) AS r FROM utt),
e AS (SELECT unnest(['the', 'une', 'der']) AS n, unnest(['MARKET', 'SECTOR', 'SECTOR']) AS t)
SELECT t AS target_type, count(*) AS support, round(avg(contains(h, n)::INT), 6) AS recall FROM p, e WHERE contains(r, n) GROUP BY t""")
def noun_recovery(spark, sf):
    from pyspark.sql import Window

    u = utterances(spark, sf)
    pairs = u.select(F.lag("text", 1, "").over(Window.partitionBy("episode").orderBy("turn")).alias("reference"), F.col("text").alias("hypothesis"))
    return N.noun_recovery(pairs, [("the", "MARKET"), ("une", "SECTOR"), ("der", "SECTOR")]).withColumn("recall", F.round("recall", 6))


@query("label_tier", "SELECT doc_id::VARCHAR AS episode_id, CASE WHEN l.doc_id IS NOT NULL THEN 'gold' ELSE 'weak' END AS label_tier FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def label_tier(spark, sf):
    weak = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("episode_id"))
    gold = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("episode_id"))
    return N.tier(gold, weak).select("episode_id", "label_tier")


@query("group_folds", """
WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS k FROM documents GROUP BY 1),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS l, NULL::VARCHAR AS source, NULL::BIGINT AS n, NULL::BIGINT AS fold UNION ALL
  SELECT g.k, list_transform(range(1, 6), lambda i: l[i] + CASE WHEN i = list_position(l, list_min(l)) THEN g.n ELSE 0 END), g.source, g.n, list_position(l, list_min(l)) - 1 FROM r JOIN g ON g.k = r.k + 1)
SELECT fold, sum(n)::BIGINT AS n, count(*) AS sources FROM r WHERE k > 0 GROUP BY fold""")
def group_folds(spark, sf):
    return S.group_folds(table(spark, sf, "documents").select("doc_id", "source"), "source").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("tfidf_baseline")
def tfidf_baseline(spark, sf):
    """Quality of held-out documents by words and pairs of words."""
    rows = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = M.tfidf_classifier(rows.filter(~held), "text", "label", 2)
    out = model.transform(rows.filter(held).withColumn("class_weight", F.lit(1.0)))
    return out.select("doc_id", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))


@query("valid_label_tier", "WITH " + UTT + r""",
b AS (SELECT episode, bool_or(episode % 4 = 0 OR trim(text) = '' OR nfc_normalize(text) <> text OR regexp_matches(text, '[0-9]') OR speaker_id < 0 OR end_sec <= start_sec OR (turn = 3 AND episode % 5 = 0)) AS bad FROM utt GROUP BY 1)
SELECT episode::VARCHAR AS episode_id, CASE WHEN bad THEN 'weak' ELSE 'gold' END AS label_tier FROM b WHERE NOT bad OR episode % 3 <> 0""")
def valid_label_tier(spark, sf):
    """Annotated episodes, some of them no gold, with faults of their texts, and some with a turn that is still to be reviewed; weak labels for two thirds."""
    open_ = (F.col("utterance_id") == "3") & (F.col("episode_id").cast("long") % 5 == 0)
    rows = N.drafts(_fused(spark, sf)).withColumn("role_tag", F.lit("host")).withColumn("role_review_required", F.lit(False)).withColumn("human_verified", F.lit(True))
    rows = rows.withColumn("annotation_status", F.when(open_, "review_required").otherwise("non_evaluative")).withColumn("is_gold_tier", F.col("episode_id").cast("long") % 4 != 0)
    weak = rows.filter(F.col("episode_id").cast("long") % 3 != 0)
    return N.episode_tiers(rows, weak).select("episode_id", "label_tier")
