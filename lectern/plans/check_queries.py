"""Validators, gates, samples, lexicons and experiments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import checks as C
from lectern.operators import experiments as X
from lectern.operators import lexicon as L
from lectern.plans.base import query
from lectern.plans.catalog import JUD, UTT, judged, table, utterances
from lectern.session import shared_folder
from lectern.sources import publishing

# Small lexicons over the words of the test tables, in the shape of the real ones.
ALIASES = [("the", "THE"), ("of", "OF"), ("une", "UNE")]
TARGETS = [
    {"canonical": "la", "stems": ["la"], "exclude": [], "orientation": 0},
    {"canonical": "al", "stems": ["al", "de la"], "exclude": ["ale"], "orientation": -1},
]
CUES = [
    {"stem": "en", "kind": "direction", "polarity": 1, "weight": 1.0, "negatable": True, "exclude": []},
    {"stem": "en", "kind": "evaluative", "polarity": -1, "weight": 1.0, "negatable": True, "exclude": []},
    {"stem": "an", "kind": "evaluative", "polarity": -1, "weight": 1.0, "negatable": True, "exclude": []},
]


@query("entity_restore", r"""
SELECT conv_id, turn, coalesce(array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), lambda x: CASE lower(x) WHEN 'the' THEN 'THE' WHEN 'of' THEN 'OF' WHEN 'une' THEN 'UNE' ELSE x END), ''), '') AS restored
FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def entity_restore(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", L.restore_entities(F.coalesce("text", F.lit("")), ALIASES).alias("restored"))


LEXICON = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
f AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nx, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS bf FROM e),
m AS (SELECT doc_id, 'al' AS target, i FROM f WHERE w = 'de' AND nx LIKE 'la%'
  UNION ALL SELECT doc_id, 'al', i FROM f WHERE w LIKE 'al%' AND w NOT LIKE 'ale%'
  UNION ALL SELECT doc_id, 'la', i FROM f WHERE w LIKE 'la%' AND bf IS DISTINCT FROM 'de'),
c AS (SELECT doc_id, i, CASE WHEN w LIKE 'en%' THEN 1 END AS up, CASE WHEN w LIKE 'en%' OR w LIKE 'an%' THEN -1 END AS bad FROM f WHERE w LIKE 'en%' OR w LIKE 'an%'),
d AS (SELECT c.doc_id, target, c.i, min(abs(c.i - m.i)) AS far, any_value(CASE WHEN target = 'al' THEN coalesce(-c.up, c.bad) ELSE c.bad END) AS v FROM c JOIN m ON m.doc_id = c.doc_id AND abs(c.i - m.i) <= 12 GROUP BY 1, 2, 3),
s AS (SELECT doc_id, target, sum(v / (1 + far / 4.0)) AS x FROM d GROUP BY 1, 2), n AS (SELECT doc_id, target, count(*) AS k FROM m GROUP BY 1, 2)
SELECT n.doc_id, n.target, k AS n_mentions, round(coalesce(x, 0.0), 6)::DOUBLE AS score, CASE WHEN coalesce(x, 0) >= 0.55 THEN 'positive' WHEN coalesce(x, 0) <= -0.55 THEN 'negative' ELSE 'non_evaluative' END AS verdict
FROM n LEFT JOIN s ON s.doc_id = n.doc_id AND s.target = n.target"""


@query("lexicon_score", LEXICON)
def lexicon_score(spark, sf):
    """A phrase that claims the word inside it, an exclusion, a target without orientation, and a direction that is then passed over for the next cue."""
    pairs = L.target_pairs(table(spark, sf, "documents"), "doc_id", "text", TARGETS, CUES)
    return pairs.withColumn("score", F.round("score", 6))


@query("validate_rows", """
SELECT doc_id, unnest(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'EMPTY_TRANSCRIPT' END, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'DIGIT_NOT_WORD' END,
  CASE WHEN coalesce(n_chars, 0) <= 50 THEN 'BAD_TIME' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'BAD_ROLE' END], lambda x: x IS NOT NULL)) AS code FROM documents""")
def validate_rows(spark, sf):
    t = F.coalesce("text", F.lit(""))
    rules = [("EMPTY_TRANSCRIPT", F.trim(t) == ""), ("DIGIT_NOT_WORD", t.rlike("[0-9]")), ("BAD_TIME", F.coalesce("n_chars", F.lit(0)) <= 50), ("BAD_ROLE", ~F.col("lang").isin("en", "fr"))]
    return C.issues(table(spark, sf, "documents"), ["doc_id"], rules)


@query("gate_staleness", """
WITH a AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.v = b.v THEN 'same' ELSE 'stale' END AS state FROM a FULL OUTER JOIN b ON a.k = b.k""")
def gate_staleness(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "k")
    return C.stale(o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("v")), o.groupBy("k").agg(F.count("*").alias("v")), "k", "v")


@query("stratified_sample", """
SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE r <= greatest(1, round_even(0.1 * n, 0))""")
def stratified_sample(spark, sf):
    key = F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    return C.stratified(table(spark, sf, "documents"), ["source", "lang"], 0.1, key).select("doc_id", "source", "lang")


@query("group_holdout", """
WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5(source), source) AS r, count(*) OVER () AS n FROM g)
SELECT doc_id, source, CASE WHEN r <= greatest(1, least(n - 1, round_even(0.4 * n, 0))) THEN 'test' ELSE 'train' END AS split FROM documents JOIN r USING (source)""")
def group_holdout(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return C.hold_out_groups(rows, "source", 0.4, F.md5(F.col("source").cast("binary"))).select("doc_id", "source", "split")


@query("dedup_keep_first", """
SELECT name, origin FROM (SELECT name, origin, row_number() OVER (PARTITION BY name ORDER BY origin, name) AS r FROM (SELECT n_name AS name, 1 AS origin FROM nation UNION ALL SELECT r_name, 2 FROM region)) WHERE r = 1""")
def dedup_keep_first(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("origin"))
    b = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit(2).alias("origin"))
    return C.keep_first(a, b, ["name"], ["name"])


@query("source_priority", """
SELECT doc_id, label, priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, label) AS r FROM
  (SELECT doc_id, toxic::VARCHAR AS label, 0::BIGINT AS priority FROM labels UNION ALL SELECT doc_id, lang, 1 FROM documents)) WHERE r = 1""")
def source_priority(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    b = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return C.first_source([a, b], ["doc_id"], ["label"])


@query("review_queue", "WITH " + JUD + """,
s AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM jud) WHERE r <= greatest(1, round_even(0.1 * n, 0)))
SELECT doc_id, CASE WHEN truth <> pred THEN 'forced' ELSE 'sampled' END AS reason FROM jud WHERE truth <> pred OR doc_id IN (SELECT doc_id FROM s)""")
def review_queue(spark, sf):
    j = judged(spark, sf)
    forced = j.filter("truth != pred").select("doc_id", F.lit("forced").alias("reason"))
    key = F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    sampled = C.stratified(j, ["lang"], 0.1, key).select("doc_id", F.lit("sampled").alias("reason"))
    return C.keep_first(forced, sampled, ["doc_id"], ["doc_id"])


@query("polarity_taxonomy", "SELECT lang, lang IN ('en', 'de', 'fr') AS known, count(*) AS n FROM documents GROUP BY 1")
def polarity_taxonomy(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.first(F.col("lang").isin("en", "de", "fr")).alias("known"), F.count("*").alias("n"))


CAND = "WITH s AS (SELECT quality AS t, least(n_chars, 10000) / 10000.0 AS sc FROM labels JOIN documents USING (doc_id)), x AS (SELECT unnest([0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70])::DOUBLE AS threshold), c AS (SELECT threshold, round(CASE WHEN sum(t) + sum((sc >= threshold)::INT) > 0 THEN 2.0 * sum(t * (sc >= threshold)::INT) / (sum(t) + sum((sc >= threshold)::INT)) ELSE 0 END, 6) AS f1, round(avg(((t = 1) = (sc >= threshold))::INT), 6) AS accuracy FROM s, x GROUP BY 1)"


def _candidates(spark, sf):
    rows = judged(spark, sf).select("truth", (F.least(F.col("n_chars"), F.lit(10000)) / 10000).alias("score"))
    return X.calibrate(rows, "truth", "score").select("threshold", F.round("f1", 6).alias("f1"), F.round("accuracy", 6).alias("accuracy"))


@query("threshold_candidates", CAND + " SELECT * FROM c")
def threshold_candidates(spark, sf):
    return _candidates(spark, sf)


@query("threshold_calibration", CAND + " SELECT * FROM c ORDER BY f1 DESC, accuracy DESC, abs(threshold - 0.5), threshold LIMIT 1")
def threshold_calibration(spark, sf):
    return X.best_threshold(_candidates(spark, sf))


@query("factorial_conditions", """
WITH s AS (SELECT quality AS q, toxic AS t, n_chars AS n FROM labels JOIN documents USING (doc_id))
SELECT a AS text_level, b AS speaker_level, round(avg((CASE a WHEN 'gold' THEN q ELSE 1 - t END = CASE b WHEN 'gold' THEN q ELSE (n > 1000)::INT END)::INT), 6) AS share
FROM s, (SELECT unnest(['gold', 'auto']) AS a), (SELECT unnest(['gold', 'auto']) AS b) GROUP BY 1, 2""")
def factorial_conditions(spark, sf):
    rows = judged(spark, sf)
    factors = {"text": {"gold": rows["truth"], "auto": rows["pred"]}, "speaker": {"gold": rows["truth"], "auto": (rows["n_chars"] > 1000).cast("int")}}
    return X.factorial(rows, factors, F.col("text") == F.col("speaker")).withColumn("share", F.round("share", 6))


PUBLISHED = "WITH " + UTT + """, e AS (SELECT DISTINCT episode FROM utt)
SELECT episode, CASE WHEN episode % 2 = 1 THEN 'new' WHEN episode % 10 = 0 THEN 'changed' ELSE 'same' END AS status FROM e"""


def _half_published(spark, sf):
    """Turns of even episodes published, and all turns, of which those of every tenth episode have changed meanwhile."""
    turns = utterances(spark, sf).select("episode", "turn", "text")
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    publishing.publish(turns.filter("episode % 2 = 0"), path, ["episode"])
    return path, turns.withColumn("text", F.when(F.col("episode") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))


@query("publish_status", PUBLISHED)
def publish_status(spark, sf):
    """A second run over all episodes: what it leaves alone, and what it writes."""
    path, turns = _half_published(spark, sf)
    return publishing.publish(turns, path, ["episode"], batches=2)


@query("published_rows", "WITH " + UTT + " SELECT episode, turn, CASE WHEN episode % 10 = 0 THEN text || '.' ELSE text END AS text FROM utt")
def published_rows(spark, sf):
    """All that is published after the second run: each turn once, as it is now."""
    path, turns = _half_published(spark, sf)
    publishing.publish(turns, path, ["episode"], batches=2)
    return publishing.published(spark, path)


@query("missing_published", "SELECT * FROM (" + PUBLISHED + ") WHERE status <> 'same'")
def missing_published(spark, sf):
    """Episodes whose output isn't there or is another one."""
    path, turns = _half_published(spark, sf)
    return publishing.missing(turns, path, ["episode"])
