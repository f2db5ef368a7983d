"""Rollups, votes, stance, roles and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import aggregates as A
from lectern.operators import vectors as V
from lectern.operators.quantiles import quantiles
from lectern.operators import sequences as Q
from lectern.plans.base import query
from lectern.plans.catalog import AIR, JUD, UTT, airings, judged, table, utterances

# Turns with a stance: of a long turn by its word count, so that every engine has the same labels.
LAB = UTT + ", lab AS (SELECT *, CASE n_words % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' WHEN 2 THEN 'negative' ELSE 'positive' END AS label, CASE n_words % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM utt)"


def labelled(spark, sf):
    m = F.col("n_words")
    label = F.when(m % 4 == 0, "neutral").when(m % 4 == 2, "negative").otherwise("positive")
    return utterances(spark, sf).withColumn("label", label).withColumn("confidence", F.when(m % 3 == 0, "high").when(m % 3 == 1, "medium").otherwise("low"))


@query("corpus_summary", "WITH " + UTT + """
SELECT count(DISTINCT episode) AS episodes, count(*) AS utterances, sum(n_words)::BIGINT AS words, round(1 - sum(CASE WHEN speaker_id < 0 THEN n_words ELSE 0 END) * 1.0 / sum(n_words), 6) AS assignment_rate,
  round(sum(end_ds - start_ds) / 36000.0, 6) AS hours FROM utt""")
def corpus_summary(spark, sf):
    loose = F.sum(F.when(F.col("speaker_id") < 0, F.col("n_words")).otherwise(0))
    return utterances(spark, sf).agg(
        F.countDistinct("episode").alias("episodes"), F.count("*").alias("utterances"), F.sum("n_words").alias("words"),
        F.round(1 - loose / F.sum("n_words"), 6).alias("assignment_rate"), F.round(F.sum(F.col("end_ds") - F.col("start_ds")) / 36000, 6).alias("hours"),
    )


@query("contributor_rollup", "SELECT n_name, count(c_custkey) AS contributors, count(DISTINCT c_mktsegment) AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def contributor_rollup(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name").agg(F.count("c_custkey").alias("contributors"), F.countDistinct("c_mktsegment").alias("segments"))


@query("episode_summary", "WITH " + UTT + """
SELECT episode, count(*) AS utterances, count(DISTINCT CASE WHEN speaker_id >= 0 THEN speaker_id END) AS speakers, sum(n_words)::BIGINT AS words, max(end_sec) AS duration_sec,
  round(CASE WHEN sum(n_words) > 0 THEN 1 - sum(CASE WHEN speaker_id < 0 THEN n_words ELSE 0 END) * 1.0 / sum(n_words) ELSE 0 END, 6) AS assignment_rate FROM utt GROUP BY episode""")
def episode_summary(spark, sf):
    loose = F.sum(F.when(F.col("speaker_id") < 0, F.col("n_words")).otherwise(0))
    return utterances(spark, sf).groupBy("episode").agg(
        F.count("*").alias("utterances"), F.countDistinct(F.when(F.col("speaker_id") >= 0, F.col("speaker_id"))).alias("speakers"), F.sum("n_words").alias("words"), F.max("end_sec").alias("duration_sec"),
        F.round(F.when(F.sum("n_words") > 0, 1 - loose / F.sum("n_words")).otherwise(0.0), 6).alias("assignment_rate"),
    )


@query("speaker_rows", "WITH " + UTT + "SELECT episode, speaker_id, count(*) AS utterances, sum(greatest(0, end_ds - start_ds))::BIGINT AS airtime_ds, sum(n_words)::BIGINT AS words FROM utt GROUP BY 1, 2")
def speaker_rows(spark, sf):
    return utterances(spark, sf).groupBy("episode", "speaker_id").agg(F.count("*").alias("utterances"), F.sum(F.greatest(F.lit(0), F.col("end_ds") - F.col("start_ds"))).alias("airtime_ds"), F.sum("n_words").alias("words"))


@query("diarization_audit", "WITH " + AIR + """, s AS (SELECT episode, speaker, count(*) AS n, sum(end_ms - start_ms) AS air, min(end_ms - start_ms) AS least FROM air GROUP BY 1, 2)
SELECT episode, sum(n)::BIGINT AS segments, count(*) AS speakers, min(least) AS least_ms, min(air)::BIGINT AS least_airtime_ms FROM s GROUP BY 1""")
def diarization_audit(spark, sf):
    d = F.col("end_ms") - F.col("start_ms")
    s = airings(spark, sf).groupBy("episode", "speaker").agg(F.count("*").alias("n"), F.sum(d).alias("air"), F.min(d).alias("least"))
    return s.groupBy("episode").agg(F.sum("n").alias("segments"), F.count("*").alias("speakers"), F.min("least").alias("least_ms"), F.min("air").alias("least_airtime_ms"))


@query("discourse_profile", "WITH " + LAB + """
SELECT episode, speaker_id, count(*) AS n, count(*) FILTER (label = 'positive') AS positive, count(*) FILTER (label = 'negative') AS negative,
  round(CASE WHEN count(*) FILTER (label <> 'neutral') > 0 THEN count(*) FILTER (label = 'positive') * 1.0 / count(*) FILTER (label <> 'neutral') ELSE 0 END, 6) AS positive_rate,
  array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, sum(end_ds - start_ds)::BIGINT AS airtime_ds FROM lab GROUP BY 1, 2""")
def discourse_profile(spark, sf):
    pos, neg = F.count_if(F.col("label") == "positive"), F.count_if(F.col("label") == "negative")
    return labelled(spark, sf).groupBy("episode", "speaker_id").agg(
        F.count("*").alias("n"), pos.alias("positive"), neg.alias("negative"), F.round(A.ratio(pos, pos + neg), 6).alias("positive_rate"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.sum(F.col("end_ds") - F.col("start_ds")).alias("airtime_ds"),
    )


@query("status_counts", "SELECT CASE WHEN l.toxic IS NOT NULL THEN 'labelled' ELSE 'review_required' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def status_counts(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy(F.when(F.col("toxic").isNotNull(), "labelled").otherwise("review_required").alias("status")).agg(F.count("*").alias("n"))


@query("distributions_multi_grain", """
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def distributions_multi_grain(spark, sf):
    out = table(spark, sf, "documents").groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "chars")


@query("rollup_cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rollup_cube(spark, sf):
    out = table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("majority_vote", "WITH " + LAB + """, c AS (SELECT episode, label, count(*) AS n, min(turn) AS f FROM lab GROUP BY 1, 2)
SELECT episode, label, round(n * 1.0 / t, 6) AS agreement FROM (SELECT *, sum(n) OVER (PARTITION BY episode) AS t, row_number() OVER (PARTITION BY episode ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def majority_vote(spark, sf):
    return A.majority_vote(labelled(spark, sf), ["episode"], "label", ["turn"]).select("episode", "label", F.round("agreement", 6).alias("agreement"))


def _net(kind, weight):
    @query(f"net_polarity_{kind}", "WITH " + LAB + f""", w AS (SELECT episode, speaker_id, sum(CASE WHEN label = 'positive' THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN label = 'negative' THEN {weight} ELSE 0 END) AS n FROM lab GROUP BY 1, 2)
SELECT episode, speaker_id, round(CASE WHEN p + n <> 0 THEN (p - n) / (p + n) ELSE 0 END, 5)::DOUBLE AS score FROM w""")
    def run(spark, sf):
        rows = labelled(spark, sf)
        w = A.weight(kind, rows["n_words"], rows["confidence"])
        return A.stance(rows, ["episode", "speaker_id"], "label", w).select("episode", "speaker_id", F.round("score", 5).alias("score"))


CW = "CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END::DOUBLE"
for _kind, _weight in (("none", "1.0::DOUBLE"), ("words", "n_words::DOUBLE"), ("confidence", CW), ("both", f"n_words * {CW}")):
    _net(_kind, _weight)


@query("speaker_verdict", "WITH " + LAB + """, s AS (SELECT episode, speaker_id, avg((label <> 'neutral')::INT) AS ps, sum((label = 'positive')::INT) AS p, sum((label = 'negative')::INT) AS n, count(*) AS t FROM lab GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN p + n <> 0 THEN (p - n) * 1.0 / (p + n) ELSE 0 END AS sc FROM s)
SELECT episode, speaker_id, CASE WHEN ps < 0.15 THEN 'neutral' WHEN abs(sc) < 0.34 THEN 'mixed' WHEN sc > 0 THEN 'positive' ELSE 'negative' END AS verdict,
  CASE WHEN (p + n) * 1.0 / t < 0.15 THEN 'neutral' WHEN p > 0 AND n > 0 AND least(p, n) * 1.0 / greatest(p, n) >= 0.5 THEN 'mixed' WHEN p > n THEN 'positive' ELSE 'negative' END AS majority FROM c""")
def speaker_verdict(spark, sf):
    s = A.stance(labelled(spark, sf), ["episode", "speaker_id"])
    return s.select("episode", "speaker_id", T.stance_label(F.col("polar_share"), F.col("score")).alias("verdict"), A.majority_verdict(F.col("positive"), F.col("negative"), F.col("n_turns")).alias("majority"))


@query("verdict_direction", "WITH " + LAB + "SELECT episode, turn, CASE label WHEN 'neutral' THEN 'neither' ELSE label END AS direction FROM lab")
def verdict_direction(spark, sf):
    return labelled(spark, sf).select("episode", "turn", T.direction(F.col("label")).alias("direction"))


@query("topk_stance", "SELECT l_suppkey AS supplier, round(avg(l_discount - l_tax), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_discount - l_tax) DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r <= 5 GROUP BY 1")
def topk_stance(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.top_k_stance(rows, ["l_suppkey"], 5, "l_discount", "l_tax", "line").select(F.col("l_suppkey").alias("supplier"), F.round("score", 6).alias("score"))


@query("role_inference_share", "WITH " + UTT + """,
p AS (SELECT episode, speaker_id, count(*) AS n, sum(n_words) AS w, min(start_ds) AS f, count(*) >= 3 AND speaker_id <> -1 AS live FROM utt GROUP BY 1, 2),
q AS (SELECT *, bool_or(live) OVER (PARTITION BY episode) AS has_live, CASE WHEN live THEN n * 1.0 / sum(CASE WHEN live THEN n END) OVER e - w * 1.0 / greatest(sum(CASE WHEN live THEN w END) OVER e, 1) + CASE WHEN f = min(f) OVER e THEN 0.05 ELSE 0 END END AS s FROM p WINDOW e AS (PARTITION BY episode)),
r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY s DESC NULLS LAST, speaker_id) AS k FROM q)
SELECT episode, speaker_id, CASE WHEN NOT has_live THEN 'unknown' WHEN speaker_id = -1 THEN 'unassigned' WHEN k = 1 THEN 'host' WHEN live THEN 'guest' ELSE 'minor' END AS inferred_role FROM r""")
def role_inference_share(spark, sf):
    return Q.roles_by_share(utterances(spark, sf).withColumn("start", F.col("start_ds")))


@query("role_inference_host", "WITH " + UTT + """, p AS (SELECT episode, speaker_id, count(*) AS n, sum(end_ds - start_ds) AS air, min(start_ds) AS f FROM utt GROUP BY 1, 2)
SELECT episode, speaker_id, CASE WHEN row_number() OVER (PARTITION BY episode ORDER BY n + CASE WHEN f <= 600 THEN 3 ELSE 0 END DESC, air DESC, f, speaker_id) = 1 THEN 'host' ELSE 'guest' END AS inferred_role FROM p""")
def role_inference_host(spark, sf):
    return Q.roles_by_airtime(utterances(spark, sf).withColumn("start", F.col("start_ds")).withColumn("end", F.col("end_ds")), 600)


# Evaluation: truth against prediction over labels.

COUNTS = JUD + """, cls AS (SELECT unnest([0, 1]) AS c),
cnt AS (SELECT c, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth <> c AND pred = c) AS fp, count(*) FILTER (truth = c AND pred <> c) AS fn, count(*) FILTER (truth = c) AS support FROM cls, jud GROUP BY c)"""


@query("confusion_matrix", "WITH " + JUD + "SELECT truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, count(*) AS support FROM jud GROUP BY truth")
def confusion_matrix(spark, sf):
    return A.confusion(judged(spark, sf), [0, 1])


@query("per_class_prf", "WITH " + COUNTS + """ SELECT c AS class, support, round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM cnt""")
def per_class_prf(spark, sf):
    r = A.per_class(judged(spark, sf), [0, 1])
    return r.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1", "WITH " + COUNTS + " SELECT (SELECT count(*) FROM jud) AS units, (SELECT round(avg((truth = pred)::INT), 6) FROM jud) AS accuracy, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM cnt")
def macro_f1(spark, sf):
    return A.scores(judged(spark, sf), [0, 1]).select("units", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("slice_breakdown", "WITH " + JUD + """, cnt AS (SELECT lang, c, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth <> c AND pred = c) AS fp, count(*) FILTER (truth = c AND pred <> c) AS fn FROM jud, (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2)
SELECT a.lang, units, accuracy, macro_f1 FROM (SELECT lang, count(*) AS units, round(avg((truth = pred)::INT), 6) AS accuracy FROM jud GROUP BY 1) a
JOIN (SELECT lang, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM cnt WHERE tp + fp + fn > 0 GROUP BY 1) b ON a.lang = b.lang""")
def slice_breakdown(spark, sf):
    return A.scores(judged(spark, sf), [0, 1], ["lang"]).select("lang", "units", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query("cohen_kappa", "WITH " + JUD + """, s AS (SELECT count(*) AS n, avg((truth = pred)::INT) AS o, avg((truth = 0)::INT) * avg((pred = 0)::INT) + avg((truth = 1)::INT) * avg((pred = 1)::INT) AS e FROM jud)
SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END, 6) AS kappa FROM s""")
def cohen_kappa(spark, sf):
    return A.cohen_kappa(judged(spark, sf), [0, 1]).select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("multilabel_f1", """
WITH b AS (SELECT vec_id, i, (embedding[i] > 0)::INT AS t, (embedding[i + 4] > 0)::INT AS p FROM embeddings, (SELECT unnest(range(1, 5)) AS i)),
f AS (SELECT i, CASE WHEN sum(t) + sum(p) > 0 THEN 2.0 * sum(t * p) / (sum(t) + sum(p)) ELSE 0 END AS f1 FROM b GROUP BY i), s AS (SELECT vec_id, bool_and(t = p) AS same FROM b GROUP BY 1)
SELECT (SELECT round(avg(f1), 6) FROM f) AS macro_f1, (SELECT round(avg(same::INT), 6) FROM s) AS subset_accuracy""")
def multilabel_f1(spark, sf):
    bits = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: (x > 0).cast("int"))
    out = A.multilabel(table(spark, sf, "embeddings").select(bits(1, 4).alias("truth"), bits(5, 4).alias("pred")), 4)
    return out.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("subset_accuracy", 6).alias("subset_accuracy"))


@query("stance_corr", "SELECT round(corr(l_extendedprice, l_quantity), 6) AS correlation FROM lineitem")
def stance_corr(spark, sf):
    return A.guarded_corr(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity").select(F.round("correlation", 6).alias("correlation"))


@query("class_weights", "SELECT lang, count(*) AS n, round(sum(count(*)) OVER () / (4 * count(*)), 6)::DOUBLE AS class_weight FROM documents GROUP BY lang")
def class_weights(spark, sf):
    return A.class_weights(table(spark, sf, "documents"), "lang", 4).select("lang", "n", F.round("class_weight", 6).alias("class_weight"))


@query("crosstab_normalized", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM customer GROUP BY 1, 2")
def crosstab_normalized(spark, sf):
    return A.crosstab(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey").withColumn("share", F.round("share", 6))


@query("quantile_bands", "WITH c AS (SELECT quantile_cont(c_acctbal, [1.0 / 3, 2.0 / 3]) AS q FROM customer) SELECT c_custkey, ((c_acctbal > q[1])::BIGINT + (c_acctbal > q[2])::BIGINT) AS band FROM customer, c")
def quantile_bands(spark, sf):
    return A.value_bands(table(spark, sf, "customer"), "c_acctbal", 3).select("c_custkey", "band")


@query("quartile_slices", """
WITH c AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS q FROM documents JOIN labels USING (doc_id)), b AS (SELECT (n_chars > q[1])::BIGINT + (n_chars > q[2])::BIGINT + (n_chars > q[3])::BIGINT AS band, n_chars, quality = 1 - toxic AS ok FROM documents JOIN labels USING (doc_id), c)
SELECT band, count(*) AS n, round(avg(n_chars), 4) AS mean, round(avg(ok::INT), 6) AS accuracy FROM b GROUP BY band""")
def quartile_slices(spark, sf):
    b = A.value_bands(judged(spark, sf), "n_chars", 4)
    return b.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 6).alias("accuracy"))


@query("binary_metrics", "WITH " + JUD + """, c AS (SELECT count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 0) AS tn, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn FROM jud)
SELECT tp, tn, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""")
def binary_metrics(spark, sf):
    r = A.binary_metrics(judged(spark, sf), F.col("truth") == 1, F.col("pred") == 1)
    return r.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("artifact_summary", "SELECT source, lang, count(*) AS files, round(sum(strlen(text)) / 1024.0, 4) AS kb FROM documents GROUP BY 1, 2")
def artifact_summary(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.round(F.sum(F.octet_length("text")) / 1024, 4).alias("kb"))


@query("split_summary", "SELECT o_orderstatus AS split, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def split_summary(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("length_percentiles", "SELECT " + ", ".join(f"round(quantile_cont(n_chars, {p / 100}), 4) AS p{p}" for p in (50, 75, 90, 95, 99)) + ", max(n_chars) AS longest, round(avg((n_chars > 4000)::INT), 6) AS over FROM documents")
def length_percentiles(spark, sf):
    docs = table(spark, sf, "documents")
    found = quantiles(docs, "n_chars", [p / 100 for p in (50, 75, 90, 95, 99)])
    cuts = [F.round(F.lit(x).cast("double"), 4).alias(f"p{p}") for p, x in zip((50, 75, 90, 95, 99), found, strict=True)]
    return docs.agg(F.max("n_chars").alias("longest"), F.round(F.avg((F.col("n_chars") > 4000).cast("double")), 6).alias("over")).select(*cuts, "longest", "over")


@query("best_by_pivot", """
WITH a AS (SELECT n_regionkey AS r, c_mktsegment AS s, round(avg(c_acctbal), 4) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT r AS region, arg_max(s, v) AS best_segment, max(v) AS best_value FROM a GROUP BY 1""")
def best_by_pivot(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    a = j.groupBy(F.col("n_regionkey").alias("region"), "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("v"))
    return a.groupBy("region").agg(F.max_by("c_mktsegment", "v").alias("best_segment"), F.max("v").alias("best_value"))


@query("prediction_record", "WITH " + LAB + """
SELECT episode, speaker_id, count(*) AS n_turns, sum(n_words)::BIGINT AS n_words, round(avg((label <> 'neutral')::INT), 6) AS polar_share, count(*) < 3 AS thin FROM lab GROUP BY 1, 2""")
def prediction_record(spark, sf):
    return labelled(spark, sf).groupBy("episode", "speaker_id").agg(F.count("*").alias("n_turns"), F.sum("n_words").alias("n_words"), F.round(F.avg((F.col("label") != "neutral").cast("double")), 6).alias("polar_share"), (F.count("*") < 3).alias("thin"))


@query("approx_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
def approx_distinct(spark, sf):
    """The sketch's count, held against the exact one: within four of its standard errors."""
    exact, approx = F.countDistinct("l_partkey"), F.approx_count_distinct("l_partkey", 0.02)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(approx - exact) <= 0.08 * exact).alias("near"))


@query("confident_errors", "WITH " + JUD + "SELECT doc_id, truth, pred, n_chars FROM jud WHERE truth <> pred ORDER BY n_chars DESC, doc_id LIMIT 20")
def confident_errors(spark, sf):
    """The longest misjudged documents: a top-k report."""
    return judged(spark, sf).filter("truth != pred").select("doc_id", "truth", "pred", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)


@query("majority_baseline", "WITH " + JUD + ", m AS (SELECT truth AS c FROM jud GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT count(*) AS units, round(avg((truth = (SELECT c FROM m))::INT), 6) AS accuracy FROM jud")
def majority_baseline(spark, sf):
    j = judged(spark, sf)
    top = j.groupBy("truth").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "truth").limit(1).select(F.col("truth").alias("c"))  # one row
    return j.crossJoin(F.broadcast(top)).agg(F.count("*").alias("units"), F.round(F.avg((F.col("truth") == F.col("c")).cast("double")), 6).alias("accuracy"))


@query("top_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long")
    return table(spark, sf, "orders").withColumn("rank", n).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


VOCABULARY = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w),
c AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY 1, 2),
v AS (SELECT gram, count(*) AS df, sum(tf)::BIGINT AS n FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, gram LIMIT 40000),
i AS (SELECT gram, df, n, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v)"""


@query("gram_vocabulary", VOCABULARY + " SELECT gram, df, n, round(idf, 6) AS idf FROM i")
def gram_vocabulary(spark, sf):
    """Words and pairs of two texts and more, the 40,000 most frequent: a limit that is the feature's."""
    docs = table(spark, sf, "documents")
    words = V.vocabulary(V.counted(docs, "doc_id", "text", V.WORDS), docs.count(), V.WORDS)
    return words.select("gram", "df", "n", F.round("idf", 6).alias("idf"))


@query("gram_weights", VOCABULARY + """, x AS (SELECT doc_id, gram, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (gram)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM x GROUP BY 1)
SELECT doc_id, count(*) AS n_grams, round(sum(w / l), 5) AS total, round(max(w / l), 5) AS largest FROM x JOIN l USING (doc_id) GROUP BY 1""")
def gram_weights(spark, sf):
    """Each document's weights, of length one, summed up."""
    docs = table(spark, sf, "documents")
    counts = V.counted(docs, "doc_id", "text", V.WORDS)
    w = V.weights(counts, V.vocabulary(counts, docs.count(), V.WORDS), "doc_id")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_grams"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 5).alias("largest"))


def _judged_texts(spark, sf):
    own = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf, "documents").select("doc_id", "text").join(own, "doc_id").withColumn("fold", (F.col("doc_id") % 3).cast("int"))


@query("fold_baselines")
def fold_baselines(spark, sf):
    """Judged documents by three folds: words and characters with a classifier for each fold, and the majority beside it. Tests hold the majority against its rule, and the classifier above it."""
    return V.by_folds(_judged_texts(spark, sf), "doc_id", "text", "label", "fold", 2, [V.WORDS, V.CHARS])
