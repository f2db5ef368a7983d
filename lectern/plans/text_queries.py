"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans.base import query
from lectern.plans.catalog import UTT, table, utterances

TOK = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"


def docs(spark, sf):
    return table(spark, sf, "documents")


NORMAL = r"trim(regexp_replace(replace(replace(replace(replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), 'inflation', 'মূল্যস্ফীতি'), 'import', 'আমদানি'), 'export', 'রপ্তানি'), 'banking', 'ব্যাংক'), '[^\p{L}\p{N}_\x{0980}-\x{09ff}]+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, {NORMAL} AS normalized FROM documents")
def normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query("normalize_draft", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\s+', ' ', 'g')) AS draft FROM documents")
def normalize_draft(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_draft(F.col("text")).alias("draft"))


@query("word_count", f"SELECT doc_id, len({TOK})::BIGINT AS n_words FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


RUNS = f"""
WITH t AS (SELECT doc_id, {TOK} AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
g AS (SELECT doc_id, w, i, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS k FROM e),
r AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, w, k, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("repetition_score", RUNS + """
SELECT t.doc_id, coalesce(r.m, 0)::BIGINT AS longest_run, round(CASE WHEN len(ws) = 0 THEN 1.0 ELSE len(list_distinct(ws)) * 1.0 / len(ws) END, 6) AS unique_share,
  (coalesce(r.m, 0) >= 4 OR (len(ws) >= 20 AND len(list_distinct(ws)) * 1.0 / len(ws) < 0.35)) AS is_loop FROM t LEFT JOIN r ON r.doc_id = t.doc_id""")
def repetition_score(spark, sf):
    ts = F.col("ts")
    rows = docs(spark, sf).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    return rows.select("doc_id", T.longest_run(ts).alias("longest_run"), F.round(T.unique_share(ts), 6).alias("unique_share"), T.is_loop(ts).alias("is_loop"))


@query("collapse_loops", f"""
WITH t AS (SELECT doc_id, {TOK} AS ws FROM documents)
SELECT doc_id, array_to_string(list_filter(ws, lambda x, i: NOT (i > 2 AND x = ws[i - 1] AND x = ws[i - 2])), ' ') AS collapsed FROM t""")
def collapse_loops(spark, sf):
    rows = docs(spark, sf).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    return rows.select("doc_id", F.array_join(T.collapse_loops(F.col("ts")), " ").alias("collapsed"))


@query("leading_fragment", r"""
SELECT doc_id, regexp_matches(coalesce(text, ''), '^[\x{09be}-\x{09c4}\x{09c7}\x{09c8}\x{09cb}-\x{09cd}\x{09d7}\x{09bc}]') AS truncated,
  strlen(coalesce(text, ''))::BIGINT AS kept_bytes FROM documents""")
def leading_fragment(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf).select("doc_id", T.leading_truncated(t).alias("truncated"), F.octet_length(T.drop_leading_fragment(t)).cast("long").alias("kept_bytes"))


@query("format_timestamp", "WITH " + UTT + """
SELECT episode, turn, CASE WHEN s >= 3600 THEN printf('%02d:', s // 3600) ELSE '' END || printf('%02d:%02d', s % 3600 // 60, s % 60) AS stamp
FROM (SELECT episode, turn, greatest(0, round_even(start_sec, 0))::BIGINT AS s FROM utt)""")
def format_timestamp(spark, sf):
    return utterances(spark, sf).select("episode", "turn", T.format_timestamp(F.col("start_sec")).alias("stamp"))


@query("safe_float", "SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END AS safe FROM (SELECT event_id, try_cast(value::VARCHAR AS DOUBLE) AS v FROM events)")
def safe_float(spark, sf):
    return table(spark, sf, "events").select("event_id", T.safe_double(F.col("value")).alias("safe"))


@query("speaker_reference", "WITH " + UTT + "SELECT episode, turn, episode::VARCHAR || ' / ' || CASE WHEN speaker_id < 0 THEN 'Unassigned' ELSE 'Speaker ' || speaker_id END AS reference FROM utt")
def speaker_reference(spark, sf):
    return utterances(spark, sf).select("episode", "turn", F.concat_ws(" / ", F.col("episode").cast("string"), T.speaker_label(F.col("speaker_id"))).alias("reference"))


@query("turn_bucket", "SELECT conv_id, CASE WHEN count(*) <= 4 THEN '1-4 turns' WHEN count(*) <= 12 THEN '5-12 turns' ELSE '13+ turns' END AS bucket FROM conversations GROUP BY conv_id")
def turn_bucket(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(T.turn_bucket(F.count("*")).alias("bucket"))


@query("duration_flag", "SELECT doc_id, CASE WHEN n_chars < 600 OR n_chars > 5400 THEN 'rejected' WHEN n_chars < 1800 THEN 'short' WHEN n_chars > 3600 THEN 'long' ELSE 'ok' END AS flag FROM documents")
def duration_flag(spark, sf):
    return docs(spark, sf).select("doc_id", T.duration_flag(F.col("n_chars")).alias("flag"))


@query("programme_key", "SELECT p_partkey, coalesce(nullif(substr(regexp_replace(lower(p_name), '[^a-z]+', '', 'g'), 1, 24), ''), 'unknown') AS programme FROM part")
def programme_key(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.programme_key(F.col("p_name")).alias("programme"))


@query("content_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


PART = 4096


@query("corpus_fingerprint", f"""
WITH a AS (SELECT doc_id // {PART} AS p, sha256(string_agg(md5(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1), b AS (SELECT p // {PART} AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM a GROUP BY 1)
SELECT substr(sha256(string_agg(h, '' ORDER BY p)), 1, 20) AS fingerprint FROM b""")
def corpus_fingerprint(spark, sf):
    """Hash of hashes in order of ids: of PART ids, then of PART such hashes, then of all of those, so that no task holds more than a few thousand."""
    ordered = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), ""), 256)
    part = lambda c: F.floor(F.col(c) / PART).alias("p")
    a = docs(spark, sf).select("doc_id", F.md5("text").alias("h")).groupBy(part("doc_id")).agg(ordered("doc_id").alias("h"))
    b = a.withColumnRenamed("p", "q").groupBy(part("q")).agg(ordered("q").alias("h"))
    return b.agg(F.substring(ordered("p"), 1, 20).alias("fingerprint"))


@query("html_highlight", r"""
SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)(title|nav)', '<mark>\1</mark>', 'g') AS marked FROM pages""")
def html_highlight(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.highlight(F.coalesce("html", F.lit("")), "nav title").alias("marked"))


@query("text_preview", r"""
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(substr(t, 1, 219)) || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)""")
def text_preview(spark, sf):
    return docs(spark, sf).select("doc_id", T.preview(F.coalesce("text", F.lit(""))).alias("preview"))


@query("vector_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS place FROM embeddings")
def vector_argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", T.argmax(F.col("embedding")).cast("long").alias("place"))


@query("softmax_top", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(list_max(v) / list_sum(v), 6) AS top FROM e""")
def softmax_top(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", F.round(F.array_max(T.softmax(F.col("v"))), 6).alias("top"))


@query("decode_multilabel", """
WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: 1 / (1 + exp(-x::DOUBLE))) AS p FROM embeddings),
f AS (SELECT vec_id, p, list_filter(range(10), lambda i: p[i + 1] >= 0.55 AND CASE WHEN i % 2 = 0 THEN p[i + 1] >= p[i + 2] ELSE p[i + 1] > p[i] END) AS c FROM e)
SELECT vec_id, array_to_string(CASE WHEN len(c) > 0 THEN c ELSE [list_position(p, list_max(p)) - 1] END, ',') AS chosen FROM f""")
def decode_multilabel(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10), T.sigmoid).alias("p"))
    return rows.select("vec_id", F.array_join(F.transform(T.decode_multilabel(F.col("p"), 0.55), lambda i: i.cast("string")), ",").alias("chosen"))


def _number(what):
    return f"('0x' || substr(md5(doc_id::VARCHAR || '|' || (i - 1) || '|0|{what}'), 1, 7))::BIGINT"


@query("noise_injection", f"""
WITH t AS (SELECT doc_id, {TOK} AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM t),
k AS (SELECT *, {_number('hit')} % 100 < 10 AS hit, {_number('kind')} % 4 AS kind, ({_number('place')} % length(x) + 1)::INT AS p, substr('{T.NOISE}', ({_number('new')} % {len(T.NOISE)} + 1)::INT, 1) AS c FROM e),
n AS (SELECT doc_id, i, CASE WHEN NOT hit THEN x WHEN kind = 0 THEN substr(x, 1, p - 1) || substr(x, p + 1) WHEN kind = 1 THEN substr(x, 1, p - 1) || substr(x, p + 1, 1) || substr(x, p, 1) || substr(x, p + 2)
  WHEN kind = 2 THEN substr(x, 1, p) || substr(x, p) ELSE substr(x, 1, p - 1) || c || substr(x, p + 1) END AS y FROM k)
SELECT t.doc_id, coalesce(md5(string_agg(y, ' ' ORDER BY i)), md5('')) AS noisy FROM t LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""")
def noise_injection(spark, sf):
    rows = docs(spark, sf).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    return rows.select("doc_id", F.md5(F.array_join(T.inject_noise(F.col("ts"), F.col("doc_id"), 10), " ").cast("binary")).alias("noisy"))


def _answers(spark, sf):
    from pyspark.sql import Window

    before = F.lag("text", 1, "").over(Window.partitionBy("episode").orderBy("turn"))
    return utterances(spark, sf).select("episode", "turn", F.col("text").alias("a"), before.alias("b"))


@query("wer")
def wer(spark, sf):
    """Each turn against the one before it, by words; tests compare every row with a table of distances."""
    a, b = F.col("a"), F.col("b")
    return _answers(spark, sf).select("episode", "turn", F.round(T.wer(a, b), 6).alias("wer"), F.round(T.wer(a, b, capped=False), 6).alias("uncapped"), F.round(T.edit_rate(a, b), 6).alias("edit_rate"))


@query("cer")
def cer(spark, sf):
    """By characters; DuckDB counts bytes, so that tests compare with a table of distances here too."""
    return _answers(spark, sf).select("episode", "turn", F.round(T.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query("build_input", "WITH " + UTT + r""",
p AS (SELECT episode, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(lag(text) OVER (PARTITION BY episode ORDER BY turn), ''), '\s+', ' ', 'g')) AS b FROM utt)
SELECT episode, turn, CASE WHEN b = '' THEN role ELSE role || ' ' || b END AS head, t AS body FROM p""")
def build_input(spark, sf):
    from pyspark.sql import Window

    rows = utterances(spark, sf).withColumn("before", F.lag("text", 1, "").over(Window.partitionBy("episode").orderBy("turn")))
    pair = T.build_input(F.col("text"), F.col("before"), F.col("role"), "role_context")
    return rows.withColumn("p", pair).select("episode", "turn", F.col("p.head").alias("head"), F.col("p.text").alias("body"))


@query("encode_pair", "SELECT conv_id, array_to_string(list(role ORDER BY t), ' ') || ' ‖ ' || any_value(n) AS encoded FROM (SELECT conv_id, role, min(turn) AS t, (SELECT count(*) FROM conversations c WHERE c.conv_id = conversations.conv_id)::VARCHAR AS n FROM conversations GROUP BY 1, 2) GROUP BY 1")
def encode_pair(spark, sf):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(T.encode_pair(roles, F.count("*").cast("string")).alias("encoded"))


@query("time_range", "WITH " + UTT + """, r AS (SELECT episode, turn, greatest(0, round_even(start_sec, 0))::BIGINT AS a, greatest(0, round_even(end_sec, 0))::BIGINT AS b FROM utt)
SELECT episode, turn, printf('%02d:%02d', a // 60, a % 60) || '–' || printf('%02d:%02d', b // 60, b % 60) AS stamp FROM r WHERE b < 3600""")
def time_range(spark, sf):
    rows = utterances(spark, sf).filter(F.bround("end_sec") < 3600)
    return rows.select("episode", "turn", T.time_range(F.col("start_sec"), F.col("end_sec")).alias("stamp"))


@query("filename_metadata", r"""
WITH n AS (SELECT c_custkey, c_custkey::VARCHAR || '_' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '-Remote guest' WHEN c_custkey % 5 = 0 THEN '__stock' ELSE '' END AS stem FROM customer)
SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(stem, '[_\-\s]+'), lambda x: x <> '')[2:], ' ') AS programme, c_custkey % 3 = 0 AS remote, c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AS market FROM n""")
def filename_metadata(spark, sf):
    tail = F.when(F.col("c_custkey") % 3 == 0, "-Remote guest").when(F.col("c_custkey") % 5 == 0, "__stock").otherwise("")
    rows = table(spark, sf, "customer").withColumn("m", T.filename_metadata(F.concat(F.col("c_custkey").cast("string"), F.lit("_"), F.lower("c_mktsegment"), tail)))
    return rows.select("c_custkey", F.col("m.programme").alias("programme"), F.col("m.has_remote_guest").alias("remote"), F.col("m.covers_market_news").alias("market"))


@query("json_props", "SELECT event_id, json_keys(props)[1] AS first_key, len(json_keys(props))::BIGINT AS n_keys FROM events")
def json_props(spark, sf):
    keys = F.json_object_keys("props")
    return table(spark, sf, "events").select("event_id", F.get(keys, F.lit(0)).alias("first_key"), F.size(keys).cast("long").alias("n_keys"))


@query("contribution_state", """
WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN f > 0 THEN CASE WHEN o > 0 THEN 'Searchable' ELSE 'Searchable (no bundle)' END WHEN o > 0 THEN 'Bundle present, no fused transcripts'
  WHEN n > 0 THEN 'Source audio only, pipeline not run' ELSE 'Folder empty' END AS state FROM c""")
def contribution_state(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey")
    c = c.agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return c.select("c_custkey", T.contribution_state(F.col("n"), F.col("o"), F.col("f")).alias("state"))


@query("runtime_estimate", """
WITH e AS (SELECT user_id, count(*)::DOUBLE AS d FROM events GROUP BY 1)
SELECT user_id, round(greatest(2, .07 * d) + .45 * d + .2, 4) AS low_min, round(greatest(8, .20 * d) + .85 * d + 1.0, 4) AS high_min FROM e""")
def runtime_estimate(spark, sf):
    d = F.col("d")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("d"))
    return rows.select("user_id", F.round(F.greatest(F.lit(2), 0.07 * d) + 0.45 * d + 0.2, 4).alias("low_min"), F.round(F.greatest(F.lit(8), 0.20 * d) + 0.85 * d + 1.0, 4).alias("high_min"))


@query("bangla_digits", "SELECT o_orderkey, translate(o_orderkey::VARCHAR, '13579', '১৩৫৭৯') AS written, o_orderkey::VARCHAR AS digits FROM orders")
def bangla_digits(spark, sf):
    """Numbers in which some digits are Bangla ones."""
    mixed = F.translate(F.col("o_orderkey").cast("string"), "13579", "১৩৫৭৯")
    return table(spark, sf, "orders").select("o_orderkey", mixed.alias("written"), T.ascii_digits(mixed).alias("digits"))


@query("leading_fragments_dropped", """
WITH m AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN 'ির ' || o_orderpriority WHEN 1 THEN '্য' ELSE o_orderpriority END AS t FROM orders)
SELECT o_orderkey, o_orderkey % 3 <> 2 AS truncated, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' ELSE t END AS rest FROM m""")
def leading_fragments_dropped(spark, sf):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.concat(F.lit("ির "), "o_orderpriority")).when(k == 1, F.lit("্য")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", T.leading_truncated(t).alias("truncated"), T.drop_leading_fragment(t).alias("rest"))
