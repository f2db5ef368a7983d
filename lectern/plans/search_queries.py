"""The flagship: ranked search over documents, and what surrounds it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import postings as P
from lectern.operators import search as S
from lectern.operators.sequences import neighbours
from lectern.plans.base import query
from lectern.plans.catalog import UTT, table, utterances
from lectern.plans.text_queries import NORMAL
from lectern.session import fingerprint

WORDS2 = "of the"
BASE = f"WITH n AS (SELECT doc_id, source, lang, {NORMAL} AS t FROM documents), k AS (SELECT *, string_split(t, ' ') AS ts FROM n)"
TOP = " ORDER BY score DESC, source, lang, doc_id LIMIT 20"


def run(spark, sf, q, method, k=20):
    out = S.search(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), S.normal_query(spark, q), method, top_k=k, order=["source", "lang", "doc_id"])
    return out.select("doc_id", "source", "lang", F.round("score", 6).alias("score"))


@query("search_exact", BASE + " SELECT doc_id, source, lang, 1.0::DOUBLE AS score FROM k WHERE contains(t, 'of the')" + TOP)
def search_exact(spark, sf):
    return run(spark, sf, WORDS2, "exact")


@query("search_all_words", BASE + " SELECT doc_id, source, lang, CASE WHEN contains(t, 'of the') THEN 0.96 ELSE 0.88 END::DOUBLE AS score FROM k WHERE list_contains(ts, 'of') AND list_contains(ts, 'the')" + TOP)
def search_all_words(spark, sf):
    return run(spark, sf, WORDS2, "all words")


@query("search_any_word", BASE + " SELECT doc_id, source, lang, round(0.65 + 0.30 * (list_contains(ts, 'of')::INT + list_contains(ts, 'une')::INT) / 2.0, 6)::DOUBLE AS score FROM k WHERE list_contains(ts, 'of') OR list_contains(ts, 'une')" + TOP)
def search_any_word(spark, sf):
    return run(spark, sf, "of une", "any word")


@query("search_smart_lexical", BASE + """, s AS (SELECT doc_id, source, lang, CASE WHEN contains(t, 'the of') THEN 1.0 WHEN list_contains(ts, 'the') AND list_contains(ts, 'of') THEN 0.9
  WHEN list_contains(ts, 'the') OR list_contains(ts, 'of') THEN 0.7 END::DOUBLE AS score FROM k)
SELECT * FROM s WHERE score >= 0.55""" + TOP)
def search_smart_lexical(spark, sf):
    from lectern.functions.text import normalize_text

    t = F.col("t")
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", normalize_text(F.col("text")).alias("t"))
    score = S.with_tokens(t, lambda ts: S.smart_lexical(t, ts, "the of", ["the", "of"]))
    rows = S.kept(rows, F.round(score, 6), F.lit("smart"), 0.55)
    return rows.select("doc_id", "source", "lang", "score").orderBy(F.col("score").desc(), "source", "lang", "doc_id").limit(20)


# An index of the turns: seven collections of episodes, with targets on every fourth turn.
IDX = "WITH " + UTT + r""", x AS (SELECT 'c' || episode % 7 AS collection, episode, turn, 'c' || episode % 7 || '::' || episode AS global_episode, 'c' || episode % 7 || '::' || episode || '::u' || turn AS key, speaker_id, start_sec, end_sec, text,
  coalesce(lag(text) OVER w, '') AS previous_text, coalesce(lead(text) OVER w, '') AS next_text FROM utt WINDOW w AS (PARTITION BY episode ORDER BY start_sec)),
""" + f"n AS (SELECT *, {NORMAL} AS t FROM x), k AS (SELECT *, string_split(t, ' ') AS ts FROM n)"


def indexed(spark, sf):
    u = utterances(spark, sf)
    label = F.array(F.struct(F.lit("MARKET").alias("target_type"), F.when(F.col("turn") % 8 == 0, "positive").alias("polarity")))
    u = u.select(F.concat(F.lit("c"), F.col("episode") % 7).alias("collection"), "episode", F.concat(F.lit("u"), "turn").alias("utterance_id"), "turn", "speaker_id", "start_sec", "end_sec", "text", F.when(F.col("turn") % 4 == 0, label).alias("targets"))
    return S.index(u)


# The same searches by a stored index: postings of the query's words are read, and texts of the hits.


def documents_index(spark, sf):
    docs = table(spark, sf, "documents")
    return P.indexed(docs.select("doc_id", "source", "lang", "text"), f"documents-{fingerprint(docs)}", ["source", "lang", "doc_id"])


def turns_index(spark, sf):
    rows = indexed(spark, sf).select("collection", "episode", "start_sec", "key", "speaker_id", "text")
    return P.indexed(rows, f"turns-{fingerprint(table(spark, sf, 'conversations'))}", ["collection", "episode", "start_sec", "key"])


def by_index(spark, sf, q, method):
    hits = P.search(documents_index(spark, sf), S.normal_query(spark, q), method, columns=["doc_id", "source", "lang"])
    return hits.select("doc_id", "source", "lang", F.round("score", 6).alias("score"))


@query("index_vocabulary", BASE + ", w AS (SELECT doc_id, unnest(ts) AS token FROM k WHERE t <> '') SELECT token, count(DISTINCT doc_id) AS n_rows, count(*) AS n_words FROM w GROUP BY token")
def index_vocabulary(spark, sf):
    """Builds the index of documents, where it isn't there yet, and gives its tokens with their rows and places."""
    return documents_index(spark, sf).table("vocabulary").select("token", "n_rows", "n_words")


@query("indexed_exact", BASE + " SELECT doc_id, source, lang, 1.0::DOUBLE AS score FROM k WHERE contains(t, 'of the')" + TOP)
def indexed_exact(spark, sf):
    return by_index(spark, sf, WORDS2, "exact")


@query("indexed_all_words", BASE + " SELECT doc_id, source, lang, CASE WHEN contains(t, 'of the') THEN 0.96 ELSE 0.88 END::DOUBLE AS score FROM k WHERE list_contains(ts, 'of') AND list_contains(ts, 'the')" + TOP)
def indexed_all_words(spark, sf):
    return by_index(spark, sf, WORDS2, "all words")


@query("indexed_any_word", BASE + " SELECT doc_id, source, lang, round(0.65 + 0.30 * (list_contains(ts, 'of')::INT + list_contains(ts, 'une')::INT) / 2.0, 6)::DOUBLE AS score FROM k WHERE list_contains(ts, 'of') OR list_contains(ts, 'une')" + TOP)
def indexed_any_word(spark, sf):
    return by_index(spark, sf, "of une", "any word")


@query("indexed_smart", BASE + """, s AS (SELECT doc_id, source, lang, CASE WHEN contains(t, 'the of') THEN 1.0 WHEN list_contains(ts, 'the') AND list_contains(ts, 'of') THEN 0.9
  WHEN list_contains(ts, 'the') OR list_contains(ts, 'of') THEN 0.7 END::DOUBLE AS score FROM k)
SELECT * FROM s WHERE score >= 0.55""" + TOP)
def indexed_smart(spark, sf):
    return by_index(spark, sf, "the of", "smart")


@query("indexed_sentence", IDX + " SELECT key FROM k WHERE contains(t, 'la') AND speaker_id >= 0 ORDER BY collection, episode, start_sec, key LIMIT 1000")
def indexed_sentence(spark, sf):
    """Part of a word, found through the vocabulary, in turns of known speakers. The first thousand hits: a top-k."""
    return P.search(turns_index(spark, sf), "la", "exact", top_k=1000, query_type="Sentence", where=F.col("speaker_id") >= 0, columns=["key"]).select("key")


def _turns(spark, sf):
    u = utterances(spark, sf)
    return u.select(F.concat_ws(":", "episode", "turn").alias("key"), "text")


@query("search_smart")
def search_smart(spark, sf):
    """Smart search over all turns, fuzzy comparison included; tests compare every hit with the rules by hand."""
    out = S.search(_turns(spark, sf), S.normal_query(spark, "an the of"), "smart", top_k=20, order=["key"])
    return out.select("key", F.round("score", 6).alias("score"), "match_type")


@query("search_fuzzy")
def search_fuzzy(spark, sf):
    out = S.search(_turns(spark, sf), S.normal_query(spark, "thand onesen"), "fuzzy", least=0.5, top_k=20, order=["key"])
    return out.select("key", F.round("score", 6).alias("score"))


def _fuzzy_documents(spark, sf, q, method, least):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return S.search(docs, S.normal_query(spark, q), method, least=least, top_k=20, order=["doc_id"]).select("doc_id", F.round("score", 6).alias("score"), "match_type")


@query("search_fuzzy_documents")
def search_fuzzy_documents(spark, sf):
    """Fuzzy search over whole documents: texts that can't reach the least score or the k-th best by counts of characters aren't compared."""
    return _fuzzy_documents(spark, sf, "thand onesen wereth", "fuzzy", 0.5)


@query("search_smart_documents")
def search_smart_documents(spark, sf):
    return _fuzzy_documents(spark, sf, "wereth zzyq", "smart", 0.55)


PROBE = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
SEM = f"""WITH d AS (SELECT vec_id, label, list_inner_product(embedding::DOUBLE[], {PROBE_SQL}) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product({PROBE_SQL}, {PROBE_SQL}))) AS raw FROM embeddings),
m AS (SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) AS s FROM d)"""


@query("search_semantic", SEM + " SELECT vec_id, round(s, 6) AS semantic FROM m")
def search_semantic(spark, sf):
    return S.semantic(table(spark, sf, "embeddings"), "embedding", PROBE).select("vec_id", F.round("semantic", 6).alias("semantic"))


@query("search_index", IDX + r"""
, s AS (SELECT *, round(0.65 + 0.30 * (list_contains(ts, 'de')::INT + list_contains(ts, 'la')::INT) / 2.0, 6)::DOUBLE AS score FROM k WHERE speaker_id = 1 AND collection = 'c3' AND (list_contains(ts, 'de') OR list_contains(ts, 'la')))
SELECT row_number() OVER (ORDER BY score DESC, collection, episode, start_sec, key) AS rank, key, score, 'any word' AS match_type,
  concat_ws(chr(10) || chr(10), CASE WHEN previous_text <> '' THEN 'Previous: ' || previous_text END, 'Match: ' || text, CASE WHEN next_text <> '' THEN 'Next: ' || next_text END) AS context FROM s ORDER BY rank LIMIT 15""")
def search_index(spark, sf):
    hits = S.find(indexed(spark, sf), S.normal_query(spark, "de la"), method="Any word", collection="c3", speaker=1, top_k=15)
    return hits.select(F.col("rank").cast("long").alias("rank"), "key", F.round("score", 6).alias("score"), "match_type", "context")


@query("search_sentence", IDX + " SELECT key FROM k WHERE contains(t, 'la') AND speaker_id >= 0 ORDER BY collection, episode, start_sec, key LIMIT 1000")
def search_sentence(spark, sf):
    """One word, sought as a sentence: anywhere in the text, not as a token. The first thousand hits: a top-k."""
    return S.find(indexed(spark, sf), "la", query_type="Sentence", method="Exact", top_k=1000).select("key")


@query("search_frame", IDX + r"""
, s AS (SELECT *, 1.0::DOUBLE AS score FROM k WHERE list_contains(ts, 'la')),
r AS (SELECT *, row_number() OVER (ORDER BY collection, episode, start_sec, key) AS rank, greatest(0, round_even(start_sec, 0))::BIGINT AS a, greatest(0, round_even(end_sec, 0))::BIGINT AS b FROM s)
SELECT rank AS "Rank", collection AS "Roll", episode AS "Episode", speaker_id AS "Speaker ID", printf('%02d:%02d', a // 60, a % 60) || '–' || printf('%02d:%02d', b // 60, b % 60) AS "Timestamp", 'exact' AS "Match", 1.0::DOUBLE AS "Relevance",
  text AS "Transcript", CASE WHEN turn % 8 = 0 THEN 'MARKET · positive' WHEN turn % 4 = 0 THEN 'MARKET · ?' ELSE '' END AS "Targets", 'No' AS "Audio" FROM r ORDER BY rank LIMIT 20""")
def search_frame(spark, sf):
    hits = S.find(indexed(spark, sf), "la", method="exact", include_unassigned=True, top_k=20)
    return S.hit_frame(hits).withColumn("Rank", F.col("Rank").cast("long"))


@query("search_hybrid", IDX + ", " + SEM.removeprefix("WITH ") + """, s AS (SELECT k.*, m.s AS sem, CASE WHEN contains(t, 'de la') THEN 1.0 WHEN list_contains(ts, 'de') AND list_contains(ts, 'la') THEN 0.9 ELSE 0 END AS lex FROM k LEFT JOIN m ON m.vec_id = episode * 100 + turn WHERE speaker_id >= 0)
SELECT key, round(sem, 6) AS semantic_score FROM s WHERE lex >= 0.9 AND 0.45 * lex + 0.55 * coalesce(sem, 0) >= 0.405""")
def search_hybrid(spark, sf):
    """Hits whose lexical part the native rules settle, each with the semantic score that counts beside it; other turns score less than 0.45 * 0.9 by words alone."""
    sem = S.semantic(table(spark, sf, "embeddings"), "embedding", PROBE).select(F.concat(F.lit("c"), F.floor(F.col("vec_id") / 100) % 7, F.lit("::"), F.floor(F.col("vec_id") / 100), F.lit("::u"), F.col("vec_id") % 100).alias("key"), "semantic")
    hits = S.find(indexed(spark, sf), "de la", method="Hybrid", minimum_score=0.405, top_k=None, semantic_scores=sem)
    return hits.filter("lexical_score >= 0.9").select("key", F.round("semantic_score", 6).alias("semantic_score"))


@query("transcript_rows", IDX + r"""
, r AS (SELECT *, greatest(0, round_even(start_sec, 0))::BIGINT AS a, greatest(0, round_even(end_sec, 0))::BIGINT AS b FROM x WHERE global_episode = 'c3::3')
SELECT printf('%02d:%02d', a // 60, a % 60) || '–' || printf('%02d:%02d', b // 60, b % 60) AS "Time", CASE WHEN speaker_id < 0 THEN 'Unassigned' ELSE 'Speaker ' || speaker_id END AS "Speaker", speaker_id AS "Speaker ID", text AS "Transcript", NULL AS "ASR confidence" FROM r""")
def transcript_rows(spark, sf):
    return S.transcript(indexed(spark, sf), "c3::3")


@query("record_by_key", IDX + " SELECT key, speaker_id, text FROM x WHERE key = 'c5::5::u1'")
def record_by_key(spark, sf):
    return S.record(indexed(spark, sf), "c5::5::u1").select("key", "speaker_id", "text")


@query("clip_spans", "WITH " + UTT + "SELECT episode, turn, greatest(0, start_sec - 2) AS clip_start, greatest(0.5, least(end_sec - start_sec + 4, 90)) AS clip_duration FROM utt")
def clip_spans(spark, sf):
    span = S.clip_span(F.col("start_sec"), F.col("end_sec"), 2.0, 90.0)
    return utterances(spark, sf).select("episode", "turn", span["start"].alias("clip_start"), span["duration"].alias("clip_duration"))


@query("search_context", "WITH " + UTT + """,
p AS (SELECT episode, turn, text, coalesce(lag(text) OVER w, '') AS b, coalesce(lead(text) OVER w, '') AS a FROM utt WINDOW w AS (PARTITION BY episode ORDER BY turn))
SELECT episode, turn, concat_ws(chr(10) || chr(10), CASE WHEN b <> '' THEN 'Previous: ' || b END, CASE WHEN text <> '' THEN 'Match: ' || text END, CASE WHEN a <> '' THEN 'Next: ' || a END) AS context FROM p""")
def search_context(spark, sf):
    return neighbours(utterances(spark, sf)).select("episode", "turn", S.context(F.col("previous_text"), F.col("text"), F.col("next_text")).alias("context"))


@query("scope_filter", "WITH " + UTT + "SELECT episode, turn, speaker_id FROM utt WHERE speaker_id = 1 AND speaker_id >= 0")
def scope_filter(spark, sf):
    return S.scope(utterances(spark, sf), speaker=1).select("episode", "turn", "speaker_id")


@query("record_order", "WITH " + UTT + "SELECT episode, turn, row_number() OVER (ORDER BY episode, start_sec, end_sec, turn)::BIGINT AS place FROM utt QUALIFY place <= 100")
def record_order(spark, sf):
    """The first hundred records in reading order: a top-k."""
    from pyspark.sql import Window

    top = utterances(spark, sf).orderBy("episode", "start_sec", "end_sec", "turn").limit(100)
    return top.select("episode", "turn", F.row_number().over(Window.orderBy("episode", "start_sec", "end_sec", "turn")).cast("long").alias("place"))
