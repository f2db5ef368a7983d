"""Ranked search over texts: exact, all words, any word, fuzzy, smart, semantic and hybrid.

A score is computed once for each row, behind a generator that the optimiser doesn't push filters through, and rows below the least
score end there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import normalize_text, speaker_label, time_range, tokens
from lectern.session import stored

#: More methods: from (normalised text, its tokens, query, query tokens) to a score column.
METHODS: dict[str, Callable[[Column, Column, str, list[str]], Column]] = {}

# Scores of matches.
PHRASE, ALL_WORDS, ANY_WORD, SMART_ALL, SMART_ANY, PER_WORD, FUZZY_SHARE = 0.96, 0.88, 0.65, 0.90, 0.55, 0.30, 0.92
LEXICAL_SHARE, SEMANTIC_SHARE = 0.45, 0.55  # fixed values: of hybrid scores


def register_search_method(name: str, fn: Callable[[Column, Column, str, list[str]], Column]) -> None:
    METHODS[name] = fn


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def any_ratio(ts: Column, words: list[str]) -> Column:
    """Share of the query's tokens, repeats included, that the text has."""
    return F.size(F.filter(literal(words), lambda w: F.array_contains(ts, w))) / len(words)


def exact(t: Column, ts: Column, q: str, words: list[str]) -> Column:
    hit = F.array_contains(ts, words[0]) if len(words) == 1 else t.contains(q)
    return F.when(hit, 1.0).otherwise(0.0)


def all_words(t: Column, ts: Column, q: str, words: list[str]) -> Column:
    return F.when(F.size(F.array_except(literal(words), ts)) == 0, F.when(t.contains(q), PHRASE).otherwise(ALL_WORDS)).otherwise(0.0)


def any_word(t: Column, ts: Column, q: str, words: list[str]) -> Column:
    r = any_ratio(ts, words)
    return F.when(r > 0, ANY_WORD + PER_WORD * r).otherwise(0.0)


def common_subsequences(masks: np.ndarray, begin: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Lengths of the longest common subsequences of a query of `size` characters with windows of a text, all at once.

    masks: for each character of the text, where the query has it, as bits; one addition carries a match along for each character of a window.
    """
    order = np.argsort(-length, kind="stable")
    at, left = begin[order], length[order]
    state = np.full(len(order), ~np.uint64(0))
    for p in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -p, side="left"))  # windows longer than p come first
        v = state[:live]
        u = v & masks[at[:live] + p]
        state[:live] = (v + u) | (v - u)
    out = np.empty(len(order), np.int64)
    out[order] = np.bitwise_count(~state & np.uint64((1 << size) - 1))
    return out


#: Texts are compared together up to so many characters of their windows.
TOGETHER = 200_000


class Fuzzy:
    """A query made ready for comparison with texts.

    A ratio is twice the matched characters by all, and no more match than a window has of each of the query's characters, in whatever order, nor, as
    matching blocks stand in order, than the longest common subsequence. The first bound comes from running counts of each character for all windows,
    the second is computed for those (of a query of up to 64 characters) that the first leaves, all at once.
    """

    def __init__(self, q: str):
        self.q, self.need, self.width = q, Counter(q), len(q.split())
        chars = sorted(c for c in self.need if c != " ")
        self.codes = np.array([ord(c) for c in chars], np.uint32)
        self.most = np.array([[self.need[c]] for c in chars], np.int32).reshape(-1, 1)
        self.masks = np.array([0, *(sum(1 << k for k, x in enumerate(q) if x == c) for c in chars), sum(1 << k for k, x in enumerate(q) if x == " ")], np.uint64) if len(q) <= 64 else None

    def classes(self, flat: str) -> np.ndarray:
        """Of each character its place among the query's, from 1; one more for a space, and 0 for any other."""
        text = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = np.searchsorted(self.codes, text) if len(self.codes) > 64 or (len(self.codes) and self.codes[-1] > 0xFFFF) else self.table()[np.minimum(text, 0x10000)]
        if k.dtype != np.uint8:
            held = np.minimum(k, len(self.codes) - 1)
            k = np.where(self.codes[held] == text, held + 1, 0)
            k[text == 32] = len(self.codes) + 1
        return k

    def table(self) -> np.ndarray:
        if "_table" not in self.__dict__:
            self._table = np.zeros(0x10001, np.uint8)
            self._table[self.codes] = np.arange(1, len(self.codes) + 1)
            self._table[32] = len(self.codes) + 1
        return self._table

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}  # each worker makes its own

    def windows(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and the greatest ratio of all windows of two words less to three words more than the query has."""
        kinds = len(self.codes) + 2
        space = classes == kinds - 1
        to = np.concatenate([[0], np.flatnonzero(space) + 1, [len(classes) + 1]])
        n = len(to) - 1
        word = np.cumsum(space, dtype=np.int64)
        counts = np.bincount(word * kinds + classes, minlength=n * kinds).reshape(n, kinds)[:, 1:-1]
        have = np.zeros((kinds - 2, n + 1), np.int32)
        np.cumsum(counts.T, axis=1, out=have[:, 1:])
        sizes = range(max(1, self.width - 2), min(n, self.width + 3) + 1)
        begin = np.concatenate([to[:-k] for k in sizes] or [to[:0]])
        length = np.concatenate([to[k:] - 1 for k in sizes] or [to[:0]]) - begin
        match = np.concatenate([np.minimum(have[:, k:] - have[:, :-k], self.most).sum(0) + min(self.need[" "], k - 1) for k in sizes] or [to[:0]])
        return begin, length, 2 * match / (len(self.q) + length)

    def bound(self, t: str) -> float:
        """No less than the score of the text."""
        q, flat = self.q, " ".join(t.split())
        if not len(q) + len(t):
            return 1.0
        best = self.windows(self.classes(flat))[2].max(initial=0.0) if flat else 0.0
        if 2 * min(len(q), len(t)) > best * (len(q) + len(t)):
            best = max(best, 2 * sum(min(t.count(c), n) for c, n in self.need.items()) / (len(q) + len(t)))
        return float(best)

    def left(self, t: str, least: float) -> tuple | None:
        """Of a text's windows those that may reach `least` by counts: the text, its ratio as a whole, begin, length and bound of each, and their classes."""
        q = self.q
        limit = 2 * min(len(q), len(t)) / (len(q) + len(t)) if len(q) + len(t) else 1.0
        best = SequenceMatcher(None, q, t).ratio() if limit >= least else 0.0
        flat = " ".join(t.split())
        if not flat:
            return flat, best, *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint8)
        classes = self.classes(flat)
        begin, length, bounds = self.windows(classes)
        some = np.flatnonzero(bounds >= max(best, least))
        begin, length, bounds = begin[some], length[some], bounds[some]
        if int(length.sum()) >= len(flat):
            return flat, best, begin, length, bounds, begin, classes
        at = np.cumsum(length) - length  # a few windows are read by themselves
        return flat, best, begin, length, bounds, at, classes[np.repeat(begin - at, length) + np.arange(int(length.sum()))]

    def scores(self, texts: Iterable[str], least: float = 0.0) -> Iterator[float]:
        """Best similarity ratio of the query with each text and with its windows; exact if at least `least`.

        Second bounds are computed for several texts at once, as most of their cost is by call. Windows are compared from the largest bound down, while it is beyond the best.
        """
        held, size = [], 0
        for t in texts:
            held.append(self.left(t, least))
            size += len(held[-1][-1]) + len(held[-1][2]) + 100
            if size > TOGETHER:
                yield from self._scores(held, least)
                held, size = [], 0
        yield from self._scores(held, least)

    def _scores(self, held: list[tuple], least: float) -> Iterator[float]:
        if not held:
            return
        q, bounds = self.q, [x[4] for x in held]
        if self.masks is not None:
            before = np.cumsum([0, *(len(x[6]) for x in held)])
            length = np.concatenate([x[3] for x in held])
            lcs = common_subsequences(self.masks[np.concatenate([x[6] for x in held])], np.concatenate([x[5] + n for x, n in zip(held, before[:-1], strict=True)]), length, len(q))
            bounds = np.split(2 * lcs / (len(q) + length), np.cumsum([len(x[3]) for x in held])[:-1])
        for (flat, best, begin, length, *_), bound in zip(held, bounds, strict=True):
            for k in np.argsort(-bound, kind="stable").tolist() if len(bound) and bound.max() >= max(best, least) else ():
                if bound[k] <= best or bound[k] < least:
                    break
                best = max(best, SequenceMatcher(None, q, flat[begin[k] : begin[k] + length[k]]).ratio())
            yield best


def fuzzy_score(q: str, t: str, least: float = 0.0) -> float:
    """Best similarity ratio of the query with the text and with windows of two words less to three words more than it has; exact if at least `least`."""
    return next(Fuzzy(q).scores([t], least))


def fuzzy_slack(t: Column, ts: Column, q: str, least: float | Column) -> Column:
    """At least 0 where fuzzy_score(q, t) may reach `least`; how far beyond it may be. Null for null."""
    made = Fuzzy(q)

    @F.pandas_udf("double")
    def bound(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else made.bound(x) for x in s], dtype="float64")

    return bound(t) - least + 1e-9


def fuzzy(t: Column, ts: Column, q: str, words: list[str], least: float = 0.0) -> Column:
    """fuzzy_score of each text, right where it is at least `least`; null for null."""
    made = Fuzzy(q)

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), np.nan)
        out[known] = np.fromiter(made.scores(s[known], least), np.float64, int(known.sum()))
        return pd.Series(out).astype(object).where(known, None)

    return score(t)


def smart_lexical(t: Column, ts: Column, q: str, words: list[str]) -> Column:
    """The native part of smart search: exact 1, all words 0.9, any word 0.55 and more, else null (left to fuzzy)."""
    hit = t.contains(q)
    if len(words) == 1:
        hit = hit | F.array_contains(ts, words[0])
    r = any_ratio(ts, words)
    return F.when(hit, 1.0).when(F.size(F.array_except(literal(words), ts)) == 0, SMART_ALL).when(r > 0, SMART_ANY + PER_WORD * r)


#: Searches for more hits than this don't look for the k-th best first.
MOST_FIRST = 10_000


def with_normal(rows: DataFrame, normal: Column) -> DataFrame:
    """Rows with _t, their normal form; made once for a row, also where Python reads it beside other steps."""
    return rows.select("*", F.inline(F.array(F.struct(normal.alias("_t")))))


def with_slack(rows: DataFrame, q: str, least: float) -> DataFrame:
    """Rows (with _t, their normal form) that may reach `least` by fuzzy comparison, with _slack."""
    t = F.col("_t")
    rows = rows.withColumn("_bound", fuzzy_slack(t, t, q, least))
    return rows.select("*", F.inline(F.filter(F.array(F.struct(F.col("_bound").alias("_slack"))), lambda x: x["_slack"] >= 0))).drop("_bound")


def with_open(rows: DataFrame, wanted: Column, q: str, least: Column) -> DataFrame:
    """Rows with _open: their text where it is wanted and may reach `least` by fuzzy comparison, else null, which needs none."""
    t = F.col("_t")
    rows = rows.withColumn("_bound", fuzzy_slack(F.when(wanted, t), t, q, least))
    return rows.select("*", F.inline(F.array(F.struct(F.when(F.col("_bound") >= 0, t).alias("_open"))))).drop("_bound")


def kth_of_first(rows: DataFrame, may: Column, score: Column, k: int, others: DataFrame | None = None) -> float:
    """What the k-th best score is at least: that of the rows that may score most, and of others with a score; 0 if they are fewer, or k too many."""
    k = max(1, k)
    if k > MOST_FIRST:
        return 0.0
    most = rows.select(may.alias("m")).orderBy(F.desc("m")).limit(4 * k).collect()
    if not most:
        return 0.0
    # By value and not by a sort of whole texts: rows of the same bound come with them.
    first = rows.filter(may >= most[-1].m).select(score.alias("score"))
    best = (first if others is None else first.unionByName(others)).orderBy(F.desc("score")).limit(k).collect()
    return best[-1].score if len(best) == k else 0.0


METHODS.update({"exact": exact, "all words": all_words, "any word": any_word, "fuzzy": fuzzy})


def normal_query(spark, q: str) -> str:
    """The query as texts are normalised; one row."""
    return spark.range(1).select(normalize_text(F.lit(q)).alias("q")).first()["q"]


def kept(rows: DataFrame, score: Column, kind: Column, least: float) -> DataFrame:
    """rows with score and match_type, without those of less than `least`; both are computed once."""
    one = F.array(F.struct(score.alias("score"), kind.alias("match_type")))
    return rows.select("*", F.inline(F.filter(one, lambda x: x["score"] >= least)))


def with_tokens(t: Column, body: Callable[[Column], Column]) -> Column:
    """body(tokens of t), which are split once."""
    return F.transform(F.array(tokens(t)), body)[0]


def search(rows: DataFrame, q: str, method: str = "smart", least: float = 0.55, top_k: int = 20, text: str = "text", order: list[str] | None = None, normal: Column | None = None, query_type: str = "auto") -> DataFrame:
    """rows with score and match_type, best first, at most max(1, top_k); an empty query finds nothing.

    query_type: of exact search: word (a token), sentence (anywhere in the text), or auto: by whether the query is one word.
    Smart search runs fuzzy comparison only on rows that the native rules don't settle at 0.9 or more.
    """
    words = q.split()
    if not words:
        return rows.limit(0).select("*", F.lit(0.0).alias("score"), F.lit("").alias("match_type"))
    name = method.lower()
    t = F.col("_t")
    base = with_normal(rows, normalize_text(F.col(text)) if normal is None else normal)
    if name == "exact" and query_type.lower() == "sentence":
        out = kept(base, F.when(t.contains(q), 1.0).otherwise(0.0), F.lit(name), max(least, 1e-9))
    elif name == "fuzzy":
        near = stored(with_slack(base, q, max(least, 1e-9)), "fuzzy")
        kth = kth_of_first(near, F.col("_slack"), fuzzy(t, t, q, words, least), top_k)
        near = near.filter(F.col("_slack") >= max(kth, least) - max(least, 1e-9))
        out = kept(near.withColumn("_f", fuzzy(t, t, q, words, max(least, kth))), F.col("_f"), F.lit(name), max(least, 1e-9)).drop("_f", "_slack")
    elif name in METHODS:
        out = kept(base, with_tokens(t, lambda ts: METHODS[name](t, ts, q, words)), F.lit(name), max(least, 1e-9))
    else:
        base = base.select("*", F.inline(F.array(F.struct(with_tokens(t, lambda ts: smart_lexical(t, ts, q, words)).alias("_s")))))
        settled = base.filter(F.col("_s") >= SMART_ALL)
        settled = kept(settled, F.col("_s"), F.when(F.col("_s") == 1, "exact").otherwise("all words"), least)
        if top_k <= MOST_FIRST:
            settled = stored(settled.drop("_t", "_s").orderBy(F.desc("score"), *(order or [])).limit(max(1, top_k)), "settled")
            kth = settled.agg(F.when(F.count("*") >= top_k, F.min("score"))).first()[0] or 0.0
        else:
            settled, kth = settled.drop("_t", "_s"), 0.0
        if kth > FUZZY_SHARE:  # no other row can come before these
            return settled.orderBy(F.col("score").desc(), *(order or [])).limit(max(1, top_k))
        lexical = F.coalesce("_s", F.lit(0.0))
        open_ = base.filter(lexical < SMART_ALL)
        may = F.greatest(lexical, FUZZY_SHARE * (F.col("_bound") + 1e-9))
        open_ = stored(open_.withColumn("_bound", fuzzy_slack(t, t, q, 0.0)).select("*", F.inline(F.filter(F.array(F.struct(may.alias("_may"))), lambda x: x["_may"] >= max(least, kth, 1e-9)))), "open")
        kth = max(kth, kth_of_first(open_, F.col("_may"), F.greatest(lexical, FUZZY_SHARE * fuzzy(t, t, q, words, max(least, kth) / FUZZY_SHARE - 1e-9)), top_k, settled.select("score")))
        open_ = open_.filter(F.col("_may") >= kth).withColumn("_open", F.when(FUZZY_SHARE * (F.col("_bound") + 1e-9) >= F.greatest(lexical, F.lit(max(least, kth))), t))
        open_ = open_.withColumn("_f", FUZZY_SHARE * fuzzy(F.col("_open"), t, q, words, max(least, kth) / FUZZY_SHARE - 1e-9)).drop("_may", "_bound")
        kind = F.when(F.col("_s").isNotNull(), "lexical").otherwise("fuzzy")
        open_ = kept(open_, F.greatest(lexical, F.coalesce("_f", F.lit(0.0))), kind, least).drop("_f", "_open", "_t", "_s")
        return settled.unionByName(open_).orderBy(F.col("score").desc(), *(order or [])).limit(max(1, top_k))
    return out.drop("_t").orderBy(F.col("score").desc(), *(order or [])).limit(max(1, top_k))


# The index of a corpus, and one call that searches it.


def index(utterances: DataFrame) -> DataFrame:
    """Index rows of utterances (collection, episode, utterance_id, speaker_id, start_sec, end_sec, text, and more), with keys and neighbours.

    Null ends and texts count as 0 and empty; empty texts stay, and are found by nothing.
    """
    from lectern.operators.sequences import neighbours

    rows = utterances.withColumn("text", F.coalesce("text", F.lit("")))
    episode = F.concat_ws("::", F.col("collection").cast("string"), F.col("episode").cast("string"))
    rows = rows.withColumn("global_episode", episode).withColumn("key", F.concat_ws("::", episode, F.col("utterance_id").cast("string")))
    return neighbours(rows, "global_episode", "start_sec")


def targets_text(labels: Column) -> Column:
    """`type · polarity` of an array of labels (target_type, polarity), ? for what is missing, between commas."""
    part = lambda x: F.concat(F.coalesce(x["target_type"], F.lit("?")), F.lit(" · "), F.coalesce(x["polarity"], F.lit("?")))
    return F.coalesce(F.array_join(F.transform(labels, part), ", "), F.lit(""))


def find(
    rows: DataFrame, q: str, query_type: str = "auto", method: str = "smart", collection: str | None = None, episode: str | None = None, speaker: int | None = None,
    include_unassigned: bool = False, minimum_score: float = 0.55, top_k: int | None = 20, include_context: bool = True, semantic_scores: DataFrame | None = None,
) -> DataFrame:
    """Ranked hits of index rows: rank, what the rows have, score, lexical_score, semantic_score, match_type, context, targets_text.

    semantic_scores: (key, semantic) of the whole corpus, for the methods semantic and hybrid. episode: a global one. Scope is cut before scoring.
    top_k: None gives all hits of these two methods, in no order and without a rank.
    """
    if not q.split():
        return rows.limit(0)
    name = method.lower()
    scoped = rows
    for column, value in (("collection", collection), ("global_episode", episode), ("speaker_id", speaker)):
        if value is not None:
            scoped = scoped.filter(F.col(column) == value)
    if not include_unassigned:
        scoped = scoped.filter("speaker_id >= 0")
    order = ["collection", "episode", "start_sec", "key"]
    if name in ("semantic", "hybrid"):
        scoped = scoped.join(semantic_scores.select("key", F.col("semantic").alias("semantic_score")), "key", "left")
        lexical = scoped.select("*", F.lit(0.0).alias("lexical_score"))
        if name == "hybrid":
            words, t = q.split(), F.col("_t")
            base = with_normal(scoped, normalize_text(F.col("text")))
            native = with_tokens(t, lambda ts: smart_lexical(t, ts, q, words))
            base = base.select("*", F.inline(F.array(F.struct(native.alias("_s")))))
            # Fuzzy comparison counts where no native rule settles a row, and where the row can reach the least score with it.
            known = F.coalesce("_s", F.lit(0.0))
            missing = (minimum_score - SEMANTIC_SHARE * F.coalesce("semantic_score", F.lit(0.0))) / LEXICAL_SHARE
            base = with_open(base, (known < SMART_ALL) & (t != ""), q, F.greatest(missing, known, F.lit(1e-9)) / FUZZY_SHARE)
            base = base.withColumn("_f", FUZZY_SHARE * fuzzy(F.col("_open"), t, q, words))
            lexical = base.withColumn("lexical_score", F.when(t == "", 0.0).otherwise(F.greatest(known, F.coalesce("_f", F.lit(0.0))))).drop("_t", "_open", "_s", "_f")
        score = hybrid(F.col("lexical_score"), F.col("semantic_score")) if name == "hybrid" else F.coalesce("semantic_score", F.lit(0.0))
        hits = kept(lexical, score, F.lit(name), minimum_score)
        if top_k is not None:
            hits = hits.orderBy(F.col("score").desc(), *order).limit(max(1, top_k))
    else:
        hits = search(scoped, q, name, minimum_score, top_k, "text", order, None, query_type)
        hits = hits.withColumn("lexical_score", F.col("score")).withColumn("semantic_score", F.lit(None).cast("double"))
    around = (F.col("previous_text"), F.col("next_text")) if include_context else (F.lit(""), F.lit(""))
    hits = hits.withColumn("context", context(around[0], F.col("text"), around[1]))
    if top_k is None:
        return hits
    # At most top_k rows are left, so that one task numbers them.
    ranked = Window.orderBy(F.col("score").desc(), *order)
    return hits.withColumn("rank", F.row_number().over(ranked))


def hit_frame(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: Rank, Roll, Episode, Speaker ID, Timestamp, Match, Relevance, Transcript, Targets, Audio."""
    targets = targets_text(F.col("targets")) if "targets" in hits.columns else F.lit("")
    audio = F.when(F.coalesce("audio_path", F.lit("")) != "", "Yes").otherwise("No") if "audio_path" in hits.columns else F.lit("No")
    return hits.select(
        F.col("rank").alias("Rank"), F.col("collection").alias("Roll"), F.col("episode").alias("Episode"), F.col("speaker_id").alias("Speaker ID"), time_range(F.col("start_sec"), F.col("end_sec")).alias("Timestamp"),
        F.col("match_type").alias("Match"), F.round("score", 3).alias("Relevance"), F.col("text").alias("Transcript"), targets.alias("Targets"), audio.alias("Audio"),
    )


def transcript(rows: DataFrame, episode: str) -> DataFrame:
    """An episode's rows as they are read: Time, Speaker, Speaker ID, Transcript, ASR confidence."""
    conf = F.round("mean_word_confidence", 3) if "mean_word_confidence" in rows.columns else F.lit(None).cast("double")
    own = rows.filter(F.col("global_episode") == episode)
    return own.select(time_range(F.col("start_sec"), F.col("end_sec")).alias("Time"), speaker_label(F.col("speaker_id")).alias("Speaker"), F.col("speaker_id").alias("Speaker ID"), F.col("text").alias("Transcript"), conf.alias("ASR confidence"))


def record(rows: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none."""
    return rows.filter(F.col("key") == key).limit(1)


def clip_span(start: Column, end: Column, padding: float = 2.0, longest: float | None = None) -> Column:
    """(start, duration) of the audio around a span: padded, not before 0, half a second at least, and at most `longest`."""
    length = end - start + 2 * padding
    length = F.least(length, F.lit(longest)) if longest is not None else length
    return F.struct(F.greatest(F.lit(0.0), start - padding).alias("start"), F.greatest(F.lit(0.5), length).alias("duration"))


def cached_vectors(rows: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(key, vector) of index rows, kept below `path` under the fingerprint of their keys and texts: encoded only where that is new.

    encode: from (key, text) to (key, vector), the model.
    """
    spark = rows.sparkSession
    # An order-free fingerprint, so that no row order has to be made: sums of two hashes, and the count.
    parts = rows.agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(k), "key", "text").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]).first()
    folder = f"{path.rstrip('/')}/{parts['n']}-{parts['h1'] or 0}-{parts['h2'] or 0}".replace("--", "-m")
    sc = spark.sparkContext
    done = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
        encode(rows.select("key", "text")).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def dot(v: Column, probe: Column) -> Column:
    return F.aggregate(F.zip_with(v, probe, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)


def semantic(rows: DataFrame, vector: str, probe: list[float]) -> DataFrame:
    """Adds raw (dot product of unit vectors) and semantic, scaled to 0..1 over all rows; constant scores are 1."""
    p = F.array(*[F.lit(float(x)) for x in probe])
    size = lambda v: F.sqrt(dot(v, v))
    raw = rows.withColumn("raw", dot(F.col(vector), p) / (size(F.col(vector)) * size(p)))
    span = raw.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))  # one row
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
    return raw.crossJoin(F.broadcast(span)).withColumn("semantic", scaled).drop("_lo", "_hi")


def hybrid(lexical: Column, semantic_score: Column) -> Column:
    return LEXICAL_SHARE * lexical + SEMANTIC_SHARE * F.coalesce(semantic_score, F.lit(0.0))


def context(previous: Column, text: Column, following: Column) -> Column:
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n\n", part("Previous", previous), part("Match", text), part("Next", following))


def scope(rows: DataFrame, collection: str | None = None, episode=None, speaker=None, include_unassigned: bool = False) -> DataFrame:
    """Rows of a scope; None disables a clause."""
    if collection is not None:
        rows = rows.filter(F.col("collection") == collection)
    if episode is not None:
        rows = rows.filter(F.col("episode") == episode)
    if speaker is not None:
        rows = rows.filter(F.col("speaker_id") == speaker)
    return rows if include_unassigned else rows.filter("speaker_id >= 0")
