"""A corpus of episodes: turns, speakers, and what each stage has made of an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

ELIGIBLE = ("ok", "short", "long")  # fixed values: duration flags of episodes that are worked on
LEAST_TURN_WORDS, LEAST_PAIR_WORDS, LEAST_WORDS, JUDGE_WORDS = 5, 6, 4, 150  # fixed values: words of a turn, a supervised pair, an utterance, a speaker


def eligible(registry: DataFrame, listed: bool = True) -> DataFrame:
    """Episodes to work on: those with a flag of ELIGIBLE, or (not listed) all but rejected ones, unflagged included."""
    flag = F.col("duration_flag")
    return registry.filter(flag.isin(*ELIGIBLE) if listed else ~flag.eqNullSafe(F.lit("rejected")))


def flagged_turns(turns: DataFrame, least: int = LEAST_TURN_WORDS) -> DataFrame:
    """Turns (text) with text_clean (loops collapsed), n_words of it, and the flags loop (of the raw text), too_short, usable and supervised (a pair may be learnt from)."""
    raw = T.tokens(F.coalesce("text", F.lit("")))
    rows = turns.withColumn("_ts", raw).withColumn("_clean", T.collapse_loops(F.col("_ts")))
    rows = rows.withColumn("text_clean", F.array_join("_clean", " ")).withColumn("n_words", F.size("_clean").cast("long")).withColumn("loop", T.is_loop(F.col("_ts")))
    rows = rows.withColumn("too_short", F.col("n_words") < least).drop("_ts", "_clean")
    return rows.withColumn("usable", ~F.col("loop") & ~F.col("too_short")).withColumn("supervised", ~F.col("loop") & (F.col("n_words") >= LEAST_PAIR_WORDS))


def speaker_units(turns: DataFrame, order: str = "turn", judge_words: int = JUDGE_WORDS) -> DataFrame:
    """Speakers of episodes from flagged turns (episode, speaker_id, dur_sec, asr_confidence, trusted).

    script joins the usable turns in order, with an empty line between; judgeable: a trusted, assigned speaker with enough clean words.
    """
    usable = F.col("usable")
    own = F.struct(F.col(order).alias("at"), F.col("text_clean").alias("text"))
    units = turns.groupBy("episode", "speaker_id").agg(
        F.count("*").alias("n_turns"), F.count_if(usable).alias("n_usable_turns"), F.sum("n_words").alias("n_words"), F.coalesce(F.sum(F.when(usable, F.col("n_words"))), F.lit(0)).alias("n_clean_words"),
        F.round(F.sum("dur_sec"), 1).alias("dur_sec"), F.count_if("loop").alias("n_loop_turns"), F.round(F.avg("asr_confidence"), 4).alias("mean_asr_confidence"), F.bool_and("trusted").alias("trusted"),
        F.array_sort(F.collect_list(F.when(usable, own))).alias("_own"),
    )
    judgeable = F.col("trusted") & (F.col("speaker_id") != -1) & (F.col("n_clean_words") >= judge_words)
    units = units.withColumn("mean_words_per_turn", F.round(F.col("n_words") / F.greatest(F.col("n_turns"), F.lit(1)), 1)).withColumn("judgeable", judgeable)
    return units.withColumn("script", F.array_join(F.transform("_own", lambda x: x["text"]), "\n\n")).withColumn("turn_ids", F.transform("_own", lambda x: x["at"])).drop("_own")


def episode_quality(utterances: DataFrame) -> DataFrame:
    """episode, utterances, repetition_loops, leading_truncations, too_short: what recognition got wrong; empty texts count as utterances only."""
    t = F.btrim(F.coalesce("text", F.lit("")))
    ts = T.tokens(t)
    some = t != ""
    return utterances.groupBy("episode").agg(
        F.count("*").alias("utterances"), F.count_if(some & T.is_loop(ts)).alias("repetition_loops"), F.count_if(some & T.leading_truncated(t)).alias("leading_truncations"), F.count_if(some & (F.size(ts) < LEAST_WORDS)).alias("too_short"),
    )


def episode_rows(episodes: DataFrame) -> DataFrame:
    """Episodes (collection, episode, programme, duration_sec, speakers, utterances, words, assignment_rate, provider, model, audio_path) as they are shown, by key."""
    name = F.regexp_extract(F.coalesce("model", F.lit("")), r"([^/]+)/*$", 1)
    return episodes.select(
        F.col("collection").alias("Roll"), F.col("episode").alias("Episode"), F.col("programme").alias("Programme"), T.format_timestamp(F.col("duration_sec")).alias("Duration"), F.col("speakers").alias("Speakers"),
        F.col("utterances").alias("Utterances"), F.col("words").alias("Words"), percent(F.col("assignment_rate")).alias("Assigned"), F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("unknown")).alias("Diarization"),
        F.when(name == "", "unknown").otherwise(name).alias("ASR model"), F.when(F.coalesce("audio_path", F.lit("")) != "", "Available").otherwise("Missing").alias("Audio"),
    )


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.2f", F.round(share * 100, 2)), F.lit("%"))


def asr_audit(segments: DataFrame) -> DataFrame:
    """episode, segments, words, timestamped_words from segments (episode, words array<struct<start, end, word>>)."""
    stamped = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    n = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).cast("long")
    return segments.groupBy("episode").agg(F.count("*").alias("segments"), n("words").alias("words"), n(stamped).alias("timestamped_words"))


def fusion_stats(words: DataFrame) -> DataFrame:
    """episode, n_words, n_utterances, unassigned_words, coarse_tokens from words (episode, utterance_id, speaker_id, coarse)."""
    return words.groupBy("episode").agg(
        F.count("*").alias("n_words"), F.countDistinct("utterance_id").alias("n_utterances"), F.count_if(F.coalesce("speaker_id", F.lit(-1)) < 0).alias("unassigned_words"), F.count_if(F.coalesce("coarse", F.lit(False))).alias("coarse_tokens"),
    )


def stage_rows(episodes: DataFrame, stages: dict[str, DataFrame], key: str = "episode") -> DataFrame:
    """For each episode and stage <name>_state (Ready, if the stage has rows for it, else Missing) and <name>_rows."""
    out = episodes
    for name, rows in stages.items():
        n = rows.groupBy(key).agg(F.count("*").alias(f"{name}_rows"))
        out = out.join(n, key, "left").withColumn(f"{name}_rows", F.coalesce(f"{name}_rows", F.lit(0)))
        out = out.withColumn(f"{name}_state", F.when(F.col(f"{name}_rows") > 0, "Ready").otherwise("Missing"))
    return out


def stage_summary(rows: DataFrame, stages: list[str]) -> DataFrame:
    """stage, ready, episodes: how many episodes each stage is ready for."""
    counts = rows.agg(*[F.count_if(F.col(f"{s}_state") == "Ready").alias(s) for s in stages], F.count("*").alias("_n"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("ready"), F.col("_n").alias("episodes")) for s in stages])))


# What a corpus should hold, and the seconds of a good episode.
NEEDS = {"min_episodes": 8, "max_episodes": 12, "min_programmes": 4, "min_remote_guest": 2, "min_market_news": 1}
IN_WINDOW = (1800, 3600)


def diversity(registry: DataFrame, needs: dict[str, int] | None = None) -> DataFrame:
    """One row: counts of the episodes that aren't rejected, mean, least and most minutes, and gaps, a message for each need that isn't met."""
    needs = needs or NEEDS
    rows = registry.filter(~F.col("duration_flag").eqNullSafe(F.lit("rejected")))
    yes = lambda c: F.count_if(F.lower(F.col(c).cast("string")) == "true")
    one = rows.agg(
        F.count("*").alias("n_episodes"), F.countDistinct("programme").alias("n_programmes"), yes("has_remote_guest").alias("n_remote_guest"), yes("covers_market_news").alias("n_market_news"),
        F.count_if(F.col("duration_sec").between(*IN_WINDOW)).alias("in_window"), F.round(F.coalesce(F.avg("duration_sec"), F.lit(0)) / 60, 2).alias("mean_duration_min"),
        F.round(F.coalesce(F.min("duration_sec"), F.lit(0)) / 60, 2).alias("min_duration_min"), F.round(F.coalesce(F.max("duration_sec"), F.lit(0)) / 60, 2).alias("max_duration_min"),
    )
    n, few = F.col("n_episodes"), needs
    under = lambda column, least, what: F.when(F.col(column) < least, F.format_string(f"%d {what}, need {least}", F.col(column)))
    gaps = [
        under("n_episodes", few["min_episodes"], "episodes"), F.when(n > few["max_episodes"], F.format_string(f"%d episodes, at most {few['max_episodes']}", n)), under("n_programmes", few["min_programmes"], "programmes"),
        under("n_remote_guest", few["min_remote_guest"], "episodes with remote guests"), under("n_market_news", few["min_market_news"], "episodes with market news"),
        F.when(F.col("in_window") != n, F.format_string("%d of %d episodes are shorter or longer than they should be", n - F.col("in_window"), n)),
    ]
    return one.withColumn("gaps", F.filter(F.array(*gaps), lambda g: g.isNotNull()))


def registry_summary(registry: DataFrame) -> DataFrame:
    """One row: total, episodes of each flag, and the distinct reasons of rejection, sorted."""
    flag = F.col("duration_flag")
    counts = [F.count_if(flag == x).alias(x) for x in (*ELIGIBLE, "rejected")]
    return registry.agg(F.count("*").alias("total"), *counts, F.array_sort(F.collect_set(F.when(flag == "rejected", F.col("rejection_reason")))).alias("rejection_reasons"))


def run_mode(episodes: Column, programmes: Column) -> Column:
    """SMOKE for under 8 episodes or 4 programmes, PIPELINE-LOW-N for under 16, else PIPELINE (fixed values)."""
    return F.when((episodes < 8) | (programmes < 4), "SMOKE").when(episodes < 16, "PIPELINE-LOW-N").otherwise("PIPELINE")


def replaced_chunks(rows: DataFrame, again: DataFrame, threshold: float) -> DataFrame:
    """Words of chunks (episode, chunk, chunk_start, start, end, word, prob) in absolute time; chunks whose mean prob is under threshold are those of `again`, if it has them."""
    low = rows.groupBy("episode", "chunk").agg(F.avg("prob").alias("_p")).filter(F.col("_p") < threshold).select("episode", "chunk")
    low = low.join(again.select("episode", "chunk").distinct(), ["episode", "chunk"])
    both = rows.join(low, ["episode", "chunk"], "left_anti").unionByName(again.join(low, ["episode", "chunk"]).select(*rows.columns))
    at = lambda c: F.col("chunk_start") + F.col(c)
    return both.withColumn("start", at("start")).withColumn("end", at("end")).drop("chunk_start")


def hysteresis(rows: DataFrame, key: str, order: list[str], value: Column, on: float, off: float) -> DataFrame:
    """key, island, first, last, n: stretches that begin where the value reaches `on` and go on as long as it is `off` or more."""
    w = Window.partitionBy(key).orderBy(*order)
    state = F.when(value >= on, F.lit(1)).when(value < off, F.lit(0))
    rows = rows.withColumn("_s", F.coalesce(F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    begins = ((F.col("_s") == 1) & (F.coalesce(F.lag("_s").over(w), F.lit(0)) == 0)).cast("int")
    rows = rows.withColumn("_b", begins).withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_s = 1").groupBy(key, "island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))
