"""Structured Streaming: sessions of events, and turns by custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of event files; times without a zone are taken as the session's."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n, total: sessions that a gap ends; with a watermark, so state stays bounded."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windows(events: DataFrame, key: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows by key."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """key, n, total after each micro-batch, by state of our own."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame([(k[0], n, total)], columns=[key, "n", "total"])

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now, to parquet, exactly once over restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


#: What a stream of words has: ts is the time of its start, times count in units of UNIT_MS.
WORDS = "episode long, speaker_id long, turn long, idx long, start long, end long, word string, ts timestamp"
UTTERANCES = "episode long, speaker_id long, start long, end long, n_words long, utterance_index long"
UNIT_MS = 100


class Segmenter(StatefulProcessor):
    """Utterances of an episode's words by the rules of segment_words, whatever the order in which words come within the watermark.

    A word waits until the watermark has passed its start, as no earlier one can come then; a timer of its start reads what waits up to
    there in order. An utterance is given when a word begins the next one, or when the watermark passes the gap behind it; with it goes all state but its number.
    """

    def __init__(self, gap: int, longest: int):
        self.gap, self.longest = gap, longest

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "speaker_id long, turn long, idx long, start long, end long, word string, at long")
        self.open = handle.getValueState("open", "speaker_id long, start long, end long, n_words long, sentence boolean, closes long")
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            fields = zip(*[pdf[c].tolist() for c in ("speaker_id", "turn", "idx", "start", "end", "word")], at.tolist(), strict=True)
            self.waiting.appendList(list(fields))
            for t in at.unique().tolist():
                self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((w for w in waiting if w[6] <= now), key=lambda w: (w[3], w[4], w[1], w[2]))
        one = self.open.get() if self.open.exists() else None
        for speaker, _, _, start, end, word, at in due:
            if one is not None and (speaker != one[0] or start - one[2] > self.gap or end - one[1] > self.longest or one[4]):
                out.append(self.numbered(key, one))
                one = None
            closes = at + (end - start + self.gap) * UNIT_MS + 1
            one = (speaker, start if one is None else one[1], end, 1 if one is None else one[3] + 1, bool(word) and word[-1] in "।!?؟", closes)
        if one is not None:
            self.handle.registerTimer(one[5])
        left = [w for w in waiting if w[6] > now]
        # All words up to the watermark are here; a timer that is set at a time it has passed would wait for another batch.
        if one is not None and one[5] <= max(now, timerValues.getCurrentWatermarkInMs()) and all(w[6] > one[5] for w in left):
            out.append(self.numbered(key, one))
            one = None
        if due:
            self.waiting.put(left) if left else self.waiting.clear()
        self.open.update(one) if one is not None else self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["episode", "speaker_id", "start", "end", "n_words", "utterance_index"])

    def numbered(self, key, one) -> tuple:
        n = self.number.get()[0] if self.number.exists() else 0
        self.number.update((n + 1,))
        return (key[0], *one[:4], n)

    def close(self) -> None:
        pass


def segmented(words: DataFrame, gap: int = 20, longest: int = 280, late: str = "10 minutes") -> DataFrame:
    """Utterances of a stream of words (WORDS), which may come out of order by `late`; needs the RocksDB state store."""
    kept = words.withWatermark("ts", late).groupBy("episode")
    return kept.transformWithStateInPandas(Segmenter(gap, longest), UTTERANCES, "Append", "EventTime")


def write_keyed(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now, to Parquet below `batch`: a batch that runs again after a failure replaces what it wrote, so that no row is there twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
