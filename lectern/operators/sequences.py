"""Ordered operators inside an episode: turns, utterances, chunks, roles."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import scans as SC
from lectern.operators.intervals import touching
from lectern.session import stored


def neighbours(rows: DataFrame, key: str = "episode", order: str = "turn", text: str = "text") -> DataFrame:
    """Adds previous_text and next_text, empty at the ends."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("previous_text", F.lag(text, 1, "").over(w)).withColumn("next_text", F.lead(text, 1, "").over(w))


def numbered(rows: DataFrame, prefix: str, digits: int, key: str = "episode", order: str = "turn") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("number_id", F.format_string(f"%s_{prefix}%0{digits}d", F.col(key).cast("string"), n))


def merge_turns(rows: DataFrame, gap: float, start: str = "start", end: str = "end") -> DataFrame:
    """Neighbours of one speaker at most gap apart become one turn: episode, turn_index, speaker_id, start, end, n_windows, n_words."""
    w = Window.partitionBy("episode").orderBy(start, "turn")
    new = (F.lag("speaker_id").over(w).isNull() | (F.lag("speaker_id").over(w) != F.col("speaker_id")) | (F.col(start) - F.lag(end).over(w) > gap)).cast("int")
    grouped = rows.withColumn("_new", new).withColumn("turn_index", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    last = F.max_by(end, F.struct(start, "turn"))
    return grouped.groupBy("episode", "turn_index").agg(F.first("speaker_id").alias("speaker_id"), F.min(start).alias("start"), last.alias("end"), F.count("*").alias("n_windows"), F.sum("n_words").alias("n_words"))


def first_appearance(rows: DataFrame, key: str = "episode", who: str = "speaker", at: str = "start_ms") -> DataFrame:
    """key, who, speaker_no: speakers numbered by when they first appear (ties by name)."""
    first = rows.groupBy(key, who).agg(F.min(at).alias("_first"))
    return first.select(key, who, (F.row_number().over(Window.partitionBy(key).orderBy("_first", who)) - 1).cast("long").alias("speaker_no"))


def chunk(rows: DataFrame, seconds: int, start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """A row for each stretch of at most `seconds` from start to end: chunk_index, chunk_start, chunk_end."""
    n = F.ceil((F.col(end) - F.col(start)) / seconds).cast("int")
    out = rows.filter(F.col(end) > F.col(start)).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    at = F.col(start) + F.col("chunk_index") * seconds
    return out.withColumn("chunk_start", at).withColumn("chunk_end", F.least(at + seconds, F.col(end)))


def roles_by_share(rows: DataFrame) -> DataFrame:
    """episode, speaker_id, role: the host's share of turns exceeds its share of words most.

    rows: episode, speaker_id, start, n_words. Only speakers with three turns count; ties by speaker.
    """
    per = rows.groupBy("episode", "speaker_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"), F.min("start").alias("f"))
    ep = Window.partitionBy("episode")
    live = (F.col("n") >= 3) & (F.col("speaker_id") != -1)
    per = per.withColumn("live", live).withColumn("first", F.col("f") == F.min("f").over(ep))
    turns, words = (F.sum(F.when(F.col("live"), F.col(c))).over(ep) for c in ("n", "w"))
    score = F.col("n") / turns - F.col("w") / F.greatest(words, F.lit(1)) + F.when(F.col("first"), 0.05).otherwise(0.0)
    per = per.withColumn("score", F.when(F.col("live"), score)).withColumn("any", F.max("live").over(ep))
    rank = F.row_number().over(ep.orderBy(F.col("score").desc_nulls_last(), "speaker_id"))
    role = F.when(~F.col("any"), "unknown").when(F.col("speaker_id") == -1, "unassigned").when(F.col("rank") == 1, "host").when(F.col("live"), "guest").otherwise("minor")
    return per.withColumn("rank", rank).select("episode", "speaker_id", role.alias("inferred_role"))


def roles_by_airtime(rows: DataFrame, early: float) -> DataFrame:
    """episode, speaker_id, role: host has most turns (three more if it speaks by `early`), then most airtime, then speaks first."""
    per = rows.groupBy("episode", "speaker_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("air"), F.min("start").alias("f"))
    points = F.col("n") + F.when(F.col("f") <= early, 3).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("episode").orderBy(points.desc(), F.col("air").desc(), "f", "speaker_id"))
    return per.select("episode", "speaker_id", F.when(rank == 1, "host").otherwise("guest").alias("inferred_role"))


#: Time of a stretch of words, in the unit of their times (ten minutes of tenths).
STRETCH_TIME = 6000


def segment_words(words: DataFrame, gap: int = 20, longest: int = 280, stretch: int = STRETCH_TIME) -> DataFrame:
    """Utterances of words (episode, speaker_id, turn, idx, start, end, word): a new one where the speaker changes, after a gap, after
    a sentence's end, and where the utterance would grow longer than `longest`. Times are whole numbers, and no word ends before it starts.

    The last rule depends on the utterance's own start. But where an utterance that began at a word would end is known from times alone: at the first word behind
    that ends too late, which either starts after the limit or is being spoken then, or at a break by the other rules. These links, followed from
    the breaks, lead to the starts there really are. An episode is shared by tasks in stretches of time.
    """
    order = ["start", "end", "turn", "idx"]
    ends_sentence = F.col("word").rlike("[।!?؟]$")
    rows = SC.numbered(words, F.col("start"), stretch, order, {"speaker": F.col("speaker_id"), "end": F.col("end"), "sentence": ends_sentence})
    before = F.col("previous")
    new = before.isNull() | (before["speaker"] != F.col("speaker_id")) | (F.col("start") - before["end"] > gap) | before["sentence"]
    rows = stored(rows.select("episode", SC.STRETCH, "k", "speaker_id", "start", "end", new.alias("new")), "words")
    limit = rows.select("episode", F.col("k").alias("id"), (F.col("start") + longest).alias("at"))
    later = SC.upto(rows.select("episode", F.col("start").alias("at")), limit, stretch).select("episode", F.col("id").alias("k"), (F.col("n") + 1).alias("later"))
    # Words that are being spoken at the limit meet it in its bucket of time.
    spoken = rows.select("episode", F.col("k").alias("to"), F.col("start").alias("r_start"), (F.col("end") - 1).alias("r_end")).filter("r_end >= r_start")
    points = limit.select("episode", F.col("id").alias("k"), F.col("at").alias("start"), F.col("at").alias("end"))
    during = touching(points, spoken, ["episode"], 300).filter("to > k").groupBy("episode", "k").agg(F.min("to").alias("during"))
    links = SC.following(rows, F.col("new")).join(later, ["episode", "k"]).join(during, ["episode", "k"], "left")
    soft = F.coalesce("during", "later")
    # A link to a break leads to what is a start anyway, and one beyond the last word nowhere.
    last = rows.groupBy("episode").agg(F.max("k").alias("last"))
    links = links.select("episode", "k", soft.alias("to"), "next_mark").join(last, "episode")
    links = links.filter((F.col("to") <= F.col("last")) & (F.col("next_mark").isNull() | (F.col("to") < F.col("next_mark")))).select("episode", "k", "to")
    begun = SC.reached(rows.filter("new"), links, stored).withColumn("begins", F.lit(True))
    rows = SC.running(rows.join(begun, ["episode", "k"], "left"), F.coalesce("begins", F.lit(False)), "n")
    out = rows.groupBy("episode", (F.col("n") - 1).alias("utterance_index")).agg(F.min_by("speaker_id", "k").alias("speaker_id"), F.min_by("start", "k").alias("start"), F.max_by("end", "k").alias("end"), F.count("*").alias("n_words"))
    return out.select("episode", "speaker_id", "start", "end", "n_words", "utterance_index")


#: Segments that a stretch of time has on average, and its least time in milliseconds (an hour).
STRETCH_ROWS, STRETCH_MS = 4096, 3_600_000

Line = tuple[int, str | None] | None  # the end that the next other speaker must keep its distance from, and whose it is


def accepted(line: Line, speaker: str | None, start: int, end: int, gap: int) -> tuple[int, Line]:
    """The start that a segment gets behind a line, and the line behind it; the same line if nothing of the segment is left."""
    if line is not None and speaker != line[1]:
        start = max(start, line[0] + gap)
    if end <= start:
        return start, line
    return start, (end if line is None else max(line[0], end), speaker)


class Stretch:
    """Segments of one stretch of time in order, as a function of the line that comes in.

    A line matters until the first segment that ends beyond it (by the gap, for other speakers): from there on the line is that
    segment's end, whatever it was before. So the function has a step for each segment that can be the first, and of these only
    such are kept as a line that comes in, at most the largest end before, can reach.
    """

    def __init__(self, segments: list[tuple[str | None, int, int]], gap: int):
        self.segments, self.gap = [x for x in segments if x[2] > x[1]], gap
        self.exits: dict[int, tuple[int, str | None]] = {}

    def exit(self, i: int) -> tuple[int, str | None]:
        """The line behind the stretch if it is at segment i's end there."""
        way, line = [], (self.segments[i][2], self.segments[i][0])
        while True:
            if i in self.exits:
                line = self.exits[i]
                break
            way.append(i)
            for j in range(i + 1, len(self.segments)):
                moved = accepted(line, *self.segments[j], self.gap)[1]
                if moved != line:
                    i, line = j, moved
                    break
            else:
                break
        self.exits.update(dict.fromkeys(way, line))
        return line

    def steps(self, who: str | None, named: bool, most: int | None) -> list[tuple[int, int, str | None]]:
        """(bound, line's end, its speaker) by rising bounds: a line of `who` (or of nobody here) below the bound comes out as that. most: as above; None for no line."""
        if most is None:
            return [(0, *self.exit(0))] if self.segments else []
        out, best = [], None
        for i, (speaker, _, end) in enumerate(self.segments):
            bound = end if named and speaker == who else end - self.gap
            if best is None or bound > best:
                out.append((bound, *self.exit(i)))
                best = bound
                if best > most:
                    break
        return out


def spaced(segments: DataFrame, gap: int, stretch: int) -> DataFrame:
    """episode, speaker, start_ms, end_ms: in order of time, different speakers are set at least `gap` apart by moving starts; what has no length left goes.

    The line behind which a segment may start depends on all before it, so it is carried over stretches of time as a composition of functions: each stretch is
    summarised by the steps of its function, one task folds an episode's steps (a few for a stretch), and each stretch is then worked
    through from the line that comes in.
    """
    order = lambda rows: sorted(rows, key=lambda x: (x[1], x[2], x[0] is not None, x[0] or ""))  # noqa: E731  nulls first, as in Spark
    rows = segments.select("episode", F.col("speaker").cast("string").alias("speaker"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.floor(F.col("start_ms") / stretch).alias("stretch"))
    line = Window.partitionBy("episode").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("episode", "stretch").agg(F.max("end_ms").alias("top")).select("episode", "stretch", F.max("top").over(line).alias("most"))
    rows = stored(rows.join(ends, ["episode", "stretch"]), "segments")
    read = lambda t: order(zip(*[t.column(c).to_pylist() for c in ("speaker", "start_ms", "end_ms")], strict=True))
    kind = rows.schema["episode"].dataType.simpleString()

    def summary(t: pa.Table) -> pa.Table:
        own, most = Stretch(read(t), gap), t.column("most")[0].as_py()
        made = [(0, None, own.steps(None, False, None))]
        if most is not None:
            made += [(1, None, own.steps(None, False, most))] + [(2, w, own.steps(w, True, most)) for w in {x[0] for x in own.segments}]
        part = lambda k: pa.array([[s[k] for s in steps] for _, _, steps in made], pa.list_(pa.string() if k == 2 else pa.int64()))
        one = lambda name: t.column(name).slice(0, 1).combine_chunks().take(pa.array([0] * len(made)))
        return pa.table({"episode": one("episode"), "stretch": one("stretch"), "kind": pa.array([x[0] for x in made], pa.int32()), "who": pa.array([x[1] for x in made], pa.string()), "bounds": part(0), "ends": part(1), "whos": part(2)})

    def fold(t: pa.Table) -> pa.Table:
        line, stretches, steps = None, [], {}
        for x in t.to_pylist():
            steps.setdefault(x["stretch"], {})[x["kind"], x["who"]] = x["bounds"], x["ends"], x["whos"]
        for at in sorted(steps):
            stretches.append((at, *(line or (None, None))))
            own = steps[at]
            bounds, ends, whos = own[0, None] if line is None else own.get((2, line[1]), own[1, None])
            k = 0 if line is None else bisect_right(bounds, line[0])
            if k < len(bounds):
                line = ends[k], whos[k]
        one = t.column("episode").slice(0, 1).combine_chunks().take(pa.array([0] * len(stretches)))
        return pa.table({"episode": one, "stretch": pa.array([x[0] for x in stretches], pa.int64()), "line": pa.array([x[1] for x in stretches], pa.int64()), "who": pa.array([x[2] for x in stretches], pa.string())})

    def apply(t: pa.Table) -> pa.Table:
        end, who = t.column("line")[0].as_py(), t.column("who")[0].as_py()
        line, out = None if end is None else (end, who), []
        for speaker, start, end in read(t):
            start, line = accepted(line, speaker, start, end, gap)
            if end > start:
                out.append((speaker, start, end))
        one = t.column("episode").slice(0, 1).combine_chunks().take(pa.array([0] * len(out), pa.int64()))
        return pa.table({"episode": one, "speaker": pa.array([x[0] for x in out], pa.string()), "start_ms": pa.array([x[1] for x in out], pa.int64()), "end_ms": pa.array([x[2] for x in out], pa.int64())})

    steps = rows.groupBy("episode", "stretch").applyInArrow(summary, f"episode {kind}, stretch long, kind int, who string, bounds array<long>, ends array<long>, whos array<string>")
    entries = steps.groupBy("episode").applyInArrow(fold, f"episode {kind}, stretch long, line long, who string")
    return rows.join(entries, ["episode", "stretch"]).groupBy("episode", "stretch").applyInArrow(apply, f"episode {kind}, speaker string, start_ms long, end_ms long")


def stretch_time(segments: DataFrame) -> int:
    """The time in which an episode has STRETCH_ROWS segments on average."""
    each = segments.groupBy("episode").agg((F.max("start_ms") - F.min("start_ms")).alias("time"), F.count("*").alias("n"))
    time, n = each.agg(F.coalesce(F.sum("time"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(1))).first()
    return max(STRETCH_MS, int(time) * STRETCH_ROWS // max(1, int(n)))


def clean_segments(segments: DataFrame, gap: int = 170, merge: int = 3790, shortest: int = 750, least_total: int = 9000, stretch: int | None = None) -> DataFrame:
    """Post-processing of raw segments (episode, speaker, start_ms, end_ms); an episode is shared by tasks in stretches of time.

    In order of time, different speakers are set at least `gap` apart by moving starts; then segments of one speaker at most `merge` apart are joined, those
    shorter than `shortest` go, speakers with less than `least_total` go, and the rest are numbered by first appearance.
    """
    stretch = stretch or stretch_time(segments)
    rows = SC.numbered(spaced(segments, gap, stretch), F.col("start_ms"), stretch, ["start_ms", "end_ms", "speaker"], {"speaker": F.col("speaker"), "end": F.col("end_ms")})
    before = F.col("previous")
    new = before["speaker"].isNull() | (before["speaker"] != F.col("speaker")) | (F.col("start_ms") - before["end"] > merge)
    rows = SC.running(rows, new, "run")
    rows = rows.groupBy("episode", "run").agg(F.min_by("speaker", "k").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    rows = rows.filter(F.col("end_ms") - F.col("start_ms") >= shortest)
    totals = rows.groupBy("episode", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"), F.min("start_ms").alias("first")).filter(F.col("total") >= least_total)
    ids = totals.select("episode", "speaker", (F.row_number().over(Window.partitionBy("episode").orderBy("first", "speaker")) - 1).cast("long").alias("speaker_no"))
    return rows.join(ids, ["episode", "speaker"]).select("episode", "speaker_no", "start_ms", "end_ms")


def bucket_rms(rows: DataFrame, n: int, key: str, order: list[str], value: str, power: float = 0.62) -> DataFrame:
    """key, bucket, level: root mean square of equal-size buckets, by the largest, to a power."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(*order)) - 1
    rows = rows.withColumn("bucket", F.floor(place * n / F.count("*").over(w)).cast("long"))
    rms = rows.groupBy(key, "bucket").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    top = F.max("rms").over(w)
    return rms.select(key, "bucket", F.when(top > 0, F.pow(F.col("rms") / top, F.lit(power))).otherwise(F.lit(0.0)).alias("level"))


def padded_first(rows: DataFrame, most: int, key: list[str], order: str, value: str) -> DataFrame:
    """The first `most` values of each key as an array padded with nulls, and how many are real."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    top = rows.withColumn("_n", n).filter(F.col("_n") <= most).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_l"))
    vals = F.transform("_l", lambda x: x[value])
    pad: Column = F.array_repeat(F.lit(None).cast(rows.schema[value].dataType), F.lit(most) - F.size("_l"))
    return top.select(*key, F.concat(vals, pad).alias("padded"), F.size("_l").cast("long").alias("n_real"))


def islands(rows: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """key, island, n: runs of neighbouring rows for which hit is true."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_hit", hit)
    start = (F.col("_hit") & ~F.coalesce(F.lag("_hit").over(w), F.lit(False))).cast("int")
    rows = rows.withColumn("_start", start).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_hit").groupBy(key, "island").agg(F.count("*").alias("n"))
