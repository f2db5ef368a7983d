"""Which recording an episode was transcribed from."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import nfc_casefold
from lectern.operators.intervals import touching
from lectern.session import stored

TOLERANCE, LOCK_TOLERANCE = 2.0, 1.0  # fixed values: seconds that lengths may differ by; that a transcript's end and a recording's may


def locked(episodes: DataFrame, recordings: DataFrame, tolerance: float = LOCK_TOLERANCE, width: float = 60.0) -> DataFrame:
    """collection, episode, path of pairs that nothing else contests.

    episodes: collection, episode, end_sec; recordings: collection, path, duration. An episode that ends within `tolerance` of one recording alone
    has it if no other episode has that one as its only candidate.
    """
    e = episodes.filter("end_sec > 0").select("collection", "episode", F.col("end_sec").alias("at"), (F.col("end_sec") - tolerance).alias("start"), (F.col("end_sec") + tolerance).alias("end"))
    r = recordings.filter("duration IS NOT NULL").select("collection", "path", F.col("duration").alias("r_start"), F.col("duration").alias("r_end"))
    pairs = touching(e, r, ["collection"], width).filter(F.abs(F.col("at") - F.col("r_start")) <= tolerance)
    only = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("collection", "episode"))).filter("_n = 1")
    return only.withColumn("_k", F.count("*").over(Window.partitionBy("collection", "path"))).filter("_k = 1").select("collection", "episode", "path")


def resolved(episodes: DataFrame, recordings: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """episodes with path and how: exact, name, duration or number, null if none fits.

    episodes: collection, episode, local_path, duration_sec, end_sec; recordings: collection, path, duration. In order of rules: the recording at
    the stated path; one with its file name (composed, in any case); the nearest in length, by the stated duration and else by the transcript's end,
    within `tolerance`; and the one numbered as the episode is, unless its length speaks against it. A recording shorter than the transcript by more than the tolerance
    is none, and the last three rules skip recordings that an earlier episode has. That makes them depend on each other, so that a collection's
    episodes are read in order of their ids; each looks at the few recordings that its rules name, and the nearest free length is found by links over those taken.
    Only recordings that some episode may come to (within_reach) go there, so that a collection takes memory by its episodes.
    """
    name = lambda c: nfc_casefold(F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1))
    e = episodes.select("collection", "episode", F.coalesce("local_path", F.lit("")).alias("local_path"), name(F.col("local_path")).alias("name"), F.coalesce(F.col("duration_sec").cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(F.col("end_sec").cast("double"), F.lit(0.0)).alias("end_sec"))
    r = recordings.filter("path IS NOT NULL").select("collection", "path", name(F.col("path")).alias("name"), F.col("duration").cast("double").alias("duration"))
    r = within_reach(e, r, tolerance)
    kinds = {c: episodes.schema[c].dataType.simpleString() for c in ("collection", "episode")}

    def run(eps: pd.DataFrame, recs: pd.DataFrame) -> pd.DataFrame:
        free = Free(recs.sort_values("path", kind="stable"), tolerance)
        order = ["episode", "local_path", "name", "duration", "end_sec"]
        out = [(c, e, *free.choice(e, local, n, d, end)) for c, e, local, n, d, end in eps.sort_values(order)[["collection", *order]].itertuples(index=False)]
        return pd.DataFrame(out, columns=["collection", "episode", "path", "how"])

    found = e.groupBy("collection").cogroup(r.groupBy("collection")).applyInPandas(run, f"collection {kinds['collection']}, episode {kinds['episode']}, path string, how string")
    return episodes.join(found, ["collection", "episode"], "left")


def within_reach(episodes: DataFrame, recordings: DataFrame, tolerance: float) -> DataFrame:
    """The recordings (collection, path, name, duration) that the rules may give to one of the episodes (collection, episode, local_path, name, duration, end_sec).

    Those are the ones that a local path, a file name or a number names, and some by their lengths. A search for the nearest goes past a length only
    if all its recordings are taken, so that the lengths passed between two that aren't hold no more recordings than may be taken there: one for
    each length that an episode looks for in between, for each that is named, and for each whose path is there again. A length at which, of all such
    stretches around it, none has so few can't be passed. Of each length as many recordings are kept, in order of their paths, as may be taken between
    its neighbours that can't be passed, and one that is left.
    """
    r = recordings
    by_name = lambda name, path: F.when(F.col(name) == "", F.concat(F.lit("p"), path)).otherwise(F.concat(F.lit("n"), name))
    digits = F.regexp_extract(F.col("episode").cast("string"), r"([0-9]+)\z", 1)
    number = F.when(digits != "", F.concat(F.lit("s"), F.regexp_replace(digits, r"^0+(?=[0-9])", "")))
    stem = F.regexp_replace("name", r"\.[^.]*\z", "")
    own = F.when(stem.rlike(r"\A[0-9]+\z"), F.concat(F.lit("s"), F.regexp_replace(stem, r"^0+(?=[0-9])", "")))
    asked = episodes.select("collection", F.explode(F.array(F.when(F.col("local_path") != "", by_name("name", F.col("local_path"))), number)).alias("_key")).filter("_key IS NOT NULL").distinct()
    keyed = r.select("*", F.explode(F.array(by_name("name", F.col("path")), own)).alias("_key")).filter("_key IS NOT NULL")
    named = stored(keyed.join(asked, ["collection", "_key"], "left_semi").drop("_key").distinct(), "named")
    known = lambda rows: rows.filter("duration IS NOT NULL AND NOT isnan(duration)")
    again = r.join(r.groupBy("collection", "path").count().filter("count > 1").select("collection", "path"), ["collection", "path"], "left_semi")
    end = F.nanvl("end_sec", F.lit(0.0))
    wanted = episodes.select("collection", end.alias("end"), F.explode(F.array(F.nanvl("duration", F.lit(0.0)), end)).alias("w")).filter("w > 0")
    wanted = wanted.select("collection", F.explode(F.array_distinct(F.array("w", F.when(F.col("end") > 0, F.greatest("w", F.col("end") - tolerance)).otherwise(F.col("w"))))).alias("at"))
    taken = reduce(DataFrame.unionByName, [wanted, *[known(x).select("collection", F.col("duration").alias("at")) for x in (named, again)]])
    line = known(r).groupBy("collection", F.col("duration").alias("at")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("c"))
    line = line.unionByName(taken.groupBy("collection", "at").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("c"))).groupBy("collection", "at").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    up, down = (Window.partitionBy("collection").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("at", F.desc("at")))
    # Before a length and behind it: what may be taken, and how many recordings there are.
    line = line.withColumn("_c", F.coalesce(F.sum("c").over(up), F.lit(0)) + F.col("c")).withColumn("_n", F.coalesce(F.sum("n").over(up), F.lit(0)) + F.col("n"))
    line = line.withColumn("_low", F.least(F.lit(0), F.min(F.col("_c") - F.col("_n")).over(up)))
    all_ = Window.partitionBy("collection")
    line = line.withColumn("_all", F.max("_c").over(all_)).withColumn("_end", F.max("_c").over(all_) - F.max("_n").over(all_))
    line = line.withColumn("_high", F.greatest(F.col("_end"), F.max(F.col("_c") - F.col("_n") + F.col("n")).over(down)))
    line = line.withColumn("_stop", F.when((F.col("n") > 0) & (F.col("_high") < F.col("_low")), F.col("_c")))
    line = line.withColumn("_after", F.coalesce(F.last("_stop", ignorenulls=True).over(down), F.col("_all"))).withColumn("_before", F.coalesce(F.last("_stop", ignorenulls=True).over(up), F.lit(0)))
    places = line.filter((F.col("n") > 0) & (F.col("_after") > F.col("_before"))).select("collection", F.col("at").alias("duration"), (F.col("_after") - F.col("_before") + 1).alias("_most"))
    rank = F.row_number().over(Window.partitionBy("collection", "duration").orderBy("path"))
    near = r.join(places, ["collection", "duration"]).withColumn("_rank", rank).filter("_rank <= _most")
    return near.select(*r.columns).unionByName(named.select(*r.columns)).distinct()


class Links:
    """Places in a row, of which some are taken: the next one on each side that isn't, by union-find in about constant time."""

    def __init__(self, n: int):
        self.right, self.left = list(range(n + 2)), list(range(n + 2))  # places 1 to n, and an end on each side

    def take(self, k: int) -> None:
        self.right[k], self.left[k] = k + 1, k - 1

    @staticmethod
    def _end(links: list[int], k: int) -> int:
        top = k
        while links[top] != top:
            top = links[top]
        while links[k] != top:
            links[k], k = top, links[k]
        return top

    def upto(self, k: int) -> int:
        return self._end(self.left, k)

    def after(self, k: int) -> int:
        return self._end(self.right, k)


class Free:
    """A collection's recordings, of which some are claimed. Each question looks at the few recordings that can answer it, whatever the collection's size."""

    def __init__(self, recordings: pd.DataFrame, tolerance: float):
        self.tolerance = tolerance
        self.paths, self.names, self.durations = (recordings[c].tolist() for c in ("path", "name", "duration"))
        self.claimed: set[str] = set()
        self.by_path: dict[str, list[int]] = {}
        self.by_name: dict[str, list[int]] = {}
        self.by_stem: dict[str, list[int]] = {}
        for k, (path, name) in enumerate(zip(self.paths, self.names, strict=True)):
            self.by_path.setdefault(path, []).append(k)
            self.by_name.setdefault(name, []).append(k)
            self.by_stem.setdefault(name.rsplit(".", 1)[0], []).append(k)
        known = sorted((d, k) for k, d in enumerate(self.durations) if d == d and d is not None)
        self.lengths = sorted({d for d, _ in known})
        self.at = {d: k + 1 for k, d in enumerate(self.lengths)}
        self.of: list[list[int]] = [[] for _ in self.lengths]  # recordings of a length, in order of their paths
        self.first = [0] * len(self.lengths)
        for d, k in known:
            self.of[self.at[d] - 1].append(k)
        self.links = Links(len(self.lengths))

    def fits(self, k: int, end: float) -> bool:
        d = self.durations[k]
        return end <= 0 or d is None or d != d or d >= end - self.tolerance

    def free(self, rows: list[int], end: float):
        return (k for k in rows if self.paths[k] not in self.claimed and self.fits(k, end))

    def claim(self, path: str) -> None:
        """A path is nobody else's; lengths of which nothing is left are skipped from now on."""
        if path in self.claimed:
            return
        self.claimed.add(path)
        for k in self.by_path[path]:
            place = self.at.get(self.durations[k])
            if place is not None:
                own, first = self.of[place - 1], self.first[place - 1]
                while first < len(own) and self.paths[own[first]] in self.claimed:
                    first += 1
                self.first[place - 1] = first
                if first == len(own):
                    self.links.take(place)

    def nearest(self, wanted: float, end: float) -> str | None:
        """The free recording nearest in length, within the tolerance and long enough; of equals the first path."""
        k, found = bisect_left(self.lengths, wanted), []
        long_enough = bisect_left(self.lengths, end - self.tolerance) if end > 0 else 0
        for place in (self.links.upto(k), self.links.after(max(k, long_enough) + 1)):
            if long_enough < place <= len(self.lengths):
                length = self.lengths[place - 1]
                if abs(length - wanted) <= self.tolerance:
                    found.append((abs(length - wanted), self.paths[self.of[place - 1][self.first[place - 1]]]))
        return min(found)[1] if found else None

    def choice(self, episode, local: str, name: str, duration: float, end: float) -> tuple[str | None, str | None]:
        """One episode's recording, and the rule that found it; it is claimed."""
        path, how = self._choice(episode, local, name, duration, end)
        if path:
            self.claim(path)
        return path, how

    def _choice(self, episode, local, name, duration, end):
        if local and any(self.fits(k, end) for k in self.by_path.get(local, ())):
            return local, "exact"
        named = next(self.free(self.by_name.get(name, []), end), None) if name else None
        if named is not None:
            return self.paths[named], "name"
        for wanted in (duration, end):
            near = self.nearest(wanted, end) if wanted > 0 else None
            if near:
                return near, "duration"
        digits = str(episode)[len(str(episode).rstrip("0123456789")) :]
        if digits:
            stems = {f"{int(digits):02d}", str(int(digits))}
            rows = sorted(k for s in stems for k in self.by_stem.get(s, ()))
            agrees = lambda d: duration <= 0 or d is None or d != d or abs(d - duration) <= self.tolerance
            for k in self.free(rows, end):
                if agrees(self.durations[k]):
                    return self.paths[k], "number"
        return None, None
