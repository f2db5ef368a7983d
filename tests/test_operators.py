"""Golden cases worked out by hand, and edge rows."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import aggregates as A
from lectern.operators import checks as C
from lectern.operators import intervals as I
from lectern.operators import lexicon as L
from lectern.operators import search as S
from lectern.operators import sequences as Q
from lectern.session import ship
from lectern.sources import files
from lectern.streaming import sessions
from tests.conftest import SF

import __spark_entry__  # noqa: F401  registers all queries


def one(spark, column):
    ship(spark)
    return spark.range(1).select(column.alias("x")).first()["x"]


def toks(s):
    return T.tokens(F.lit(s))


@pytest.mark.parametrize(("seconds", "want"), [(59.5, "01:00"), (3600.0, "01:00:00"), (-3.0, "00:00"), (61.0, "01:01")])
def test_timestamp(spark, seconds, want):
    assert one(spark, T.format_timestamp(F.lit(seconds))) == want


def test_repetition(spark):
    assert one(spark, T.longest_run(toks("a a a a b"))) == 4 and one(spark, T.unique_share(toks("a a a a b"))) == 0.4
    assert one(spark, T.longest_run(toks(""))) == 0 and one(spark, T.unique_share(toks(""))) == 1.0
    assert not one(spark, T.is_loop(toks("a a a b"))) and one(spark, T.is_loop(toks("a a a a")))
    assert one(spark, T.is_loop(toks(" ".join("abcdef"[i % 6] for i in range(20)))))
    assert not one(spark, T.is_loop(toks(" ".join("abcdef"[i % 6] for i in range(19)))))
    assert one(spark, T.collapse_loops(toks("a a a a b a"))) == ["a", "a", "b", "a"]


@pytest.mark.parametrize(("s", "flag"), [(0, "rejected"), (599, "rejected"), (600, "short"), (1799, "short"), (1800, "ok"), (3600, "ok"), (3601, "long"), (5401, "rejected")])
def test_duration_flag(spark, s, flag):
    assert one(spark, T.duration_flag(F.lit(s))) == flag


def test_text_edges(spark):
    assert one(spark, T.normalize_text(F.lit("Inflation, and  BANKING!"))) == "মূল্যস্ফীতি and ব্যাংক"
    assert one(spark, T.normalize_text(F.lit("é É"))) == "é é"
    assert one(spark, T.normalize_draft(F.lit("a​b \n c"))) == "ab c"
    assert one(spark, T.leading_truncated(F.lit("াক"))) and one(spark, T.drop_leading_fragment(F.lit("াক খ"))) == "খ"
    assert one(spark, T.word_count(F.lit(None).cast("string"))) == 0
    assert [one(spark, T.safe_double(F.lit(x))) for x in ("1.5", "nan", "inf", "x")] == [1.5, 0.0, 0.0, 0.0]
    assert one(spark, T.wer(F.lit("a b c"), F.lit("a x c d"))) == pytest.approx(2 / 3)
    assert one(spark, T.wer(F.lit(""), F.lit("a"))) == 1.0 and one(spark, T.wer(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, T.highlight(F.lit("<b>Nav & x"), "nav")) == "&lt;b&gt;<mark>Nav</mark> &amp; x"
    assert one(spark, T.programme_key(F.lit("Money Talks 7"))) == "money talks" and one(spark, T.programme_key(F.lit("123"))) == "unknown"
    assert one(spark, T.decode_multilabel(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.1, 0.2)]), 0.5)) == [1]
    assert one(spark, T.decode_multilabel(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.4, 0.3)]), 0.5)) == [2]


def test_word_to_speaker(spark):
    seg = spark.createDataFrame([(1, 7, 0, 100), (1, 8, 100, 200)], "episode long, speaker_id long, start_ds long, end_ds long")
    w = spark.createDataFrame([(1, 0, 0, "a", 99, 101), (1, 0, 1, "b", 198, 206), (1, 0, 2, "c", 205, 210)], "episode long, turn long, idx long, word string, start_ds long, end_ds long")
    got = {r.word: (r.speaker_id, r.method) for r in I.assign_words(w, seg).collect()}
    assert got == {"a": (8, "midpoint"), "b": (8, "max_overlap"), "c": (-1, "unassigned")}
    closed = {r.word: r.speaker_id for r in I.assign_words(w, seg, closed=True).collect()}
    assert closed["a"] == 7


def test_interval_join_is_complete(spark):
    import random

    rnd = random.Random(1)
    a = [(rnd.randint(0, 3), i, s := rnd.randint(0, 500), s + rnd.randint(0, 90)) for i in range(200)]
    b = [(rnd.randint(0, 3), i, s := rnd.randint(0, 500), s + rnd.randint(0, 90)) for i in range(200)]
    got = I.touching(spark.createDataFrame(a, "episode long, i long, start long, end long"), spark.createDataFrame(b, "episode long, j long, r_start long, r_end long"), ["episode"], 37).select("i", "j").collect()
    want = {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def utt(spark, rows):
    return spark.createDataFrame(rows, "episode long, turn long, speaker_id long, start double, end double, n_words long")


def test_turn_merge(spark):
    rows = utt(spark, [(1, 0, 5, 0.0, 1.0, 3), (1, 1, 5, 3.0, 4.0, 2), (1, 2, 5, 6.001, 7.0, 1), (1, 3, 0, 7.0, 8.0, 1)])
    got = sorted(tuple(r) for r in Q.merge_turns(rows, 2.0).select("speaker_id", "start", "end", "n_windows").collect())
    assert got == [(0, 7.0, 8.0, 1), (5, 0.0, 4.0, 2), (5, 6.001, 7.0, 1)]


def test_segmentation_caps_utterances(spark):
    w = [(1, 0, 3, i, f"w{i}" + ("!" if i == 2 else ""), 10 * i, 10 * i + 10) for i in range(6)] + [(1, 0, 3, 6, "late", 81, 90)]
    df = spark.createDataFrame(w, "episode long, turn long, speaker_id long, idx long, word string, start long, end long")
    got = sorted((r.start, r.end, r.n_words) for r in Q.segment_words(df, gap=20, longest=25).collect())
    assert got == [(0, 20, 2), (20, 30, 1), (30, 50, 2), (50, 60, 1), (81, 90, 1)]


def test_votes_and_stance(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("abba")], "k long, i long, label string")
    assert tuple(A.majority_vote(rows, ["k"], "label", ["i"]).first()) == (1, "a", 0.5)
    lab = spark.createDataFrame([(1, "positive", 10.0), (1, "positive", 10.0), (1, "negative", 1.0), (1, "neutral", 5.0)], "k long, label string, w double")
    plain, weighted = A.stance(lab, ["k"]).first(), A.stance(lab, ["k"], w=F.col("w")).first()
    assert plain["score"] == pytest.approx(1 / 3) and weighted["score"] == pytest.approx(19 / 21)
    verdict = lambda r: one(spark, T.stance_label(F.lit(r["polar_share"]), F.lit(r["score"])))
    assert verdict(plain) == "mixed" and verdict(weighted) == "positive"
    m = lambda p, n, t: one(spark, A.majority_verdict(F.lit(p), F.lit(n), F.lit(t)))
    assert (m(1, 2, 3), m(1, 3, 4), m(1, 0, 7), m(1, 0, 6)) == ("mixed", "negative", "neutral", "positive")


def test_metrics(spark):
    grid = [[124, 37, 17], [24, 78, 6], [9, 4, 25]]
    rows = spark.createDataFrame([(i, j) for i in range(3) for j in range(3) for _ in range(grid[i][j])], "truth long, pred long")
    s = A.scores(rows, [0, 1, 2]).first()
    assert s["macro_f1"] == pytest.approx(0.66964, abs=1e-5) and s["accuracy"] == pytest.approx(0.70062, abs=1e-5)
    k = lambda pairs: A.cohen_kappa(spark.createDataFrame(pairs, "truth string, pred string"), ["a", "b"]).first()["kappa"]
    assert k([("a", "a")] * 4) == 1.0 and k([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]) == 0.0
    never = {r["class"]: r for r in A.per_class(spark.createDataFrame([(0, 0)], "truth long, pred long"), [0, 1]).collect()}
    assert (never[1]["precision"], never[1]["recall"], never[1]["f1"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("method", "text", "q", "score"), [("all words", "b x a", "a b", 0.88), ("any word", "b x a", "a b", 0.95), ("any word", "a x", "a b", 0.80), ("any word", "a", "a a b", 0.85), ("exact", "xay", "a", None)])
def test_search_methods(spark, method, text, q, score):
    ship(spark)
    got = S.search(spark.createDataFrame([(1, text)], "id long, text string"), q, method, order=["id"]).collect()
    assert (got[0]["score"] if got else None) == (pytest.approx(score) if score else None)


def test_search_edges(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a b")], "id long, text string")
    assert S.search(rows, "", "exact").count() == 0
    assert S.search(rows, "a", "exact", top_k=0, order=["id"]).count() == 1
    assert {r["match_type"] for r in S.search(rows, "a", "smart", order=["id"]).collect()} == {"exact"}
    same = S.semantic(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, v array<double>"), "v", [1.0, 0.0]).collect()
    assert [r["semantic"] for r in same] == [1.0, 1.0]


def lexicon(targets, cues=()):
    return L.Lexicon([{"exclude": [], "orientation": 1, **t} for t in targets], [{"exclude": [], "negatable": True, "weight": 1.0, **c} for c in cues])


def test_mentions():
    names = lambda x, text: [m[:2] for m in x.mentions(text)]
    assert lexicon([{"canonical": "car", "stems": ["car"]}]).mentions("red cars run oscar") == [("car", "cars", 4, 8)]
    # The longer stem claims its words; what lies inside a claim is no mention, what only overlaps it is.
    nested = lexicon([{"canonical": "bank", "stems": ["bank"]}, {"canonical": "central bank", "stems": ["central bank"]}])
    assert names(nested, "central  banks and bankers") == [("central bank", "central  banks"), ("bank", "bankers")]
    overlap = lexicon([{"canonical": "long", "stems": ["aa bb"]}, {"canonical": "late", "stems": ["bb c"]}])
    assert names(overlap, "aa bb cc") == [("long", "aa bb"), ("late", "bb cc")]
    excluded = lexicon([{"canonical": "rate", "stems": ["sud"], "exclude": ["sudan"]}])
    assert names(excluded, "sudan suds sudanese") == [("rate", "suds")]


def test_cue_scores():
    up, bad = {"stem": "up", "kind": "direction", "polarity": 1}, {"stem": "bad", "kind": "evaluative", "polarity": -1}
    x = lexicon([{"canonical": "debt", "stems": ["debt"]}], [up, bad])
    assert x.score("up a b c debt", -1, [9]) == pytest.approx(-0.5)
    # Distance is to the word in which a mention of several words begins, not to its nearest.
    assert x.score("central bank of the land up", 1, [0]) == pytest.approx(1 / (1 + 5 / 4))
    # A direction without an orientation is passed over for the next cue of the same token.
    fallthrough = lexicon([{"canonical": "debt", "stems": ["debt"]}], [up, {"stem": "up", "kind": "evaluative", "polarity": 1}])
    assert fallthrough.score("debt x up", 0, [0]) == pytest.approx(2 / 3) and x.score("debt x up", 0, [0]) == 0.0
    assert x.score("debt bad না", 1, [0]) == pytest.approx(0.8) and x.score("debt bad a b c না", 1, [0]) == pytest.approx(-0.8)
    assert x.score("debt " + "a " * 12 + "bad", 1, [0]) == 0.0 and x.score("debt " + "a " * 11 + "bad", 1, [0]) == pytest.approx(-1 / 4)
    noun = lexicon([{"canonical": "debt", "stems": ["debt"]}], [{**bad, "negatable": False}])
    assert noun.score("debt bad না", 1, [0]) == pytest.approx(-0.8)


def test_verdict_and_restoration(spark):
    assert one(spark, L.verdict(F.lit(-0.5))) == "non_evaluative" and one(spark, L.verdict(F.lit(-0.55))) == "negative"
    assert one(spark, L.restore_entities(F.lit("the theme THE the,the éthe"), [("the", "X")])) == "X theme X X,X éthe"


def test_as_of_with_three_speakers(spark):
    rows = [(1, 1, 2, 0, 10), (1, 2, 0, 10, 20), (1, 3, 1, 20, 30), (1, 4, 2, 30, 40), (1, 5, 2, 40, 50), (1, 6, 0, 45, 60), (2, 7, 5, 0, 5), (2, 8, 5, 6, 7)]
    df = spark.createDataFrame(rows, "episode long, turn long, speaker_id long, start long, end long")
    got = {(r.episode, r.turn): r.p_turn for r in I.as_of_backward(df, 0).collect()}
    assert got == {(1, 1): None, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 3, (1, 6): 4, (2, 7): None, (2, 8): None}
    import random

    rnd = random.Random(2)
    many = [(rnd.randint(0, 2), t, rnd.randint(0, 4), s := rnd.randint(0, 60), s + rnd.randint(0, 9)) for t in range(150)]
    got = {r.turn: r.p_turn for r in I.as_of_backward(spark.createDataFrame(many, df.schema), 0).collect()}
    for e, t, w, s, _ in many:
        others = [(y[4], y[1]) for y in many if y[0] == e and y[2] != w and y[4] <= s]
        assert got[t] == (max(others)[1] if others else None)


def test_nearest_segment(spark):
    import random

    rnd = random.Random(4)
    seg = [(e, w, s := rnd.randint(0, 200), s + rnd.randint(0, 12)) for e in range(3) for w in range(9)]
    pts = [(rnd.randint(0, 2), k, rnd.randint(-20, 230)) for k in range(200)]
    got = {r.k: r.speaker_id for r in I.nearest_segment(spark.createDataFrame(pts, "episode long, k long, at long"), spark.createDataFrame(seg, "episode long, speaker_id long, r_start long, r_end long"), ["k"], 25).collect()}
    for e, k, at in pts:
        best = min((not s <= at <= t, 0 if s <= at <= t else min(abs(at - s), abs(at - t)), s, w) for x, w, s, t in seg if x == e)
        assert got[k] == best[3]


def test_gates_and_samples(spark):
    ship(spark)
    got = {r["gate"]: r["status"] for r in C.gates(spark.range(1), [C.gate("a", F.lit(None).cast("int"), F.lit(True)), C.gate("b", F.lit(1), F.lit(False))]).collect()}
    assert got == {"a": "SKIPPED", "b": "FAIL"}
    rows = spark.createDataFrame([(i, i % 3) for i in range(31)], "id long, g long")
    n = {r["g"]: r["count"] for r in C.stratified(rows, ["g"], 0.1, F.xxhash64("id")).groupBy("g").count().collect()}
    assert n == {0: 1, 1: 1, 2: 1}
    split = C.hold_out_groups(rows, "g", 0.4, F.xxhash64("g"))
    assert split.select("g", "split").distinct().count() == 3 and split.filter("split = 'test'").select("g").distinct().count() == 1
    first = C.keep_first(spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), ["k"], ["v"])
    assert sorted(tuple(r) for r in first.collect()) == [(1, "a"), (2, "c")]


def test_files(spark, tmp_path):
    d = tmp_path / "own" / "fused"
    d.mkdir(parents=True)
    (d / "ep1.json").write_text(json.dumps({"episode_id": "ep1", "stats": {"n_words": 12}, "words": [{"word": "a", "start": 0, "prob": None}], "utterances": [{"speaker_id": 0, "start_sec": 0, "end_sec": 10}], "more": 1}))
    (d / "bad.json").write_text("{broken")
    good, bad = files.split_corrupt(files.read_documents(spark, str(d)).cache())
    assert good.select("episode_id").first()[0] == "ep1" and bad.count() == 1
    assert good.select(files.collection_of(F.col("path"))).first()[0] == "own"
    (tmp_path / "r.csv").write_text("﻿episode_id,duration_sec\ne1,12\n")
    assert files.read_csv(spark, str(tmp_path / "r.csv")).first().asDict() == {"episode_id": "e1", "duration_sec": "12"}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()) == [1, 2]
    rows = spark.createDataFrame([("e", 0.5, 2.0, "spk0")], "episode_id string, start double, end double, label string")
    files.write_rttm(rows, str(tmp_path / "rttm"))
    assert files.read_rttm(spark, str(tmp_path / "rttm")).collect() == rows.collect()
    assert files.list_files(spark, str(tmp_path / "own"), ".json").count() == 2 and files.manifest(spark, str(tmp_path / "own")).count() == 2
    assert C.missing(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string"), ["k"]).first()[0] == "b"


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    base = [(1, f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 10, 20)] + [(1, "2024-01-01 02:00:00", 2.0), (2, "2024-01-02 00:00:00", 3.0)]
    df = spark.createDataFrame(base, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(src)
    q = sessions.write_once(sessions.sessions(sessions.read_events(spark, src, df.schema), "user_id"), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted((r["user_id"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (1, 3)]  # the last session stays open at the watermark
    ship(spark)
    s = sessions.running_counts(sessions.read_events(spark, src, df.schema), "user_id").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert {r["user_id"]: r["n"] for r in spark.sql("SELECT * FROM counts").collect()} == {1: 4, 2: 1}


def test_roles_and_chunks(spark):
    rows = utt(spark, [(1, t, 0 if t % 2 else 7, float(t), t + 1.0, 2 if t % 2 else 50) for t in range(8)])
    got = {r["speaker_id"]: r["inferred_role"] for r in Q.roles_by_share(rows).collect()}
    assert got == {0: "host", 7: "guest"}  # speaker 0 is a speaker like any other
    c = Q.chunk(spark.createDataFrame([(0.0, 60.0), (5.0, 5.0)], "start_sec double, end_sec double"), 28).select("chunk_start", "chunk_end").collect()
    assert [tuple(r) for r in sorted(c)] == [(0.0, 28.0), (28.0, 56.0), (56.0, 60.0)]
    assert math.isclose(one(spark, F.array_max(T.softmax(F.array(F.lit(0.0), F.lit(0.0))))), 0.5)


def test_annotations(spark):
    from lectern.operators import annotations as N

    ship(spark)
    label = lambda *a: (*a, None)
    ok = ("e1", "u1", 0, "host", False, 0.0, 1.0, "bank rises", "bank rises", [label("bank", "SECTOR", "positive")], "labelled", True)
    bad = ("e2", "u1", None, "x", True, 2.0, 1.0, "a 5\u200be\u0301", None, [label("q", "SECTOR", "positive"), label("Q", "MARKET", "positive"), label("q", "SECTOR", "negative"), label("", "NO", "maybe")], "odd", None)
    excluded = ("e3", "u1", 1, "host", False, 0.0, 1.0, "bank", "bank", [label("bank", "SECTOR", "positive")], "out_of_scope", True)
    none = ("e3", "u2", 1, "host", False, 0.0, 1.0, "bank", "bank", None, "labelled", True)
    rows = spark.createDataFrame([ok, bad, excluded, none], N.ANNOTATED)
    found: dict = {}
    for r in N.issues(rows).collect():
        found.setdefault((r.episode_id, r.utterance_id), []).append(r.code)
    assert ("e1", "u1") not in found and found["e3", "u1"] == ["LABEL_ON_EXCLUDED_UTTERANCE"] and found["e3", "u2"] == ["MISSING_LABEL"]
    want = ["BAD_ANNOTATION_STATUS", "BAD_POLARITY", "BAD_ROLE", "BAD_SPEAKER", "BAD_TARGET", "BAD_TIME", "BIDI_OR_ZERO_WIDTH", "CONFLICTING_TARGET_TYPE", "CONTRADICTORY_POLARITY", "DIGIT_NOT_WORD", "MISSING_TARGET_SPAN", "NOT_HUMAN_VERIFIED", "NOT_NFC", "ROLE_REVIEW_UNRESOLVED", *["TARGET_SPAN_NOT_IN_TEXT"] * 3]
    assert sorted(found["e2", "u1"]) == want
    gold = N.gold_labels(rows)
    assert [r.episode_id for r in gold.collect()] == ["e1"]
    assert N.multilabel_examples(gold).first()["vector"] == [0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    turns = spark.createDataFrame([("s", 0, "t0"), ("s", 1, "t1")], "speaker_key string, index long, turn_id string")
    votes = spark.createDataFrame([("s", 0, 0, "positive"), ("s", 0, 1, "negative"), ("s", 9, 2, "negative")], "speaker_key string, index long, ord long, label string")
    assert [(r.turn_id, r.label) for r in N.attach_votes(turns, votes).collect()] == [("t0", "positive")]
    reg = spark.createDataFrame([("p1", "e1", "false"), ("p2", "e2", "false"), ("p3", "e3", "true")], "local_path string, episode_id string, remote string")
    over = spark.createDataFrame([("p1", " TRUE "), ("e2", "true"), ("e3", "maybe")], "key string, remote string")
    assert {r.episode_id: r.remote for r in N.overridden(reg, over, ["remote"]).collect()} == {"e1": "true", "e2": "true", "e3": "true"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_by_table(spark):
    """Every turn of the smallest table against the one before it: words, characters, and the longer text's share."""
    from lectern.plans import base, text_queries

    ship(spark)
    want = text_queries._answers(spark, SF).collect()
    got, chars = ({(r.episode, r.turn): r for r in base.QUERIES[q](spark, SF).collect()} for q in ("wer", "cer"))
    for r in want:
        a, b = r.a.split(), r.b.split()
        d = distance(a, b)
        assert got[r.episode, r.turn].uncapped == pytest.approx(d / len(a) if a else float(bool(b)), abs=1e-6) and got[r.episode, r.turn].wer == pytest.approx(min(1, d / len(a)) if a else float(bool(b)), abs=1e-6)
        assert got[r.episode, r.turn].edit_rate == pytest.approx(d / max(len(a), len(b)) if a else float(bool(b)), abs=1e-6)
        assert chars[r.episode, r.turn].cer == pytest.approx(distance(r.a, r.b) / len(r.a) if r.a else float(bool(r.b)), abs=1e-6)


def test_noise(spark):
    words = [f"word{i}" for i in range(400)]
    noisy = one(spark, T.inject_noise(F.array(*[F.lit(w) for w in words]), F.lit("k"), 25))
    changed = [(a, b) for a, b in zip(words, noisy, strict=True) if a != b]
    assert 60 < len(changed) < 140 and all(distance(a, b) in (1, 2) for a, b in changed)
    assert one(spark, T.inject_noise(F.array(F.lit("a"), F.lit("b")), F.lit("k"), 0)) == ["a", "b"]


def test_noise_costs(spark):
    from lectern.plans import base

    curve = sorted(tuple(r) for r in base.QUERIES["noise_curve"](spark, SF).select("level", "achieved_wer", "macro_f1").collect())
    assert [x[0] for x in curve] == [5, 15, 25, 35, 45, 55, 65]
    assert all(abs(w - level / 100) < 0.12 for level, w, _ in curve) and [x[1] for x in curve] == sorted(x[1] for x in curve) and curve[0][2] > curve[-1][2] - 0.05 and all(0 <= x[2] <= 1 for x in curve)


def plain_fuzzy(q, t):
    from difflib import SequenceMatcher

    w, n = t.split(), len(q.split())
    windows = [" ".join(w[i : i + k]) for k in range(max(1, n - 2), min(len(w), n + 3) + 1) for i in range(len(w) - k + 1)]
    return max(SequenceMatcher(None, q, x).ratio() for x in [t, *windows])


def test_fuzzy_and_smart_by_hand(spark):
    """All turns: the registered queries against the rules, every window compared."""
    from lectern.plans import base, search_queries

    ship(spark)
    texts = {r.key: r.t or "" for r in search_queries._turns(spark, SF).select("key", T.normalize_text(F.col("text")).alias("t")).collect()}
    fuzzy = {k: plain_fuzzy("thand onesen", t) for k, t in texts.items()}
    top = lambda scores, least: sorted(((-round(s, 6), k) for k, s in scores.items() if s >= least))[:20]
    got = base.QUERIES["search_fuzzy"](spark, SF).collect()
    assert [(-r.score, r.key) for r in got] == top(fuzzy, 0.5)

    def smart(q, t):
        w, ts = q.split(), set(t.split())
        r = sum(x in ts for x in w) / len(w)
        return 1.0 if q in t else 0.9 if r == 1 else max(0.55 + 0.3 * r if r else 0.0, 0.92 * plain_fuzzy(q, t))

    got = base.QUERIES["search_smart"](spark, SF).collect()
    assert [(-r.score, r.key) for r in got] == top({k: smart("an the of", t) for k, t in texts.items()}, 0.55)


def test_index_search(spark, tmp_path):
    ship(spark)
    label = "array<struct<target_type: string, polarity: string>>"
    rows = [("a", "e1", "u1", 0, 0.0, 2.0, "bank branch rises", [("SECTOR", "positive")]), ("a", "e1", "u2", 1, 2.0, 4.0, "the bank", [(None, None)]), ("b", "e1", "u1", 0, 0.0, 3.0, "bank again", None), ("b", "e1", "u2", -1, 3.0, 4.0, "bank noise", None), ("b", "e1", "u3", 0, 4.0, None, None, None)]
    ix = S.index(spark.createDataFrame(rows, f"collection string, episode string, utterance_id string, speaker_id long, start_sec double, end_sec double, text string, targets {label}"))
    assert ix.select("key").distinct().count() == 5  # ids repeat between collections, keys don't
    q = S.normal_query(spark, "bank")
    hits = S.find(ix, q, method="Exact").collect()
    assert [(r["rank"], r["key"]) for r in hits] == [(1, "a::e1::u1"), (2, "a::e1::u2"), (3, "b::e1::u1")] and hits[0]["context"].endswith("Next: the bank")
    assert [r["key"] for r in S.find(ix, q, method="exact", collection="b", include_unassigned=True).collect()] == ["b::e1::u1", "b::e1::u2"]
    assert [r["key"] for r in S.find(ix, q, method="exact", episode="a::e1", speaker=1, include_context=False).collect()] == ["a::e1::u2"]
    assert S.find(ix, "", method="exact").count() == 0 and S.find(ix, "an", query_type="Word", method="exact").count() == 0 and S.find(ix, "an", query_type="Sentence", method="exact").count() == 3
    assert [r["Targets"] for r in S.hit_frame(S.find(ix, q, method="exact")).orderBy("Rank").collect()] == ["SECTOR · positive", "? · ?", ""]
    sem = spark.createDataFrame([("a::e1::u2", 1.0), ("b::e1::u1", 0.2)], "key string, semantic double")
    got = {r["key"]: (r["score"], r["lexical_score"]) for r in S.find(ix, q, method="Hybrid", minimum_score=0.0, semantic_scores=sem).collect()}
    assert got["a::e1::u2"] == (pytest.approx(1.0), 1.0) and got["b::e1::u1"] == (pytest.approx(0.56), 1.0) and got["a::e1::u1"] == (pytest.approx(0.45), 1.0)
    assert [r["key"] for r in S.find(ix, q, method="semantic", semantic_scores=sem).collect()] == ["a::e1::u2"]
    S.register_search_method("starts", lambda t, ts, q, words: F.when(t.startswith(q), 0.7).otherwise(0.0))
    assert S.find(ix, q, method="starts").count() == 2
    calls = []
    encode = lambda d: (calls.append(1), d.select("key", F.array(F.length("text").cast("double")).alias("vector")))[1]
    assert S.cached_vectors(ix, encode, str(tmp_path)).count() == 5 and S.cached_vectors(ix, encode, str(tmp_path)).count() == 5 and len(calls) == 1
    assert S.cached_vectors(ix.filter("collection = 'a'"), encode, str(tmp_path)).count() == 2 and len(calls) == 2
    plan = S.search(ix, q, "any word")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1 and plan.count("split(") == 1


def test_registered_aggregator(spark):
    A.register_aggregator("always", lambda p, n, t: F.lit("mixed"))
    try:
        rows = spark.createDataFrame([(1, "positive", 3, "high")], "k long, label string, n_words long, confidence string")
        got = A.aggregated(rows, ["k"]).first()
        assert (got["agg_always"], got["agg_majority_vote"], got["agg_word_conf_weighted"]) == ("mixed", "positive", "positive")
    finally:
        del A.AGGREGATORS["always"]


def test_diarization_error(spark):
    ref = [(1, 0.0, 10.0, "a"), (1, 10.0, 20.0, "b"), (2, 0.0, 10.0, "a"), (3, 0.0, 4.0, "a"), (3, 2.0, 6.0, "b")]
    hyp = [(1, 0.0, 12.0, "x"), (1, 12.0, 20.0, "y"), (2, 2.0, 12.0, "x"), (3, 0.0, 6.0, "x")]
    frame = lambda x: spark.createDataFrame(x, "episode long, start double, end double, label string")
    got = {r.episode: tuple(r)[1:] for r in A.diarization_error(frame(ref), frame(hyp)).collect()}
    assert got[1] == pytest.approx((20, 0, 0, 2, 0.1)) and got[2] == pytest.approx((10, 2, 2, 0, 0.4)) and got[3] == pytest.approx((8, 2, 0, 2, 0.5))
    collared = {r.episode: r.error for r in A.diarization_error(frame(ref), frame(hyp), 4.0).collect()}
    assert collared[1] == pytest.approx(0.0)
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(40):
        n, m = rnd.randint(1, 5), rnd.randint(1, 5)
        shared = {(f"r{i}", f"h{j}"): float(rnd.randint(0, 9)) for i in range(n) for j in range(m)}
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        at = lambda i, j: shared[f"r{i}", f"h{j}"] if n <= m else shared[f"r{j}", f"h{i}"]
        assert A.best_mapping(shared) == max(sum(at(i, j) for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))


def test_diarization_error_query(spark):
    """Segments that end early, speakers renamed: what is cut off is missed, and nothing is confused."""
    from lectern.plans import base, catalog

    ship(spark)
    u = {(r.episode, r.turn): r for r in catalog.utterances(spark, SF).collect()}
    lost = {}
    for r in catalog.segments(spark, SF).collect():
        lost.setdefault(r.episode, [0, 0])
        lost[r.episode][0] += u[r.episode, r.turn].end_ds - r.end_ds
        lost[r.episode][1] += u[r.episode, r.turn].end_ds - u[r.episode, r.turn].start_ds
    for r in base.QUERIES["diarization_error"](spark, SF).collect():
        assert (r.missed, r.total, r.false_alarm, r.confusion) == (*lost[r.episode], 0, 0)


def test_audio_resolution(spark):
    from lectern.operators import audio

    ship(spark)
    recs = [("c", "c/audio/01.mp3", 100.0), ("c", "c/Show É.mp3", 200.0), ("c", "c/x.mp3", 301.5), ("c", "c/y.mp3", 300.5), ("c", "c/07.wav", None), ("c", "c/short.mp3", 50.0)]
    eps = [("c", "e1", "c/audio/01.mp3", 100.0, 99.0), ("c", "e2", "old/show e\u0301.MP3", 0.0, 0.0), ("c", "e3", "gone.mp3", 301.0, 0.0), ("c", "e4", "gone.mp3", 301.0, 0.0), ("c", "e5", "c/short.mp3", 50.0, 90.0), ("c", "e7", "", 0.0, 0.0), ("d", "e1", "", 9.0, 9.0)]
    got = {(r.collection, r.episode): (r.path, r.how) for r in audio.resolved(spark.createDataFrame(eps, "collection string, episode string, local_path string, duration_sec double, end_sec double"), spark.createDataFrame(recs, "collection string, path string, duration double")).collect()}
    assert got["c", "e1"] == ("c/audio/01.mp3", "exact") and got["c", "e2"] == ("c/Show É.mp3", "name") and got["c", "e3"] == ("c/x.mp3", "duration") and got["c", "e4"] == ("c/y.mp3", "duration")
    assert got["c", "e5"] == (None, None) and got["c", "e7"] == ("c/07.wav", "number") and got["d", "e1"] == (None, None)


def test_splits(spark):
    from lectern.operators import splits

    rows = spark.createDataFrame([(i, i % 7, i % 2) for i in range(70)], "id long, g long, y long")
    three = splits.three_way(rows, "g", (F.xxhash64("g"), F.xxhash64("g", F.lit(1))))
    parts = {r.split: set(r.gs) for r in three.groupBy("split").agg(F.collect_set("g").alias("gs")).collect()}
    assert sorted(map(len, parts.values())) == [1, 2, 4] and len(set.union(*parts.values())) == 7 and three.count() == 70
    alone = splits.disjoint_or_stratified(rows.filter("g = 1"), "g", "y", 0.2, F.xxhash64("g"), F.col("id"))
    assert {(r.y, r.n) for r in alone.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, 1)}
    folds = splits.group_folds(rows, "g", 3)
    assert {r.fold: r.n for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {0: 30, 1: 20, 2: 20} and folds.select("g", "fold").distinct().count() == 7
    with pytest.raises(ValueError):
        splits.group_folds(rows, "g", 3, most_groups=6)
    blind = splits.balanced_sample(rows.withColumn("v", F.when(F.col("id") % 9 != 0, F.col("id"))), "y", "v", 12, F.xxhash64("id"), ["y"])
    assert blind.count() == 12 and blind.columns == ["id", "g", "v"]


def test_weak_labels(spark):
    from lectern.operators import review

    ship(spark)
    kind = "id long, text string, labels array<struct<target_text: string, target_type: string, polarity: string, confidence: double>>, annotation_status string, review_required boolean"
    rows = [
        (1, "the bank", [("bank", "SECTOR", "positive", 0.9), ("Bank", "SECTOR", "negative", 0.9), ("bond", "MARKET", "positive", 0.9), ("bank", "PLANET", "positive", 0.9)], "out_of_scope", False),
        (2, None, [("x", "MARKET", "negative", None)], None, None), (3, "a", None, "non_evaluative", False), (4, "a", [], "odd", False), (5, "ab", [("a", "MARKET", "negative", 0.2), ("a", "MARKET", "negative", 0.95)], "labelled", True),
    ]
    got = {r.id: r for r in review.valid_weak(spark.createDataFrame(rows, kind)).collect()}
    assert [tuple(x) for x in got[1].labels] == [] or [(x.target_text, x.confidence) for x in got[1].labels] == [("bank", 0.9)]
    assert (got[1].annotation_status, got[1].review_required) == ("labelled", True) and "status_label_conflict" in got[1].validation_flags
    assert got[2].annotation_status == "labelled" and got[2].review_required and got[3].annotation_status == "non_evaluative" and not got[3].review_required
    assert got[4].annotation_status == "review_required" and [(x.target_text, x.confidence) for x in got[5].labels] == [("a", 0.95)] and got[5].review_required and got[5].validation_flags == []


def test_noise_of_sources(spark, tmp_path):
    files_ = [(x,) for x in ("b/r1/data/fused/e1.json", "b/r1/data/fused/e2.json", "b/r2/fused/e1.json", "b/_source_runs/r3/fused/e1.json", "b/r1/raw/registry_old.csv", "b/r1/raw/registry (1).csv", "b/r2/raw/registry.csv", "b/r2/raw/registry2.csv", "b/a.mp3", "b/r1/processed/x.WAV", "b/t.txt")]
    df = spark.createDataFrame(files_, "path string")
    assert sorted(tuple(r) for r in files.bundles(df).collect()) == [("b/r1", 2), ("b/r2", 1)]
    assert sorted(tuple(r) for r in files.registry_file(df).collect()) == [("b/r1/raw", "b/r1/raw/registry (1).csv"), ("b/r2/raw", "b/r2/raw/registry.csv")]
    own = df.withColumn("owner", F.lit("o"))
    assert [r.path for r in files.source_files(own, spark.createDataFrame([("o", "b/r1")], "owner string, root string"), [".mp3", ".wav"]).collect()] == ["b/a.mp3"]
    copies = spark.createDataFrame([("d/gate.json", 10), ("d/gate (1).json", 10), ("d/other.json", 5), ("d/other_copy2.json", 9)], "path string, bytes long")
    assert {r.stem: r.path for r in files.best_copy(copies, "stem").collect()} == {"gate": "d/gate.json", "other": "d/other_copy2.json"}
    folders = spark.createDataFrame([("b", "data/fused"), ("b", "fused"), ("b", "weak")], "bundle string, folder string")
    at = lambda first: {r.stage: r.folder for r in files.stage_folders(folders, ["fused", "weak_labels", "asr"], first).collect()}
    assert at(True) == {"fused": "data/fused", "weak_labels": "weak", "asr": "data/asr"} and at(False)["fused"] == "fused"
    d = tmp_path / "news"
    d.mkdir()
    (d / "a1.csv").write_bytes('\ufeffID,The Title,Body text\n1,"One, ""two""",Words here\n2,x,y\n'.encode())
    (d / "a2.csv").write_bytes(b"article,when\nonly body\n")
    got = {r.article_id: (r.title, r.text) for r in files.read_articles(spark, str(d)).collect()}
    assert got == {"a1": ('One, "two"', "Words here"), "a2": ("", "only body")}
    assert files.read_csv(spark, str(tmp_path / "none.csv"), columns=["a", "b"]).columns == ["a", "b"]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "none.csv"))
    assert not files.write_csv(df.limit(0), str(tmp_path / "empty")) and not (tmp_path / "empty").exists()
    assert files.write_csv(df.limit(1).coalesce(1), str(tmp_path / "one"), mark=True) and next((tmp_path / "one").glob("part-*")).read_bytes().startswith("\ufeffpath\n".encode())
    files.write_jsonl(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "l"))
    assert "".join(f.read_text() for f in (tmp_path / "l").glob("part-*")) == '{"a":1,"b":null}\n'
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n')
    assert [r.a for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long").collect()] == [1]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long", strict=True).collect()


def test_models(spark):
    from lectern.operators import models
    from lectern.plans import base

    ship(spark)
    grams = one(spark, models.word_bound_grams(F.lit("abcd a")))
    assert sorted(grams) == sorted([" ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd ", " a "])
    rows = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(40)] + [(40, None)], "id long, text string").repartition(3)
    got = {r.id: r for r in models.scored(rows, "text", lambda: lambda texts: [[len(t) / 4, 1 - len(t) / 4] for t in texts], ["long", "short"], 7).collect()}
    assert len(got) == 41 and all(r.p_long == (i % 5) / 4 and r.pred == ("long" if i % 5 >= 2 else "short") for i, r in got.items() if i < 40) and got[40].pred == "short"
    train = spark.createDataFrame([(f"good fine text{i % 3}", 1.0) for i in range(20)] + [(f"bad poor text{i % 3}", 0.0) for i in range(20)], "text string, label double")
    model, reg = models.grid_choice(train, train, "text", "label", 2, [0.01, 10.0])
    out = model.transform(train.withColumn("class_weight", F.lit(1.0)))
    assert reg in (0.01, 10.0) and out.filter("prediction = label").count() == 40
    out = base.QUERIES["tfidf_baseline"](spark, SF).toPandas()
    assert set(out.pred) <= {0, 1} and (out.truth == out.pred).mean() >= 0.5


def test_corrections(spark):
    from lectern.operators import review

    ship(spark)
    word = "episode string, segment long, text string, words array<struct<prob: double>>, confidence double"
    segs = spark.createDataFrame([("e", 0, "a b c d", [(0.9,), (0.9,)], None), ("e", 1, "a b", [(0.1,)], 0.99), ("e", 2, "q", None, 0.2), ("e", 3, "z", None, None)], word)
    routed = review.routed(segs, spark.createDataFrame([], "key string, corrected string"), 0.85)
    assert {r.segment: r.route for r in routed.collect()} == {0: "pass", 1: "submit", 2: "submit", 3: "pass"}
    done = routed.withColumn("corrected", F.when(F.col("segment") == 1, "a x y z").when(F.col("segment") == 2, "q").otherwise(F.col("corrected")))
    assert tuple(review.correction_stats(done).first()) == (4, 2, 2, 2, 0.1875, 1, 1)


def test_stream_windows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00", 1.0) for m in (1, 4, 11)] + [(1, "2024-01-01 05:00:00", 1.0)], "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(src)
    sessions.write_once(sessions.windows(sessions.read_events(spark, src, df.schema), "user_id", "10 minutes", "5 minutes"), out, str(tmp_path / "cp")).awaitTermination(120)
    got = sorted((r.start.minute + 60 * r.start.hour, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, 2), (5, 1), (10, 1), (23 * 60 + 55, 2)]


def test_library_without_training_data(tmp_path):
    """With the training-data folders and the pipeline gone, the other queries are there and import."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q) and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, timeout=120)


def scanned_files(frame):
    """(files, bytes) that a frame's scans of stored tables read when it ran."""
    found, todo = [0, 0], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.finalPhysicalPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "FileSourceScanExec":
                found[0] += node.metrics().apply("numFiles").value()
                found[1] += node.metrics().apply("filesSize").value()
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    return found


def test_stored_index(spark, tmp_path):
    """Hits by postings are those of the texts; a search opens the shelves of its own tokens; an index that wasn't finished is built anew."""
    import random
    from pathlib import Path

    from lectern.operators import postings as P

    ship(spark)
    rnd = random.Random(4)
    rows = [(k, rnd.choice("abc"), None if k == 7 else " ".join(rnd.choice(["Of", "the", "of,the", "oft", "roof", "them", "x1", "x2", "x3", ""]) for _ in range(rnd.randint(0, 8)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "id long, part string, text string")
    path = str(tmp_path / "index")
    (tmp_path / "index" / "postings").mkdir(parents=True)
    assert P.opened(spark, path) is None
    index = P.build(docs, path, ["part", "id"])
    assert P.opened(spark, path) == index and index.rows == 200
    plain = {r.id: r.t for r in docs.select("id", T.normalize_text(F.col("text")).alias("t")).collect()}
    part = {k: p for k, p, _ in rows}
    for q, method, kind in (("of the", "exact", "auto"), ("the of the", "exact", "auto"), ("of", "exact", "auto"), ("of", "exact", "Sentence"), ("of the", "all words", "auto"), ("x1 x2 x1 zz", "any word", "auto"), ("of them", "smart", "auto"), ("nothing", "any word", "auto")):
        w = q.split()

        def score(t):
            ts = t.split()
            share = sum(x in ts for x in w) / len(w)
            if method == "exact":
                return 1.0 if (w[0] in ts if len(w) == 1 and kind == "auto" else q in t) else 0
            if method == "all words":
                return 0 if share < 1 else 0.96 if q in t else 0.88
            if method == "any word":
                return 0.65 + 0.3 * share if share else 0
            return 1.0 if q in t else 0.9 if share == 1 else 0.55 + 0.3 * share if share else 0

        ranked = sorted((-round(s, 9), part[k], k) for k, t in plain.items() if (s := score(t)) >= 0.55)
        want = ranked[:15]
        got = [(-round(r.score, 9), r.part, r.id) for r in P.search(index, q, method, top_k=15, query_type=kind).collect()]
        assert got == want, q
        scoped = [r.id for r in P.search(index, q, method, top_k=9, query_type=kind, where=F.col("part") == "b").collect()]
        assert scoped == [k for _, p, k in ranked if p == "b"][:9]
    found = index.occurrences(["x1"])
    n = found.count()
    assert n == sum(t.split().count("x1") for t in plain.values())
    found = index.occurrences(["x1"])
    found.collect()
    files = list(Path(path, "postings").glob("*/*.parquet"))
    shelf = spark.range(1).select(index.shelf(F.lit("x1"))).first()[0]
    own = [f for f in files if f.parent.name == f"shelf={shelf}"]
    assert scanned_files(found) == [len(own), sum(f.stat().st_size for f in own)] and len(own) < len(files)
    empty = P.build(docs.limit(0), str(tmp_path / "empty"), ["id"])
    assert P.search(empty, "of the", "any word").count() == 0 and empty.words == 0


def test_fuzzy_bounds(spark):
    """No text that reaches a score is left out natively, and scores are those of all windows compared."""
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    texts = ["", *[" ".join(word() for _ in range(rnd.randint(1, 25))) for _ in range(80)]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    left = 0
    for q in ("abc", "ab cde", "dab é bad cab", "zzz"):
        exact = [plain_fuzzy(q, t) for t in texts]
        assert all(abs(S.fuzzy_score(q, t) - x) < 1e-12 and S.fuzzy_score(q, t, x) == S.fuzzy_score(q, t) for t, x in zip(texts, exact))
        for least in (0.5, 0.8, 0.95):
            kept = {r.id for r in rows.filter(S.fuzzy_slack(F.col("t"), T.tokens(F.col("t")), q, least) >= 0).collect()}
            assert {k for k, x in enumerate(exact) if x >= least} <= kept
            left += len(texts) - len(kept)
        got = [(round(r.score, 9), r.id) for r in S.search(rows, q, "fuzzy", least=0.6, top_k=7, text="t", order=["id"], normal=F.col("t")).collect()]
        assert got == [(-s, k) for s, k in sorted((-round(x, 9), k) for k, x in enumerate(exact) if x >= 0.6)[:7]]
    assert left > 200


def test_collars_in_one_pass(spark):
    """However many collars there are, an episode goes to Python once, and each collar gives what it gives alone."""
    from lectern.operators import aggregates as A

    ref = spark.createDataFrame([(1, 0.0, 4.0, "a"), (1, 3.0, 9.0, "b"), (2, 1.0, 1.0, "a"), (2, 2.0, 5.0, None)], "episode long, start double, end double, label string")
    hyp = spark.createDataFrame([(1, 0.0, 5.0, "x"), (1, 5.0, 8.5, "y"), (2, 2.5, 7.0, "x")], "episode long, start double, end double, label string")
    found = A.diarization_errors(ref, hyp, (0.0, 0.5, 1.0))
    assert found._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsIn") == 1
    got = {(r.episode, r.collar): (r.total, r.missed, r.false_alarm, r.confusion) for r in found.collect()}
    for c in (0.0, 0.5, 1.0):
        assert {r.episode: (r.total, r.missed, r.false_alarm, r.confusion) for r in A.diarization_error(ref, hyp, c).collect()} == {k: x for (k, d), x in got.items() if d == c}
    assert got[1, 0.0] == (10.0, 1.5, 0.0, 1.0) and got[2, 0.0] == (3.0, 0.5, 2.0, 0.0) and got[2, 1.0] == (2.0, 0.0, 1.5, 0.0)


def test_key_check_in_small_tasks(spark, monkeypatch):
    """Keys are counted in as many tasks as the rows need, neither merged by their size nor bound to one number."""
    from lectern.operators import checks
    from lectern.plans import base
    from lectern.plans.catalog import table

    ship(spark)
    want = base.QUERIES["reproducibility_check"](spark, SF).first()
    n = table(spark, SF, "lineitem").count()
    monkeypatch.setattr(checks, "TASK_ROWS", 500)
    found = base.QUERIES["reproducibility_check"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.first() == want and f", {-(-n // 500)}), REPARTITION_BY_NUM" in plan


def test_fuzzy_bounds_by_counts(spark):
    """A character counts as often as the query has it in all of a window's words; texts compared together get what each gets alone; smart search finds the best of many that are near."""
    import random

    q = "thand onesen wereth"
    rows = spark.createDataFrame([(1, "th " * 50), (2, "thand onesun"), (3, "")], "id long, t string")
    assert [r.id for r in rows.filter(S.fuzzy_slack(F.col("t"), T.tokens(F.col("t")), q, 0.5) >= 0).collect()] == [2]
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice("thandonesw\U0001f600é") for _ in range(rnd.randint(1, 7))) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    for query in (q, "é\U0001f600 th", "x" * 70):
        made = S.Fuzzy(query)
        for least in (0.0, 0.6):
            for t, x in zip(texts, made.scores(texts, least)):
                best = plain_fuzzy(query, t)
                assert x == best or (x < least and best < least)
                assert made.bound(t) >= best
    rows = spark.createDataFrame(list(enumerate([*texts, "thand", "thand onesen"])), "id long, t string")
    want = {k: max(S.FUZZY_SHARE * plain_fuzzy(q, t), 1.0 if q in t else 0, 0.55 + 0.1 * n if (n := sum(w in t.split() for w in q.split())) else 0) for k, t in enumerate([*texts, "thand", "thand onesen"])}
    got = [(r.id, round(r.score, 9)) for r in S.search(rows, q, "smart", least=0.3, top_k=5, text="t", order=["id"], normal=F.col("t")).collect()]
    assert got == sorted(((k, round(x, 9)) for k, x in want.items()), key=lambda r: (-r[1], r[0]))[:5]


def test_fuzzy_documents_by_brute_force(spark):
    from lectern.plans import base
    from lectern.plans.catalog import table

    ship(spark)
    texts = {r.doc_id: r.t for r in table(spark, SF, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("t")).collect()}

    def windows(q, t):
        return max([S.SequenceMatcher(None, q, t).ratio() if len(t) < 4 * len(q) else 0, *(S.SequenceMatcher(None, q, x).ratio() for n in range(max(1, len(q.split()) - 2), len(q.split()) + 4) for k in range(len(w) - n + 1) if 3 * len(q) >= len(x := " ".join(w[k : k + n])) and 2 * sum((S.Counter(q) & S.Counter(x)).values()) >= 0.5 * (len(q) + len(x)))]) if (w := t.split()) else 0

    q = "thand onesen wereth"
    want = sorted((-round(x, 6), k) for k, t in texts.items() if (x := windows(q, t)) >= 0.5)[:20]
    assert [(-r.score, r.doc_id) for r in base.QUERIES["search_fuzzy_documents"](spark, SF).collect()] == want
    q = "wereth zzyq"
    smart = {k: 1.0 if q in t else max(0.7 if "wereth" in t.split() else 0, 0.92 * windows(q, t)) for k, t in texts.items()}
    want = sorted((-round(x, 6), k) for k, x in smart.items() if x >= 0.55)[:20]
    assert [(-r.score, r.doc_id) for r in base.QUERIES["search_smart_documents"](spark, SF).collect()] == want


def test_words_of_a_long_episode(spark):
    """Segmentation of one episode in short stretches of time is that of a loop over its words, overlapping words included."""
    import random

    ship(spark)
    rnd = random.Random(9)
    rows, at = [], 0
    for k in range(900):
        at += rnd.choice([0, 1, 3, 4, 5, 9, 30 if k % 90 == 0 else 4])
        rows.append((1 + k // 850, (k // 300) % 2, k // 50, k % 50, at, at + rnd.choice([0, 2, 4, 9, 40]), "end." if rnd.random() < 0.01 else "stop!" if rnd.random() < 0.02 else "w"))
    out, one = {}, None
    for ep, sp, turn, idx, s, e, w in sorted(rows, key=lambda r: (r[0], r[4], r[5], r[2], r[3])):
        if one is None or one[0] != ep or sp != one[1] or s - one[3] > 20 or e - one[2] > 280 or one[5]:
            one = [ep, sp, s, e, 0, False]
            out.setdefault(ep, []).append(one)
        one[3], one[4], one[5] = e, one[4] + 1, w[-1] in "।!?؟"
    want = sorted((*u[:5], k) for us in out.values() for k, u in enumerate(us))
    words = spark.createDataFrame(rows, "episode long, speaker_id long, turn long, idx long, start long, end long, word string")
    for stretch in (70, 6000):
        assert sorted(map(tuple, Q.segment_words(words, stretch=stretch).select("episode", "speaker_id", "start", "end", "n_words", "utterance_index").collect())) == want
    assert Q.segment_words(words.limit(0)).count() == 0


def test_gaps_over_stretches(spark):
    """Enforced gaps of an episode in stretches of time are those of a loop over its segments."""
    import random

    ship(spark)
    rnd = random.Random(10)
    for case in range(3):
        rows = []
        for ep in range(3):
            at = 0
            for _ in range(150):
                at += rnd.choice([0, 10, 200, 900])
                rows.append((ep, rnd.choice("ab" if case else "abcd"), at, at + rnd.choice([0, 5, 100, 400, 5000 if case == 2 else 800])))
        want, line = [], {}
        for ep, sp, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
            if ep in line and line[ep][1] != sp:
                s = max(s, line[ep][0] + 170)
            if e > s:
                want.append((ep, sp, s, e))
                line[ep] = (max(line[ep][0], e) if ep in line else e, sp)
        frame = spark.createDataFrame(rows, "episode long, speaker string, start_ms long, end_ms long").repartition(3)
        for stretch in (700, 20_000, 10**7):
            assert sorted(map(tuple, Q.spaced(frame, 170, stretch).select("episode", "speaker", "start_ms", "end_ms").collect())) == sorted(want)


def test_segmentation_as_a_stream(spark, tmp_path):
    """Words out of order, in micro-batches and over a restart, give the utterances of the batch form; a batch that is run again doubles nothing."""
    import random

    ship(spark)
    rnd = random.Random(3)
    rows, at = [], 0
    for k in range(160):
        at += rnd.choice([2, 4, 5, 30 if k % 30 == 0 else 4])
        rows.append((1 + k % 2, (k // 40) % 2, k // 20, k % 20, at, at + 3, "end!" if rnd.random() < 0.05 else "w"))
    cols = "episode long, speaker_id long, turn long, idx long, start long, end long, word string"
    words = spark.createDataFrame(rows, cols)
    want = sorted(map(tuple, Q.segment_words(words).select("episode", "speaker_id", "start", "end", "n_words", "utterance_index").collect()))
    timed = words.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("start") * 100))
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    place = {r: k for k, r in enumerate(rows)}
    late = timed.collect()
    late.sort(key=lambda r: place[tuple(r)[:7]] // 8 * 8 + rnd.randint(0, 12))  # neighbours change places
    flush = (9, 0, 0, 0, 0, 1, "w")
    parts = [late[k : k + 20] for k in range(0, len(late), 20)]

    def drop(k, part):
        spark.createDataFrame(part, timed.schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = sessions.write_keyed(sessions.segmented(stream, late="20 seconds"), out, cp)
        q.awaitTermination(240)
        assert q.exception() is None

    for k, part in enumerate(parts[:5]):
        drop(k, part)
    run()
    first = spark.read.parquet(out).count()
    for k, part in enumerate(parts[5:], 5):
        drop(k, part)
    import datetime

    drop(99, [(*flush, late[0].ts + datetime.timedelta(days=1))])
    run()  # from the checkpoint
    got = sorted(tuple(r) for r in spark.read.parquet(out).drop("batch").filter("episode < 9").collect())
    assert [x for x in got if x not in want] == [] and [x for x in want if x not in got] == []
    assert got == want and 0 < first < len(got)
    # A batch that is run again after a failure replaces its rows.
    import shutil

    shutil.rmtree(f"{cp}/commits")
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).drop("batch").filter("episode < 9").collect()) == want


def test_files_as_they_are(spark, tmp_path):
    """Quoted line breaks, commas, marks, encodings, missing values and broken files, by the readers and by the data source."""
    from lectern.sources import datasource

    d = tmp_path / "b1" / "data" / "fused"
    d.mkdir(parents=True)
    news = tmp_path / "news"
    news.mkdir()
    body = 'First line, with comma\nsecond "quoted" line\r\nthird'
    quoted = '"' + body.replace('"', '""') + '"'
    (news / "a.csv").write_text(f"id,Title,News body\n1,Headline,{quoted}\n2,other,x\n", newline="")
    (news / "b.csv").write_bytes(f"title,article\r\nT,{quoted}\r\n".encode("utf-8-sig"))
    (news / "c.csv").write_bytes(f"title,body\nবাংলা,{quoted}\n".encode("utf-16"))
    (news / "d.csv").write_bytes(b"title,body\nonly title\n")
    (news / "e.csv").write_bytes(b"")
    (news / "f.csv").write_bytes(b"title,body\nbad \xff byte,x\n")
    want = {"a": ("Headline", body), "b": ("T", body), "c": ("বাংলা", body), "d": ("only title", ""), "f": ("bad \ufffd byte", "x")}
    assert {r.article_id: (r.title, r.text) for r in files.read_articles(spark, str(news)).collect()} == want
    got = files.read_csv(spark, str(news / "a.csv")).collect()
    assert len(got) == 2 and got[0]["News body"].replace("\r\n", "\n") == body.replace("\r\n", "\n") and got[1]["News body"] == "x"

    datasource.register(spark)
    load = lambda kind, path: spark.read.format("lectern").option("kind", kind).load(str(path))
    assert {r.stem: (r.title, r.text) for r in load("articles", news).collect()} == want
    rows = load("csv", news).filter("stem = 'a'").orderBy("record").collect()
    assert [r.fields["News body"] for r in rows] == [body, "x"] and all(r.error is None for r in rows)
    (d / "e1.json").write_text(json.dumps({"episode_id": "E1", "utterances": [{}, {}]}))
    (d / "e2.json").write_text("{broken")
    (d / "e3.json").write_text("[1]")
    (tmp_path / "b1" / "_source_runs" / "fused").mkdir(parents=True)
    (tmp_path / "b1" / "_source_runs" / "fused" / "old.json").write_text("{}")
    (d / "x.rttm").write_text("SPEAKER e1 1 0.5 1.25 <NA> <NA> s1 <NA> <NA>\nSPEAKER e1 1 zero 1 <NA> <NA> s2 <NA> <NA>\nNOISE a b c d e f g\nSPEAKER short\n")
    episodes = {r.stem: (r.collection, r.episode_id, r.utterances, r.error) for r in load("bundle", tmp_path).collect()}
    assert episodes == {"e1": ("b1", "E1", 2, None), "e2": ("b1", None, None, "no JSON object"), "e3": ("b1", None, None, "no JSON object")}
    one = load("bundle", tmp_path).filter("stem = 'e1' AND collection = 'b1'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1 and load("bundle", tmp_path).filter("stem = 'none'").count() == 0
    assert [tuple(r)[2:] for r in load("rttm", tmp_path).orderBy("label").collect()] == [("e1", 0.5, 1.75, "s1", None), ("e1", None, None, "s2", "a number can't be read")]


def test_quantiles(spark, monkeypatch):
    """By refined ranges, as numpy has them: ties, few values, wide spans, nulls and what isn't finite."""
    import random

    import numpy as np

    from lectern.operators import quantiles as QU

    rnd = random.Random(2)
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    for k, values in enumerate(([rnd.gauss(0, 1) for _ in range(501)], [rnd.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(100)], [5.0], [1e308, -1e308, 0.0, 5e-324, 1.0], [float(10**rnd.randint(0, 300)) for _ in range(200)])):
        monkeypatch.setattr(QU, "BUCKETS", 4 if k else 1024)
        rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "x double").repartition(3)
        assert np.allclose(QU.quantiles(rows, "x", shares), np.quantile(values, shares) if k != 3 else [-1e308, 0.0, 5e-324, 1.0, 6e307, 9.6e307, 1e308], rtol=1e-12)
    assert QU.quantiles(rows.filter("x < 0"), "x", [0.5]) == [None]


def test_many_aliases(spark, monkeypatch):
    """One automaton gives what the replacements one after another give: chains, borders, cases, overlaps, and names that make new aliases."""
    import random
    import time

    rnd = random.Random(8)
    parts = ["ab", "Ab", "b", "ba", "c d", "d", "é", "éb", "a.b", "_b", "$1", "ক", "কব"]
    texts = [None, "", *["".join(rnd.choice([*parts, " ", " ", ".", "-", "É"]) for _ in range(rnd.randint(1, 14))) for _ in range(150)]]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string").coalesce(2)
    ship(spark)
    for _ in range(4):
        names = [(rnd.choice(parts) + rnd.choice(["", " ", "."]) + rnd.choice(parts) if rnd.random() < 0.5 else rnd.choice(parts), rnd.choice([*parts, "ab d", "X\\\\y", "c d é"])) for _ in range(14)]
        both = []
        for few in (100, 0):
            monkeypatch.setattr(L, "FEW", few)
            both.append([tuple(r) for r in rows.select("id", L.restore_entities(F.col("t"), names).alias("x"), L.restored_hits(F.col("t"), names).alias("h")).orderBy("id").collect()])
        assert both[0] == both[1]

    def cost(n):
        held = L.Aliases([(f"alias{k} word", f"name{k}") for k in range(n)])
        held.present("")
        text = "some words without one and alias3 word here " * 200
        return min(_timed(lambda: held.present(text)) for _ in range(5))

    def _timed(fn):
        began = time.perf_counter()
        fn()
        return time.perf_counter() - began

    assert cost(10_000) < 20 * cost(10)


def test_many_stems():
    """Mentions by looked-up beginnings are those of a pattern for each stem."""
    import random
    import re

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    for _ in range(60):
        targets = [{"canonical": f"t{k}", "stems": [" ".join(word() for _ in range(rnd.choice([1, 1, 2]))) for _ in range(3)], "exclude": [word() + word()]} for k in range(4)]
        text = rnd.choice(["", " "]) + "  ".join(word() + rnd.choice(["", ".", word()]) for _ in range(20))
        stems = sorted(((s, t) for t in targets for s in t["stems"]), key=lambda x: -len(x[0]))
        spans, want = [], []
        for s, t in stems:
            for m in re.finditer(rf"(?<!\S)(?:{r'\s+'.join(s.split())})\S*", text):
                other = any(m.group().startswith(x) and not re.search(r"\s", m.group()[len(x) :]) for x in t["exclude"])
                if not other and not any(a <= m.start() and m.end() <= b for a, b in spans):
                    spans.append(m.span())
                    want.append((t["canonical"], m.group(), *m.span()))
        assert L.Lexicon(targets, []).mentions(text) == sorted(want, key=lambda x: x[2])


def test_publishing(spark, tmp_path):
    """A killed run goes on where it stopped, changed and lost keys are written again, and no row is lost or doubled."""
    import shutil

    from lectern.sources import publishing as P

    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(k % 7 if k % 7 else None, k, f"t{k}") for k in range(40)], "key long, n long, text string")
    plain = lambda d: sorted(map(str, d.collect()))
    with pytest.raises(FileNotFoundError):
        P.published(spark, path)

    def stop(batch):
        if batch == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        P.publish(rows, path, ["key"], batches=4, after=stop)
    some = P.published(spark, path).count()
    assert 0 < some < 40
    left = {r.key for r in P.missing(rows, path, ["key"]).collect()}
    got = {r.key: r.status for r in P.publish(rows, path, ["key"], batches=4).collect()}
    assert {k for k, s in got.items() if s == "new"} == left and plain(P.published(spark, path)) == plain(rows) and len(got) == 7
    version = P.current(spark, path)["version"]
    assert {r.status for r in P.publish(rows.repartition(3), path, ["key"]).collect()} == {"same"} and P.current(spark, path)["version"] == version
    changed = rows.filter("key IS NULL OR key != 3").withColumn("text", F.when(F.col("n") == 7, "other").otherwise(F.col("text")))
    assert {r.key: r.status for r in P.publish(changed, path, ["key"]).collect()}[None] == "changed"
    assert plain(P.published(spark, path)) == plain(changed.unionByName(rows.filter("key = 3")))
    P.publish(changed, path, ["key"], drop=True)
    assert plain(P.published(spark, path)) == plain(changed)
    run = P.manifest(spark, path).filter("key = 1").first().run
    shutil.rmtree(f"{path}/data/run={run}")
    assert "lost" in {r.status for r in P.publish(changed, path, ["key"]).collect()} and plain(P.published(spark, path)) == plain(changed)


def test_recordings_by_links(spark):
    """Free recordings by links, against a loop over all recordings for each episode; and a large collection in seconds."""
    import random
    import time

    import pandas as pd

    from lectern.operators import audio

    def _choice(ep, recordings: list, claimed: set[str], tolerance: float) -> tuple[str | None, str | None]:
        """One episode's recording, and the rule that found it."""
        known = lambda x: x is not None and x == x
        long_enough = lambda r: ep["end_sec"] <= 0 or not known(r["duration"]) or r["duration"] >= ep["end_sec"] - tolerance
        fits = [r for r in recordings if long_enough(r)]
        for r in fits:
            if ep["local_path"] and r["path"] == ep["local_path"]:
                return r["path"], "exact"
        free = [r for r in fits if r["path"] not in claimed]
        for r in free:
            if ep["name"] and r["name"] == ep["name"]:
                return r["path"], "name"
        for wanted in (ep["duration"], ep["end_sec"]):
            near = [(abs(r["duration"] - wanted), r["path"]) for r in free if wanted > 0 and known(r["duration"]) and abs(r["duration"] - wanted) <= tolerance]
            if near:
                return min(near)[1], "duration"
        digits = str(ep["episode"])[len(str(ep["episode"]).rstrip("0123456789")) :]
        if digits:
            stems = {f"{int(digits):02d}", str(int(digits))}
            for r in free:
                agrees = ep["duration"] <= 0 or not known(r["duration"]) or abs(r["duration"] - ep["duration"]) <= tolerance
                if r["name"].rsplit(".", 1)[0] in stems and agrees:
                    return r["path"], "number"
        return None, None

    rnd = random.Random(5)
    for case in range(120):
        recs = sorted(((rnd.choice(["a/", "b/"]) + rnd.choice(["x.mp3", "y.mp3", "07.mp3", "7.wav", f"{k}.mp3"]), rnd.choice([None, 5.0, 6.0, 6.5, 7.0, 60.0])) for k in range(rnd.randint(0, 12))), key=lambda r: r[0])
        recs = [{"path": p, "name": p.split("/")[-1], "duration": d} for p, d in recs]
        free = audio.Free(pd.DataFrame(recs, columns=["path", "name", "duration"]), 2.0)
        claimed = set()
        for k in range(10):
            local = rnd.choice(["", "", "a/x.mp3", "c/y.mp3"])
            ep = {"episode": rnd.choice(["e7", "e", "ep07", "e3"]), "local_path": local, "name": local.split("/")[-1], "duration": rnd.choice([0.0, 5.5, 6.0, 9.0]), "end_sec": rnd.choice([0.0, 5.0, 8.5, 61.0])}
            want = _choice(ep, recs, claimed, 2.0)
            if want[0]:
                claimed.add(want[0])
            assert free.choice(ep["episode"], ep["local_path"], ep["name"], ep["duration"], ep["end_sec"]) == want, case
    began = time.perf_counter()
    n = 100_000
    free = audio.Free(pd.DataFrame({"path": [f"r{k:06d}" for k in range(n)], "name": [f"r{k:06d}" for k in range(n)], "duration": [float(k % 5000) for k in range(n)]}), 2.0)
    assert sum(free.choice(f"e{k}x", "", "", float(k * 7 % 5000), 0.0)[0] is not None for k in range(n)) > n // 2 and time.perf_counter() - began < 20


def test_recordings_within_reach(spark):
    """Of many recordings few are read in Python, and each episode gets what it gets of all, with paths that are there twice and lengths that all want."""
    import random

    import pandas as pd

    from lectern.operators import audio

    ship(spark)
    rnd = random.Random(8)
    eps, recs = [], []
    for c in range(60):
        lengths = rnd.choice([[5.0, 6.0, 6.5, 7.0, 8.0], [x / 4 for x in range(60)]])
        most = rnd.choice([6, 20, 60])
        for k in range(rnd.randint(0, most)):
            path = rnd.choice(["a/", "b/"]) + rnd.choice(["x.mp3", "07.mp3", "7.wav", "É.mp3", *[f"{rnd.randint(0, 99)}k.mp3"] * 12])
            recs.append((c, path, audio_name(path), rnd.choice([None, float("nan"), *[rnd.choice(lengths)] * 10])))
        for k in range(rnd.randint(1, 12)):
            local = rnd.choice(["", "", "", "a/x.mp3", "c/é.mp3"])
            eps.append((c, f"{rnd.choice(['e', 'e0', 'f'])}{rnd.choice(['', k, 7])}-{k}" if rnd.random() < 0.5 else f"{k}e7", local, audio_name(local), rnd.choice([0.0, 5.5, 6.0, 6.5, 9.0]), rnd.choice([0.0, 0.0, 5.0, 6.0, 8.5, 61.0])))
    recs += [(99, f"r/{k:06d}x", f"{k:06d}x", float(k % 500)) for k in range(40_000)]
    eps += [(99, f"e{k}x", "", "", 200.0 + k % 3, 200.0) for k in range(50)]
    e = spark.createDataFrame(eps, "collection long, episode string, local_path string, name string, duration double, end_sec double")
    r = spark.createDataFrame(recs, "collection long, path string, name string, duration double")
    left = [tuple(x) for x in audio.within_reach(e, r, 2.0).select("collection", "path", "name", "duration").collect()]
    assert sum(x[0] == 99 for x in left) < 2_000

    def choices(rows, c):
        free = audio.Free(pd.DataFrame([x[1:] for x in rows if x[0] == c], columns=["path", "name", "duration"]).sort_values("path", kind="stable"), 2.0)
        return [free.choice(*x[1:]) for x in sorted(x for x in eps if x[0] == c)]

    found = {c: choices(recs, c) for c in [*range(60), 99]}
    assert all(choices(left, c) == want for c, want in found.items())
    assert {how for x in found.values() for _, how in x} == {"exact", "name", "duration", "number", None}
    whole = audio.resolved(e.drop("name").withColumnRenamed("duration", "duration_sec"), r.drop("name"))
    got = {(x.collection, x.episode): (x.path, x.how) for x in whole.collect()}
    assert got == {(x[0], x[1]): y for c, want in found.items() for x, y in zip(sorted(x for x in eps if x[0] == c), want)}


def audio_name(path):
    import unicodedata

    return unicodedata.normalize("NFC", path.split("/")[-1]).casefold()


def test_resolved_recordings_query(spark):
    """The registered query gives each episode what a loop over its collection's recordings gives."""
    from lectern.plans import base, corpus_queries

    ship(spark)
    eps, recs = corpus_queries.cascade(spark, SF)
    rows = [r.asDict() for r in recs.select("collection", "path", "duration").collect()]
    want, claimed = {}, {}
    for e in sorted(eps.collect(), key=lambda r: (r.collection, r.episode)):
        mine = claimed.setdefault(e.collection, set())
        fits = [r for r in rows if r["collection"] == e.collection and r["duration"] >= e.end_sec - 2]
        found, how = next(((r["path"], "exact") for r in fits if r["path"] == e.local_path), (None, None))
        near = [(abs(r["duration"] - e.duration_sec), r["path"]) for r in fits if r["path"] not in mine and abs(r["duration"] - e.duration_sec) <= 2]
        if found is None and e.duration_sec > 0 and near:
            found, how = min(near)[1], "duration"
        near = [(abs(r["duration"] - e.end_sec), r["path"]) for r in fits if r["path"] not in mine and abs(r["duration"] - e.end_sec) <= 2]
        if found is None and e.end_sec > 0 and near:
            found, how = min(near)[1], "duration"
        mine.add(found)
        want[e.collection, e.episode] = (found, how)
    got = {(r.collection, r.episode): (r.path, r.how) for r in base.QUERIES["resolved_recordings"](spark, SF).collect()}
    assert got == want and {h for _, h in want.values()} == {"exact", "duration", None}


def test_folds(spark):
    """No text of a fold has a part in its vocabulary or majority; the classifier learns what the majority can't."""
    from collections import Counter

    from lectern.operators import vectors as V
    from lectern.plans import aggregate_queries, base

    ship(spark)
    rows = {r.doc_id: r for r in aggregate_queries._judged_texts(spark, SF).collect()}
    got = {r.doc_id: r for r in base.QUERIES["fold_baselines"](spark, SF).collect()}
    assert set(got) == set(rows)
    for f in {r.fold for r in rows.values()}:
        counts = Counter(r.label for r in rows.values() if r.fold != f)
        most = min(counts, key=lambda c: (-counts[c], c))
        assert {r.majority for r in got.values() if r.fold == f} == {most}
    both = lambda c, k: 2 * sum(r[c] == r.truth == k for r in got.values()) / max(1, sum((r[c] == k) + (r.truth == k) for r in got.values()))
    assert both("pred", 0) + both("pred", 1) > both("majority", 0) + both("majority", 1)
    train = spark.createDataFrame([(k, ("good fine " if k % 2 else "bad poor ") + f"word{k % 3}", k % 2) for k in range(24)], "id long, text string, label int")
    test = spark.createDataFrame([(100, "fine unseen", 1), (101, "Bad x", 0), (102, None, 0)], "id long, text string, label int")
    words = V.Vectorizer(train, "id", "text", [V.WORDS, V.Kind(V.char_grams, 3, 10)])
    assert "unseen" not in {r.gram for w in words.words for r in w.collect()} and words.words[1].count() == 10
    out, strength = V.grid_refit(train, train.withColumn("id", F.col("id") + 1000), test, "id", "text", "label", 2, [V.WORDS, V.CHARS], [0.5, 2.0])
    assert strength == 0.5 and {r.id: r.pred for r in out.collect() if r.id < 102} == {100: 1, 101: 0}
    norms = {round(sum(x * x for x in r.features.values), 9) for r in V.Vectorizer(train, "id", "text", [V.WORDS]).vectors(test).collect()}
    assert norms <= {0.0, 1.0}


def test_measured_noise_limit(spark):
    from lectern.plans import base

    ship(spark)
    curve = base.QUERIES["noise_curve"](spark, SF).collect()
    best = max(r.macro_f1 for r in curve)
    near = [r.achieved_wer for r in curve if r.macro_f1 >= best - 0.03]
    assert base.QUERIES["measured_noise_limit"](spark, SF).first()[0] == max(near)


def test_grams_are_counted_without_a_shuffle_of_grams(spark):
    """Counts of a key stand in its own part: texts are dealt by key, and neither counts nor weights are dealt or sorted again. Rows of one key are one text."""
    from lectern.operators import vectors as V

    rows = spark.createDataFrame([(1, "aa bb aa"), (1, "bb"), (2, None), (3, "aa c")], "id int, text string").coalesce(1)
    counts = V.counted(rows, "id", "text", V.WORDS)
    assert sorted(map(tuple, counts.collect())) == [(1, "aa", 2), (1, "aa bb", 1), (1, "bb", 2), (1, "bb aa", 1), (3, "aa", 1)]
    words = V.vocabulary(counts, 3, V.Kind(V.word_grams, 1, 9))
    plan = V.weights(counts, words, "id")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+, gram", plan) and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_postings_hold_a_row_for_a_token_of_a_row(spark, tmp_path):
    """A text's words are grouped inside it, so that the index shuffles and sorts fewer rows than words; places stay whole."""
    from lectern.operators import postings as P

    ship(spark)
    docs = spark.createDataFrame([(0, "a b a a"), (1, None), (2, "b c b")], "id long, text string").coalesce(1)
    index = P.build(docs, str(tmp_path / "index"), ["id"])
    assert sorted((r.token, r.row & 0xFF, r.places) for r in index.table("postings").collect()) == [("a", 0, [0, 2, 3]), ("b", 0, [1]), ("b", 2, [0, 2]), ("c", 2, [1])]
    assert sorted(map(tuple, index.table("vocabulary").collect())) == [("a", 1, 3), ("b", 2, 3), ("c", 1, 1)] and index.words == 7


def test_noise_is_made_once(spark):
    """Error rates and F1 of the noise curve come from one pass over the noisy turns."""
    from lectern.plans import base, review_queries  # noqa: F401

    plan = base.QUERIES["noise_curve"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conversations") <= 1 and plan.count("Relation") == 1


def test_folds_read_texts_twice(spark):
    """Grams are made once for all folds' counts and once for all folds' vectors, not for each fold's fit, training and test; rows of one key are told once each."""
    from lectern.operators import vectors as V

    ship(spark)
    made = []

    def grams(text):
        made.append(text)
        return V.word_grams(text)

    rows = [(k, ("good fine " if k % 2 else "bad poor ") + f"word{k % 3}", k % 2, k // 2 % 3) for k in range(24)]
    frame = spark.createDataFrame([*rows, (0, "bad bad", 0, 0)], "id long, text string, label int, fold int")
    got = V.by_folds(frame, "id", "text", "label", "fold", 2, [V.Kind(grams, 2, 50), V.CHARS]).collect()
    assert len(made) == 2
    assert sorted((r.id, r.fold, r.truth, r.pred) for r in got) == sorted((k, f, label, label) for k, _, label, f in [*rows, rows[0]])


def test_vectors_are_the_weights(spark):
    """Vectors made over Arrow batches, a few words at a time, hold what the joins of counts and vocabulary give, for several texts of a key and for other scripts as well."""
    import pyarrow as pa

    from lectern.operators import vectors as V

    ship(spark)
    texts = [(1, "Aa bb aa été x"), (1, "bb শব্দটি 😀z abcde"), (2, None), (3, "aa c  abcd"), (4, ""), (5, "aaaaaaa aa bb")]
    rows = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    kinds = [V.Kind(V.word_grams, 1, 9), V.Kind(V.char_grams, 1, 40)]
    fit = V.Vectorizer(rows, "id", "text", kinds)
    want, start = {}, 0
    for kind, own in zip(kinds, fit.words, strict=True):
        words = V.vocabulary(V.counted(rows, "id", "text", kind), len(texts), kind)
        grams = sorted((r.gram, r.df, r.n) for r in words.collect())
        assert sorted(map(tuple, own.collect())) == grams
        place = {g: start + k for k, (g, _, _) in enumerate(grams)}
        for r in V.weights(V.counted(rows, "id", "text", kind), words, "id").collect():
            want[r.id, place[r.gram]] = r.weight
        start += len(grams)
    told = fit.vectors(rows).collect()
    assert sorted(r.id for r in told) == [1, 1, 2, 3, 4, 5] and {r.features.size for r in told} == {start}
    got = {(r.id, int(i)): v for r in told for i, v in zip(r.features.indices, r.features.values, strict=True)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    units = pa.record_batch({"u": pa.array([[["a"] * 3], [["b"]], [], [["c"], ["d"] * 9]], pa.list_(pa.list_(pa.string())))})
    held, V.UNITS = V.UNITS, 4
    try:
        assert [p.num_rows for p in V._portions(units, 1)] == [2, 2]
    finally:
        V.UNITS = held
