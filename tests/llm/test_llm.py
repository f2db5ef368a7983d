"""Each operator against a brute-force version or an exact round trip, with nulls, empty texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import chosenpath, common, decontaminate, exchange, licenses, lm, packing, quality, ranking, registry, simhash, substrings, suffixes, toxicity, warc, whitening
from tests.conftest import SF, normal

CLASH = "doc_id long, text string, " + ", ".join(f"{c} string" for c in "id row row_number kept_text hit items fp component_id root key sketch score n_words start block dest extra".split())
NAMES = [c.split()[0] for c in CLASH.split(", ")]


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *["x"] * (len(NAMES) - 2)) for i, t in rows], CLASH).repartition(parts)


def sample(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["été", "ÉTÉ", "Mixed", "mixed"]
    passages = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "a " * 300), (5, "x" * 700)]
    for i in range(6, n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 150)))
        if rnd.random() < 0.5:
            p = rnd.choice(passages).split()
            t += " " + " ".join(p[rnd.randint(0, 20) :]) + ("\n" if rnd.random() < 0.5 else " ") + t[: rnd.randint(0, 90)]
        rows.append((i * 37 % 1009, t))
    rows += [(2000, rows[10][1]), (2001, rows[10][1]), (2002, passages[0]), (2003, passages[0] + " end")]
    return rows


def blob(t):
    return (t or "").encode()


def lower(b):
    return b.lower()


# The queries with SQL.


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


EMPTY = [
    lambda d: lm.score(d), lambda d: packing.pack(d), lambda d: licenses.report(d), lambda d: simhash.near_duplicate_components(d), lambda d: suffixes.report(d), lambda d: substrings.report(d),
    lambda d: quality.measure(d), lambda d: decontaminate.report(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
    lambda d: toxicity.report(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int")), lambda d: warc.roundtrip(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
    lambda d: simhash.drop_near_duplicates(d), lambda d: substrings.deduplicate(d), lambda d: quality.filter_quality(d),
    lambda d: chosenpath.near_duplicate_components(d), lambda d: ranking.report(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: whitening.report(d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("double")).alias("embedding"))),
]


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_empty_table(spark, k):
    assert EMPTY[k](frame(spark, [], 1)).count() == 0


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_nulls_and_repeats(spark, k):
    """Null ids and texts, and repeated rows, come through without failing; all operators but filters give a row for each."""
    rows = [(None, None), (None, "a b c"), (1, None), (1, None), (2, "a b c " * 30), (2, "a b c " * 30)]
    assert EMPTY[k](frame(spark, rows)).count() >= (6 if k < 10 or k == 13 else 0)


# Blocks and shards


@pytest.fixture(params=["direct", "routed"])
def exchanged(request, monkeypatch):
    """Shards asked by blocks, and through routers; small blocks, so that there are many."""
    if request.param == "routed":
        monkeypatch.setattr(exchange, "DIRECT_SHARDS", 2)
    for m in (lm, substrings, suffixes):
        monkeypatch.setattr(m, "BLOCK_BYTES", 4000)
    return request.param


def test_packed_numbers():
    for x in (np.array([], np.uint64), np.array([1, 5, 2], np.int64), np.array([True, False, True]), np.arange(9, dtype=np.uint8), np.array([1 << 63], np.uint64)):
        got = exchange.unpack(exchange.pack(x))
        assert got.dtype == x.dtype and np.array_equal(got, x)
    b = exchange.Batch(np.array([3, 3, 9], np.uint64), [np.array([1, 2, 3], np.uint32)], np.frombuffer(b"abcdef", np.uint8), np.array([1, 2, 3], np.uint16))
    c = exchange.Batch.of(b.part(1, 3).blobs())
    assert c.keys.tolist() == [3, 9] and c.columns[0].tolist() == [2, 3] and c.text.tobytes() == b"bcdef" and b.at(np.array([2, 0])).text.tobytes() == b"defa"


def test_routers_fold_equal_keys():
    """A router sends each key once, and gives every block the answer that a shard without routers gives."""
    rng = np.random.default_rng(3)
    keys, ids, at = np.sort(rng.integers(0, 20, 90)).astype(np.uint64), rng.integers(0, 9, 90), rng.integers(0, 99, 90).astype(np.uint32)
    who = rng.integers(0, 7, 90)
    q = exchange.Firsts()
    whole, _ = q.answer(exchange.Batch(keys, [ids, at]), who)
    batch, of, folded = q.fold(exchange.Batch(keys, [ids, at]), who)
    assert len(batch.keys) == len(set(keys.tolist()))
    again = q.unfold(q.answer(batch, of)[0], folded)
    assert all(np.array_equal(a, b) for a, b in zip(whole, again))
    s = exchange.Sums()
    batch, of, folded = s.fold(exchange.Batch(keys, [at]), who)
    assert np.array_equal(s.unfold(s.answer(batch, of)[0], folded)[0], s.answer(exchange.Batch(keys, [at]), who)[0][0])


# 1


def test_lm(spark, exchanged):
    rows = [*sample(), (3000, "a b c d e f g " * 40), (3001, "a b c d e f g " * 20), (3002, "a b c d e q")]
    toks = {i: [*lower(blob(t)).split(), b"</s>"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    order = len(lm.PRIORS) + 1
    c = [Counter() for _ in range(order + 1)]
    for i, w in toks.items():
        for k in range(1, order + 1) if not held[i] else ():
            c[k].update(zip(*[w[x:] for x in range(k)]))
    n, v = sum(c[1].values()), len(c[1])

    def p(context, w):
        if not context:
            return (c[1][(w,)] + 0.1) / (n + 0.1 * (v + 1))
        seen = c[len(context)][context]
        if seen < (1 if len(context) == 1 else 2):
            return p(context[1:], w)
        m = lm.PRIORS[len(context) - 1]
        return (c[len(context) + 1][*context, w] + m * p(context[1:], w)) / (seen + m)

    # The probabilities after any context add up to one over the vocabulary and the class of unseen words.
    for context in ((), (b"a",), (b"a", b"b"), (b"b", b"c", b"d"), (b"a", b"b", b"c", b"d")):
        assert sum(p(context, w) for (w,) in c[1]) + p(context, b"never seen") == pytest.approx(1.0)
    got = {r.doc_id: r for r in lm.score(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, w in toks.items():
        r = got[i]
        want = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(len(w)))
        assert r.score == pytest.approx(want, rel=1e-9) and r.base_score == pytest.approx(sum(math.log10(p((), x)) for x in w), rel=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[1][(x,)] > 0 for x in w), n)


def test_lm_reads_long_texts_in_pieces(monkeypatch):
    """Where a text is cut into pieces for the cursors makes no difference."""
    rnd = random.Random(2)
    text = " ".join(f"w{rnd.randrange(9)}" for _ in range(5000)).encode()
    block = exchange.Block(0, np.array([1, 2]), np.frombuffer(text + b"w1 w2", np.uint8), np.array([0, len(text), len(text) + 5]))
    had = []
    for q in (lm.ShortGrams(), *[lm.LongGrams(k) for k in range(3, 6)]):
        batch = q.ask(block, had)
        columns, stats = q.answer(batch, np.zeros(len(batch.keys), np.int64))
        total, kinds = stats or (total, kinds)
        had.append(columns)
    t = lm.Tokens(block)
    scores = []
    for lane in (256, 17, 100_000):
        monkeypatch.setattr(lm, "LANE", lane)
        scores.append(lm.Automaton(t, lm.levels_of(t, had), total, kinds, lm.PRIORS).read(t.first))
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


# 2


def test_toxicity(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        sents = [" ".join(rnd.choice(words) for _ in range(8)) for _ in range(rnd.randint(3, 12))]
        if bad := rnd.random() < 0.25:
            k = rnd.randrange(len(sents))
            sents[k] += f" vile{rnd.choice(['st', 'ness', ''])} scum"
        rows.append((i, ". ".join(sents) + "."))
        labels.append((i, int(bad)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.report(docs, marks).toPandas()
    truth = dict(labels)
    out = got[got.held_out]
    assert (out.predicted == out.doc_id.map(truth)).mean() > 0.97 and ((got.score >= 0) & (got.score <= 1)).all()
    assert set(got[got.held_out].doc_id) == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    model = toxicity.train(docs, marks)
    found = toxicity.locate(docs, model).toPandas()
    assert found.sentence.str.contains("scum").mean() > 0.9 and set(found.doc_id) >= {i for i in truth if truth[i]} - set(got[got.predicted == 0].doc_id)
    again = toxicity.report(docs.withColumn("text", F.col("text")), marks).toPandas()
    assert np.allclose(sorted(again.score), sorted(got.score))


def test_noisy_or_by_hand(spark):
    """Scores are the noisy-or over sentences of the logistic of summed weights, feature by feature."""
    import re

    model = toxicity.Model(np.random.default_rng(5).normal(0, 2, toxicity.WEIGHTS + 1), -1.5)
    model.weights[toxicity.WEIGHTS] = 0
    rows = [(1, "One two. Threes! four?five\nsixsixsix"), (2, ""), (3, None), (4, "..."), (5, "été Été, abcdefgh"), (None, "a b"), (None, "a b")]

    def feature(b, size):
        h = sum(int(common.BYTE_VALUE[x]) * pow(int(common.BASE), k, 1 << 64) for k, x in enumerate(b)) + size
        return int(common.mix(np.array([h % (1 << 64)], np.uint64))[0] % np.uint64(toxicity.WEIGHTS))

    def want(t):
        out = 1.0
        for s in re.split(rb"[.!?\n]", lower(blob(t))):
            ws = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", s)
            if ws or not re.search(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]", lower(blob(t))):
                z = -1.5 + sum(model.weights[feature(w, 0)] + sum(model.weights[feature(w[:n], n)] for n in toxicity.STEMS if len(w) > n) for w in ws)
                out *= 1 - 1 / (1 + math.exp(-z))
                if not ws:
                    break
        return 1 - out

    got = [(r.doc_id, r.score) for r in toxicity.score(frame(spark, rows), model, ["doc_id"]).collect()]
    assert sorted((str(i), round(x, 9)) for i, x in got) == sorted((str(i), round(want(t), 9)) for i, t in rows)


def test_toxicity_of_null_ids(spark):
    rows = [(None, "bad words"), (2, "good words"), (2, "good words"), (3, None)]
    marks = spark.createDataFrame([(None, 1), (2, 0), (2, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.report(frame(spark, rows), marks).collect()
    assert len(got) == 4 and all(r.held_out is not None and 0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out


def test_toxicity_learns_whole_texts(spark):
    """An offending sentence behind 20,000 words is learnt from like any other."""
    rows = [(i, "plain words here " * (7000 if i % 4 == 0 else 3) + (". utter scum." if i % 4 == 0 else ".")) for i in range(40)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), marks)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [(1, "plain words. utter scum."), (2, "plain words.")]), model, ["doc_id"]).collect()}
    assert got[1] > 0.5 > got[2]


# 3


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*sample(), (3000, "long word " * 6000), (3001, "<|endoftext|> x<|startoftext|>y"), (3002, "don't ΣΣ 　é")]
    for window in (256, 4096):
        got = packing.pack(frame(spark, rows), window=window).toPandas()
        for i, t in rows:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            own = got[got.doc_id == i].sort_values("start")
            assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
            at = 0
            for _, p in own.iterrows():
                assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and (n := s.length.sum()) <= window and (n == window or n & (n - 1) == 0)
        assert (got.length > 0).all()


def test_packing_by_placement():
    """Of many documents most tokens stay in the windows that placement chose, and few documents are cut."""
    rnd = random.Random(4)
    p, out, cut = packing.Packer(4096), [], Counter()
    for i in range(6000):
        out += p.add(i, np.arange(rnd.randint(1, 900)))
    placed = sum(x[2] for x in out)
    out += p.finish()
    cut.update(x[0] for x in out)
    assert placed / sum(x[2] for x in out) > 0.6 and sum(n > 1 for n in cut.values()) < 600
    sizes = Counter()
    for x in out:
        sizes[x[5]] += x[2]
    assert sum(n != 4096 for n in sizes.values()) <= 12 and all(n & (n - 1) == 0 for n in sizes.values())


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_sum_of_squares_choice():
    """The level chosen is the one that a sum over the whole array says."""
    rnd = random.Random(5)
    p = packing.Packer(32)
    for i in range(300):
        size = rnd.randint(1, 31)
        sums = {}
        for at in range(0, 33 - size):
            if at == 0 or p.count[at] > 0:
                c = p.count.copy()
                if at:
                    c[at] -= 1
                if at + size < 32:
                    c[at + size] += 1
                sums[at] = int((c[1:32] ** 2).sum())
        assert sums[p.level(size)] == min(sums.values())
        list(p.add(i, np.arange(size)))


# 4


def test_licenses(spark):
    def units(t):
        import re

        yield from ((k, u) for k, us in (("line", t.split("\n")), ("sentence", re.split(r"(?<=[.!?])(?=[ \t\r\x0b\x0c\n])|\n", t)), ("paragraph", t.split("\n\n")), ("text", [t])) for u in us)

    grams = lambda t: {(a, b) for w in [decontaminate.normal_words(t.encode())] for a, b in zip(w, w[1:])}
    mit = licenses.TEMPLATES[6][1]
    rows = [*sample(), (4000, "Some words. Licensed under the Apache License, Version 2.0. More"), (4001, "x\nreleased UNDER the MIT licence\ny"), (4002, mit), (4003, "pre\n\n" + mit.replace("free", "gratis") + "\n\npost"), (4004, "Licensed under CC BY-NC 4.0.")]
    want = {}
    for i, t in rows:
        want[i] = set()
        for kind, u in units(t or ""):
            a = grams(u)
            for name, tpl in licenses.TEMPLATES:
                b = grams(tpl)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= licenses.LEAST:
                    want[i].add(name)
        w = decontaminate.normal_words(blob(t))
        for name, tpl in licenses.TEMPLATES:
            b, n = grams(tpl), len(decontaminate.normal_words(tpl.encode()))
            for k in range(len(w) - n + 1):
                a = set(zip(w[k : k + n], w[k + 1 : k + n]))
                if 2 * len(a & b) / (len(a) + len(b)) >= licenses.LEAST:
                    want[i].add(name)
    got = {r.doc_id: r for r in licenses.report(frame(spark, rows)).collect()}
    assert {i: set(filter(None, r.licenses.split(","))) for i, r in got.items()} == want
    assert got[4000].best_license == "Apache-2.0" and got[4000].best_dice == 1.0 and got[4002].best_license == "MIT" and got[0].best_license is None and got[0].best_dice == 0.0
    assert licenses.scan(frame(spark, rows)).filter("doc_id = 4004 AND unit = 'line'").first().matched == "Licensed under CC BY-NC 4.0"


def test_licenses_inside_long_texts(spark):
    """A licence of several paragraphs, one wrapped in comment lines, and one with CRLF are found between much other text."""
    rnd = random.Random(6)
    other = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(400))
    mit, apache = licenses.TEMPLATES[6][1], licenses.TEMPLATES[1][1].split()
    paragraphs = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    lines = [" ".join(apache[k : k + 9]) for k in range(0, len(apache), 9)]
    rows = [(1, f"{other()}\n\n{paragraphs}\n\n{other()}"), (2, other() + "\n * " + "\n * ".join(lines) + "\n" + other()), (3, other() + "\r\n\r\n" + "\r\n".join(lines) + "\r\n\r\n" + other()), (4, other())]
    got = {r.doc_id: (r.licenses, r.best_dice) for r in licenses.report(frame(spark, rows)).collect()}
    assert got == {1: ("MIT", 1.0), 2: ("Apache-2.0", 1.0), 3: ("Apache-2.0", 1.0), 4: ("", 0.0)}


# 5


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark):
    rows = sample()

    def fp(t):
        w = lower(blob(t)).split()
        if not w:
            return 0
        k = min(3, len(w))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    want = {i: fp(t) for i, t in rows}
    ids = list(want)
    comp = roots(ids, [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 2])
    got = {r.doc_id: r for r in simhash.near_duplicate_components(frame(spark, rows)).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want and {i: r.component_id for i, r in got.items()} == comp


def test_bit_sliced_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (40, 1), dtype=np.uint64)
    fp = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, (40, 1)).astype(np.uint64)) for _ in range(5)] + [base])
    keys = np.sort(rng.integers(0, 3, len(fp)))
    for radii in ([2], [1, 2, 30]):
        i, j = simhash.forest(keys, fp, radii)
        dist = lambda a, b: int(np.bitwise_count(fp[a] ^ fp[b])[0])
        assert all(keys[a] == keys[b] and dist(a, b) <= radii[-1] for a, b in zip(i.tolist(), j.tolist()))
        n = range(len(fp))
        assert roots(n, zip(i.tolist(), j.tolist())) == roots(n, [(a, b) for a in n for b in n if a < b and keys[a] == keys[b] and dist(a, b) <= radii[-1]])


def test_simhash_hot_blocks(spark, monkeypatch):
    """Blocks over their bound are parted again without losing a link."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(20)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    reps = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    found = {r.id: r.root for r in simhash.components(simhash.compared(simhash.blocks_within_two(reps), [2])).collect()}
    n = range(len(fps))
    want = roots(n, [(a, b) for a in n for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {i: found.get(i, i) for i in n} == want


def shingled(rows):
    return {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))} for i, t in rows}


def jaccard_roots(rows):
    sets = shingled(rows)
    jac = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return roots(sets, [(a, b) for a in sets for b in sets if a < b and jac(a, b) >= 0.8])


@pytest.mark.parametrize("bound", [16_384, 4])
def test_near_duplicates(spark, monkeypatch, bound):
    """Groups of copies and near copies; the bound makes every block a hot one, of which pairs of parts are compared."""
    rnd = random.Random(7)
    rows = []
    for g in range(12):
        text = [f"g{g}w{rnd.randrange(400)}" for _ in range(150)]
        for c in range(4):
            own = list(text)
            for _ in range((0, 1, 2, 30)[c]):
                own[rnd.randrange(150)] = f"new{rnd.random()}"
            rows.append((g * 10 + c, " ".join(own)))
    rows += [(500 + k, " ".join(f"s{x}" for x in range(k % 5 + 1))) for k in range(10)]
    want = jaccard_roots(rows)
    monkeypatch.setattr(simhash, "SKETCH_ROWS", bound)
    kept = simhash.drop_near_duplicates(frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} and kept.columns == NAMES


@pytest.mark.parametrize("changed", [5, 6, 7])
def test_near_duplicates_of_one_text(spark, changed):
    """Very many variants of one text, similar to each other at 0.7 to 0.85, and a passage that all others share: recall of removable documents."""
    rnd = random.Random(changed)
    base = [f"b{k}" for k in range(300)]
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(0, " ".join(base))]
    for i in range(1, 250):
        own = list(base)
        for k in rnd.sample(range(300), changed):
            own[k] = f"v{i}x{k}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"o{i}x{k}" for k in range(70)) + " " + passage) for i in range(150)]
    want = jaccard_roots(rows)
    removable = {i for i in want if want[i] != i}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert len(removable) > 50 and len(removable - kept) >= 0.98 * len(removable) and kept >= set(want) - removable


def test_near_duplicates_of_failing_links(spark):
    """Chains of similarities from 0.75 to 0.85: a link that fails doesn't stand for one that holds."""
    rnd = random.Random(9)
    rows = []
    for g in range(12):
        center = [f"g{g}w{k}" for k in range(1500)]
        spots = rnd.sample(range(0, 1500, 10), 75)
        for c in range(6):
            own = list(center)
            for k in rnd.sample(spots, rnd.randint(22, 30)):
                own[k] = f"new{g}w{k}"
            rows.append((g * 10 + c, " ".join(own)))
    want = jaccard_roots(rows)
    assert len({want[i] for i in want}) > 12
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == {i for i in want if want[i] == i}


# 6


def test_warc(spark, tmp_path):
    big, small = "<p>é" + "x" * 200, "tiny"
    pages = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (1, "u", small), (2, "u", small), (4, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" + "z" * 100), (3, "http://b/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.roundtrip(df).toPandas()
    assert len(got) == len(pages)
    for _, r in got.iterrows():
        body = blob(next(h for i, _, h in pages if i == r.page_id))
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
    kinds = Counter((r.page_id, r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to)) for r in got.itertuples())
    assert kinds == Counter([(1, "response", None), (2, "response", None), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "revisit", 3), (7, "response", None), (9, "revisit", 3)])
    where = warc.write_archive(df)
    assert spark.read.parquet(where.payloads).count() == 4
    rec = {r.id: bytes(r.record) for r in warc.records(spark, where).collect()}
    assert rec[5].startswith(b"WARC/1.1\r\nWARC-Type: revisit") and big.encode() not in rec[5] and rec[7].endswith(b"z\r\n\r\n")
    warc.export(spark, where, str(tmp_path / "warc"))
    files = b"".join(f.read_bytes() for f in sorted((tmp_path / "warc").glob("part-*")))
    assert len(files) == sum(len(r.record) for r in warc.records(spark, where).collect()) and all(x in files for x in rec.values())
    dated = warc.write_archive(df.withColumn("seen", F.lit("2024-02-03 04:05:06").cast("timestamp")), date_col="seen")
    assert b"WARC-Date: 2024-02-03T04:05:06Z" in bytes(warc.records(spark, dated).first().record) and warc.UNDATED.encode() in rec[1]
    head, body = rec[1].split(b"\r\n\r\n", 1)
    assert int(head.split(b"Content-Length: ")[1]) == len(body) - 4


# 7


def test_decontaminate(spark, monkeypatch):
    rnd = random.Random(4)
    ws = [f"t{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rnd.choice(ws) for _ in range(rnd.choice((1, 2, 5, 13, 20, 40))))) for k in range(25)] + [("none", ""), ("null", None), ("dup", "t1 t2 t3 t4"), ("dup", "t9 t8 t7")]
    rows = []
    for i in range(60):
        t = [rnd.choice(ws) for _ in range(rnd.randint(0, 80))]
        if rnd.random() < 0.6:
            own = (rnd.choice(items)[1] or "").split()
            t[rnd.randint(0, len(t)) : 0] = own[: rnd.randint(0, len(own))]
        rows.append((i, ", ".join(x.upper() if rnd.random() < 0.3 else x for x in t)))
    rows += [(100, None), (101, items[5][1])]
    norm = lambda t: decontaminate.normal_words(blob(t))
    pats = {}
    for n, t in items:
        w = norm(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m else ():
            pats.setdefault(tuple(w[k : k + m]), set()).add(n)
    want = {}
    for i, t in rows:
        w, hit, names = norm(t), set(), set()
        for p, ns in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    names |= ns
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (8 << 20, 200):
        monkeypatch.setattr(decontaminate, "TABLE_BYTES", size)
        got = {r[0]: tuple(r[1:]) for r in decontaminate.report(frame(spark, rows), bench).collect()}
        assert got == want
        kept = decontaminate.decontaminate(frame(spark, rows), bench)
        assert {r.doc_id for r in kept.collect()} == {i for i in want if not want[i][4]} and kept.columns == NAMES


def test_shifts_skip_words_and_buckets_are_compared():
    """Words without a block of any pattern are passed over twelve at a time; of windows with a pattern's suffix and prefix, words between are compared."""
    t = decontaminate.build([("a", " ".join(f"p{k}" for k in range(13))), ("b", " ".join(f"p{k}" for k in range(13))), ("c", "short item")])
    long = next(p for p in t.patterns if p.size == 13)
    assert len(long.at) == 1 and long.of.tolist() == [0, 1]
    w = decontaminate.Words(np.frombuffer(" ".join(f"x{k}" for k in range(5000)).encode(), np.uint8), np.array([0, len(" ".join(f"x{k}" for k in range(5000)))]))
    found, looked = decontaminate.candidates(decontaminate.block_hashes(w.hashes, 2), long)
    assert not len(found) and looked < 5000 / 11
    near = [f"p{k}" for k in range(13)]
    near[6] = "other"
    text = (" ".join(near) + " . " + " ".join(f"P{k}" for k in range(13))).encode()
    hit, items = decontaminate.search(decontaminate.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])), t)
    assert hit.tolist() == [False] * 13 + [True] * 13 and items == [{0, 1}]


# 8, 9


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffixes(spark, monkeypatch, exchanged, hot):
    """hot: every anchor has too many segments, so that strings are looked up one by one."""
    rows = [*sample(), (4000, "ab" * 300), (4001, "x" + "ab" * 120 + "y"), (4002, "é" * 200)]
    seen, want, kept = set(), {}, {}
    for i, t in sorted(rows):
        b, n = blob(t), len(blob(t))
        gone = bytearray(n)
        for p in range(n - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k in range(n) if gone[k] and not (k and gone[k - 1]))
        kept[i] = bytes(c for c, z in zip(b, gone) if not z)
        want[i] = (n, sum(gone), spans, hashlib.sha256(kept[i]).hexdigest())
    assert sum(x[1] for x in want.values()) > 1000
    monkeypatch.setattr(suffixes, "PART_BYTES", 3000)
    monkeypatch.setattr(suffixes, "HOT_SEGMENTS", hot)
    assert {r[0]: tuple(r[1:]) for r in suffixes.report(frame(spark, rows)).collect()} == want
    if hot == 1:
        out = suffixes.deduplicate(frame(spark, rows))
        assert out.columns == NAMES and {r.doc_id: r.text for r in out.collect()} == {i: t.decode("utf-8", "replace") for i, t in kept.items()}


def test_anchors_fall_evenly_on_shards():
    """An anchor is the least of many hashes; its number must not be small for that, or one shard gets most segments."""
    data = np.frombuffer(random.Random(5).randbytes(200_000), np.uint8)
    block = exchange.Block(0, np.array([1]), data, np.array([0, len(data)]))
    n = np.bincount(exchange.shard_of(suffixes.Segments(block, 100).value, 16), minlength=16)
    assert n.min() > 0 and n.max() < 2 * n.mean()


def test_suffix_order():
    rnd = random.Random(8)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    group = np.sort(np.array([rnd.randrange(9) for _ in strings]))
    n = np.array(list(map(len, strings)))
    t = suffixes.Text(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(n) - n, n)
    order = t.sort(group)
    assert [(group[k], strings[k]) for k in order] == sorted((g, s) for g, s in zip(group, strings))
    lcp = t.neighbours(order, group)
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert all(lcp[k] == (common(strings[order[k - 1]], strings[order[k]]) if k and group[order[k]] == group[order[k - 1]] else -1) for k in range(len(order)))


def test_substrings(spark, exchanged):
    import re

    rows = sample()
    seen, want, texts = set(), {}, {}
    for i, t in sorted(rows):
        w = blob(t).split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            s = tuple(w[p : p + 20])
            if s in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(s)
        kept = b" ".join(x for x, z in zip(w, gone) if not z)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
        # White space stays with the word before it, but for that before a cut at the end.
        parts = re.findall(rb"\S+\s*", blob(t))
        lead = blob(t)[: len(blob(t)) - len(b"".join(parts))]
        left = lead * (not gone or not gone[0]) + b"".join(p for p, z in zip(parts, gone) if not z)
        texts[i] = (left.rstrip() if gone and gone[-1] else left).decode() if any(gone) else t
    assert sum(x[1] for x in want.values()) > 300
    docs = frame(spark, rows)
    assert {r[0]: tuple(r[1:]) for r in substrings.report(docs).collect()} == want
    out = substrings.deduplicate(docs)
    assert out.columns == NAMES and {r.doc_id: r.text for r in out.collect()} == {i: t for i, t in texts.items() if not (want[i][1] and want[i][0] == want[i][1])}
    words = {i: blob(t).split() for i, t in rows}
    for f in substrings.factors(docs).collect():
        assert f.words >= 20 and words[f.doc_id][f.start : f.start + f.words] == words[f.source_id][f.source_start : f.source_start + f.words] and (f.source_id, f.source_start) < (f.doc_id, f.start)


def test_factors_are_greedy_and_compared(spark, monkeypatch):
    """A factor goes on over words whose first place is another document; one at a colliding hash isn't a factor."""
    rnd = random.Random(3)
    w = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = [(1, " ".join(w[60:90])), (2, " ".join(w)), (3, " ".join(["own", *w, "end"]))]
    got = [tuple(r)[:3] for r in substrings.factors(frame(spark, rows)).orderBy("doc_id", "start").collect()]
    assert got == [(2, 60, 30), (3, 1, 120)]
    lines = "Title one\n\n" + " ".join(w[:40]) + "\n\nPara two.\n- last line"
    out = {r.doc_id: r.text for r in substrings.deduplicate(frame(spark, [(2, " ".join(w)), (3, lines)])).collect()}
    assert out[3] == "Title one\n\nPara two.\n- last line"
    block = exchange.Block(0, np.array([1, 2]), np.frombuffer(b"a b c d x y z w", np.uint8), np.array([0, 7, 15]))
    found = object.__new__(substrings.Sources)
    substrings.Runs.__init__(found, block, 4)
    found.place, found.block, found.word, found.id, found.again = np.array([0, 4]), np.zeros(2, np.int64), np.array([0, 0]), np.array([1, 1]), np.array([False, True])
    assert substrings.parse(block, found, None, 4) == []


def test_null_and_repeated_ids(spark):
    """Both dedup stages tell rows of one id, or of none, apart: of repeated rows one stays, others aren't touched."""
    rnd = random.Random(12)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    twin, first, other, clean, more, near, far = (text() for _ in range(7))
    near2 = near.rsplit(" ", 1)[0] + " changed"
    rows = [(5, twin), (5, twin), (None, first), (None, other), (None, first + " " + clean), (7, more), (3, near), (9, near2), (9, far)]
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()]
    assert Counter(kept) == Counter([(5, twin), *rows[2:7], (9, far)])
    cut = [(r.doc_id, r.text) for r in substrings.deduplicate(frame(spark, rows, 1)).collect()]
    assert Counter(cut) == Counter([(5, twin), *rows[2:4], (None, clean), *rows[5:7], (9, "changed"), (9, far)])
    longest = (50_000, " ".join(f"l{k}" for k in range(60_000)))  # a text far beyond a block
    assert substrings.report(frame(spark, [longest, (60_000, longest[1])])).filter("doc_id = 60000 AND n_removed = n_words").count() == 1


# 10


def test_quality_order_and_verdict(spark):
    clean = " ".join(f"word{i} other" for i in range(60)) + "."
    rows = [(1, clean), (2, "too short"), (3, None), (4, "same again here " * 40), (5, clean.replace(" ", " # ")), (6, clean.upper()), (7, (clean + "\n") * 5)]
    docs = frame(spark, rows)
    found = quality.estimate(docs, sample_rows=100)
    assert set(found.seconds) == {r.name for r in quality.RULES} and all(x > 0 for x in found.seconds.values()) and sum(found.rows.values()) == 7
    assert found.rows[frozenset()] == 1 and found.rows[frozenset({"shouting"})] == 1
    # The second rule is chosen by the rows that the first one leaves: what symbols rejects besides is rejected already.
    both, one = frozenset({"too_short", "symbols"}), frozenset({"shouting"})
    rates = quality.Estimates(dict.fromkeys((r.name for r in quality.RULES), 0.004), {both: 9, one: 2, frozenset(): 50})
    assert [r.name for r in quality.ordered(rates)][:2] == ["too_short", "shouting"]
    rates.seconds["too_short"] = 0.1
    assert [r.name for r in quality.ordered(rates)][:2] == ["symbols", "shouting"]
    kept = {r.doc_id for r in docs.filter(quality.verdict(docs["text"], list(quality.RULES)).isNull()).collect()}
    assert kept == {1} == {r.doc_id for r in quality.measure(docs).filter("kept").collect()} == {r.doc_id for r in quality.filter_quality(docs).collect()}
    assert docs.select(quality.verdict(docs["text"], list(quality.RULES)[::-1]).isNull().alias("k")).filter("k").count() == 1


def test_later_rules_are_not_evaluated(spark):
    fails = quality.Rule("fails", lambda t, w: F.raise_error("evaluated").isNull())
    rules = [quality.RULES[0], fails]
    docs = frame(spark, [(1, "short"), (2, None)])
    assert {r.v for r in docs.select(quality.verdict(docs["text"], rules).alias("v")).collect()} == {"too_short"}
    with pytest.raises(Exception, match="evaluated"):
        docs.select(quality.verdict(docs["text"], rules[::-1]).alias("v")).collect()


def test_quality_is_native(spark):
    plan = quality.measure(frame(spark, sample()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 11


def ranked(docs, items, most=50):
    """item by item: (rank, doc_id, score) by definition."""
    import re

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i))
        out[item] = [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:most])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranking(spark, monkeypatch, small):
    """small: segments of a few documents, blocks of two items, and joins without a broadcast."""
    if small:
        for name, value in (("SEGMENT_BYTES", 900), ("BLOCK_ITEMS", 2), ("BROADCAST_BYTES", -1), ("BROADCAST_CELLS", -1)):
            monkeypatch.setattr(ranking, name, value)
    rows = [*sample(), *[(3000 + k, "tie tie Tie") for k in range(9)], (4000, "W1-w2_w3.w4 " * 2000)]
    items = [(1, "w1 w2 W3 w3"), (2, None), (3, "nothing_of_this zzz"), (4, "tie w5"), (5, rows[20][1]), (6, "ÉTÉ w7"), (7, "one")]
    want = ranked(rows, items, 7)
    assert sum(map(len, want.values())) > 20 and [x[1] for x in want[4][:7]] == [3000 + k for k in range(7)]
    frames = frame(spark, rows), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, item string")
    got = ranking.report(*frames, 7)
    assert got.schema["item_id"].dataType.simpleString() == "int" and got.columns == ["item_id", "rank", "doc_id", "score"]
    by_item = {i: [] for i, _ in items}
    for r in got.orderBy("item_id", "rank").collect():
        by_item[r.item_id].append(tuple(r)[1:])
    assert by_item == want


def test_bounds_enclose_scores():
    tf, norm = np.arange(1, 400).repeat(50), np.tile(np.arange(50, 5050, 100), 399)
    exact = ranking.impact(tf, norm)
    level = -(-exact // ranking.STEP)
    assert level.max() < 256 and (level * ranking.STEP >= exact).all() and ((level - 1) * ranking.STEP < exact).all()


# 12


def components_by_pairs(rows, size=4):
    sets = [(i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if (w := blob(t).lower().split()) else set()) for i, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return {(i, len(s), least[top(k)], i == least[top(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("most", [1 << 14, 40, 8])
def test_chosen_paths(spark, monkeypatch, most):
    """most: nodes are branched, and cut into parts, beyond so many texts."""
    monkeypatch.setattr(chosenpath, "NODE_ROWS", most)
    rnd = random.Random(12)
    rows = list(sample())
    for g, n in enumerate((120, 30, 8, 8, 2)):
        base = [f"g{g}x{rnd.randrange(10**6)}" for _ in range(100)]
        for k in range(n):
            own = list(base)
            for p in rnd.sample(range(100), rnd.randint(0, 6)):
                own[p] = f"z{rnd.randrange(10**6)}"
            rows.append((10_000 + 1000 * g + k, " ".join(own) + "  \n"))
    got = chosenpath.near_duplicate_components(frame(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == components_by_pairs(rows)


def test_chosen_paths_rows_of_one_id(spark):
    """Rows of one id and of none are told apart, and an empty set is linked with nothing."""
    rows = [(5, "a b c d e"), (5, "k l m n o"), (3, "A B  C D E"), (None, "k l m n o"), (None, None), (7, " "), (8, "\t")]
    got = sorted(map(str, chosenpath.near_duplicate_components(frame(spark, rows)).collect()))
    want = [(5, 2, 3, False), (5, 2, None, None), (3, 2, 3, True), (None, 2, None, True), (None, 0, None, True), (7, 0, 7, True), (8, 0, 8, True)]
    assert [x.split("kept")[0] for x in got] == sorted(f"Row(doc_id={i}, n_shingles={n}, component_id={c}, " for i, n, c, _ in want)


def test_trees_reach_their_recall():
    """By simulated descents: each level keeps a pair if one of two children does."""
    assert chosenpath.trees_for(0.8, 0.9) == 1 and chosenpath.trees_for(0.8, 1 - 1e-6) == 5
    rnd = np.random.Generator(np.random.PCG64(5))
    first = np.array([0])
    values = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = values[:360], np.concatenate([values[40:], values[:0]])
    near = (chosenpath.minwise(a, first) == chosenpath.minwise(b, first)).mean()
    assert abs(near - 320 / 400) < 0.1


# 13


def test_whitening(spark):
    rnd = np.random.Generator(np.random.PCG64(13))
    vectors = rnd.normal(size=(300, 7)) @ rnd.normal(size=(7, 7)) + 3
    bad = [None, [], [1.0], [1.0] * 6 + [None], [1.0] * 6 + [float("nan")], [1.0] * 6 + [float("inf")]]
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)] + [(1000 + k, v, "x") for k, v in enumerate(bad)] + [(0, vectors[0].tolist(), "x"), (None, vectors[1].tolist(), "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(5)
    got = whitening.report(table, 5).toPandas()
    x = np.floor(64 * np.vstack([vectors, vectors[:2]])).astype(np.int64) + 1_000_000
    n = len(x)
    off = n * x - x.sum(axis=0)
    values, found = np.linalg.eigh(off.T @ off / n**3)
    assert len(got) == 5 * n and set(got.n) == {n} and got.vec_id.isna().sum() == 5 and not (got.vec_id >= 1000).any()
    want = off / n @ found[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    own = got[(got.vec_id > 1) & (got.vec_id < 300)].sort_values(["vec_id", "component"])
    made = own.whitened.to_numpy().reshape(-1, 5)
    sign = np.sign((made * want[2:300]).sum(axis=0))
    assert np.abs(made * sign - want[2:300]).max() < 1e-9
    assert (own.deviation.to_numpy().reshape(-1, 5) == (off * off).sum(axis=1)[2:300, None]).all()
    assert np.abs(own.explained.to_numpy()[:5] - values[::-1][:5] / values.sum()).max() < 1e-12 and got.identity_error.max() < 1e-9


def test_whitening_without_variance(spark):
    """Components along which nothing varies have no value; what doesn't fit 64 bits is null."""
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.report(one).toPandas()
    assert got.whitened.isna().all() and (got.deviation == 0).all() and (got.identity_error == 0).all() and len(got) == 4
    wide = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<double>")
    assert set(whitening.report(wide).filter("vec_id < 3").select(F.col("deviation").isNull()).distinct().toPandas().iloc[:, 0]) == {True}


# What the operators share


def twins():
    """Two words with one polynomial hash modulo 2^64, whatever its odd base."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_words_with_one_polynomial_hash(spark):
    a, b = twins()
    table = common.word_hashes(np.frombuffer(f"{a} {b} {a}".encode(), np.uint8), np.array([0, 1025, 2050]), np.array([1024, 2049, 3074]))
    assert table[0] != table[1] and table[0] == table[2]
    rest = " ".join(f"w{k}" for k in range(25))
    docs = frame(spark, [(1, f"{a} one"), (2, f"{b} two"), (3, f"{a} {rest}"), (4, f"{b} {rest} z"), (5, f"{b} {rest}")], 1)
    assert {r.doc_id: r.n_removed for r in substrings.report(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 25, 5: 26}
    from public_tokenizers import path
    from tokenizers import Tokenizer

    ids = {i: np.array([*Tokenizer.from_file(path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in ((1, f"{a} one"), (2, f"{b} two"))}
    packed = packing.pack(docs.filter("doc_id < 3")).collect()
    assert len(packed) >= 2 and all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in packed)
    items = spark.createDataFrame([(1, f"{a} one"), (2, f"{b} two")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(docs, items).collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0}
    assert {r.n_known for r in lm.score(docs).filter("held_out = false").collect()} >= {3}


def test_tables_of_two_threads(spark):
    """What one thread's scratch() makes goes with it, and nothing of another's; a failed run leaves nothing."""
    import threading
    from pathlib import Path

    made, ready, done = {}, threading.Event(), threading.Event()

    def other():
        made["other"] = common.written(spark.range(3).toDF("x"), "other")
        ready.set()
        done.wait(60)

    t = threading.Thread(target=other)
    with pytest.raises(ValueError, match="stop"), common.scratch():
        made["own"] = common.written(spark.range(3).toDF("x"), "own")
        path = Path(made["own"]._lectern_path.removeprefix("file:"))
        t.start()
        ready.wait(60)
        assert path.exists()
        raise ValueError("stop")
    done.set()
    t.join()
    assert not path.exists() and made["other"].count() == 3
