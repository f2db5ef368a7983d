"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and their stems (first
bytes), hashed to a fixed number of weights, and a document's is the noisy-or of its sentences: one offending sentence is enough.
Only document labels are learnt from; the sentence scores that come out of it locate what offends.

Weights are fitted on at most TRAIN_ROWS labelled rows (a bounded sample, those with the smallest hashes of
their ids), of whose whole texts only features that can have a weight arrive at the driver, as numbers.

Defined results: null and empty texts are one sentence without words; labels that are null are left out, and of
repeated labels of an id the largest counts; a null id is not held out and has no label; without labels of both kinds every weight
is zero; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ALNUM, BYTE_VALUE, LOWER, U, byte_set, mix, over_texts, prefix_sums, span_hashes, words

#: Labelled rows to learn from, at most.
TRAIN_ROWS = 6_000
WEIGHTS = 1 << 18
#: Beside a longer word itself, its first so many bytes are features.
STEMS = (4, 5, 6)
#: Words in fewer documents of the sample have no weight.
LEAST_DOCS = 3
#: A feature counts if its documents' share of the label is so many standard deviations from that of all.
LEAST_SPREAD = 3.0
STEPS = 400
RATE = 0.2
#: Inverse variance of each weight before the data.
DECAY = 0.1
THRESHOLD = 0.3

ENDS = byte_set((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))  # line end ! . ?
NORMAL = np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8)


@dataclass
class Bags:
    """Words by sentence and sentences by document: features of each word (a row; WEIGHTS: none); first word of each sentence; first sentence of each document (each with an end)."""

    features: np.ndarray
    sentences: np.ndarray
    documents: np.ndarray


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(n, 1 + stems): a word's hash and those of its first bytes, WEIGHTS where it has no more."""
    out = np.full((len(s), 1 + len(STEMS)), WEIGHTS, np.int32)
    if not len(s):
        return out
    total = prefix_sums(BYTE_VALUE[data])
    narrow = lambda h, salt: (mix(h + U(salt)) % U(WEIGHTS)).astype(np.int32)
    out[:, 0] = narrow(span_hashes(total, s, e), 0)
    for k, size in enumerate(STEMS, 1):
        longer = np.flatnonzero(e - s > size)
        out[longer, k] = narrow(span_hashes(total, s[longer], s[longer] + size), size)
    return out


def bags(data: np.ndarray, bounds: np.ndarray) -> tuple[Bags, np.ndarray]:
    """Sentences with words, and the byte at which each begins; a text without words has one empty sentence."""
    s, e, first = words(NORMAL[data], bounds, ALNUM)
    features = word_features(NORMAL[data], s, e)
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ENDS[data], out=stops[1:])
    new = np.ones(len(s), bool)
    new[1:] = stops[s[1:]] != stops[s[:-1]]
    new[first[:-1][first[:-1] < first[1:]]] = True
    start = np.flatnonzero(new)
    docs = np.searchsorted(start, first)
    empty = np.flatnonzero(docs[:-1] == docs[1:])
    start = np.insert(start, docs[empty], first[empty])
    docs = docs + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(bounds) - 1), empty))])
    at = np.append(s, len(data))[np.minimum(start, len(s))]
    return Bags(features, np.append(start, len(s)), docs), at


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sentence_scores(b: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.clip(sums(weights[b.features].sum(axis=1), b.sentences) + bias, -30, 30)
    return 1 / (1 + np.exp(-z))


def document_scores(p: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Noisy-or: one minus the chance that no sentence offends."""
    return -np.expm1(np.minimum(sums(np.log1p(-np.minimum(p, 1 - 1e-12)), documents), 0))


def usable(having: np.ndarray, marked: np.ndarray, rate: float) -> np.ndarray:
    """Which features can have a weight: having documents hold each, marked of them with the label, whose share is rate."""
    spread = np.sqrt(np.maximum(having, 1) * rate * (1 - rate))
    out = (having >= LEAST_DOCS) & (np.abs(marked - having * rate) >= LEAST_SPREAD * spread)
    out[WEIGHTS] = False
    return out


def fit(b: Bags, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest likelihood of the document labels, by Adam."""
    weights, bias = np.zeros(WEIGHTS + 1), -7.0
    if not labels.any() or labels.all():
        return weights, bias
    document = np.repeat(np.arange(len(labels)), np.diff(b.documents))
    sentence = np.repeat(np.arange(len(b.sentences) - 1), np.diff(b.sentences))
    # Only features that enough documents have, and that go with the label, are learnt; the others drop out here.
    width, rate = WEIGHTS + 1, labels.mean()
    having, marked = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for i in range(b.features.shape[1]):
        pairs = np.unique(document[sentence].astype(np.int64) * width + b.features[:, i])
        having += np.bincount(pairs % width, minlength=width)
        marked += np.bincount(pairs[labels[pairs // width]] % width, minlength=width)
    used = usable(having, marked, rate)[b.features]
    where = np.nonzero(used)
    own, features = np.unique(b.features[where], return_inverse=True)
    features, sentence = features.astype(np.int32), sentence[where[0]]
    bounds = np.searchsorted(sentence, np.arange(len(b.sentences)))
    kept = Bags(features[:, None], bounds, b.documents)
    w, m, v = np.zeros(len(own) + 1), np.zeros(len(own) + 1), np.zeros(len(own) + 1)
    w[-1] = bias
    for step in range(1, STEPS + 1):
        p = sentence_scores(kept, w[:-1], w[-1])
        doc = np.maximum(document_scores(p, b.documents), 1e-9)
        pull = p * np.where(labels, (1 - doc) / doc, -1.0)[document]
        slope = np.append(np.bincount(features, weights=pull[sentence], minlength=len(own)), pull.sum()) / len(labels)
        slope[:-1] -= DECAY / len(labels) * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        w = w + RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights[own] = w[:-1]
    return weights, float(w[-1])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most `rows` of the documents that labels marks; held-out rows must be cut off before."""
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(rows)  # so many small rows at most, which is why they may be broadcast
    plain = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    sample = plain.join(F.broadcast(chosen), "id").select("text", "y")

    def distinct(data, bounds):
        b, _ = bags(data, bounds)
        at = b.sentences[b.documents].tolist()
        return [[np.unique(b.features[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]]

    seen = over_texts(sample, distinct, "features array<int>", ["y"]).select((F.col("y") > 0).cast("long").alias("y"), F.explode("features").alias("f"))
    counts = seen.groupBy("f").agg(F.count("*").alias("having"), F.sum("y").alias("marked")).toArrow()  # WEIGHTS + 1 rows at most
    having, marked = np.zeros(WEIGHTS + 1, np.int64), np.zeros(WEIGHTS + 1, np.int64)
    having[counts.column("f").to_numpy()], marked[counts.column("f").to_numpy()] = counts.column("having").to_numpy(), counts.column("marked").to_numpy()
    rate = sample.agg(F.avg((F.col("y") > 0).cast("int"))).first()[0] or 0.0
    may = docs.sparkSession.sparkContext.broadcast(usable(having, marked, rate))

    def fn(data, bounds):
        b, _ = bags(data, bounds)
        used = may.value[b.features]
        features = b.features[used]
        at = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[b.sentences]  # first feature left of each sentence
        out = []
        for i, j in zip(b.documents[:-1].tolist(), b.documents[1:].tolist(), strict=True):
            lengths = np.diff(at[i : j + 1])
            out.append(np.concatenate([[j - i], lengths, features[at[i] : at[j]]]).astype("<i4").tobytes())
        return [out]

    got = over_texts(sample, fn, "bag binary", ["y"]).toArrow()
    features, lengths, sizes = [], [], []
    for raw in got.column("bag").to_pylist():
        x = np.frombuffer(raw, "<i4")
        lengths.append(x[1 : 1 + x[0]])
        features.append(x[1 + x[0] :])
        sizes.append(int(x[0]))
    if not sizes:
        return Model(np.zeros(WEIGHTS + 1), -7.0)
    bounds = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    b = Bags(np.concatenate(features).reshape(-1, 1), bounds(np.concatenate(lengths)), bounds(sizes))
    return Model(*fit(b, np.array(got.column("y").to_pylist()) > 0))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` and the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # always WEIGHTS + 1 numbers

    def fn(data, bounds):
        b, _ = bags(data, bounds)
        return [document_scores(sentence_scores(b, *held.value), b.documents)]

    return over_texts(docs, fn, "score double", keep, text_col)


def locate(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Offending sentences: doc_id, sentence (its text) and its probability, of `least` or more."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def fn(data, bounds):
        b, at = bags(data, bounds)
        p = sentence_scores(b, *held.value)
        out = []
        for d, (i, j) in enumerate(zip(b.documents[:-1].tolist(), b.documents[1:].tolist(), strict=True)):
            ends = [*at[i + 1 : j].tolist(), int(bounds[d + 1])]
            out.append([{"sentence": data[at[k] : ends[k - i]].tobytes().decode("utf-8", "replace").strip(), "probability": float(p[k])} for k in range(i, j) if p[k] >= least])
        return [out]

    found = over_texts(rows, fn, "found array<struct<sentence: string, probability: double>>", ["doc_id"])
    return found.select("doc_id", F.inline("found"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from those that aren't held out."""
    rows = docs.select("doc_id", "text")
    learnt = ~held_out(F.col("doc_id"))
    model = train(rows.filter(learnt), labels.select("doc_id", "toxic").filter(learnt))
    return score(rows, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
