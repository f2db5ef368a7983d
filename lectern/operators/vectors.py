"""Term vectors over a real vocabulary, and a linear classifier for each fold.

A vocabulary has the grams of at least min_df texts, the most frequent max_features of them (ties by the gram), each with its inverse document frequency; a text's
weights are (1 + ln of its count) times that, of length one for each kind of gram. Kinds (words and their pairs, characters inside words) are put side by side. A vocabulary is bounded by
max_features, so that it may be broadcast. A text without a gram of the vocabulary has the zero vector.

Where vectors are wanted, texts are read twice: once for the grams' counts by fold, from which each fold's vocabulary follows by subtraction, and once for the places and counts of each text's grams in the
union of the folds' vocabularies, which are written. A fold's vectors are these with its own weights. Grams are made over Arrow batches, a bounded number of words at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import bound, tokens
from lectern.operators.aggregates import class_weights, scores
from lectern.operators.models import word_bound_grams
from lectern.session import stored

WORD = r"[\p{L}\p{N}_]{2,}"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_grams(text: Column) -> Column:
    """Words of two characters and more, and pairs of neighbours."""

    def both(words: Column) -> Column:
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
        return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))

    return bound(words_of(text), both)


def char_grams(text: Column) -> Column:
    """Three to five characters inside words, each word between spaces."""
    return word_bound_grams(F.lower(F.coalesce(text, F.lit(""))))


@dataclass
class Kind:
    """One kind of gram and the limits of its vocabulary."""

    grams: Callable[[Column], Column]
    min_df: int
    max_features: int


WORDS, CHARS = Kind(word_grams, 2, 40_000), Kind(char_grams, 3, 200_000)  # fixed values: the published limits


def runs(grams: Column) -> Column:
    """Structs (gram, tf) of the distinct strings of an array: its runs once sorted, so that no aggregate over single grams is needed."""

    def tell(each: Column) -> Column:
        starts = F.array_compact(F.transform(each, lambda g, k: F.when((k == 0) | (g != F.get(each, k - 1)), k)))
        return bound(starts, lambda at: F.transform(at, lambda a, k: F.struct(F.get(each, a).alias("gram"), (F.coalesce(F.get(at, k + 1), F.size(each)) - a).cast("long").alias("tf"))))

    return bound(F.sort_array(grams), tell)


def counted(rows: DataFrame, key: str, text: str, kind: Kind) -> DataFrame:
    """(key, gram, tf), dealt by key: texts are shuffled, and not their grams."""
    texts = rows.groupBy(key).agg(F.collect_list(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    grams = F.flatten(F.transform("_t", kind.grams))
    return texts.select(key, F.inline(runs(grams)))


def vocabulary(counts: DataFrame, n_texts: int, kind: Kind) -> DataFrame:
    """(gram, df, n, idf) of counts (key, gram, tf)."""
    per = counts.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).filter(F.col("df") >= kind.min_df)
    top = per.orderBy(F.desc("n"), "gram").limit(kind.max_features)
    return top.withColumn("idf", F.log(F.lit(1.0 + n_texts) / (1 + F.col("df"))) + 1)


def weights(counts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, gram, weight): damped counts times inverse frequency, of length one for each text."""
    each = counts.join(F.broadcast(words.select("gram", "idf")), "gram").select(key, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = each.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # Both sides are dealt by key already, and the lengths of a part are few: neither grams nor their weights are shuffled or sorted.
    return each.join(length.hint("shuffle_hash"), key).select(key, "gram", (F.col("w") / F.col("length")).alias("weight"))


#: Units (words) of texts whose grams are made at a time, and weights of vectors.
UNITS, WEIGHTS = 1 << 18, 1 << 20


def _with_pairs(codes: np.ndarray, text: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """word_grams of coded words: (gram, the unit that it begins at, grams)."""
    at = np.flatnonzero(text[1:] == text[:-1])
    own, gram = np.unique(codes[at] * len(words) + codes[at + 1], return_inverse=True)
    pairs = pc.binary_join_element_wise(words.take(pa.array(own // max(1, len(words)))), words.take(pa.array(own % max(1, len(words)))), " ")
    return np.concatenate([codes, len(words) + gram]).astype(np.int32), np.concatenate([np.arange(len(codes)), at]), pa.concat_arrays([words, pairs])


def _inside(codes: np.ndarray, text: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """char_grams of coded words, made once for each different word: windows over all of them, told apart by the number of the window one shorter and the character that follows."""
    spaced = "".join([f" {w} " for w in words.to_pylist()])
    points, chars = np.unique(np.frombuffer(spaced.encode("utf-32-le"), "<u4"), return_inverse=True)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    begins = np.cumsum(lengths) - lengths
    shorter, found, at, grams = chars[:-1] * len(points) + chars[1:], [], [], []
    for n in (3, 4, 5):
        sizes = np.where((lengths > n) | (n == 3), lengths - n + 1, 0)
        window = _ranges(begins, sizes)
        _, first, own = np.unique(shorter[window] * len(points) + chars[window + n - 1], return_index=True, return_inverse=True)
        shorter = np.zeros(len(chars), np.int64)
        shorter[window] = own
        found.append((len(grams) + own).astype(np.int32)[_ranges((np.cumsum(sizes) - sizes)[codes], sizes[codes])])
        at.append(np.repeat(np.arange(len(codes), dtype=np.int32), sizes[codes]))
        grams += [spaced[i : i + n] for i in window[first].tolist()]
    return np.concatenate(found), np.concatenate(at), pa.array(grams, pa.string())


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, so many as its size, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _as_they_are(codes: np.ndarray, text: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return codes, np.arange(len(codes)), words


def _reading(kind: Kind) -> tuple[Callable[[Column], Column], Callable]:
    """(the units of a text that go to Python, what makes the kind's grams of them)."""
    known = {word_grams: (words_of, _with_pairs), char_grams: (lambda t: tokens(F.lower(F.coalesce(t, F.lit("")))), _inside)}
    return known.get(kind.grams, (kind.grams, _as_they_are))


def _occurring(units: pa.Array, makes: Callable) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, gram, grams): each occurrence of a gram in rows that are lists of texts, which are lists of units."""
    texts = units.flatten()
    n = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(n)), n)
    row = np.repeat(np.arange(len(units), dtype=np.int32), pc.list_value_length(units).to_numpy(zero_copy_only=False))[text]
    coded = texts.flatten().dictionary_encode()
    gram, at, grams = makes(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, coded.dictionary.cast(pa.string()))
    return row[at], gram, grams


def _portions(batch: pa.RecordBatch, kinds: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about UNITS units at a time; its last columns are the kinds' units."""
    n = np.zeros(batch.num_rows, np.int64)
    for k in range(batch.num_columns - kinds, batch.num_columns):
        column = batch.column(k)
        inner = np.concatenate([[0], np.cumsum(pc.list_value_length(column.flatten()).to_numpy(zero_copy_only=False))])
        ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        n += np.diff(inner[np.concatenate([[0], ends]).astype(np.int64)])
    yield from _cut(batch, n, UNITS)


def _cut(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows next to each other until their sizes pass most."""
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


def _keys(row: np.ndarray, size: int, value: np.ndarray) -> np.ndarray:
    keys = row.astype(np.int64)
    keys *= size
    keys += value
    return keys


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, how often each occurs)."""
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.concatenate([starts, [len(keys)]]))


def _units(texts: DataFrame, columns: list[Column], kinds: list[Kind]) -> DataFrame:
    """columns and the units of each kind in `_t`, the texts of a row."""
    return texts.select(*columns, *[F.transform("_t", _reading(kind)[0]).alias(f"_u{k}") for k, kind in enumerate(kinds)])


def gram_counts(texts: DataFrame, fold: Column, folds: int, kinds: list[Kind]) -> DataFrame:
    """(kind, gram, df0, n0, df1, n1, ...): texts with a gram and its occurrences, by fold (0 to folds - 1). A portion of texts gives a row for a gram, and rows are added up before they are shuffled."""
    makes = [_reading(kind)[1] for kind in kinds]
    names = [f"{c}{f}" for f in range(folds) for c in ("df", "n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, len(makes)):
                of = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for k, make in enumerate(makes):
                    row, gram, grams = _occurring(part.column(1 + k), make)
                    keys, tf = _runs(_keys(row, max(1, len(grams)), gram))
                    row, gram = np.divmod(keys, max(1, len(grams)))
                    own = gram * folds + of[row]
                    df, n = np.bincount(own, minlength=len(grams) * folds), np.bincount(own, tf, len(grams) * folds).astype(np.int64)
                    told = [x[f::folds] for f in range(folds) for x in (df, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), grams, *map(pa.array, told)], names=["kind", "gram", *names])

    each = _units(texts, [fold.cast("int").alias("_f")], kinds).mapInArrow(run, "kind int, gram string, " + ", ".join(f"{c} long" for c in names))
    return each.groupBy("kind", "gram").agg(*[F.sum(c).alias(c) for c in names])


@dataclass
class Fitted:
    """A vocabulary: for each kind the grams in order with df and n; their inverse frequencies side by side."""

    grams: list[pa.Table]
    idf: np.ndarray


def fit_vocabulary(counts: DataFrame, folds: list[int], n_texts: int, kinds: list[Kind]) -> Fitted:
    """The vocabulary of some folds, from gram_counts; at most max_features grams of a kind come to the driver."""
    found = []
    for k, kind in enumerate(kinds):
        df, n = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0).cast("long")) for c in ("df", "n"))
        own = counts.filter(F.col("kind") == k).select("gram", df.alias("df"), n.alias("n")).filter(F.col("df") >= kind.min_df)
        found.append(own.filter("df > 0").orderBy(F.desc("n"), "gram").limit(kind.max_features).toArrow().sort_by("gram"))
    df = np.concatenate([t["df"].to_numpy() for t in found])
    return Fitted(found, np.log((1.0 + n_texts) / (1 + df)) + 1)


class Places:
    """The union of vocabularies, each kind's grams in order; of each vocabulary the place of every gram (-1: not in it) and its weight."""

    def __init__(self, fitted: list[Fitted], kinds: list[Kind]):
        def column(f: Fitted, k: int) -> pa.Array:
            return pa.array(f.grams[k]["gram"].combine_chunks()).cast(pa.string())

        self.grams = [pa.chunked_array([column(f, k) for f in fitted]).unique().sort() for k in range(len(kinds))]
        self.starts = np.concatenate([[0], np.cumsum([len(g) for g in self.grams])])
        self.own = []
        for f in fitted:
            at = np.concatenate([b + pc.index_in(column(f, k), value_set=g).to_numpy(zero_copy_only=False).astype(np.int64) for k, (g, b) in enumerate(zip(self.grams, self.starts, strict=False))])
            place, idf = np.full(self.starts[-1], -1, np.int64), np.zeros(self.starts[-1])
            place[at], idf[at] = np.arange(len(at)), f.idf
            self.own.append((place, idf, len(at)))


def gram_places(texts: DataFrame, keep: list[str], places: Places, kinds: list[Kind]) -> DataFrame:
    """keep, with `_g` and `_n`: the grams of a row's texts in the union, in order, and how often each occurs, as bytes of four-byte numbers (Parquet's reader holds levels for each element of an array)."""
    makes = [_reading(kind)[1] for kind in kinds]
    held = texts.sparkSession.sparkContext.broadcast((places.grams, places.starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, starts = held.value
        most = max(1, int(starts[-1]))
        for batch in batches:
            for part in _portions(batch, len(makes)):
                keys = []
                for k, make in enumerate(makes):
                    row, gram, grams = _occurring(part.column(len(keep) + k), make)
                    at = pc.fill_null(pc.index_in(grams, value_set=known[k]), -1).to_numpy(zero_copy_only=False).astype(np.int32)[gram]
                    keys.append(_keys(row[at >= 0], most, at[at >= 0]) + starts[k])
                found, n = _runs(np.concatenate(keys))
                row, at = np.divmod(found, most)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                packed = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (at.astype("<i4"), n.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(keep))), *packed], names=[*keep, "_g", "_n"])

    schema = T.StructType([*(texts.schema[c] for c in keep), *(T.StructField(c, T.BinaryType()) for c in ("_g", "_n"))])
    return _units(texts, [F.col(c) for c in keep], kinds).mapInArrow(run, schema)


def with_features(rows: DataFrame, places: Places, which: int) -> DataFrame:
    """rows of gram_places with `features`, their sparse vectors by one of the vocabularies, in place of _g and _n."""
    from pyspark.ml.linalg import VectorUDT

    keep = [c for c in rows.columns if c not in ("_g", "_n")]
    held = rows.sparkSession.sparkContext.broadcast((places.own[which], places.starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (place, idf, size), starts = held.value
        for whole in batches:
            for batch in _cut(whole, pc.binary_length(whole.column(len(keep))).to_numpy(zero_copy_only=False).astype(np.int64) // 4, WEIGHTS):
                n, lengths = batch.num_rows, pc.binary_length(batch.column(len(keep))).to_numpy(zero_copy_only=False)
                gram, tf = (np.frombuffer(b"".join(batch.column(len(keep) + k).to_pylist()), "<i4") for k in (0, 1))
                row = np.repeat(np.arange(n, dtype=np.int32), lengths // 4)
                known = place[gram] >= 0
                row, gram, tf = row[known], gram[known], tf[known]
                w = (1 + np.log(tf)) * idf[gram]
                kind = _keys(row, len(starts), np.searchsorted(starts, gram, "right") - 1)
                w /= np.sqrt(np.bincount(kind, w * w, n * len(starts)))[kind]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
                own = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, max(1, size), np.int32)), pa.ListArray.from_arrays(ends, pa.array(place[gram].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(w))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.StructArray.from_arrays(own, ["type", "size", "indices", "values"])], names=[*keep, "features"])

    return rows.select(*keep, "_g", "_n").mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("features", VectorUDT())]))


def _texts(rows: DataFrame, by: list[str], text: str, *more: Column) -> DataFrame:
    """by, and `_t`: the texts of a key, each read by itself and counted as one."""
    return rows.groupBy(*by).agg(F.collect_list(F.coalesce(F.col(text), F.lit(""))).alias("_t"), *more)


class Vectorizer:
    """Vocabularies of several kinds, fitted on some texts; vectors() puts their weights side by side."""

    def __init__(self, rows: DataFrame, key: str, text: str, kinds: list[Kind]):
        self.key, self.text, self.kinds = key, text, kinds
        counts = stored(gram_counts(_texts(rows, [key], text), F.lit(0), 1, kinds), "grams")
        fitted = fit_vocabulary(counts, [0], rows.count(), kinds)
        self.places = Places([fitted], kinds)
        self.size = len(fitted.idf)
        self.words = [rows.sparkSession.createDataFrame(t) for t in fitted.grams]

    def vectors(self, rows: DataFrame) -> DataFrame:
        """rows with `features`, a sparse vector."""
        packed = with_features(gram_places(_texts(rows, [self.key], self.text), [self.key], self.places, self.kinds), self.places, 0).withColumnRenamed(self.key, "_k")
        return rows.join(packed, F.col(self.key).eqNullSafe(F.col("_k")), "left").drop("_k")


def weighted(rows: DataFrame, label: str, n_classes: int) -> DataFrame:
    """rows with a label, it as `label`, and class_weight."""
    own = class_weights(rows, label, n_classes).select(F.col(label).alias("_l"), "class_weight")
    return rows.join(F.broadcast(own), F.col(label) == F.col("_l")).withColumn("label", F.col(label).cast("double")).drop("_l")


def fitted(train: DataFrame, n: int, strength: float, iterations: int = 30):
    """A balanced logistic regression of n rows (label, features, class_weight); strength: as C, the larger the less it is held back."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(weightCol="class_weight", maxIter=iterations, regParam=1.0 / (strength * max(1, n)), standardization=False).fit(train)


def majority(rows: DataFrame, label: str):
    """The most frequent label, the first of equals; None without rows."""
    top = rows.groupBy(label).count().orderBy(F.desc("count"), label).first()
    return None if top is None else top[0]


def predicted(train: DataFrame, test: DataFrame, key: str, text: str, label: str, n_classes: int, kinds: list[Kind], strength: float) -> DataFrame:
    """(key, pred) of test by a vocabulary and a classifier of train alone; where train has one class alone that is predicted."""
    if train.select(label).distinct().count() < 2:
        return test.select(key, F.lit(majority(train, label)).cast("int").alias("pred"))
    vectors = Vectorizer(train, key, text, kinds)
    rows = stored(weighted(vectors.vectors(train), label, n_classes).select("label", "features", "class_weight"), "train")
    return fitted(rows, rows.count(), strength).transform(vectors.vectors(test)).select(key, F.col("prediction").cast("int").alias("pred"))


def by_folds(rows: DataFrame, key: str, text: str, label: str, fold: str, n_classes: int, kinds: list[Kind], strength: float = 2.0) -> DataFrame:
    """key, fold, truth, majority and pred of each row, by what the other folds say: no text of a fold has a part in its own vocabulary, weights or majority.

    Texts are read twice for all folds together: a fold's vocabulary comes from counts without its own, and vectors are the written places with each fold's weights.
    """
    texts = stored(_texts(rows, [key, fold], text, F.collect_list(F.struct(F.col(label).alias("label"))).alias("_l")), "folds")
    held = texts.select(key, fold, F.explode("_l.label").alias("_label"))
    sizes: dict = {}
    for f, value, n in held.groupBy(fold, "_label").count().collect():  # folds and classes are few
        sizes.setdefault(f, {})[value] = n
    folds = sorted(sizes)
    if not folds:
        return held.select(key, F.col(fold).alias("fold"), *[F.lit(0).alias(c) for c in ("truth", "majority", "pred")])
    rest = {f: _sum(sizes[g] for g in folds if g != f) for f in folds}
    apart = [f for f in folds if len(rest[f]) >= 2]  # folds for which there is something to learn
    if apart:
        number = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)) - 1
        counts = stored(gram_counts(texts, number, len(folds), kinds), "grams")
        places = Places([fit_vocabulary(counts, [k for k, g in enumerate(folds) if g != f], sum(rest[f].values()), kinds) for f in apart], kinds)
        found = stored(gram_places(texts, [key, fold, "_l"], places, kinds), "places")
        found = found.select(key, fold, F.explode("_l.label").alias("_label"), "_g", "_n")
    out = None
    for f in folds:
        most = min(rest[f], key=lambda c: (-rest[f][c], c is not None, c), default=None)
        if f in apart:
            known = {value: c for value, c in rest[f].items() if value is not None}
            weight = F.coalesce(*[F.when(F.col("_label") == value, sum(rest[f].values()) / (n_classes * c)) for value, c in known.items()])  # as class_weights, from the same counts
            train = found.filter((F.col(fold) != f) & F.col("_label").isNotNull()).select(F.col("_label").cast("double").alias("label"), weight.alias("class_weight"), "_g", "_n")
            n = sum(known.values())
            which = apart.index(f)
            told = fitted(with_features(train, places, which), n, strength).transform(with_features(found.filter(F.col(fold) == f), places, which))
        else:
            told = held.filter(F.col(fold) == f).withColumn("prediction", F.lit(most))
        part = told.filter(F.col(key).isNotNull()).select(key, F.col(fold).alias("fold"), F.col("_label").cast("int").alias("truth"), F.lit(most).cast("int").alias("majority"), F.col("prediction").cast("int").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def _sum(parts) -> dict:
    out: dict = {}
    for part in parts:
        for value, n in part.items():
            out[value] = out.get(value, 0) + n
    return out


def grid_refit(train: DataFrame, validation: DataFrame, test: DataFrame, key: str, text: str, label: str, n_classes: int, kinds: list[Kind], grid: list[float]) -> tuple[DataFrame, float]:
    """(predictions of test, the strength chosen): the candidate with the best macro-F1 on the validation set, the first of equals, fitted again on both sets."""
    best = None
    for strength in grid:
        out = predicted(train, validation, key, text, label, n_classes, kinds, strength).join(validation, key).select(F.col(label).cast("int").alias("truth"), "pred")
        f1 = scores(out, list(range(n_classes))).first()["macro_f1"]
        if best is None or f1 > best[0]:
            best = (f1, strength)
    return predicted(train.unionByName(validation), test, key, text, label, n_classes, kinds, best[1]), best[1]
