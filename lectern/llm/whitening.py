"""Embedding whitening by a two-pass covariance.

Entries become whole numbers, so that the first pass has exact sums and with them the exact mean. The second pass
sums outer products of centred vectors, one matrix product for each batch, and the tasks' matrices are merged by treeAggregate. The
driver has one matrix of the dimension's square, whose eigenvectors LAPACK finds; they go to the tasks as a broadcast, and a
further pass measures the covariance of what they give. Nothing is shuffled but one matrix a task.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out; of vectors of several lengths those of
the most frequent one are taken (ties: the longest), as others have no place in one matrix; repeated rows and null ids count and come out each for itself;
entries beyond 2^52 after scaling count as 2^52; a deviation beyond 64 bits is null; components along which nothing
varies have no whitened value (null), and identity_error is measured over the others (0 if there are none); no vectors give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.common import bounded_batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Levels of treeAggregate: the driver gets about the fourth root of the tasks' number of matrices.
DEPTH = 4
#: Scaled entries are held within this, so that they and their sums stay exact.
MOST = 1 << 52
#: Entries of vectors that one matrix product takes at once.
STEP = 1 << 20
#: Variance below this part of the largest counts as none: what rounding leaves.
LEAST = 1e-14


def matrices(col: pa.Array, size: int | None = None, scale: int = SCALE, shift: int = SHIFT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x): places of complete vectors, and their whole numbers as a matrix; for each length by itself, or only those of length size."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    values = col.flatten()  # of vectors that aren't null
    flat = np.asarray(values.fill_null(np.nan), np.float64)
    first = np.cumsum(lengths, dtype=np.int64) - lengths
    for n in np.unique(lengths[lengths > 0]).tolist() if size is None else [size]:
        rows = np.flatnonzero(lengths == n)
        for k in range(0, len(rows), max(1, STEP // n)):
            some = rows[k : k + max(1, STEP // n)]
            found = flat[first[some, None] + np.arange(n)]
            whole = np.isfinite(found).all(axis=1)
            if whole.any():
                yield some[whole], np.clip(np.floor(found[whole] * scale), -MOST, MOST).astype(np.int64) + shift


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns, in two halves so that none overflows."""
    high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
    return [(a << 26) + b for a, b in zip(high.tolist(), low.tolist(), strict=True)]


@dataclass
class Moments:
    """n vectors' mean and sum of centred outer products; two of them join without loss of digits."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def joined(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + off * (other.n / n), self.products + other.products + np.outer(off, off) * (self.n / n * other.n))


@dataclass
class Whitening:
    """n and sums of the vectors it was fitted on; vectors: components in columns, values: their eigenvalues, trace: of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x less the mean, and each row's sum of (n*x - S)^2 (null beyond 64 bits)."""
        if float(np.abs(x).max(initial=0)) * self.n < 2.0**62:
            off = x * self.n - np.array([int(s) for s in self.sums], np.int64)
            if (off.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
                return off / self.n, (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        squares = (off * off).sum(axis=1).tolist()
        return (off / self.n).astype(np.float64), [s if s < 1 << 63 else None for s in squares]

    def apply(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan for components along which nothing varies."""
        scale = np.where(self.varying(), np.sqrt(np.maximum(self.values, 0)), np.nan)
        return centred @ self.vectors / scale

    def varying(self) -> np.ndarray:
        return self.values > LEAST * max(float(self.values.max(initial=0)), 1e-300)


def per_task(vectors: DataFrame, fn, fields: str) -> DataFrame:
    """One row of fn(iterator of the columns) for each task."""

    kinds = to_arrow_schema(T._parse_datatype_string(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (pa.RecordBatch.from_pylist([row], schema=kinds) for row in fn(b.column(0) for b in batches if b.num_rows))

    return vectors.mapInArrow(run, fields)


def tree_merged(rows: DataFrame, zero, read, join):
    """join() of all rows, which read() makes of them, merged by tasks in DEPTH levels."""
    return rows.rdd.treeAggregate(zero, lambda a, row: join(a, read(row)), join, DEPTH)


def dimension(vectors: DataFrame) -> int:
    """The most frequent length of complete vectors, 0 if there are none."""

    def lengths(columns):
        counts: dict[int, int] = {}
        for col in columns:
            for rows, x in matrices(col):
                counts[x.shape[1]] = counts.get(x.shape[1], 0) + len(rows)
        return ({"size": k, "n": n} for k, n in counts.items())

    top = per_task(vectors, lengths, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return int(top[0]) if top else 0


def totals(vectors: DataFrame, size: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sums of their whole numbers."""

    def sums(columns):
        n, total = 0, [0] * size
        for col in columns:
            for _, x in matrices(col, size, scale, shift):
                n, total = n + len(x), [a + b for a, b in zip(total, exact_sums(x), strict=True)]
        yield {"n": n, "sums": [str(s) for s in total]}

    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)])
    return tree_merged(per_task(vectors, sums, "n long, sums array<string>"), (0, [0] * size), lambda r: (r[0], [int(s) for s in r[1]]), add)


def moments(vectors: DataFrame, size: int, scale: int, shift: int, model: Whitening, through) -> Moments:
    """Moments of through(centred vectors), held about their mean in each task."""

    def products(columns):
        held = Moments(0, np.zeros(0), np.zeros((0, 0)))
        for col in columns:
            for _, x in matrices(col, size, scale, shift):
                y = through(model.centred(x)[0])
                mean = y.mean(axis=0)
                y = y - mean
                held = held.joined(Moments(len(y), mean, y.T @ y))
        if held.n:
            yield {"n": held.n, "mean": held.mean.tobytes(), "products": held.products.tobytes()}

    def read(row):
        mean = np.frombuffer(bytes(row[1]), np.float64)
        return Moments(row[0], mean, np.frombuffer(bytes(row[2]), np.float64).reshape(len(mean), -1))

    return tree_merged(per_task(vectors, products, "n long, mean binary, products binary"), Moments(0, np.zeros(0), np.zeros((0, 0))), read, Moments.joined)


def centred_products(vectors: DataFrame, size: int, scale: int, shift: int, model: Whitening) -> np.ndarray:
    """The sum over all vectors of the outer product of x - S/n with itself."""

    def products(columns):
        held = np.zeros((size, size))
        for col in columns:
            for _, x in matrices(col, size, scale, shift):
                y = model.centred(x)[0]
                held += y.T @ y
        yield {"products": held.tobytes()}

    read = lambda row: np.frombuffer(bytes(row[0]), np.float64).reshape(size, size)
    return tree_merged(per_task(vectors, products, "products binary"), np.zeros((size, size)), read, np.add)


def column(table: DataFrame, vector_col: str) -> DataFrame:
    return table.select(table[vector_col].cast("array<double>").alias("vector"))


def fit(table: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of all complete vectors of a table, in its first `components` components (fewer if vectors are shorter)."""
    bounded_batches(table.sparkSession)
    vectors = column(table, vector_col)
    size = dimension(vectors)
    if not size:
        return Whitening(0, [])
    model = Whitening(*totals(vectors, size, scale, shift))
    covariance = centred_products(vectors, size, scale, shift, model) / model.n
    values, found = np.linalg.eigh((covariance + covariance.T) / 2)
    top = np.argsort(-values, kind="stable")[:components]
    model.values, model.vectors, model.trace = values[top], np.ascontiguousarray(found[:, top]), float(np.trace(covariance))
    return model


def identity_error(table: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components that vary."""
    good = np.flatnonzero(model.varying())
    if not model.n or not len(good):
        return 0.0
    held = table.sparkSession.sparkContext.broadcast(model)
    found = moments(column(table, vector_col), len(model.sums), scale, shift, model, lambda y: held.value.apply(y)[:, good])
    return float(np.abs(found.products / found.n - np.eye(len(good))).max())


def whiten(table: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The id and, for each component, a row: component, n, deviation, whitened, explained."""
    bounded_batches(table.sparkSession)
    rows = table.select(table[id_col], table[vector_col].cast("array<double>").alias("vector"))
    new = T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double")
    schema = T.StructType([rows.schema.fields[0], *new.fields])
    names, held, size = [f.name for f in schema.fields], table.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds = held.value, to_arrow_schema(new)
        k = len(own.values)
        explained = own.values / own.trace if own.trace else np.full(k, np.nan)
        for b in batches:
            if not b.num_rows or not size:
                continue
            for at, x in matrices(b.column(1), size, scale, shift):
                off, deviation = own.centred(x)
                made = [np.tile(np.arange(1, k + 1), len(at)), np.full(len(at) * k, own.n), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), own.apply(off).ravel(), np.tile(explained, len(at))]
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, f.type, from_pandas=True) for v, f in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(at, k))), *arrays], names=names)

    return rows.mapInArrow(run, schema)


def report(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """What whiten() gives of a whitening fitted on the table itself, with identity_error."""
    model = fit(table, components, vector_col)
    return whiten(table, model, id_col, vector_col).withColumn("identity_error", F.lit(identity_error(table, model, vector_col)))
