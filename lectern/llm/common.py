"""What the operators of this subpackage share: work folders, Arrow chunks, vectorised words and hashes.

Texts reach Python as Arrow buffers and stay there: words, their hashes and n-gram keys are
computed over whole buffers with numpy, never one Python string at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.session import ship

#: Bytes of text that one numpy step handles; a single longer text is one step.
CHUNK = 4 << 20
#: Row id given to a null id while rows are ordered; null again in results.
NULL_ID = -(1 << 63)
U = np.uint64


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Only where that is unset and Spark runs in this process alone (tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(base)
    run = f"{base.rstrip('/')}/lectern-{sc.applicationId}"
    if getattr(sc, "_lectern_run", None) != run:
        path = sc._jvm.org.apache.hadoop.fs.Path(run)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._lectern_run = run
    return f"{run}/{name}-{uuid.uuid4().hex}"


_settings: dict[tuple, list] = {}
_changing = Lock()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for as long as the block lasts, or another thread's block with the same one."""
    name = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), key)
    with _changing:
        held = _settings.setdefault(name, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _changing:
            held[0] -= 1
            if not held[0]:
                del _settings[name]
                if held[1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[1])


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows of df, written to the shared folder and read back: lineage ends there, and shuffle files of the job go with it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    for scope in _scopes.get():
        scope.append(out)
    return out


#: Lists that written() adds its tables to: those of this thread (or task of asyncio) alone.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


@contextmanager
def recorded():
    """A list of the tables that written() makes inside, in this thread."""
    made: list[DataFrame] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


@contextmanager
def scratch():
    """Tables that written() makes inside are deleted at the end, also if it fails, but for those given to the function that this yields. What is returned must read only such."""
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    with recorded() as made:
        try:
            yield keep
        finally:
            discard(*[t for t in made if not any(t is k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        if t._lectern_path is None:
            continue
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._lectern_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        t._lectern_path = None


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, written so that it stays the same (ids may be null or repeat); and that column's name."""
    row = fresh("row_number", docs.columns)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def bounded_batches(spark: SparkSession) -> None:
    """Ship the code, and bound Arrow batches for this session, so that long texts don't fill a Python worker; smaller bounds stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(doc_id long, text string, and columns `keep`): null texts are empty, null ids NULL_ID; other columns are cut off."""
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in keep],
    )


def null_id(c: Column) -> Column:
    return F.when(c != F.lit(NULL_ID), c)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Members of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Members of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and each row's first word (one more than rows)."""
    inside = member[data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = bounds[1:-1]
    before[cut[cut < n]] = False
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


# Hash of a byte string: sum of a random 64-bit value per byte times a power of an odd base, modulo 2^64,
# so that prefix sums give the hash of any span; then mixed, since low bits of such sums are weak.
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INV = U(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = U(pow(int(base), done, 1 << 64))
        m = min(done, n - done)
        np.multiply(out[:m], step, out=out[done : done + m])
        done += m
    return out[:n]


class Powers:
    """Powers of the base and of its inverse, grown when longer ones are needed."""

    up = powers(BASE, 1 << 10)
    down = powers(INV, 1 << 10)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = powers(BASE, n + n // 4), powers(INV, n + n // 4)
        return cls.up, cls.down


#: Key of the hashes of words.
WORD_SEED = 0x5EED_0F_3047


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of values[k]*BASE**k for i <= k < j."""
    up, _ = Powers.of(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Raw hashes of spans, equal for equal contents wherever they stand."""
    _, down = Powers.of(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word among the distinct ones, these), told apart by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    flat = data[np.cumsum(inside, dtype=np.int8)[:-1].view(bool)]
    each = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets32(ends - starts)), pa.py_buffer(flat)]).dictionary_encode()
    return each.indices.to_numpy(), each.dictionary.to_pylist()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; two different words meet with a chance of 2^-64.

    Eight bytes at a time go through mix(), which is no polynomial, behind the length and a key: what one step makes of two words has no algebra
    by which a later step could undo the difference for all words of a form.
    """
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + U(WORD_SEED))
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))  # the eight bytes from each place on
    at, step = np.flatnonzero(length > 0), 0
    while len(at):
        left = length[at] - step
        bits = (U(64) - U(8) * np.minimum(left, 8).astype(np.uint64)) & U(63)
        out[at] = mix(out[at] ^ ((eight[starts[at] + step] << bits) * U(0x9E3779B97F4A7C15)))
        step += 8
        at = at[left > 8]
    return out


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Mixed hashes of every run of `size` values."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    s = prefix_sums(values)
    _, down = Powers.of(len(s))
    return mix((s[size:] - s[:-size]) * down[: len(s) - size])


def offsets32(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def over_texts(docs: DataFrame, fn, fields: str, keep: list[str], text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Columns `keep` as they are, then those that fn(bytes, bounds) gives for each chunk of texts (null: empty).

    fields: DDL of the new columns, whose names must differ from those kept; fn returns one array of values for each. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    new = T._parse_datatype_string(fields)
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(fresh("text", keep)))
    schema = T.StructType([*rows.schema.fields[:-1], *new.fields])
    names, n = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(new)
        for b in batches:
            if not b.num_rows:
                continue
            data, off = buffers(b.column(n))
            i = 0
            while i < b.num_rows:
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(off, off[i] + chunk, side="right")) - 1))
                made = fn(data[off[i] : off[j]], off[i : j + 1] - off[i])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kinds.field(k).type) for k, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([b.column(k).slice(i, j - i) for k in range(n)] + arrays, names=names)
                i = j

    return rows.mapInArrow(run, schema)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    s = np.sort(values)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def span_places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of spans, one span after another."""
    to = np.cumsum(lengths)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - lengths), lengths)
