"""Ranked lexical search by a two-level quantised index.

The index is a table of postings by segment and term, sorted by term within a segment (some MB of text): the documents that hold the term, at
the first level a byte for each, its impact rounded upwards, and at the second its exact count. A search reads the first level of the query's
terms only: the bytes give each document an upper and, as no impact is rounded up by more than a step, a lower bound of its score.
The k-th largest lower bound of an item over all segments is its threshold; each document whose upper bound reaches it is rescored in whole numbers from the
second level, and no other can be among the best k. Texts aren't read again, and no document but these leaves its segment.

Items are dealt to blocks, so that what a task holds of them is bounded; tasks work on one segment and one block of items. Terms are told
apart by their bytes, never by hashes.

Defined results: null and empty texts have no terms, and don't count as documents; items without terms, and items of which no term occurs,
give no rows; rows of `benchmark` with one item_id are each answered for themselves; documents that share an id, or have none,
count each for itself (null ids rank as the smallest on ties and come back as null); no documents or no items give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, bounded_batches, buffers, byte_set, fresh, null_id, over_texts, scratch, texts, words, written

TOP = 50
#: Members of terms `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`.
TERM = ~byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Text of a segment; a longer text is a segment of its own. Documents of one are numbered by 16 bits.
SEGMENT_BYTES = 16 << 20
SEGMENT_ROWS = 1 << 16
#: An impact is at most a million, so that in such steps it fits a byte.
STEP = 4096
#: Items that a task scores at once.
BLOCK_ITEMS = 2048
#: Terms of items are broadcast up to this size, else the postings are joined with them by a shuffle; and cells up to this number.
BROADCAST_BYTES, BROADCAST_CELLS = 8 << 20, 1 << 20


@dataclass
class Index:
    """postings: segment, term, n (documents), docs (16-bit numbers), impacts (bytes), tfs (32 bits). The row without a term has the segment's
    document ids as docs and their length norms as tfs, 64 bits each. documents, terms: how many the collection has."""

    postings: DataFrame
    documents: int
    terms: int


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each term among the distinct ones, these in order of their bytes)."""
    inside = TERM[data]
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=off[1:])
    each = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(data[inside])]).dictionary_encode()
    order = np.asarray(pc.sort_indices(each.dictionary))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[np.asarray(each.indices)], each.dictionary.take(pa.array(order))


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 50 + (50 * n * documents) div terms, for each length n."""
    if 50 * int(lengths.max(initial=0)) * documents < 1 << 63:
        return 50 + 50 * lengths * documents // max(1, terms)
    return np.array([50 + 50 * n * documents // terms for n in lengths.tolist()], np.int64)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norm)


SCHEMA = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary())])


def cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Values between each two cuts as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def segment_rows(segment: int, ids: np.ndarray, data: np.ndarray, bounds: np.ndarray, documents: int, terms: int) -> pa.RecordBatch:
    """The postings of one segment."""
    data = LOWER[data]
    s, e, first = words(data, bounds, TERM)
    n = np.diff(first)
    norm = norms(n, documents, terms)
    head = pa.RecordBatch.from_pylist([{"segment": segment, "term": "", "n": len(ids), "docs": ids.tobytes(), "impacts": b"", "tfs": norm.tobytes()}], schema=SCHEMA)
    if not len(s):
        return head
    term, names = spelled(data, s, e)
    key, tf = np.unique(term * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
    doc, term = key % len(n), key // len(n)
    cuts = np.searchsorted(term, np.arange(len(names) + 1))
    level = -(-impact(tf, norm[doc]) // STEP)
    arrays = [pa.array(np.full(len(names), segment)), names.cast(pa.binary()).cast(pa.string()), pa.array(np.diff(cuts)), cells(doc.astype(np.uint16), cuts), cells(level.astype(np.uint8), cuts), cells(tf.astype(np.uint32), cuts)]
    return pa.concat_batches([head, pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, written. Lengths of all of them are counted first, as impacts depend on their mean."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = texts(docs, id_col, text_col)
    counted = over_texts(plain, lambda data, bounds: [np.diff(words(LOWER[data], bounds, TERM)[2])], "n long", [])
    documents, terms = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def made():
            ids, data, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            return segment_rows(at, ids, data, np.concatenate([[0], np.cumsum(lengths)]), documents, terms)

        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column(0))
            data, off = buffers(b.column(1))
            i = 0
            while i < b.num_rows:
                most = min(SEGMENT_BYTES - size, SEGMENT_BYTES)
                j = min(b.num_rows, i + SEGMENT_ROWS - rows, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
                if j <= i:
                    if held:
                        yield made()
                        at, held, rows, size = at + 1, [], 0, 0
                        continue
                    j = i + 1
                held.append((ids[i:j], np.array(data[off[i] : off[j]]), np.diff(off[i : j + 1])))
                rows, size, i = rows + j - i, size + int(off[j] - off[i]), j
        if held:
            yield made()

    fields = "segment long, term string, n long, docs binary, impacts binary, tfs binary"
    return Index(written(plain.mapInArrow(run, fields), "postings"), documents, terms)


def wanted(index: Index, items: DataFrame) -> DataFrame:
    """(term, block, uses): the items of a block that ask for a term, with its weight; written. items: item long, text."""
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))

    def distinct_terms(data, bounds):
        data = LOWER[data]
        s, e, first = words(data, bounds, TERM)
        raw = data.tobytes()
        return [[sorted({raw[s[k] : e[k]].decode() for k in range(a, b)}) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]]

    asked = written(over_texts(items, distinct_terms, "terms array<string>", ["item"]).select("item", F.explode("terms").alias("term")), "asked")
    found = index.postings.select("term", "n").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = asked.join(found.select("term", weight.alias("w")), "term").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    uses = weighted.groupBy("term", "block").agg(F.collect_list(F.struct("item", "w")).alias("uses"))
    none = F.array().cast("array<struct<item:bigint,w:bigint>>")
    heads = items.sparkSession.range(blocks).select(F.lit("").alias("term"), F.col("id").alias("block"), none.alias("uses"))
    return written(uses.unionByName(heads), "wanted")


class Cell:
    """One segment's postings for the terms of one block of items."""

    def __init__(self, table: pa.Table, level: str, kind: type):
        terms = table.column("term").to_pylist()
        docs, values = table.column("docs").to_pylist(), table.column(level).to_pylist()
        head = terms.index("")
        self.ids = np.frombuffer(docs[head], np.int64)
        self.docs = [np.frombuffer(d, np.uint16) if k != head else self.ids[:0] for k, d in enumerate(docs)]
        self.values = [np.frombuffer(v, kind).astype(np.int64) if k != head else self.ids[:0] for k, v in enumerate(values)]
        self.norm = np.frombuffer(values[head], np.int64) if level == "tfs" else None
        uses = table.column("uses").combine_chunks()
        row = np.repeat(np.arange(len(uses)), np.asarray(pc.list_value_length(uses)))
        flat = uses.flatten()
        item, weight = np.asarray(flat.field("item")), np.asarray(flat.field("w"))
        order = np.lexsort((row, item))
        self.row, self.weight = row[order], weight[order]
        self.items, begin = np.unique(item[order], return_index=True)
        self.begin = np.append(begin, len(order))

    def terms_of(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(docs, values, weight) of each term of the k-th item."""
        for x in range(self.begin[k], self.begin[k + 1]):
            yield self.docs[self.row[x]], self.values[self.row[x]], int(self.weight[x])


FOUND = pa.schema([("block", pa.int64()), ("segment", pa.int64()), ("item", pa.int64()), ("docs", pa.binary()), ("uppers", pa.binary()), ("lowers", pa.list_(pa.int64())), ("top", pa.int64())])


def bounds_of(table: pa.Table, most: int) -> pa.Table:
    """For each item, the documents that may be among its best in this segment, their upper bounds, and the largest lower bounds."""
    cell, out = Cell(table, "impacts", np.uint8), []
    block, segment = table.column("block")[0].as_py(), table.column("segment")[0].as_py()
    for k, item in enumerate(cell.items.tolist()):
        levels, weights = np.zeros(len(cell.ids), np.int64), np.zeros(len(cell.ids), np.int64)
        for docs, level, w in cell.terms_of(k):
            levels[docs] += w * level
            weights[docs] += w * (level > 0)
        at = np.flatnonzero(levels)
        upper = STEP * levels[at]
        lower = upper - (STEP - 1) * weights[at]  # an impact of level q is more than (q - 1) steps
        best = np.sort(np.partition(lower, len(lower) - most)[-most:] if len(lower) > most else lower)
        if len(lower) >= most:
            near = upper >= best[0]
            at, upper = at[near], upper[near]
        if len(at):
            out.append({"block": block, "segment": segment, "item": item, "docs": at.astype(np.uint16).tobytes(), "uppers": upper.tobytes(), "lowers": best, "top": int(upper.max())})
    return pa.Table.from_pylist(out, schema=FOUND)


SCORED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("segment", pa.int64()), ("place", pa.int32())])


def rescored(postings: pa.Table, found: pa.Table, most: int) -> pa.Table:
    """The best documents of this segment for each item, among those whose upper bound reaches its threshold."""
    if not found.num_rows or not postings.num_rows:
        return SCORED.empty_table()
    cell, out = Cell(postings, "tfs", np.uint32), []
    segment = postings.column("segment")[0].as_py()
    place = {item: k for k, item in enumerate(cell.items.tolist())}
    for row in found.select(["item", "threshold", "docs", "uppers"]).to_pylist():
        at = np.frombuffer(row["docs"], np.uint16)[np.frombuffer(row["uppers"], np.int64) >= row["threshold"]].astype(np.int64)
        norm, score = cell.norm[at], np.zeros(len(at), np.int64)
        for docs, tf, w in cell.terms_of(place[row["item"]]):
            k = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
            has = docs[k] == at
            score[has] += w * impact(tf[k[has]], norm[has])
        best = np.lexsort((at, cell.ids[at], -score))[:most]
        best = best[score[best] > 0]
        n = len(best)
        out.append(pa.table([np.full(n, row["item"]), cell.ids[at[best]], score[best], np.full(n, segment), at[best].astype(np.int32)], schema=SCORED))
    return pa.concat_tables(out)


def search(index: Index, items: DataFrame, most: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score, written: for each row of items its `most` best documents."""
    bounded_batches(items.sparkSession)
    # Texts of items, by numbers of their own.
    name = fresh("item", [id_col])
    numbered = written(items.select(items[id_col], F.coalesce(items[text_col].cast("string"), F.lit("")).alias("text_")).withColumn(name, F.monotonically_increasing_id()), "items")
    terms = wanted(index, numbered.select(F.col(name).alias("item"), F.col("text_").alias("text")))
    bytes_ = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16 * F.size("uses")), F.lit(0))).first()[0]
    asked = F.broadcast(terms) if bytes_ <= BROADCAST_BYTES else terms
    by = ["block", "segment"]

    first = index.postings.select("segment", "term", "docs", "impacts").join(asked, "term")
    found = written(first.groupBy(*by).applyInArrow(lambda t: bounds_of(t, most), "block long, segment long, item long, docs binary, uppers binary, lowers array<long>, top long"), "bounds")
    lowers = found.select("item", F.explode("lowers").alias("lower"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("lower")))
    kth = lowers.withColumn("place", place).filter(F.col("place") <= most).groupBy("item").agg(F.when(F.count("*") == most, F.min("lower")).otherwise(F.lit(0)).alias("threshold"))
    near = written(found.join(kth, "item").filter("top >= threshold").select(*by, "item", "threshold", "docs", "uppers"), "near")
    cells_ = written(near.select(*by).distinct(), "cells")

    second = index.postings.select("segment", "term", "docs", "tfs").join(asked, "term")
    second = second.join(F.broadcast(cells_) if cells_.count() <= BROADCAST_CELLS else cells_, by, "left_semi")
    scored = second.groupBy(*by).cogroup(near.groupBy(*by)).applyInArrow(lambda p, f: rescored(p, f, most), "item long, doc_id long, score long, segment long, place int")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "segment", "place"))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= most)
    ids = numbered.select(F.col(name).alias("item"), F.col(id_col).alias("item_id"))
    return written(ranked.join(ids, "item").select("item_id", "rank", null_id(F.col("doc_id")).alias("doc_id"), "score"), "ranked")


def report(docs: DataFrame, items: DataFrame, most: int = TOP) -> DataFrame:
    """What search() gives of an index of docs."""
    with scratch() as keep:
        return keep(search(index(docs), items, most))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, t, count(*)::BIGINT AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY doc_id, t),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, nd),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt))))::BIGINT AS score FROM b JOIN p USING (t) JOIN f USING (t), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
