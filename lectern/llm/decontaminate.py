"""Benchmark decontamination by Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of benchmark items (an item with fewer is one
window). For each window length there is a shift table over blocks of two words: it says how far the
window's end may move without passing an occurrence, and the words between are never looked at. Where the shift is zero, the hash of
the window's last block, its suffix, selects a bucket of patterns, of which those whose first block, the prefix, has the hash of the window's
are compared with the text word by word. Many cursors move over the text at once.

The tables are broadcast in sets of at most TABLE_BYTES of benchmark text (about five times as many bytes); however many sets
there are, documents are read and split into words once, and at most one set is held for each stretch of GROUP_BYTES of them.

Defined results: null and empty texts have no words and are clean; items without words occur nowhere;
repeated item ids count once; a null item id counts as the empty string; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ALNUM, CHUNK, LOWER, U, distinct, fresh, mix, over_texts, span_places, window_hashes, word_hashes, words

WINDOW = 13
#: Bytes of benchmark text in one set of tables.
TABLE_BYTES = 8 << 20
#: Text of documents that sets of tables are used on in turn, if there is more than one.
GROUP_BYTES = 16 << 20
#: Words between two cursors.
LANE = 512

NORMAL = np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8)


@dataclass
class Patterns:
    """All patterns of one length.

    blocks: sorted hashes of their blocks, shifts: of each; pairs: sorted hashes of suffix and prefix, buckets: of each the first of its patterns (and
    the end); at: of each pattern its first word in the tables' words; items: the first of its items (and the end) in `of`.
    """

    size: int
    blocks: np.ndarray
    shifts: np.ndarray
    pairs: np.ndarray
    buckets: np.ndarray
    at: np.ndarray
    items: np.ndarray
    of: np.ndarray


@dataclass
class Tables:
    """names: of items; data, starts, ends: the words of all items; patterns: by length."""

    names: list[str]
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    patterns: list[Patterns]


def normal_words(text: bytes) -> list[bytes]:
    return np.take(NORMAL, np.frombuffer(text, np.uint8)).tobytes().split()


def block_width(size: int) -> int:
    return min(2, size)


def block_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """Of the block that ends at each word; blocks that don't fit are 0."""
    if width == 1:
        return w
    out = np.zeros(len(w), np.uint64)
    out[1:] = mix(w[:-1] * U(0x9E3779B97F4A7C15) + w[1:])
    return out


def pair_hashes(ends: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Of the last and the first block of windows; ends: hashes of blocks by their last words."""
    return mix(ends[begin + size - 1] ^ mix(ends[begin + block_width(size) - 1]))


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Tables:
    """The tables for items (name, text)."""
    names = sorted({i or "" for i, _ in items})
    place = {n: k for k, n in enumerate(names)}
    raw = [(t or "").encode() for _, t in items]
    bounds = np.cumsum([0, *map(len, raw)])
    data = NORMAL[np.frombuffer(b"".join(raw), np.uint8)]
    s, e, first = words(data, bounds, ALNUM)
    text = data.tobytes()
    tables = Tables(names, text, s.astype(np.int64), e.astype(np.int64), [])
    if not len(s):
        return tables
    h = word_hashes(data, s, e)
    counts = np.diff(first)
    sizes = np.minimum(counts, window)
    owner = np.array([place[i or ""] for i, _ in items])
    for size in distinct(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == size)
        n = counts[mine] - size + 1
        at, of = span_places(first[:-1][mine], n), np.repeat(owner[mine], n)
        width = block_width(size)
        ends = block_hashes(h, width)
        # Shifts: each block's least distance to the end of a pattern.
        places = np.concatenate([at + width - 1 + k for k in range(size - width + 1)])
        far = np.repeat(np.arange(size - width, -1, -1), len(at))
        order = np.lexsort((far, ends[places]))
        new = np.append(True, np.diff(ends[places][order]) != 0)
        blocks, shifts = ends[places][order][new], far[order][new]
        # Equal patterns are one, with all their items; equality is checked word by word.
        whole = window_hashes(h, size)[at]
        order = np.lexsort((of, whole, pair_hashes(ends, at, size)))
        at, of, whole = at[order], of[order], whole[order]
        new = np.append(True, np.diff(whole) != 0)
        head = np.flatnonzero(new)
        for k in np.flatnonzero(~new).tolist():
            a, b = int(at[head[np.searchsorted(head, k, side="right") - 1]]), int(at[k])
            if any(text[s[a + x] : e[a + x]] != text[s[b + x] : e[b + x]] for x in range(size)):
                new[k] = True  # another pattern with the same hash
        head = np.flatnonzero(new)
        pattern = np.cumsum(new) - 1
        once = np.append(True, (np.diff(pattern) != 0) | (np.diff(of) != 0))
        begin = np.append(np.searchsorted(pattern[once], np.arange(len(head))), once.sum())
        pairs = pair_hashes(ends, at[head], size)
        bucket = np.flatnonzero(np.append(True, np.diff(pairs) != 0))
        tables.patterns.append(Patterns(size, blocks, shifts, pairs[bucket], np.append(bucket, len(head)), at[head].astype(np.int32), begin, of[once].astype(np.int32)))
    return tables


def lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def candidates(ends: np.ndarray, p: Patterns) -> tuple[np.ndarray, int]:
    """Last words of windows whose shift is zero, of which every occurrence is one; and how many words were looked at. ends: hashes of blocks by their last words."""
    n, width = len(ends), block_width(p.size)
    if n < p.size:
        return np.zeros(0, np.int64), 0
    at = np.arange(p.size - 1, n, LANE)
    stop = np.minimum(at + LANE, n)
    found, looked = [], 0
    while len(at):
        looked += len(at)
        k, there = lookup(p.blocks, ends[at])
        shift = np.where(there, p.shifts[k], p.size - width + 1)
        found.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return np.concatenate(found), looked


def same_words(data: bytes, s: np.ndarray, e: np.ndarray, at: int, t: Tables, there: int, size: int) -> bool:
    """Whether `size` words from one place of the text on are those of the tables, compared one by one from the last."""
    for k in range(size - 1, -1, -1):
        if data[s[at + k] : e[at + k]] != t.data[t.starts[there + k] : t.ends[there + k]]:
            return False
    return True


class Words:
    """Words of a chunk of texts: normalised bytes, spans, first word of each text, and hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        data = NORMAL[data]
        self.start, self.end, self.first = words(data, bounds, ALNUM)
        self.hashes = word_hashes(data, self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.data = data.tobytes()


def search(w: Words, t: Tables) -> tuple[np.ndarray, list[set[int]]]:
    """Hit words, and items with occurring windows by text."""
    n = len(w.start)
    edge = np.zeros(n + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(w.first) - 1)]
    ends = {1: w.hashes, 2: block_hashes(w.hashes, 2)}
    for p in t.patterns if n else ():
        by = ends[block_width(p.size)]
        last, _ = candidates(by, p)
        begin = last - p.size + 1
        row = np.searchsorted(w.first, begin, side="right") - 1
        whole = last < w.first[row + 1]
        begin, row = begin[whole], row[whole]
        if not len(begin):
            continue
        k, there = lookup(p.pairs, pair_hashes(by, begin, p.size))
        begin, row, k = begin[there], row[there], k[there]
        size = p.buckets[k + 1] - p.buckets[k]
        for b, r, x in zip(np.repeat(begin, size).tolist(), np.repeat(row, size).tolist(), span_places(p.buckets[k], size).tolist(), strict=True):
            if same_words(w.data, w.start, w.end, b, t, int(p.at[x]), p.size):
                edge[b] += 1
                edge[b + p.size] -= 1
                items[r].update(p.of[p.items[x] : p.items[x + 1]].tolist())
    return np.cumsum(edge[:n]) > 0, items


def tables_of(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[Tables]:
    """Tables for parts of the benchmark of about TABLE_BYTES of text each, by a hash of the rows."""
    rows = benchmark.select(benchmark[id_col].cast("string").alias("i"), F.coalesce(benchmark[text_col].cast("string"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-total // TABLE_BYTES) or 1
    for k in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else rows
        yield build([tuple(r) for r in mine.collect()], window)


class Found:
    """Columns that occurrences() adds, under names that the documents don't have."""

    def __init__(self, taken: list[str]):
        self.n_words, self.hit, self.items = (fresh(x, taken) for x in ("n_words", "hit", "items"))

    def n_hit(self) -> Column:
        """Bits set in hit, by its hexadecimal digits."""
        digits = F.hex(self.hit)
        weight = {1: "1248", 2: "3569AC", 3: "7BDE", 4: "F"}
        n = sum(((F.length(digits) - F.length(F.translate(digits, chars, ""))) * k for k, chars in weight.items()), F.lit(0))
        return n.cast("long")

    def contaminated(self) -> Column:
        """At least one hit word, and a twentieth of all words hit."""
        n = self.n_hit()
        return (n > 0) & (20 * n >= F.col(self.n_words))


def occurrences(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, Found]:
    """Columns `keep` of each document, then how many words it has, which are hit (a packed bit for each), and the names of items that occur, sorted."""
    sc = docs.sparkSession.sparkContext
    sets: list[Broadcast] = [sc.broadcast(t) for t in tables_of(benchmark, window, item_col, item_text_col)]
    names = Found(keep)

    def fn(data, bounds):
        w = Words(data, bounds)
        hit, items = np.zeros(len(w.start), bool), [set() for _ in range(len(bounds) - 1)]
        for held in sets:
            t = held.value
            more, own = search(w, t)
            hit |= more
            for mine, found in zip(items, own, strict=True):
                mine.update(t.names[i] for i in found)
            if len(sets) > 1:
                del held._value  # only one set is in memory
        masks = [np.packbits(hit[a:b]).tobytes() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        return np.diff(w.first), masks, [sorted(x) for x in items]

    fields = f"`{names.n_words}` long, `{names.hit}` binary, `{names.items}` array<string>"
    return over_texts(docs, fn, fields, keep, text_col, CHUNK if len(sets) == 1 else GROUP_BYTES), names


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found, names = occurrences(rows, benchmark, ["doc_id"], window)
    return found.select(
        "doc_id", F.col(names.n_words).alias("n_words"), names.n_hit().alias("n_hit"), F.size(names.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(names.items, ",").cast("binary"), 256).alias("items_sha256"), names.contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Rows of docs that aren't contaminated, with all their columns."""
    found, names = occurrences(docs, benchmark, docs.columns, window, text_col)
    return found.filter(~names.contaminated()).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM
  (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
v AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM
  (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT doc_id, i, v.m, item_id FROM v JOIN p ON v.m = p.m AND v.g = p.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, (coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
