"""Exact substring dedup by a hash-compared suffix sort.

Every string of 100 bytes is found again wherever it stands: its anchor, the leftmost least of the hashes of its 61 substrings
of 40 bytes, depends on nothing else. Strings with one anchor form a segment of at most 160 bytes; segments whose anchor
occurs once in the corpus hold no repeated string and stay where they are. The others meet by anchor in a shard. There the
suffixes at the anchors are sorted by mergesort, and so are the reversed prefixes before them; two of them are compared in
logarithmic time, since prefix polynomial hashes and binary search give the length that they have in common. A string at distance
d before its anchor is that of another segment if the prefixes have d bytes in common and the suffixes 100 - d, which the
common lengths of neighbours in the two orders tell. Equal spans that hashes claim are verified byte by byte, in blocks and in shards.

Anchors with over HOT_SEGMENTS segments (a passage that very many documents hold has one at each of its ends) would gather in
one task. Their strings are looked up one by one instead, by two independent hashes of 64 bits; a shard keeps the first place of each.

Defined results: null and empty texts have no bytes; null ids come before all others and stay null; of rows with equal ids
the one stored first comes first; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BASE, BYTE_VALUE, INV, U, fresh, mix, null_id, powers, prefix_sums, span_hashes, span_places, window_hashes, with_rows
from lectern.llm.exchange import Batch, Block, Firsts, Question, Repeats, exchange, over_blocks, per_block, sliding_argmin, starts_within, store, summed_stats

WINDOW = 100
SEED = 40
BLOCK_BYTES = 1 << 20
#: Shards for each that a corpus has by its text: here they hold segments, not hashes alone.
SHARDS = 4
#: Strings handled in one step where a step makes arrays of many times their bytes.
STRINGS = 1 << 13
#: Text of segments worked on at once in a shard.
PART_BYTES = 2 << 20
#: Segments of one anchor that may meet in a task: 5 MB of text, and some 250 MB of numbers about it while they are sorted.
HOT_SEGMENTS = 1 << 15


class Segments:
    """Of a block: for each place of an anchor, its value and the windows (starts lo to hi) that it is the anchor of."""

    def __init__(self, block: Block, window: int):
        seed = max(1, window * SEED // WINDOW)
        if window - seed > 63:
            raise ValueError("a window has at most 64 places for its anchor")
        at = starts_within(block.bounds, window)
        if not len(at):
            self.value, self.anchor, self.lo, self.hi = np.zeros(0, np.uint64), at, at, at
            return
        seeds = window_hashes(BYTE_VALUE[block.data], seed)
        anchor = sliding_argmin(seeds, window - seed + 1)[at]
        new = np.flatnonzero(np.diff(anchor, prepend=-1))
        self.anchor = anchor[new].astype(np.int64)
        # An anchor is the least of 61 hashes, so that nearly all are small; mixed again (one to one) they fall evenly on shards.
        self.value = mix(seeds[self.anchor])
        self.lo, self.hi = at[new], at[np.append(new[1:], len(at)) - 1]

    def only(self, some: np.ndarray) -> Segments:
        out = object.__new__(Segments)
        out.value, out.anchor, out.lo, out.hi = self.value[some], self.anchor[some], self.lo[some], self.hi[some]
        return out

    def shapes(self, block: Block, window: int) -> np.ndarray:
        """A hash of each segment's text and of where its anchor stands in it."""
        text = span_hashes(prefix_sums(BYTE_VALUE[block.data]), self.lo, self.hi + window)
        shape = ((self.anchor - self.lo) * 64 + (self.anchor - self.hi)).astype(np.uint64)
        return mix(text + shape * U(0x9E3779B97F4A7C15))


class BlockRepeats(Repeats):
    """Question: which anchors occur twice, and which have over HOT_SEGMENTS segments, each counted once for a block that holds it."""

    def __init__(self, window: int):
        self.window = window
        super().__init__(None, True, HOT_SEGMENTS)

    def ask(self, block, had):
        seg = Segments(block, self.window)
        distinct, back, counts = np.unique(seg.value, return_inverse=True, return_counts=True)
        first = np.unique(seg.shapes(block, self.window), return_index=True)[1]
        return Batch(distinct, [np.minimum(counts, 2).astype(np.uint8), np.bincount(back[first], minlength=len(distinct)).astype(np.uint32)])


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> None:
    """Fail unless spans at a and at b have the same bytes."""
    for i in range(0, len(a), STRINGS):
        n = length[i : i + STRINGS]
        if not np.array_equal(data[span_places(a[i : i + STRINGS], n)], data[span_places(b[i : i + STRINGS], n)]):
            raise RuntimeError("two strings share a hash")


class LookedUp:
    """A block's segments whose anchor occurs twice (cold) or in very many segments (hot).

    Cold: the first of each distinct one (first, in order of values), and which of those each is (of). Hot: starts of their strings
    (place), two hashes of each distinct one (keys, second), its first place (head), and which of those each string is (back).
    """

    def __init__(self, block: Block, repeats: list[np.ndarray], window: int):
        every = Segments(block, window)
        back = np.unique(every.value, return_inverse=True)[1]
        state = repeats[0][back] if len(back) else np.zeros(0, np.uint8)
        self.cold = cold = every.only(np.flatnonzero(state == 1))
        _, first, of = np.unique(cold.shapes(block, window), return_index=True, return_inverse=True)
        order = np.argsort(cold.value[first], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first, self.of = first[order], rank[of]
        head = self.first[self.of]
        copy = np.flatnonzero(head != np.arange(len(head)))
        lo, length = cold.lo, cold.hi - cold.lo + window
        if not (np.array_equal(length[copy], length[head[copy]]) and np.array_equal((cold.anchor - lo)[copy], (cold.anchor - lo)[head[copy]])):
            raise RuntimeError("two segments share a hash")
        equal_spans(block.data, lo[copy], lo[head[copy]], length[copy])
        hot = every.only(np.flatnonzero(state == 2))
        self.place = np.sort(span_places(hot.lo, hot.hi - hot.lo + 1))
        values = BYTE_VALUE[block.data]
        raw = span_hashes(prefix_sums(values), self.place, self.place + window) if len(self.place) else np.zeros(0, np.uint64)
        self.keys, head, self.back = np.unique(mix(raw), return_index=True, return_inverse=True)
        self.head = self.place[head]
        other = span_hashes(prefix_sums(mix(values)), self.head, self.head + window) if len(self.head) else raw
        self.second = mix(other)
        equal_spans(block.data, self.place, self.head[self.back], np.full(len(self.place), window))


class AskSegments(Question):
    """Question: for each of a block's distinct segments of cold anchors, a bit for each of its windows whose string also stands earlier.

    Anchors are independent of one another, so that a shard is worked through in parts of about PART_BYTES of text.
    """

    def __init__(self, window: int):
        self.window = window

    def ask(self, block, had):
        found = LookedUp(block, had[0], self.window)
        seg, f = found.cold, found.first
        lo, hi, anchor = seg.lo[f], seg.hi[f], seg.anchor[f]
        doc = np.searchsorted(block.bounds, lo, side="right") - 1
        n = hi + self.window - lo
        columns = [(anchor - lo).astype(np.uint8), (anchor - hi).astype(np.uint8), block.ids[doc], lo.astype(np.uint32)]
        return Batch(seg.value[f], columns, block.data[span_places(lo, n)], n.astype(np.uint16))

    def answer(self, batch, who):
        far, near, ids, pos = (c.astype(np.int64) for c in batch.columns)
        value, window = batch.keys, self.window
        length = far - near + window
        start = np.cumsum(length) - length
        order = np.argsort(value, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(np.append(True, value[order[1:]] != value[order[:-1]])) if len(order) else order
        part = before[first] // PART_BYTES
        cuts = first[np.flatnonzero(np.append(True, part[1:] != part[:-1]))] if len(order) else order
        mask = np.zeros(len(value), np.uint64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=len(order) > 0):
            k = order[a:b]
            text = gathered(batch.text, start[k], length[k])
            mask[k] = repeated_windows(text, value[k], far[k], near[k], ids[k], who[k], pos[k], window)
        return [mask], []


class AskStrings(Firsts):
    """Question: whether a block has the first place of each of its distinct strings of hot anchors."""

    def __init__(self, window: int):
        self.window = window

    def ask(self, block, had):
        found = LookedUp(block, had[0], self.window)
        doc = np.searchsorted(block.bounds, found.head, side="right") - 1
        return Batch(found.keys, [block.ids[doc], found.head.astype(np.uint32), found.second])

    @staticmethod
    def heads(batch, who):
        """By both hashes."""
        ids, at, second = batch.columns
        order = np.lexsort((at, who, ids, second, batch.keys))
        new = np.append(True, (batch.keys[order[1:]] != batch.keys[order[:-1]]) | (second[order[1:]] != second[order[:-1]])) if len(order) else np.zeros(0, bool)
        head = np.empty(len(order), np.int64)
        head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        return head

    def answer(self, batch, who):
        return [self.heads(batch, who) == np.arange(len(who))], []

    def unfold(self, columns, folded):
        back, is_head, _ = folded
        return [columns[0][back] & is_head]


class Text:
    """Byte strings side by side, of which common lengths are found by hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, lengths
        longest = int(lengths.max()) if len(lengths) else 0
        self.up, self.down = powers(BASE, longest + 1), powers(INV, longest + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        for i in range(0, len(starts), STRINGS):  # step by step, since what is made on the way takes many times the text
            a, n = int(starts[i]), lengths[i : i + STRINGS]
            b = a + int(n.sum())
            place = np.arange(b - a) - np.repeat(starts[i : i + STRINGS] - a, n)
            np.cumsum(BYTE_VALUE[data[a:b]] * self.up[place], out=self.sums[a + 1 : b + 1])
            self.sums[a + 1 : b + 1] += self.sums[a]

    def hashes(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of the first k bytes of strings i."""
        s = self.starts[i]
        return self.sums[s + k] - self.sums[s]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many first bytes strings i and j have in common."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            same = self.hashes(i[open_], mid) == self.hashes(j[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether string i sorts before string j, or with or_equal not after it."""
        k = self.common(i, j)
        end_i, end_j = k == self.lengths[i], k == self.lengths[j]
        last = len(self.data) - 1
        less = self.data[np.minimum(self.starts[i] + k, last)] < self.data[np.minimum(self.starts[j] + k, last)]
        return np.where(end_i & end_j, or_equal, np.where(end_i, True, np.where(end_j, False, less)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the strings, those of a group (equal numbers, side by side) among themselves: mergesort of all groups at once."""
        n = len(group)
        order = np.arange(n)
        if not n:
            return order
        begin = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(np.append(begin, n))
        head, count = np.repeat(begin, size), np.repeat(size, size)
        q, width = np.arange(n) - head, 1
        while width < size.max():
            run = q // width
            left = run % 2 == 0
            lo = np.minimum((run ^ 1) * width, count)
            base, hi = lo, np.minimum(lo + width, count)
            lo, hi = lo.copy(), hi.copy()
            while True:  # how many of the other run stand before this string
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                there = self.before(order[head[open_] + mid], order[open_], ~left[open_])
                lo[open_[there]] = mid[there] + 1
                hi[open_[~there]] = mid[~there]
            new = np.empty(n, np.int64)
            new[head + (run & ~1) * width + (q - run * width) + (lo - base)] = order
            order = new
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Common length of each string in order with the one before it, -1 at a group's first; verified byte by byte."""
        out = np.full(len(order), -1, np.int64)
        k = np.flatnonzero(np.diff(group[order], prepend=-1) == 0)
        out[k] = self.common(order[k - 1], order[k])
        for i in range(0, len(k), STRINGS):
            j = k[i : i + STRINGS]
            a, b = span_places(self.starts[order[j - 1]], out[j]), span_places(self.starts[order[j]], out[j])
            if not np.array_equal(self.data[a], self.data[b]):
                raise RuntimeError("two strings share a hash")
        return out


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes of spans side by side."""
    parts = [data[span_places(starts[i : i + STRINGS], lengths[i : i + STRINGS])] for i in range(0, len(starts), STRINGS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def repeated_windows(data, value, far, near, ids, asker, pos, window: int) -> np.ndarray:
    """The bits of segments whose texts stand side by side in data; first places in order of (ids, asker, pos)."""
    length = far - near + window
    start = np.cumsum(length) - length
    text = Text(data, start, length)
    whole = mix(text.hashes(np.arange(len(value)), length) + (far * 64 + near).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    del text
    order = np.lexsort((pos, asker, ids, whole, value))
    new = np.ones(len(order), bool)
    new[1:] = (value[order[1:]] != value[order[:-1]]) | (whole[order[1:]] != whole[order[:-1]])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    copy, of = order[~new], head[~new]
    # Copies of a whole segment: all their windows stand earlier, once the bytes are verified.
    for i in range(0, len(copy), STRINGS):
        c, o = copy[i : i + STRINGS], of[i : i + STRINGS]
        if not (np.array_equal(length[c], length[o]) and np.array_equal(data[span_places(start[c], length[c])], data[span_places(start[o], length[o])])):
            raise RuntimeError("two segments share a hash")
    mask = np.zeros(len(value), np.uint64)
    mask[copy] = ~U(0) >> (U(63) - (far - near)[copy].astype(np.uint64))
    # Segments that differ, by anchor.
    kept = order[new]
    _, group, count = np.unique(value[kept], return_inverse=True, return_counts=True)
    some = kept[count[group] > 1]
    if len(some):
        _, group = np.unique(value[some], return_inverse=True)
        place = np.lexsort((pos[some], asker[some], ids[some]))
        turn = np.empty(len(some), np.int64)
        turn[place] = np.arange(len(some))
        ahead = common_classes(data, start[some] + far[some], length[some] - far[some], group)
        behind = common_classes(data[::-1], len(data) - start[some] - far[some], far[some], group)
        for d in range(int(near[some].min()), int(far[some].max()) + 1):
            there = np.flatnonzero((near[some] <= d) & (d <= far[some]))
            key = ahead(window - d)[there] * len(some) + behind(d)[there]
            by = np.lexsort((turn[there], key))
            again = there[by[1:][key[by[1:]] == key[by[:-1]]]]
            mask[some[again]] |= U(1) << (far[some[again]] - d).astype(np.uint64)
    return mask


def common_classes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray):
    """A function from a length to numbers that are equal for strings of a group that share so many first bytes."""
    text = Text(gathered(data, starts, lengths), np.cumsum(lengths) - lengths, lengths)
    order = text.sort(group)
    shared = text.neighbours(order, group)

    def classes(k: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum((shared < k) | (shared < 0)) - 1
        return out

    return classes


def removed(block: Block, had: list[list[np.ndarray]], window: int) -> np.ndarray:
    """Which bytes of the block are covered by a string that also stands earlier."""
    found = LookedUp(block, had[0], window)
    seg = found.cold
    # A segment that the block has had before stands earlier with all its windows.
    mask = ~U(0) >> (U(63) - (seg.hi - seg.lo).astype(np.uint64))
    if len(found.first):
        mask[found.first] = had[1][0]
    start = np.zeros(len(block.data) + 1, np.int64)
    for w in range(64):
        start[seg.lo[(mask >> U(w) & U(1)).astype(bool)] + w] = 1
    if len(found.place):
        start[found.place[~(had[2][0][found.back] & (found.head[found.back] == found.place))]] = 1
    total = np.cumsum(start[:-1])
    total[window:] -= total[:-window].copy()
    return total > 0


class Searched:
    """A corpus whose repeated strings have been found."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None):
        self.window = window
        self.corpus = store(docs, BLOCK_BYTES, id_col, text_col, row_col)
        repeats = exchange(self.corpus, BlockRepeats(window), factor=SHARDS)
        self.answers = [repeats, exchange(self.corpus, AskSegments(window), [repeats], SHARDS)]
        if summed_stats(repeats, 1)[0]:
            self.answers.append(exchange(self.corpus, AskStrings(window), [repeats], SHARDS))

    def rows(self, fn, fields: str, schema: pa.Schema) -> DataFrame:
        """fn(block, mask of removed bytes) for each block."""
        window = self.window
        return over_blocks(self.corpus, self.answers, per_block(lambda block, had: fn(block, removed(block, had, window)), schema), fields)


def kept_bytes(block: Block, gone: np.ndarray) -> list[bytes]:
    keep = ~gone
    raw, at = block.data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[block.bounds].tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def report(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def fn(block: Block, gone: np.ndarray):
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = block.bounds[1:-1]
        inner = inner[inner < len(gone)]
        begins[inner] = gone[inner]
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.bounds])
        return block.ids, np.diff(block.bounds), count(gone), count(begins), [hashlib.sha256(t).hexdigest() for t in kept_bytes(block, gone)]

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    out = Searched(docs, window, id_col, text_col).rows(fn, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", schema)
    return out.withColumn("doc_id", null_id(F.col("doc_id")))


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with what is left of every text; bytes of a character that was cut in part are replaced. Null texts are empty. Rows are told apart by numbers of their own."""
    held, row = with_rows(docs)
    new = fresh("kept_text", held.columns)

    def fn(block: Block, gone: np.ndarray):
        return block.rows, [t.decode("utf-8", "replace") for t in kept_bytes(block, gone)]

    left = Searched(held, window, id_col, text_col, row).rows(fn, f"`{row}` long, `{new}` string", pa.schema([(row, pa.int64()), (new, pa.string())]))
    return held.join(left, row).select(*[F.col(new).alias(c) if c == text_col else held[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS f FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS e FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM b) GROUP BY doc_id, k),
t AS (SELECT doc_id, a, e, coalesce(lag(e) OVER w, 0) AS p, lead(a) OVER w AS nx FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
x AS (SELECT doc_id, sum(e - a + 1)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - 1 - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""
