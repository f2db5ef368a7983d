"""Substring dedup by relative Lempel-Ziv factors over words.

The reference is the corpus itself, in blocks. A run of 20 words is a possible factor start; an index over hash shards keeps of each
run its first place (smallest document id, then position). Each document's runs are looked up there, which gives every reference
block that can hold a factor; the words at those places are fetched in cells from the blocks that have them. A document is then
parsed from left to right: where a run stands earlier, the factor is extended greedily, word by word compared, as far as
document and reference agree. Every factor of 20 words or more is a duplicate span. Parsing goes on at the first run that the factor
doesn't hold whole, so that runs over factor boundaries are checked like all others and nothing is missed there. Hashes only
propose places; no word is removed that wasn't compared.

To keep the exchange small, a run is looked up only if its minimizer (the smallest of its 13 hashes of 8 words) occurs twice
in the corpus, which it must if the run does.

Defined results: null and empty texts have no words; null ids come before all others and stay null; of rows with equal ids
the one stored first comes first; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NOT_SPACE, distinct, fresh, null_id, span_places, window_hashes, with_rows, word_hashes, written
from lectern.llm.exchange import Batch, Block, Firsts, Repeats, exchange, expand, over_blocks, pack, per_block, sliding_argmin, squeeze, starts_within, store, unpack

WINDOW = 20
#: Words whose hashes a minimizer is chosen from.
SEED = 8
BLOCK_BYTES = 3 << 20
#: Words that are fetched together.
CELL = 64


class Runs:
    """Word spans of a block; starts of all runs; place and value of the minimizer of each, and its hash."""

    def __init__(self, block: Block, window: int):
        self.start, self.end, self.first = block.words(NOT_SPACE)
        self.at = starts_within(self.first, window)
        self.anchor, self.least, self.whole = self.at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(self.at):
            h = word_hashes(block.data, self.start, self.end)
            seed = min(SEED, window)
            seeds = window_hashes(h, seed)
            self.anchor = sliding_argmin(seeds, window - seed + 1)[self.at]
            self.least, self.whole = seeds[self.anchor], window_hashes(h, window)[self.at]

    def minimizers(self) -> np.ndarray:
        """One for each place."""
        return self.least[np.flatnonzero(np.diff(self.anchor, prepend=-1))]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


class LookedUp(Runs):
    """Of the runs whose minimizers occur twice: starts (place), distinct hashes, the first run of each hash, and the number of each run's."""

    def __init__(self, block: Block, repeats: list[np.ndarray], window: int):
        super().__init__(block, window)
        some = np.zeros(0, np.int64)
        if len(self.at):
            back = np.unique(np.concatenate([self.minimizers(), self.least]), return_inverse=True)[1][-len(self.at) :]
            some = np.flatnonzero(repeats[0][back] > 0)
        self.place = self.at[some]
        self.hashes, self.head, self.back = np.unique(self.whole[some], return_index=True, return_inverse=True)


class RunFirsts(Firsts):
    """Question: the first place of each of a block's runs."""

    def __init__(self, window: int):
        self.window = window

    def ask(self, block, had):
        found = LookedUp(block, had[0], self.window)
        place = found.place[found.head]
        return Batch(found.hashes, [block.ids[found.document(place)], place.astype(np.uint32)])


class Sources(LookedUp):
    """For each run looked up, where it stands first: id, block and word there; again: it stands there earlier."""

    def __init__(self, block: Block, repeats, firsts, window: int):
        super().__init__(block, repeats, window)
        own, ids, blocks, words = firsts or [np.zeros(0, bool), *[np.zeros(0, np.int64)] * 3]
        head = self.place[self.head][self.back]
        local = own[self.back]
        self.block = np.where(local, block.block, blocks[self.back])
        self.word = np.where(local, head, words[self.back].astype(np.int64))
        self.id = np.where(local, block.ids[self.document(head)] if len(head) else head, ids[self.back])
        self.again = ~(local & (head == self.place))

    def cells(self, mine: int, window: int) -> dict[int, np.ndarray]:
        """For each other block, the cells of its words that runs of this one stand in."""
        k = np.flatnonzero(self.again & (self.block != mine))
        out = {}
        order = k[np.argsort(self.block[k], kind="stable")]
        cuts = np.append(np.flatnonzero(np.diff(self.block[order], prepend=-1)), len(order)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            w = self.word[order[a:b]]
            low, high = w // CELL, (w + window - 1) // CELL
            out[int(self.block[order[a]])] = distinct(span_places(low, high - low + 1))
        return out


class Reference:
    """Words of reference blocks: this one's, and cells of others."""

    def __init__(self, block: Block, found: Runs, fetched: list[dict] | None):
        self.own, self.found, self.data = block.block, found, block.data.tobytes()
        self.cells: dict[tuple[int, int], list[bytes]] = {}
        self.documents: dict[int, np.ndarray] = {}
        starts: dict[int, list[np.ndarray]] = {}
        for x in fetched or ():
            self.cells[x["source"], x["cell"]] = expand(x["words"]).split(b" ")
            starts.setdefault(x["source"], []).append(unpack(x["starts"]))
        for b, parts in starts.items():
            self.documents[b] = distinct(np.concatenate(parts))

    def mine(self, a: int, b: int) -> list[bytes]:
        """Words a to b of this block."""
        s, e = self.found.start[a:b].tolist(), self.found.end[a:b].tolist()
        return [self.data[i:j] for i, j in zip(s, e, strict=True)]

    def start(self, block: int, word: int) -> int:
        """First word of the document that a word is in."""
        firsts = self.found.first if block == self.own else self.documents.get(block, np.zeros(1, np.int64))
        return int(firsts[np.searchsorted(firsts, word, side="right") - 1])

    def stop(self, block: int, word: int) -> int:
        """End of the document that a word is in, if it is known to end."""
        firsts = self.found.first if block == self.own else self.documents.get(block, np.zeros(0, np.int64))
        k = int(np.searchsorted(firsts, word, side="right"))
        return int(firsts[k]) if k < len(firsts) else 1 << 62

    def words(self, block: int, word: int, n: int) -> list[bytes]:
        """At most n words from one on, as far as they were fetched."""
        if block == self.own:
            return self.mine(word, word + n)
        stop, out = word + n, []
        while word < stop:
            cell = self.cells.get((block, word // CELL))
            if cell is None or word % CELL >= len(cell):
                break
            part = cell[word % CELL : word % CELL + stop - word]
            out += part
            word += len(part)
        return out

    def extend(self, mine: list[bytes], k: int, block: int, word: int) -> int:
        """How many words from mine[k] on agree with those of a block from `word` on, inside that document."""
        most = min(len(mine) - k, self.stop(block, word) - word)
        length, step = 0, 64
        while length < most:
            there = self.words(block, word + length, min(step, most - length))
            same = agreement(mine[k + length : k + length + len(there)], there)
            length += same
            if same < len(there) or not there:
                break
            step *= 2
        return length


def agreement(a: list[bytes], b: list[bytes]) -> int:
    """How many first words two lists have in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


Factor = tuple[int, int, int, int, int]


def parse(block: Block, found: Sources, fetched, window: int) -> list[Factor]:
    """Factors of the block's documents: (first word, words, source's id, its block, its first word), greedily from left to right."""
    again = np.flatnonzero(found.again)
    if not len(again):
        return []
    reference = Reference(block, found, fetched)
    place = found.place[again]
    document = found.document(place)
    cuts = np.append(np.flatnonzero((np.diff(place, prepend=-9) != 1) | (np.diff(document, prepend=-1) != 0)), len(place)).tolist()
    blocks, words, ids = found.block[again].tolist(), found.word[again].tolist(), found.id[again].tolist()
    out: list[Factor] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # runs that follow one another, all of them earlier somewhere
        first, n = int(place[a]), b - a
        mine = reference.mine(first, first + n + window - 1)
        k = 0
        while k < n:
            length = reference.extend(mine, k, blocks[a + k], words[a + k])
            if length < window:
                k += 1
                continue
            out.append((first + k, length, ids[a + k], blocks[a + k], words[a + k]))
            k += length - window + 1
    return out


def covered(n_words: int, factors: list[Factor]) -> np.ndarray:
    """Which words lie in factors."""
    edge = np.zeros(n_words + 1, np.int64)
    if factors:
        at, length = np.array([f[0] for f in factors]), np.array([f[1] for f in factors])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n_words]) > 0


class Parsed:
    """A corpus whose runs have been looked up, and of which each block has the reference words that its runs stand in."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None):
        self.window = window
        self.corpus = store(docs, BLOCK_BYTES, id_col, text_col, row_col)
        repeats = exchange(self.corpus, Repeats(lambda block: Runs(block, window).minimizers()))
        firsts = exchange(self.corpus, RunFirsts(window), [repeats])
        self.answers = [repeats, firsts]
        self.fetched = self.fetch()

    def fetch(self) -> DataFrame:
        """(block, extra: cells of other blocks), each cell cut once by the block that has it, however many need it."""
        window = self.window

        def needs(block: Block, had) -> Iterator[pa.RecordBatch]:
            for source, cells in Sources(block, *had, window).cells(block.block, window).items():
                n = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array([block.block] * n, pa.int64()), pa.array([source] * n, pa.int64()), pa.array(cells, pa.int32())], names=["block", "source", "cell"])

        def cut(block: Block, had, extra) -> Iterator[pa.RecordBatch]:
            if not extra:
                return
            start, end, first = block.words(NOT_SPACE)
            data, cells = block.data.tobytes(), sorted(extra)
            texts, starts = [], []
            for c in cells:
                a, b = c * CELL, min(c * CELL + CELL, len(start))
                texts.append(squeeze(b" ".join([data[i:j] for i, j in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])))
                starts.append(pack(first[np.searchsorted(first, a, side="right") - 1 : np.searchsorted(first, b)]))
            yield pa.RecordBatch.from_arrays([pa.array([block.block] * len(cells), pa.int64()), pa.array(cells, pa.int32()), pa.array(texts, pa.binary()), pa.array(starts, pa.binary())], names=["source", "cell", "words", "starts"])

        wanted = written(over_blocks(self.corpus, self.answers, needs, "block long, source long, cell int"), "wanted")
        once = wanted.select("source", "cell").distinct().groupBy(F.col("source").alias("block")).agg(F.collect_list("cell").alias("extra"))
        cells = over_blocks(self.corpus, [], cut, "source long, cell int, words binary, starts binary", once)
        return wanted.join(cells, ["source", "cell"]).groupBy("block").agg(F.collect_list(F.struct("source", "cell", "words", "starts")).alias("extra"))

    def rows(self, fn, fields: str, schema: pa.Schema) -> DataFrame:
        """fn(block, runs, factors, reference) for each block."""
        window = self.window

        def run(block: Block, had, fetched):
            found = Sources(block, *had, window)
            return fn(block, found, parse(block, found, fetched, window), fetched)

        return over_blocks(self.corpus, self.answers, per_block(run, schema), fields, self.fetched)


def per_row(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def kept_words(block: Block, runs: Runs, mask: np.ndarray) -> list[bytes]:
    """Words outside of factors, one space between them, for each document."""
    raw = block.data.tobytes()
    keep = np.flatnonzero(~mask)
    cuts = np.searchsorted(keep, runs.first)
    s, e = runs.start[keep].tolist(), runs.end[keep].tolist()
    return [b" ".join([raw[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def kept_text(block: Block, runs: Runs, mask: np.ndarray, k: int) -> bytes:
    """Text k without factors: a factor goes with the white space behind it, or at the text's end with that before it; all else stays as it is."""
    raw = block.data[block.bounds[k] : block.bounds[k + 1]].tobytes()
    a, b = int(runs.first[k]), int(runs.first[k + 1])
    s, e = (runs.start[a:b] - block.bounds[k]).tolist(), (runs.end[a:b] - block.bounds[k]).tolist()
    gone = mask[a:b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        last = j == b - a
        out.append(raw[at : (e[i - 1] if i else 0) if last else s[i]])
        at = len(raw) if last else s[j]
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def fn(block, runs, factors, _):
        mask = covered(len(runs.start), factors)
        return block.ids, np.diff(runs.first), per_row(mask, runs.first), [hashlib.sha256(t).hexdigest() for t in kept_words(block, runs, mask)]

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    out = Parsed(docs, window, id_col, text_col).rows(fn, "doc_id long, n_words long, n_removed long, kept_sha256 string", schema)
    return out.withColumn("doc_id", null_id(F.col("doc_id")))


def factors(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, words, source_id, source_start of every factor, in words."""

    def fn(block, runs, found, fetched):
        reference = Reference(block, runs, fetched)
        at, n, ids, blocks, words = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 5))
        document = runs.document(at)
        source = [w - reference.start(b, w) for b, w in zip(blocks.tolist(), words.tolist(), strict=True)]
        return block.ids[document], at - runs.first[document], n, ids, source

    names = ["doc_id", "start", "words", "source_id", "source_start"]
    out = Parsed(docs, window, id_col, text_col).rows(fn, ", ".join(f"{n} long" for n in names), pa.schema([(n, pa.int64()) for n in names]))
    return out.withColumn("doc_id", null_id(F.col("doc_id"))).withColumn("source_id", null_id(F.col("source_id")))


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with duplicate spans cut out of their texts, line breaks and spaces elsewhere kept; documents that lose no word keep theirs byte for byte.

    A document of which no word is left goes. Rows are told apart by numbers of their own, so that ids may be null or
    repeat: a repeated row is cut like any other later text, and one of its kind stays whole.
    """
    held, row = with_rows(docs)
    new = fresh("kept_text", held.columns)

    def fn(block, runs, factors, _):
        mask = covered(len(runs.start), factors)
        lost = per_row(mask, runs.first)
        changed = np.flatnonzero(lost > 0)
        left = np.diff(runs.first) - lost
        return block.rows[changed], [kept_text(block, runs, mask, k).decode("utf-8", "replace") if left[k] else "" for k in changed.tolist()]

    cut = Parsed(held, window, id_col, text_col, row).rows(fn, f"`{row}` long, `{new}` string", pa.schema([(row, pa.int64()), (new, pa.string())]))
    both = held.join(cut, row, "left")
    both = both.filter(F.col(new).isNull() | (F.col(new) != ""))
    return both.select(*[F.coalesce(F.col(new), held[c]).alias(c) if c == text_col else held[c] for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
x AS (SELECT doc_id, w, list(p) AS ps, count(*) AS n FROM c JOIN d USING (doc_id) GROUP BY doc_id, w),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS s FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) u
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = u.doc_id AND c.p = u.p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(x.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
