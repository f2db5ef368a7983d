"""Sum-of-squares packing of tokenised documents into windows of fixed length.

Windows that are partly filled are counted by their fill level in an array. A piece goes to the level,
or to a new window, whose choice makes the sum of squared counts least. A document longer than a window
fills whole windows first, and its rest is placed. In the end a task fills its fullest open windows with what stands in the emptiest,
cutting only the pieces moved, and the last tokens become windows of powers of two, which need no padding. Of 2,000 texts of the test tables
46 % of tokens are in open windows then and 0.8 % are moved, of 8,000 texts 11 % and 0.2 %.

A text is tokenised word by word: each distinct word is encoded once while it stays in a bounded cache. That is right only for
tokenizers that never join what white space parts; others are refused when they are loaded.

Defined results: null and empty texts are the end token alone; repeated rows are packed each;
ids may be null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import CHUNK, bounded_batches, buffers, distinct_words, offsets32, words

WINDOW = 4096
END = 2
#: Distinct words whose ids a worker keeps, at most (about 200 bytes each); then those met in one chunk only go.
CACHE_WORDS = 600_000
#: Words in one call of the tokenizer.
STEP = 20_000
#: Longer words are kept by their SHA-256, behind which stands a byte that no word has.
KEY_BYTES, KEY_TAG = 64, b" "


class WordIds:
    """Ids of each word of a text, by one tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        for probe in ("one two", "a  b", "x\ny\t.", " lead"):
            if encode(probe) != [i for w in probe.split() for i in encode(w)]:
                raise ValueError("this tokenizer doesn't part texts at white space first")
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}  # of words, or of the SHA-256 of longer ones
        self.starts, self.lengths, self.chunks = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def trim(self) -> None:
        """Forget words that one chunk had; all, if that leaves too many."""
        keep = np.flatnonzero(self.chunks > 1)
        if len(keep) > CACHE_WORDS // 2:
            self.clear()
            return
        size = self.lengths[keep].astype(np.int64)
        to = offsets32(size)
        self.pool = self.pool[np.repeat(self.starts[keep] - to[:-1], size) + np.arange(to[-1])]
        now = np.full(len(self.starts), -1)
        now[keep] = np.arange(len(keep))
        now = now.tolist()
        self.places = {k: now[p] for k, p in self.places.items() if now[p] >= 0}
        self.lengths, self.chunks = self.lengths[keep], np.ones(len(keep), np.int32)
        self.starts, self.used = to[:-1], int(to[-1])

    def add(self, keys: list[bytes], found: list[bytes]) -> None:
        """Encode words that aren't kept yet."""
        made = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in found], add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        total = int(sizes.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.int32, total)
        self.places.update(zip(keys, range(len(self.starts), len(self.starts) + len(keys)), strict=True))
        self.starts = np.append(self.starts, self.used + offsets32(sizes)[:-1])
        self.lengths = np.append(self.lengths, sizes)
        self.chunks = np.append(self.chunks, np.zeros(len(keys), np.int32))
        self.used += total

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, with the end token behind."""
        s, e, first = words(data, bounds)
        ends = np.full(1, END, np.int32)
        if not len(s):
            return [ends] * (len(bounds) - 1)
        back, found = distinct_words(data, s, e)
        keys = [w if len(w) <= KEY_BYTES else hashlib.sha256(w).digest() + KEY_TAG for w in found]
        if len(self.places) + len(keys) > CACHE_WORDS:
            self.trim()
        new = [k for k, key in enumerate(keys) if key not in self.places]
        for i in range(0, len(new), STEP):
            self.add([keys[k] for k in new[i : i + STEP]], [found[k] for k in new[i : i + STEP]])
        place = np.fromiter((self.places[k] for k in keys), np.int64, len(keys))
        self.chunks[place] += 1
        word = place[back]
        size = self.lengths[word].astype(np.int64)
        to = offsets32(size)
        # Each id's place in the pool: its word's start there, and its place in the word.
        ids = self.pool[np.repeat(self.starts[word] - to[:-1], size) + np.arange(to[-1])]
        cut = to[first]
        return [np.concatenate([ids[a:b], ends]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Packs what one task reads; sequence ids count up from `first`."""

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next = window, first
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level, the windows: lists of (row, start, ids, tokens)

    def level(self, size: int) -> int:
        """The level whose windows the piece joins, 0 for a new window: it makes the sum of squared counts least."""
        w, n = self.window, self.count
        change = np.full(w - size + 1, np.iinfo(np.int64).max)
        change[0] = 2 * n[size] + 1
        if size < w:
            down = 1 - 2 * n[1 : w - size + 1]
            up = 2 * n[size + 1 : w + 1] + 1
            up[-1] = 0  # a full window isn't counted any more
            change[1:] = np.where(n[1 : w - size + 1] > 0, down + up, change[1:])
        return len(change) - 1 - int(np.argmin(change[::-1]))  # of equal ones the fullest

    def close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for row, start, ids, tokens in pieces:
            yield row, start, len(ids), crc(ids), tokens, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, row, ids: np.ndarray) -> Iterator[tuple]:
        """Place a document; gives the pieces of windows that are full now."""
        w, n = self.window, len(ids)
        whole = n // w * w
        for i in range(0, whole, w):
            yield from self.close([(row, i, ids[i : i + w], n)])
        size = n - whole
        if not size:
            return
        at = self.level(size)
        pieces = self.open[at].pop() if at else []
        pieces.append((row, whole, ids[whole:].astype(np.uint32), n))
        if at:
            self.count[at] -= 1
        if at + size == w:
            yield from self.close(pieces)
        else:
            self.count[at + size] += 1
            self.open[at + size].append(pieces)

    def finish(self) -> Iterator[tuple]:
        """Fill the fullest open windows with pieces of the emptiest; the rest ends at powers of two."""
        left = [p for at in range(self.window - 1, 0, -1) for p in self.open[at]]
        fullest = 0
        while fullest < len(left):
            pieces = left[fullest]
            fullest += 1
            size = sum(len(x[2]) for x in pieces)
            while size < self.window and fullest < len(left):
                row, start, ids, tokens = left[-1].pop()
                room = self.window - size
                if len(ids) > room:
                    left[-1].append((row, start + room, ids[room:], tokens))
                    ids = ids[:room]
                elif not left[-1]:
                    left.pop()
                pieces.append((row, start, ids, tokens))
                size += len(ids)
            if size == self.window:
                yield from self.close(pieces)
            else:
                yield from self.close_rest(pieces, size)

    def close_rest(self, pieces: list, size: int) -> Iterator[tuple]:
        """The last pieces of a task, cut to windows of powers of two."""
        stream = pieces[::-1]
        for power in (1 << b for b in range(self.window.bit_length() - 1, -1, -1) if size >> b & 1):
            own, room = [], power
            while room:
                row, start, ids, tokens = stream.pop()
                if len(ids) > room:
                    stream.append((row, start + room, ids[room:], tokens))
                    ids = ids[:room]
                own.append((row, start, ids, tokens))
                room -= len(ids)
            yield from self.close(own)


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each file in a worker, kept from task to task."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def default_tokenizer() -> str:
    """Where the executor that asks has the tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | Callable[[], str] = default_tokenizer, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: a file's path, or a function that gives it on the executor. window: a power of two.
    Each task packs what it reads, so nothing is shuffled; its open windows are all that it holds.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(x, T.LongType()) for x in names]])

    def batch(kind, pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", *names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_ids(tokenizer if isinstance(tokenizer, str) else tokenizer())
        packer, kind = Packer(window, TaskContext.get().partitionId() << 40), pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            data, off = buffers(b.column(1))
            ids = b.column(0).to_pylist()
            i = 0
            while i < len(ids):
                j = min(len(ids), max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1))
                out = [x for row, doc in zip(ids[i:j], encode(data[off[i] : off[j]], off[i : j + 1] - off[i]), strict=True) for x in packer.add(row, doc)]
                if out:
                    yield batch(kind, out)
                i = j
        if out := list(packer.finish()):
            yield batch(kind, out)

    return rows.mapInArrow(run, schema)
