"""Blocks of documents, and questions that blocks ask of hash shards.

A corpus is stored once as blocks of a few MB of text, one row each. A block asks about hashes (windows,
n-grams) by sending each shard one blob of its distinct ones, sorted, with what belongs to them; a shard sees the blobs of
all blocks and answers each in the same order, and the answers return to the blocks. Repeated hashes cross the network
once per block, whatever their counts, and no task holds more than a shard or a block.

The number of shards follows the bytes of text, so that blobs, one for each block and shard, would grow with its square. From
DIRECT_SHARDS shards on, blocks therefore send to ranges of shards, about as many as the root of the shards' number. A router
takes what a group of as many blocks sends to one range, folds equal hashes, and asks the range's shards for the whole group; answers
come back the same way. A hash that all blocks hold thus reaches its shard once for each group. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import U, bounded_batches, buffers, discard, span_places, texts, words, written

#: Text for which one shard is made.
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 12
#: More shards than these are asked through routers.
DIRECT_SHARDS = 1024
#: Shards are dealt to at most so many tasks, which work through theirs one by one.
MOST_TASKS = 20_000

_packer, _opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(raw: bytes) -> bytes:
    return _packer.compress(raw)


def expand(raw: bytes) -> bytes:
    return _opener.decompress(raw)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, those of one place together, behind a letter for their kind."""
    values = np.ascontiguousarray(values)
    kind = values.dtype.char.encode()
    if not len(values):
        return kind
    if kind == b"?":
        return kind + len(values).to_bytes(8, "little") + squeeze(np.packbits(values).tobytes())
    return kind + squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:1].decode())
    if len(raw) == 1:
        return np.zeros(0, kind)
    if kind == bool:
        return np.unpackbits(np.frombuffer(expand(raw[9:]), np.uint8), count=int.from_bytes(raw[1:9], "little")).astype(bool)
    return np.ascontiguousarray(np.frombuffer(expand(raw[1:]), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


@dataclass
class Batch:
    """Rows by columns: keys (hashes, sorted in what a block asks), numbers, and texts side by side of given lengths if there are any."""

    keys: np.ndarray
    columns: list[np.ndarray]
    text: np.ndarray | None = None
    lengths: np.ndarray | None = None

    def part(self, a: int, b: int) -> Batch:
        if self.text is None:
            return Batch(self.keys[a:b], [c[a:b] for c in self.columns])
        at = np.concatenate([[0], np.cumsum(self.lengths[:b], dtype=np.int64)])
        return Batch(self.keys[a:b], [c[a:b] for c in self.columns], self.text[at[a] : at[b]], self.lengths[a:b])

    def at(self, places: np.ndarray) -> Batch:
        columns = [c[places] for c in self.columns]
        if self.text is None:
            return Batch(self.keys[places], columns)
        start = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        n = self.lengths[places]
        return Batch(self.keys[places], columns, self.text[span_places(start[places], n.astype(np.int64))], n)

    def blobs(self) -> list[bytes]:
        step = np.diff(self.keys, prepend=self.keys[:1] * U(0)) if len(self.keys) else self.keys
        out = [pack(step), *map(pack, self.columns)]
        return out if self.text is None else [b"t", *out, pack(self.lengths), squeeze(self.text.tobytes())]

    @staticmethod
    def of(blobs: list[bytes]) -> Batch:
        text = lengths = None
        if blobs[0] == b"t":
            lengths, text = unpack(blobs[-2]), np.frombuffer(expand(blobs[-1]), np.uint8)
            blobs = blobs[1:-2]
        return Batch(np.cumsum(unpack(blobs[0]), dtype=np.uint64), [unpack(b) for b in blobs[1:]], text, lengths)

    @staticmethod
    def joined(parts: list[Batch]) -> Batch:
        cols = [np.concatenate(c) for c in zip(*[p.columns for p in parts], strict=True)]
        if parts[0].text is None:
            return Batch(np.concatenate([p.keys for p in parts]), cols)
        return Batch(np.concatenate([p.keys for p in parts]), cols, np.concatenate([p.text for p in parts]), np.concatenate([p.lengths for p in parts]))


class Question:
    """What blocks ask of shards. Answers and folded columns stand in the order of the rows that they belong to.

    ask(block, had): a Batch of distinct keys, sorted. answer(batch, who): columns for the rows that all blocks sent to a shard, and
    numbers to be summed over shards; who: the block of each row, or its group of blocks. fold(batch, who): for routers, the rows with one for each
    key, and what unfold(columns, folded) needs to give each row that was folded its answer; None if rows can't be folded.
    """

    def ask(self, block: Block, had: list[list[np.ndarray]]) -> Batch:
        raise NotImplementedError

    def answer(self, batch: Batch, who: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        raise NotImplementedError

    def fold(self, batch: Batch, who: np.ndarray):
        return None

    def unfold(self, columns: list[np.ndarray], folded) -> list[np.ndarray]:
        raise NotImplementedError


@dataclass
class Corpus:
    """blocks: block, ids, lengths, data (compressed), rows; shards: how many there are; size: blocks."""

    blocks: DataFrame
    shards: int
    size: int


@dataclass
class Block:
    """One block's rows in order of their ids: ids, bytes of all texts, and each text's bounds; rows: their numbers, if stored."""

    block: int
    ids: np.ndarray
    data: np.ndarray
    bounds: np.ndarray
    rows: np.ndarray | None = None

    def words(self, member) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.bounds, member)


def store(docs: DataFrame, block_bytes: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> Corpus:
    """Write docs as blocks of about block_bytes of text; a longer text is a block of its own. row_col: a column of row numbers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = texts(docs, id_col, text_col, [row_col] if row_col else [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            order = sorted(range(len(held)), key=lambda k: held[k][0])
            ids = np.array([held[k][0] for k in order], np.int64)
            parts = [held[k][1] for k in order]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            rows = pack(np.array([held[k][2] for k in order], np.int64)) if row_col else None
            cols = [[block], [pack(ids)], [pack(lengths)], [squeeze(b"".join(parts))], [rows], [int(lengths.sum())]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:5]], pa.array(cols[5], pa.int64())], names=["block", "ids", "lengths", "data", "rows", "bytes"])

        for b in batches:
            if not b.num_rows:
                continue
            data, off = buffers(b.column(1))
            ids = b.column(0).to_pylist()
            rows = b.column(2).to_pylist() if row_col else ids
            raw = data[off[0] : off[-1]].tobytes()
            off = (off - off[0]).tolist()
            for k, i in enumerate(ids):
                n = off[k + 1] - off[k]
                if held and size + n > block_bytes:
                    yield out()
                    block, held, size = block + 1, [], 0
                held.append((i, raw[off[k] : off[k + 1]], rows[k]))
                size += n
        if held:
            yield out()

    blocks = written(plain.mapInArrow(run, "block long, ids binary, lengths binary, data binary, rows binary, bytes long"), "blocks", "uncompressed")
    total, size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    return Corpus(blocks.drop("bytes"), max(LEAST_SHARDS, -(-total // SHARD_BYTES)), size)


def opened(block: int, ids: bytes, lengths: bytes, data: bytes, rows: bytes | None) -> Block:
    n = unpack(lengths)
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    return Block(block, unpack(ids), np.frombuffer(expand(data), np.uint8), bounds, None if rows is None else unpack(rows))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """By the high bits, so that sorted hashes stand in order of their shards."""
    return ((hashes >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def parts_of(batch: Batch, where: np.ndarray) -> Iterator[tuple[int, Batch]]:
    """Parts of a batch whose rows go to one place each; where: rising."""
    if len(where):
        cuts = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(where))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(where[a]), batch.part(a, b)


def told(replies: list[dict] | None) -> list[np.ndarray]:
    """Columns of answers, those of all shards one after another: in order of the keys asked for. [] if none were."""
    got = [[unpack(b) for b in x["reply"]] for x in sorted(replies or (), key=lambda x: x["dest"])]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else []


def by_block(answers: list[DataFrame]) -> DataFrame:
    """(block, replies) of several tables of answers, told apart by `kind`."""
    tagged = [a.select("block", F.lit(k).alias("kind"), "dest", "reply") for k, a in enumerate(answers)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return every.groupBy("block").agg(F.collect_list(F.struct("kind", "dest", "reply")).alias("replies"))


def over_blocks(corpus: Corpus, answers: list[DataFrame], fn: Callable, fields: str, more: DataFrame | None = None) -> DataFrame:
    """Rows that fn(block, had) yields as record batches. had: columns of each table of answers, in order of the keys asked.

    more: a table (block, extra) whose extra is given as a third argument.
    """
    rows, n = corpus.blocks, len(answers)
    bounded_batches(rows.sparkSession)
    if n:
        rows = rows.join(by_block(answers), "block", "left")
    extra = more is not None
    if extra:
        rows = rows.join(more, "block", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                block = opened(*[b.column(c)[k].as_py() for c in range(5)])
                got = (b.column(5)[k].as_py() or []) if n else []
                had = [told([x for x in got if x["kind"] == i]) for i in range(n)]
                yield from fn(block, had, *([b.column(5 + bool(n))[k].as_py()] if extra else []))

    return rows.mapInArrow(run, fields)


def per_block(fn: Callable, schema: pa.Schema) -> Callable:
    """For over_blocks: fn gives one list of arrays for each block."""

    def run(*args) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(fn(*args), schema, strict=True)], names=schema.names)

    return run


def _sent(who: int, parts: list[tuple[int, Batch]], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([who] * len(parts), pa.int64()), pa.array([s for s, _ in parts], pa.int32()), pa.array([p.blobs() for _, p in parts], pa.list_(pa.binary()))], names=[*names, "payload"]
    )


def _replies(columns: list[np.ndarray], sizes: list[int]) -> list[list[bytes]]:
    cuts = np.cumsum([0, *sizes]).tolist()
    return [[pack(c[a:b]) for c in columns] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _opened(table: pa.Table, by: str) -> tuple[list, list[Batch]]:
    """Payloads of a table's rows in order of a column, and that column."""
    keys = table.column(by).to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    payloads = table.column("payload")
    return [keys[k] for k in order], [Batch.of(payloads[k].as_py()) for k in order]


def _answered(asked: DataFrame, question: Question, shards: int) -> DataFrame:
    """(who, dest, reply, stats) from (who, dest, payload): each task has its own shards and takes them one by one."""
    tasks = min(shards, MOST_TASKS)

    def run(table: pa.Table) -> pa.Table:
        who, parts = _opened(table, "who")
        sizes = [len(p.keys) for p in parts]
        columns, stats = question.answer(Batch.joined(parts), np.repeat(np.array(who, np.int64), sizes))
        n = len(who)
        return pa.table({"who": pa.array(who, pa.int64()), "dest": pa.array([table.column("dest")[0].as_py()] * n, pa.int32()), "reply": pa.array(_replies(columns, sizes), pa.list_(pa.binary())), "stats": pa.array([stats] + [None] * (n - 1), pa.list_(pa.int64()))})

    dealt = asked.withColumn("task", (F.col("dest").cast("long") * tasks / shards).cast("int")).repartitionById(tasks, F.col("task"))
    return dealt.groupBy("task", "dest").applyInArrow(run, "who long, dest int, reply array<binary>, stats array<bigint>")


def exchange(corpus: Corpus, question: Question, answers: list[DataFrame] | None = None, factor: int = 1) -> DataFrame:
    """(block, dest, reply, stats), written: what shards answer to each block. answers: earlier ones, which question.ask is told; factor: more shards."""
    shards = factor * corpus.shards
    ranges = 0 if shards <= DIRECT_SHARDS else int(np.ceil(shards**0.5))
    range_of = lambda keys: shard_of(keys, shards) * ranges // shards
    groups = max(1, corpus.size // ranges) if ranges else 0

    def fn(block: Block, had) -> Iterator[pa.RecordBatch]:
        batch = question.ask(block, had)
        parts = list(parts_of(batch, range_of(batch.keys) if ranges else shard_of(batch.keys, shards)))
        if parts:
            yield _sent(block.block, parts, ("who", "dest"))

    asked = over_blocks(corpus, answers or [], fn, "who long, dest int, payload array<binary>")
    if not ranges:
        return written(_answered(asked, question, shards).withColumnRenamed("who", "block"), "answers", "uncompressed")

    def merged(table: pa.Table):
        """A router's rows sorted by key, folded if they can be: (batch, who, place of each row among those sorted, folded, blocks, sizes)."""
        who, parts = _opened(table, "block")
        sizes = [len(p.keys) for p in parts]
        batch, of = Batch.joined(parts), np.repeat(np.array(who, np.int64), sizes)
        order = np.argsort(batch.keys, kind="stable")
        batch, of = batch.at(order), of[order]
        return batch, of, order, question.fold(batch, of), who, sizes

    def route(table: pa.Table) -> pa.Table:
        batch, of, _, folded, *_ = merged(table)
        if folded is not None:
            batch, of = folded[0], folded[1]
        batch.columns.append(of)
        sent = _sent(table.column("router")[0].as_py(), list(parts_of(batch, shard_of(batch.keys, shards))), ("who", "dest"))
        return pa.Table.from_batches([sent])

    def back(table: pa.Table) -> pa.Table:
        own = pa.compute.is_valid(table.column("payload"))
        _, _, order, folded, who, sizes = merged(table.filter(own))
        replies = table.filter(pa.compute.invert(own))
        columns = told(replies.select(["dest", "reply"]).to_pylist())
        if folded is not None:
            columns = question.unfold(columns, folded[2])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        stats = [x for x in replies.column("stats").to_pylist() if x]
        total = [sum(x) for x in zip(*stats, strict=True)] if stats else None
        n = len(who)
        return pa.table({"block": pa.array(who, pa.int64()), "dest": pa.array([table.column("router")[0].as_py() % ranges] * n, pa.int32()), "reply": pa.array(_replies([c[place] for c in columns], sizes), pa.list_(pa.binary())), "stats": pa.array([total] + [None] * (n - 1), pa.list_(pa.int64()))})

    class Routed(Question):
        """The same question, where rows say in a last column which block they are from."""

        def answer(self, batch: Batch, who: np.ndarray):
            return question.answer(Batch(batch.keys, batch.columns[:-1], batch.text, batch.lengths), batch.columns[-1])

    group = F.pmod(F.xxhash64("who"), F.lit(groups))
    asked = written(asked.select((group * ranges + F.col("dest")).alias("router"), F.col("who").alias("block"), "payload"), "asked", "uncompressed")
    routed = asked.groupBy("router").applyInArrow(route, "who long, dest int, payload array<binary>")
    replies = written(_answered(routed, Routed(), shards), "replies", "uncompressed")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    mine = asked.select("router", "block", "payload", none("int", "dest"), none("array<binary>", "reply"), none("array<bigint>", "stats"))
    theirs = replies.select(F.col("who").alias("router"), none("long", "block"), none("array<binary>", "payload"), "dest", "reply", "stats")
    out = written(mine.unionByName(theirs).groupBy("router").applyInArrow(back, "block long, dest int, reply array<binary>, stats array<bigint>"), "answers", "uncompressed")
    discard(asked, replies)
    return out


def summed_stats(answers: DataFrame, n: int) -> list[int]:
    """The sums of the numbers that shards gave besides their answers."""
    row = answers.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)) for k in range(n)]).first()
    return [int(x) for x in row]


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least of every `width` values."""
    at, size = np.arange(len(x), dtype=np.int32), 1
    least = x
    join = lambda step: (least[:-step] <= least[step:], at[:-step], at[step:])
    while size < width:
        step = min(size, width - size)
        left, a, b = join(step)
        at = np.where(left, a, b)
        least = x[at]
        size += step
    return at


def starts_within(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of `size` items inside one row; first: each row's first item, and the end."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    to = np.cumsum(n)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(first[:-1] - (to - n), n)


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row's key among the distinct ones, in their order, and how many there are."""
    found, back = np.unique(keys, return_inverse=True)
    return back, len(found)


class Sums(Question):
    """Sums over all blocks of the numbers in a batch's columns, for each key."""

    def totals(self, batch: Batch) -> tuple[list[np.ndarray], np.ndarray]:
        back, n = groups_of(batch.keys)
        return [np.bincount(back, weights=c, minlength=n).astype(np.uint64) for c in batch.columns], back

    def answer(self, batch, who):
        totals, back = self.totals(batch)
        return [t[back] for t in totals], []

    def fold(self, batch, who):
        totals, back = self.totals(batch)
        first = np.unique(back, return_index=True)[1]
        return Batch(batch.keys[first], totals), who[first], back

    def unfold(self, columns, folded):
        return [c[folded] for c in columns]


class Repeats(Sums):
    """Which of a block's values also occur in another place, of this block or another: the first question of repeat searches.

    values_of(block): its values, repeats included; weights_of(block, values, distinct): a second count of each distinct one. Answers: 0: once,
    1: more often, 2: more often and with a second count beyond `hot`. A number besides: how many are 2.
    """

    def __init__(self, values_of: Callable[[Block], np.ndarray], weights_of: Callable | None = None, hot: int = 0):
        self.values_of, self.weights_of, self.hot = values_of, weights_of, hot

    def ask(self, block, had):
        values = self.values_of(block)
        distinct, counts = np.unique(values, return_counts=True)
        columns = [np.minimum(counts, 2).astype(np.uint8)]
        if self.weights_of:
            columns.append(self.weights_of(block, values, distinct).astype(np.uint32))
        return Batch(distinct, columns)

    def answer(self, batch, who):
        totals, back = self.totals(batch)
        state = (totals[0] > 1).astype(np.uint8)
        if self.weights_of:
            state += (state > 0) & (totals[1] > self.hot)
        return [state[back]], [int((state == 2).sum())]


class Firsts(Question):
    """The first place of each key over all blocks: columns are id and place in the block, first by (id, block, place).

    Answers: whether the block's own place is it (own), else its id, block and place; zeros where own.
    """

    @staticmethod
    def heads(batch: Batch, who: np.ndarray) -> np.ndarray:
        """For each row, the row that has its key's first place."""
        ids, at = batch.columns[:2]
        order = np.lexsort((at, who, ids, batch.keys))
        new = np.append(True, batch.keys[order[1:]] != batch.keys[order[:-1]]) if len(order) else np.zeros(0, bool)
        head = np.empty(len(order), np.int64)
        head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        return head

    def answer(self, batch, who):
        head = self.heads(batch, who)
        own = head == np.arange(len(head))
        ids, at = batch.columns[:2]
        return [own, *[np.where(own, 0, x[head]).astype(x.dtype) for x in (ids, who, at)]], []

    def fold(self, batch, who):
        head = self.heads(batch, who)
        first = np.flatnonzero(head == np.arange(len(head)))
        first = first[np.argsort(batch.keys[first], kind="stable")]
        place = np.empty(len(head), np.int64)
        place[first] = np.arange(len(first))
        return batch.at(first), who[first], (place[head], head == np.arange(len(head)), [x[head] for x in (batch.columns[0], who, batch.columns[1])])

    def unfold(self, columns, folded):
        back, is_head, places = folded
        own = columns[0][back]
        mine = own & is_head
        source = [np.where(own, p, c[back]).astype(c.dtype) for p, c in zip(places, columns[1:], strict=True)]
        return [mine, *[np.where(mine, 0, s).astype(s.dtype) for s in source]]
