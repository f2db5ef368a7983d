"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a block stand as bit planes: plane b holds bit b of 64 documents in each machine word.
Shifting a plane against itself compares every document with the one s places on; a carry-save counter of
vertical bits adds the differing planes for 64 pairs at once, and a word of pairs is abandoned once all of
them exceed the radius. Blocks are made so that every pair within the radius meets in one: of four parts of
a 64-bit fingerprint at least two agree if at most two bits differ; blocks that are still large are parted
again by their remaining bits, which stays exact.

Inside a block only a spanning forest of its links is emitted, so no group's pairs are listed. Components
are found by alternating star contraction over tables, never on the driver.

For similarities far from one (drop_near_duplicates) fingerprints are wide and blocks are made of the rarest of a text's smallest shingle hashes.

Defined results: null and empty texts have fingerprint zero and are linked like any other; null ids count as the
smallest id and stay null; repeated rows share a component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, NULL_ID, U, bounded_batches, discard, distinct, mix, null_id, offsets32, over_texts, scratch, texts, window_hashes, with_rows, word_hashes, words, written

#: Shingles whose bits are counted in one step.
STEP = 1 << 15
#: A block of more rows is parted again.
BLOCK_ROWS = 2048
#: Rows of a block of wide fingerprints that a task compares at once; a larger block is compared by pairs of its parts.
SKETCH_ROWS = 16_384
#: Machine words of pairs compared in one step.
PAIR_WORDS = 8192
#: Pairs whose sets are compared before groups are joined by those that hold.
CHECKED = 1024
#: Machine words that the sets of a task's rows may take as bits; larger ones are compared pair by pair.
SET_WORDS = 1 << 24
#: Wide fingerprints, for similarities far from one.
WIDE_BITS = 1024
#: Smallest shingle hashes of a text that its blocks are chosen from.
SKETCH = 32
#: Similar texts share at least this part of them; see blocks_of_sketch.
SKETCH_SHARE = 0.375


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all runs of `size` words, or of the whole sequence if it has fewer; in steps."""
    ws = text.lower().split()
    if not ws:
        return
    joined = b" ".join(ws)
    at = offsets32(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    size = min(size, len(ws))
    starts, ends = at[: len(ws) - size + 1].tolist(), (at[size:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    for i in range(0, len(starts), STEP):
        yield np.array([h(joined[a:b], 42) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)], np.uint64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit fingerprint of a text; repeated shingles count each time."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        n += len(h)
        for i in range(0, len(h), 255):
            bits = np.unpackbits(h[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""

    def fn(data, bounds):
        raw = data.tobytes()
        return [np.array([fingerprint(raw[a:b], size) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.uint64).view(np.int64)]

    return over_texts(texts(docs, id_col, text_col), fn, "fp long", ["doc_id"])


def expand(h: np.ndarray, k: int) -> np.ndarray:
    """k independent 64-bit hashes of each hash."""
    salts = mix(np.arange(1, k + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return mix(h[:, None] ^ salts[None, :])


def wide_fingerprints(docs: DataFrame, size: int = 5, bits: int = WIDE_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary, sketch array<long>): of the set of shingles; sketch has the SKETCH smallest hashes."""

    def fn(data, bounds):
        data = LOWER[data]
        s, e, first = words(data, bounds)
        h = word_hashes(data, s, e)
        fps, sketches = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            shingles = distinct(window_hashes(h[a:b], min(size, b - a))) if b > a else np.zeros(0, np.uint64)
            sketches.append(shingles[:SKETCH].view(np.int64))
            fps.append(wide(shingles, bits).tobytes())
        return fps, sketches

    return over_texts(texts(docs, id_col, text_col), fn, "fp binary, sketch array<long>", ["doc_id"])


def wide(shingles: np.ndarray, bits: int) -> np.ndarray:
    counts, k = np.zeros(bits, np.int64), bits // 64
    for i in range(0, len(shingles), 255):
        cells = np.unpackbits(expand(shingles[i : i + 255], k).view(np.uint8), axis=1, bitorder="little")
        counts += cells.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view(np.uint64)


def radius(similarity: float, bits: int, deviations: float) -> int:
    """Bits that differ between sets of this Jaccard similarity, and so many standard deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    p = float(np.arccos(cosine) / np.pi)
    return int(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(n, k) words to (64k, words) bit planes, with two words of zeros behind."""
    n, k = fp.shape
    cells = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    out = np.zeros((64 * k, (n + 63) // 64 + 2), np.uint64)
    packed = np.packbits(cells.T, axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def as_words(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits) + 63) // 64, np.uint64)
    packed = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(packed)] = packed
    return out


def add_planes(counter: list[np.ndarray], planes: np.ndarray) -> np.ndarray:
    """Add 16 planes of bits to a vertical counter by carry-save adders; gives where it overflowed.

    Three words of one place become a sum and a carry, so that a place is touched once for each pair of planes.
    """
    width, over = len(counter), np.zeros(planes.shape[1], np.uint64)
    level = list(planes)
    for c in range(width):
        up = []
        for a, b in zip(level[::2], level[1::2], strict=False):
            half = counter[c] ^ a
            up.append((counter[c] & a) | (half & b))
            counter[c] = half ^ b
        if len(level) % 2:
            up.append(counter[c] & level[-1])
            counter[c] = counter[c] ^ level[-1]
        level = up
    for carry in level:
        over |= carry
    return over


def close_pairs(planes: np.ndarray, shifts: np.ndarray, wanted: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows i with wanted[k][i] for a shift, and at most `most` bits differing from row j = i + shift.

    All shifts are compared at once, 64 pairs in each word.
    """
    masks = [as_words(w) for w in wanted]
    at = [np.flatnonzero(m) for m in masks]
    alive = np.concatenate([m[a] for m, a in zip(masks, at, strict=True)])
    shift = np.repeat(shifts, [len(a) for a in at])
    at = np.concatenate(at)
    width = int(most).bit_length()
    start = (1 << width) - 1 - most  # so that the counter overflows once over `most`
    counter = [np.full(len(at), ~U(0) if start >> b & 1 else U(0)) for b in range(width)]
    for b in range(0, len(planes), 16):
        if not len(at):
            break
        q, r = shift >> 6, (shift & 63).astype(np.uint64)
        part = planes[b : b + 16]
        ahead = np.where(r > 0, part[:, at + q + 1] << ((U(64) - r) & U(63)), U(0))
        differ = part[:, at] ^ ((part[:, at + q] >> r) | ahead)
        alive = alive & ~add_planes(counter, differ)
        live = alive != 0
        if live.sum() < 0.7 * len(live):  # words of pairs that are all beyond the radius are abandoned
            at, alive, shift = at[live], alive[live], shift[live]
            counter = [c[live] for c in counter]
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, k = np.nonzero(bits)
    i = at[w] * 64 + k
    return i, i + shift[w]


def joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Groups with the pairs' groups united, and the pairs that did it, earlier pairs first."""
    found = []
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        hooked, at = np.unique(high, return_index=True)
        parent[hooked] = low[at]
        found.append(np.stack([i[at], j[at]]))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent, found


def steps(keys: np.ndarray, planes: np.ndarray, parent: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows with equal keys and different groups, at most `most` bits apart, many shifts at a time.

    Rows with equal keys stand together. parent may be changed in place between two steps.
    """
    ends = np.flatnonzero(np.diff(keys)) + 1
    longest = int(np.diff(np.concatenate([[0], ends, [len(keys)]])).max()) if len(keys) else 0
    held, words_held = ([], []), 0
    for shift in range(1, longest):
        if shift % 64 == 0 and not ((keys[1:] == keys[:-1]) & (parent[1:] != parent[:-1])).any():
            break  # each block is one group
        same = (keys[:-shift] == keys[shift:]) & (parent[:-shift] != parent[shift:])
        if same.any():
            held[0].append(shift)
            held[1].append(same)
            words_held += min(int(same.sum()), len(same) // 64 + 1)
        if held[0] and (words_held >= PAIR_WORDS or len(held[0]) >= 256):
            yield close_pairs(planes, np.array(held[0]), held[1], most)
            held, words_held = ([], []), 0
    if held[0]:
        yield close_pairs(planes, np.array(held[0]), held[1], most)


def forest(keys: np.ndarray, fp: np.ndarray, radii: list[int], parent: np.ndarray | None = None, holds=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that span the groups within the last radius; rows with equal keys stand together and are compared.

    Radii ascend, so that groups are joined by their closest pairs. parent: groups that are there before;
    holds(i, j): which pairs may join any; asked only of pairs whose groups are still apart.
    """
    parent = np.arange(len(keys)) if parent is None else parent
    planes = planes_of(fp)
    found: list[np.ndarray] = []
    for most in radii:
        for i, j in steps(keys, planes, parent, most):
            near = np.argsort(np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1), kind="stable")
            i, j = i[near], j[near]
            for k in range(0, len(i), CHECKED if holds else max(1, len(i))):
                a, b = (i[k : k + CHECKED], j[k : k + CHECKED]) if holds else (i, j)
                if holds:
                    apart = parent[a] != parent[b]
                    a, b = a[apart], b[apart]
                    good = holds(a, b)
                    a, b = a[good], b[good]
                parent[:], new = joined(parent, a, b)
                found += new
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


class ShingleSets:
    """Sets of shingles of a task's rows, of which pairs are compared exactly: a bit for each shingle that two rows have."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray, similarity: float):
        self.values, self.sizes, self.similarity = values, sizes.astype(np.int64), similarity
        self.start = np.cumsum(self.sizes) - self.sizes
        row = np.repeat(np.arange(len(sizes)), self.sizes)
        _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
        shared = counts > 1
        column = (np.cumsum(shared) - 1)[place]
        width = (int(shared.sum()) + 63) // 64
        self.bits = None
        if len(sizes) * width <= SET_WORDS:
            self.bits = np.zeros((len(sizes), width), np.uint64)
            k = np.flatnonzero(shared[place])
            np.bitwise_or.at(self.bits, (row[k], column[k] >> 6), U(1) << (column[k] & 63).astype(np.uint64))

    def own(self, i: int) -> np.ndarray:
        return self.values[self.start[i] : self.start[i] + self.sizes[i]]

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have the Jaccard similarity; two empty sets do."""
        if self.bits is not None:
            both = np.bitwise_count(self.bits[i] & self.bits[j]).sum(axis=1, dtype=np.int64)
        else:
            both = np.array([len(np.intersect1d(self.own(a), self.own(b), assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        every = self.sizes[i] + self.sizes[j] - both
        return both >= self.similarity * every


def compared(blocks: DataFrame, radii: list[int], similarity: float = 0.0) -> DataFrame:
    """(a, b): a spanning forest of the links inside each block; blocks: key long, id long, fp binary.

    blocks may also have root long and shingles array<long>: rows of one root are one group before, and only pairs whose sets have the similarity are links.
    """
    bounded_batches(blocks.sparkSession)
    known = "root" in blocks.columns
    ordered = blocks.select("key", "id", "fp", *["root", "shingles"] * known).repartition("key").sortWithinPartitions("key", "id")

    def pairs(keys, ids, fp, root=None, values=None, sizes=None):
        parent, holds = None, None
        if known:
            _, first, back = np.unique(root, return_index=True, return_inverse=True)
            parent, holds = first[back], ShingleSets(values, sizes, similarity).similar
        i, j = forest(keys, fp, radii, parent, holds)
        lo, hi = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    def part(batch, fp, a, b):
        plain = batch.column(0).to_numpy()[a:b], batch.column(1).to_numpy()[a:b], fp[a:b]
        if not known:
            return plain
        sets = batch.column(4).slice(a, b - a)
        return *plain, batch.column(3).to_numpy()[a:b], sets.flatten().to_numpy(), sets.value_lengths().to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(keys), -1)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last block may go on in the next batch
            if cut:
                held.append(part(batch, fp, 0, cut))
                yield from pairs(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append(part(batch, fp, cut, len(keys)))
        if held:
            yield from pairs(*map(np.concatenate, zip(*held, strict=True)))

    return ordered.mapInArrow(run, "a long, b long")


def part_keys(fp: Column, bits: list[int], salt: Column) -> Column:
    """For each two of four parts of these bits: a key that is equal where both parts are."""
    step = len(bits) // 4
    parts = [bits[i * step : (i + 1) * step] for i in range(4)]

    def part(p):  # consecutive bits
        return F.shiftrightunsigned(fp, p[0]).bitwiseAND(F.lit((1 << len(p)) - 1))

    return F.array(*[F.struct(F.xxhash64(salt, F.lit(i * 4 + j), part(parts[i]), part(parts[j])).alias("key"), F.lit(i * 4 + j).alias("way")) for i, j in combinations(range(4), 2)])


def blocks_within_two(reps: DataFrame) -> DataFrame:
    """key, id, fp rows in which all fingerprints at most two bits apart share a key.

    Keys of two equal 16-bit parts come first. Where over BLOCK_ROWS rows share one, the 32 bits left are
    parted in the same way, and once more; then at most 256 fingerprints can share a key.
    """
    left = {4 * i + j: [b for k in range(4) if k not in (i, j) for b in range(16 * k, 16 * k + 16)] for i, j in combinations(range(4), 2)}
    rows = reps.select("id", F.col("fp").alias("f"), F.explode(part_keys(F.col("fp"), list(range(64)), F.lit(0))).alias("k")).select("id", "f", "k.key", "k.way")
    rows = written(rows, "simhash-blocks")
    hot = written(rows.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).select("key"), "simhash-hot")
    done = rows
    if not hot.isEmpty():
        done = rows.join(hot, "key", "left_anti").select("key", "id", "f")
        again = rows.join(hot, "key", "left_semi")
        for way, bits in left.items():
            own = again.filter(F.col("way") == way)
            low, high = bits[:16], bits[16:]
            # The two parts left, side by side, as one number of 32 bits.
            rest = F.shiftrightunsigned(F.col("f"), low[0]).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("f"), high[0]).bitwiseAND(F.lit(0xFFFF)), 16))
            finer = own.select("id", "f", rest.alias("rest"), F.explode(part_keys(rest, list(range(32)), F.col("key"))).alias("k")).select("id", "f", "rest", "k.key", "k.way")
            many = finer.groupBy("key").count().filter(F.col("count") > BLOCK_ROWS).select("key")
            done = done.unionByName(finer.join(many, "key", "left_anti").select("key", "id", "f"))
            last = finer.join(many, "key", "left_semi")
            for i, j in combinations(range(4), 2):
                k, m = [x for x in range(4) if x not in (i, j)]
                tail = F.shiftrightunsigned(F.col("rest"), 8 * k).bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("rest"), 8 * m).bitwiseAND(F.lit(0xFF)), 8))
                keyed = last.filter(F.col("way") == 4 * i + j).select("id", "f", F.explode(part_keys(tail, list(range(16)), F.col("key"))).alias("k"))
                done = done.unionByName(keyed.select("k.key", "id", "f"))
    return done.select("key", "id", little_endian(F.col("f")).alias("fp"))


def little_endian(x: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(x), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def blocks_of_sketch(reps: DataFrame) -> DataFrame:
    """key, id, fp rows in which similar texts share a key: blocks of the rarest of each text's smallest shingle hashes.

    Of texts of similarity 0.8 each of the smallest hashes of both together is in both with a chance of 0.8, so that under
    SKETCH_SHARE of 32 are shared with a chance of about 10^-7. A pair that shares so many of m hashes has one in common among the m - share * m + 1
    that the fewest texts have (ties by hash), whichever the others are. Only these make blocks, and only where two texts have them: hashes of a
    passage that very many texts hold make none, unless nearly all of a text is made of such.
    A block of more than SKETCH_ROWS rows (near copies by the thousands) is cut into parts, and all pairs of parts are compared.
    """
    more = [c for c in ("root", "shingles") if c in reps.columns]
    each = reps.select("id", F.size("sketch").alias("m"), F.explode("sketch").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = each.join(counts, "key").groupBy("id").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    # A hash that one text has alone is rarer than all that are shared.
    alone = F.col("m") - F.size("keys")
    wanted = F.col("m") - F.ceil(F.col("m") * SKETCH_SHARE).cast("int") + 1
    chosen = shared.select("id", F.explode(F.slice("keys", F.lit(1), F.greatest(F.lit(0), wanted - alone))).alias("k")).select("id", "k.key")
    chosen = written(chosen, "sketch-blocks")
    sizes = chosen.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / (SKETCH_ROWS // 2)).cast("int"))
    sizes = sizes.withColumn("parts", F.when(F.col("n") > SKETCH_ROWS, F.col("parts")).otherwise(1))
    rows = chosen.join(sizes.select("key", "parts"), "key")
    part = F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")
    rows = rows.select("key", "id", "parts", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).filter("parts = 1 OR part != other")
    tile = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return rows.select("id", tile.alias("key")).join(reps.select("id", "fp", *more), "id").select("key", "id", "fp", *more)


def contracted(links: DataFrame) -> DataFrame:
    """(u, v) links of the same groups: what each task reads is joined there, and each id linked to the smallest of its group. Nothing is shuffled."""
    bounded_batches(links.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            parent, _ = joined(np.arange(len(names)), place[: len(u)], place[len(u) :])
            k = np.flatnonzero(parent != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(names[parent[k]])], names=["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): each linked id with the smallest id that links lead to, by alternating large and small stars over links that tasks have contracted."""
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = state(e)
    while was[0]:
        short = contracted(e)
        both = short.unionByName(short.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        last, e = e, written(small, "links")
        discard(last)
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def rooted(links: DataFrame, roots: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(ra, rb): the roots of both ends of links; ids without a root are their own."""
    x, y = roots.select(F.col("id").alias(a), F.col("root").alias("ra")), roots.select(F.col("id").alias(b), F.col("root").alias("rb"))
    return links.join(x, a, "left").join(y, b, "left").select(F.coalesce("ra", a).alias("ra"), F.coalesce("rb", b).alias("rb"))


def verified(reps: DataFrame, blocks, radii: list[int], sets_of, similarity: float) -> DataFrame:
    """(id, root) of groups that links which hold connect; sets_of(ids): their shingle sets.

    A first forest joins whatever is within the last radius, and its links are checked by their sets, which settles nearly all. But it may join two groups
    by a link that fails, where another one would hold. Groups at both ends of failed links are therefore compared again, with their sets
    beside them, so that a task checks a pair before it joins groups; no pair that fails leaves it, and none that holds between two groups is passed over.
    """
    tried = written(compared(blocks(reps), radii).distinct(), "candidates")
    sets = sets_of(tried.select(F.col("a").alias("id")).union(tried.select("b")).distinct())
    good = written(similar(sets, tried, similarity), "verified")
    failed = written(tried.join(good, ["a", "b"], "left_anti"), "failed")
    found = components(good)
    if failed.isEmpty():
        return found
    ends = rooted(failed, found).filter("ra != rb")
    roots = ends.select(F.col("ra").alias("root")).union(ends.select("rb")).distinct()
    known = roots.select(F.col("root").alias("id"), "root").unionByName(found.join(roots, "root").select("id", "root"))
    again = written(reps.join(known, "id").join(sets, "id"), "simhash-again")
    new = written(compared(blocks(again), radii, similarity).distinct(), "verified")
    # Only the groups' roots are linked now; all else keeps its place below its old root.
    over = components(rooted(new, found).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    moved = over.select(F.col("id").alias("root"), F.col("root").alias("top"))
    return written(found.join(moved, "root", "left").select("id", F.coalesce("top", "root").alias("root")).unionByName(over), "groups").dropDuplicates(["id"])


def grouped(rows: DataFrame, blocks, radii: list[int], sets_of=None, similarity: float = 0.0) -> DataFrame:
    """doc_id, fp and component_id of rows (doc_id, fp, and what blocks needs): equal fingerprints stand for one another.

    sets_of, similarity: of verified(); without them all links hold.
    """
    others = [F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "fp")]
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), *others), "simhash-reps")
    found = verified(reps, blocks, radii, sets_of, similarity) if sets_of else components(compared(blocks(reps), radii))
    named = reps.join(found, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return rows.select("doc_id", "fp").join(named, "fp")


def near_duplicate_components(docs: DataFrame, size: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id: texts whose 64-bit fingerprints differ in at most two bits are linked."""
    if most != 2:
        raise ValueError("blocks are made for two differing bits")
    rows = written(fingerprints(docs, size, id_col, text_col), "simhash")
    out = grouped(rows, blocks_within_two, [most])
    return out.select(null_id(F.col("doc_id")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), null_id(F.col("component_id")).alias("component_id"))


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles array<long>), written: the sets of `size`-word shingles of these ids' texts; docs: doc_id, text."""

    def fn(data, bounds):
        data = LOWER[data]
        s, e, first = words(data, bounds)
        h = word_hashes(data, s, e)
        return [[distinct(window_hashes(h[a:b], min(size, b - a))).view(np.int64) if b > a else np.zeros(0, np.int64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]]

    sets = over_texts(docs.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi"), fn, "shingles array<long>", ["id"])
    return written(sets.dropDuplicates(["id"]), "shingles")


def similar(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose sets (id, shingles) have this Jaccard similarity."""
    x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    share = both >= similarity * (F.size("x") + F.size("y") - both)
    return links.join(x, "a").join(y, "b").filter(share | ((F.size("x") == 0) & (F.size("y") == 0))).select("a", "b")


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, bits: int = WIDE_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those of each group of near-duplicates that don't have its smallest id; all columns stay.

    Wide fingerprints find pairs of texts, closest first, that may have a Jaccard similarity of `similarity` or more
    between their sets of `size`-word shingles (within three standard deviations); pairs that would join groups are
    compared by the sets themselves, until no such pair is left. Groups are what the pairs that hold connect.
    Rows are told apart by numbers of their own: of rows with equal ids in one group exactly one stays, and rows with
    that id or without one that are in no group, or in others, aren't touched.
    """
    held, row = with_rows(docs)
    plain = texts(held, row, text_col)
    levels = [radius(similarity + (1 - similarity) * x, bits, 0) for x in (0.7, 0.3)]
    with scratch() as keep:
        rows = written(wide_fingerprints(held, size, bits, row, text_col), "simhash-wide")
        groups = grouped(rows, blocks_of_sketch, [*levels, radius(similarity, bits, 3)], lambda ids: shingle_sets(plain, ids, size), similarity).select(F.col("doc_id").alias("row"), "component_id")
        # Of each group the row with the smallest id stays, and of several such rows the first; lone rows are no group.
        shared = groups.groupBy("component_id").count().filter("count > 1").select("component_id")
        ids = held.select(held[row].alias("row"), F.coalesce(held[id_col].cast("long"), F.lit(NULL_ID)).alias("id"))
        members = keep(written(groups.join(shared, "component_id", "left_semi").join(ids, "row"), "simhash-members"))
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first"))
    gone = members.join(first, "component_id").filter("row != first.row").select(F.col("row").alias(row))
    return held.join(gone, row, "left_anti").select(*[held[c] for c in docs.columns])
