"""Near-duplicates by a chosen-path set similarity join.

A tree's root has all texts. A node sends its texts on by the minwise tokens (least shingles under a hash function) at coordinates
that it selects, two at each node: a child has the texts that agree there. A pair of similar texts agrees with a chance of its similarity, so
at two coordinates a node more than one child of each node on its way is expected to have both, and the chance that
they stay together tends to a limit, however deep the tree; independent trees are repeated until the target recall is reached. A node of up to
NODE_ROWS texts is compared exhaustively, by fingerprints of four bits of 256 minwise tokens, and the links found are confirmed on full sets.
All nodes of a depth are made at once, as rows (node, text).

A node that a selected coordinate fails to part (a child has over half of it) consists of near copies; it is cut into parts, and all pairs of
parts are compared, so that no pair is lost. Inside a node only links that join groups are emitted, never all pairs, and copies
with equal sets are one text. The trees miss a pair of similarity 0.8 with a chance of 10^-6 (RECALL), the comparison of fingerprints
with one of 10^-5 (DEVIATIONS), the less the more similar it is; links themselves are exact.

Defined results: null and empty texts and texts without words have an empty set, and are linked with nothing; rows are told apart by numbers of their own, so
ids may repeat or be null (a null id counts as the smallest and stays null; a component of such has a null component_id, and its null row is kept);
repeated rows share a component; rows of one id in one component are all marked kept if theirs is its smallest; an empty table gives an empty table.
Shingles are compared by 64-bit hashes: two different ones of a set or pair meet with a chance of 2^-64.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, U, distinct, mix, null_id, over_texts, scratch, texts, window_hashes, word_hashes, words, written
from lectern.llm.simhash import shingle_sets, verified

#: Minwise tokens of a text: of all, four bits each are its fingerprint; of the first BRANCH, nodes select.
TOKENS, BRANCH = 256, 64
#: Coordinates that a node selects.
WAYS = 2
#: A node of more texts is branched.
NODE_ROWS = 16_384
#: Chance with which the trees find a pair of the least similarity.
RECALL = 1 - 1e-6
#: Standard deviations of an estimate beyond the least similarity that are still compared by sets.
DEVIATIONS = 4.5

_RNG = np.random.Generator(np.random.PCG64(19530423))
FACTORS = _RNG.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * U(2) + U(1)


def trees_for(similarity: float, recall: float = RECALL) -> int:
    """Trees that find a pair of this similarity with a chance of `recall`, at any depth."""
    stays = 1.0
    for _ in range(200):  # chance that a child, and what follows from it, keeps the pair
        stays = 1 - (1 - similarity * stays) ** WAYS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - stays)))


def radius(similarity: float, deviations: float) -> int:
    """Bits that differ between fingerprints of texts of this similarity, and so many standard deviations more."""
    p = 1 - similarity
    return int(TOKENS * 2 * p + deviations * (TOKENS * (5 * p - 4 * p * p)) ** 0.5)


def minwise(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, TOKENS): the least of each text's values under each hash function; first: where texts begin, none empty."""
    out, hashed = np.empty((len(first), TOKENS), np.uint64), np.empty_like(values)
    for k, f in enumerate(FACTORS):
        np.multiply(values, f, out=hashed)
        np.bitwise_xor(hashed, hashed >> U(29), out=hashed)
        out[:, k] = np.minimum.reduceat(hashed, first)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, n_shingles, digest (two longs of the set), fp binary, sig array<int> (both empty for empty sets); docs: row, doc_id, text."""

    def fn(data, bounds):
        data = LOWER[data]
        s, e, first = words(data, bounds)
        h = word_hashes(data, s, e)
        sets = [distinct(window_hashes(h[a:b], min(size, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        n = np.array([len(x) for x in sets], np.int64)
        some = np.flatnonzero(n)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
        fps, sigs = [b""] * len(sets), [np.zeros(0, np.int32)] * len(sets)
        if len(some):
            tokens = mix(minwise(np.concatenate([sets[k] for k in some.tolist()]), np.cumsum(n[some]) - n[some]))
            nibbles = (tokens >> U(60)).astype(np.uint8)
            packed = nibbles[:, ::2] | nibbles[:, 1::2] << 4
            chosen = (tokens[:, :BRANCH] & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            for x, k in enumerate(some.tolist()):
                fps[k], sigs[k] = packed[x].tobytes(), chosen[x]
        return [n, np.ascontiguousarray(digests[:, 0]), np.ascontiguousarray(digests[:, 1]), fps, sigs]

    return over_texts(docs, fn, "n_shingles long, digest_a long, digest_b long, fp binary, sig array<int>", ["row", "doc_id"])


def tiles(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, id): nodes cut into parts of half of NODE_ROWS, all pairs of parts of each; sizes: key, n."""
    parts = F.greatest(F.lit(2), F.ceil(F.col("n") / (NODE_ROWS // 2)).cast("int"))
    cut = rows.join(sizes.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part != other")
    return met.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "id")


def child(path: Column, at: Column) -> Column:
    """The child of a node for texts that agree at a coordinate."""
    return F.xxhash64(path, at, F.get("sig", at))


def nodes(reps: DataFrame, trees: int) -> DataFrame:
    """key, id, fp (and root, shingles, if there) rows: the nodes of all trees that are compared exhaustively."""
    more = [c for c in ("root", "shingles") if c in reps.columns]
    own = reps.select("id", "sig")
    top = trees * WAYS
    roots = F.array(*[child(F.lit(t), F.lit(t * WAYS + w)) for t in range(trees) for w in range(WAYS)])
    rows = written(own.select("id", F.explode(roots).alias("key")), "paths")
    last = None
    for level in range(64):
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "nodes")
        small = rows.join(sizes.filter(F.col("n") <= NODE_ROWS).select("key"), "key").select("key", "id")
        last = small if last is None else last.unionByName(small)
        large = sizes.filter(F.col("n") > NODE_ROWS)
        if large.isEmpty():
            break
        # Coordinates that no node above has selected, while there are such.
        width = (BRANCH - top) // 4
        base = top + level % 4 * width
        one = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(width)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("key", F.lit(-1 - level)), F.lit(width - 1)).cast("int"), F.lit(width))
        branched = rows.join(large, "key").join(own, "id").select("id", F.col("key").alias("parent"), "n", F.explode(F.array(child(F.col("key"), one + base), child(F.col("key"), two + base))).alias("key"))
        branched = written(branched, "paths")
        most = branched.groupBy("parent", "n", "key").count().groupBy("parent", "n").agg(F.max("count").alias("most"))
        dense = written(most.filter("2 * most > n").select(F.col("parent").alias("key"), "n"), "dense")
        last = last.unionByName(tiles(rows.select("key", "id"), dense))
        rows = branched.join(dense.select(F.col("key").alias("parent")), "parent", "left_anti").select("id", "key")
    return last.join(reps.select("id", "fp", *more), "id").select("key", "id", "fp", *more)


def near_duplicate_components(docs: DataFrame, size: int = 4, similarity: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row, written: sets of `size`-word shingles whose Jaccard similarity is at least `similarity` are linked."""
    with scratch() as keep:
        held = written(texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rows")
        rows = written(signatures(held, size), "signatures")
        digest = ["digest_a", "digest_b"]
        full = rows.filter("n_shingles > 0")
        classes = written(full.groupBy(*digest).agg(F.min("row").alias("id"), F.min("doc_id").alias("least")), "classes")
        reps = written(classes.select("id").join(full.select(F.col("row").alias("id"), "fp", "sig"), "id"), "representatives")
        plain = held.select(F.col("row").alias("doc_id"), "text")
        levels = [radius(similarity + (1 - similarity) * x, 0) for x in (0.7, 0.3)]
        trees = trees_for(similarity, recall)
        found = verified(reps, lambda r: nodes(r, trees), [*levels, radius(similarity, DEVIATIONS)], lambda ids: shingle_sets(plain, ids, size), similarity)
        named = written(classes.join(found, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        of = named.join(least, "root").select(*digest, "component_id")
        linked = full.select("doc_id", "n_shingles", *digest).join(of, digest).select("doc_id", "n_shingles", "component_id")
        alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        out = linked.unionByName(alone).select(null_id(F.col("doc_id")).alias("doc_id"), "n_shingles", null_id(F.col("component_id")).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))
        return keep(written(out, "components"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
