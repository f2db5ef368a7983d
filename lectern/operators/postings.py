"""A stored inverted index over texts, and searches that read a few postings instead of the corpus.

Three tables below one folder, each written once:

* `rows`: what is indexed, numbered in the order in which hits of equal score are listed, in blocks of neighbouring numbers;
* `postings`: token, row and places of every word of a row, sorted, on shelves by a hash of the token. Sorted columns are what a list of postings is: Parquet keeps
  the token once for a run and differences of rows and places. Rows are dealt to tasks that sort the words of about PART_BYTES of text in memory and write some of every
  shelf: texts are shuffled and not their words, a frequent token is no task's burden, and a search opens the shelves of its own tokens only;
* `vocabulary`: each token with its rows and places, for parts of words.

A phrase needs no text either: its words stand at neighbouring places, the first as the end of a token and the last as the beginning of one, as in
a search for the phrase anywhere in a text. Texts are read for the hits that are returned, from their blocks.

A file written last says that an index is whole; a folder without it is built anew. Rows of null or empty texts are kept and found by nothing; an empty table makes an index without postings.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.text import bound, normalize_text, tokens
from lectern.operators.search import ALL_WORDS, ANY_WORD, PER_WORD, PHRASE, SMART_ALL, SMART_ANY
from lectern.session import delete, exists, read_text, shared_folder, write_text

#: Text for which one shelf is made, and limits of their number.
SHELF_BYTES, LEAST_SHELVES, MOST_SHELVES = 32 << 20, 16, 4096
#: Hits up to this number are looked up by their numbers; more are joined.
MOST_LITERALS = 10_000
#: Files of the index hold groups of this size, so that one token's rows are few groups of a shelf.
GROUP_BYTES = 8 << 20
#: Text whose words a task sorts, and the most such tasks; beyond those a task sorts more.
PART_BYTES, MOST_PARTS = 32 << 20, 1024
#: Tokens that parts of words may stand for, up to which they are broadcast.
MOST_BROADCAST = 1_000_000
DONE = "index.json"
SCHEMAS = {"postings": "token string, row long, places array<int>, shelf int", "vocabulary": "token string, n_rows long, n_words long"}


@dataclass
class Index:
    """A stored index: its folder, and what its file says: shelves, numbers of rows and words, and the schema of the rows (as JSON)."""

    spark: SparkSession
    path: str
    shelves: int
    rows: int
    words: int
    schema: str

    def table(self, name: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(self.schema)) if name == "rows" else SCHEMAS[name]
        return self.spark.read.schema(kind).parquet(f"{self.path}/{name}")

    def shelf(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.shelves)).cast("int")

    def postings(self, words: list[str]) -> DataFrame:
        """Postings (token, row, places) of some tokens, one for each row that has them, read from their shelves."""
        own = sorted(set(words))
        shelves = self.spark.range(1).select(*[self.shelf(F.lit(w)).alias(f"s{k}") for k, w in enumerate(own)]).first()
        return self.table("postings").filter(F.col("shelf").isin(sorted(set(shelves))) & F.col("token").isin(own))

    def occurrences(self, words: list[str]) -> DataFrame:
        """(token, row, place) of some tokens."""
        return self.postings(words).select("token", "row", F.explode("places").alias("place"))

    def placed(self, words: list[str]) -> DataFrame:
        """(row, k, start): tokens that can be the k-th word of a phrase, and where the phrase would begin then."""
        last = len(words) - 1
        token = F.col("token")
        fits = [token == w if 0 < k < last else token.contains(w) if not last else token.endswith(w) if not k else token.startswith(w) for k, w in enumerate(words)]
        wanted = self.table("vocabulary").select("token", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in enumerate(fits)]))).alias("k"))
        wanted = wanted.withColumn("shelf", self.shelf(token))
        if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            wanted = F.broadcast(wanted)  # else all postings are shuffled for a few tokens
        at = self.table("postings").join(wanted, ["shelf", "token"]).select("row", "k", F.explode("places").alias("place"))
        return at.select("row", "k", (F.col("place") - F.col("k")).alias("start"))

    def phrases(self, words: list[str]) -> DataFrame:
        """Rows whose texts hold the words, one space between them, anywhere."""
        at = self.placed(words)
        if len(words) > 1:
            at = at.groupBy("row", "start").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("seen")).filter(F.col("seen") == (1 << len(words)) - 1)
        return at.select("row").distinct()


def placed_words(words: Column) -> Column:
    """Structs (token, places) of an array's distinct tokens: runs of its sorted (token, place)."""

    def tell(each: Column) -> Column:
        starts = F.array_compact(F.transform(each, lambda w, k: F.when((k == 0) | (w["token"] != F.get(each, k - 1)["token"]), k)))

        def run(at: Column) -> Column:
            size = lambda a, k: F.coalesce(F.get(at, k + 1), F.size(each)) - a
            return F.transform(at, lambda a, k: F.struct(F.get(each, a)["token"].alias("token"), F.transform(F.slice(each, a + 1, size(a, k)), lambda w: w["place"]).alias("places")))

        return bound(starts, run)

    return bound(F.sort_array(F.transform(words, lambda w, k: F.struct(w.alias("token"), k.alias("place")))), tell)


def build(rows: DataFrame, path: str, order: list[str], text: str = "text") -> Index:
    """Index rows below a folder. order: columns by which hits of equal score are listed; together they tell rows apart."""
    spark = rows.sparkSession
    if exists(spark, path):
        delete(spark, path)
    numbered = rows.orderBy(*order).withColumn("row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("block", F.shiftright("row", 33).cast("int"))
    numbered.write.partitionBy("block").parquet(f"{path}/rows")
    index = Index(spark, path, 0, 0, 0, numbered.schema.json())
    stored = index.table("rows")
    size = stored.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    index.rows, index.shelves = size[1], int(min(MOST_SHELVES, max(LEAST_SHELVES, size[0] // SHELF_BYTES)))
    few = min(spark.sparkContext.defaultParallelism, 1 + (size[0] >> 20))  # a small corpus has a task for each core
    parts = int(min(MOST_PARTS, max(few, size[0] // PART_BYTES)))
    words = stored.select("row", text).repartition(parts, "row").select("row", F.inline(placed_words(tokens(normalize_text(F.col(text)))))).withColumn("shelf", index.shelf(F.col("token")))
    dealt = words.sortWithinPartitions("shelf", "token", "row").select("token", "row", "places", "shelf")
    dealt.write.partitionBy("shelf").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(f"{path}/postings")
    by_token = index.table("postings").groupBy("token").agg(F.count("*").alias("n_rows"), F.sum(F.size("places").cast("long")).alias("n_words"))
    by_token.write.parquet(f"{path}/vocabulary")
    index.words = index.table("vocabulary").agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    write_text(spark, f"{path}/{DONE}", json.dumps({"shelves": index.shelves, "rows": index.rows, "words": index.words, "schema": index.schema}))
    return index


def opened(spark: SparkSession, path: str) -> Index | None:
    """The index in a folder, or None where none was finished."""
    if not exists(spark, f"{path}/{DONE}"):
        return None
    said = json.loads(read_text(spark, f"{path}/{DONE}"))
    return Index(spark, path, said["shelves"], said["rows"], said["words"], said["schema"])


def indexed(rows: DataFrame, name: str, order: list[str], text: str = "text") -> Index:
    """The index of rows below the shared folder, built where none is yet. name: tells contents apart; see session.fingerprint."""
    path = f"{shared_folder(rows.sparkSession)}/index-{name}"
    return opened(rows.sparkSession, path) or build(rows, path, order, text)


def share(index: Index, words: list[str]) -> DataFrame:
    """(row, ratio, full): the share of the query's words, repeats included, that a row has, and whether it has all."""
    distinct = list(dict.fromkeys(words))
    weight = [words.count(w) for w in distinct]
    bit = F.element_at(F.create_map(*[x for k, w in enumerate(distinct) for x in (F.lit(w), F.lit(1 << k))]), F.col("token"))
    seen = index.postings(distinct).groupBy("row").agg(F.bit_or(bit).alias("seen"))
    ratio = sum((F.when(F.col("seen").bitwiseAND(F.lit(1 << k)) > 0, n).otherwise(0) for k, n in enumerate(weight)), F.lit(0)) / len(words)
    return seen.select("row", ratio.alias("ratio"), (F.col("seen") == (1 << len(distinct)) - 1).alias("full"))


def scores(index: Index, q: str, method: str, query_type: str = "auto") -> DataFrame:
    """(row, score, match_type) of all rows that a query finds by postings alone. method: exact, all words, any word, or smart (its part without fuzzy comparison)."""
    words = q.split()
    if len(words) > 62:
        raise ValueError("a query has at most 62 words")
    name = method.lower()
    one = len(words) == 1 and query_type.lower() != "sentence"
    if name == "exact":
        rows = index.postings(words).select("row").distinct() if one else index.phrases(words)
        return rows.select("row", F.lit(1.0).alias("score"), F.lit(name).alias("match_type"))
    found = share(index, words)
    if name == "any word":
        return found.select("row", (ANY_WORD + PER_WORD * F.col("ratio")).alias("score"), F.lit(name).alias("match_type"))
    whole = index.phrases(words).withColumn("phrase", F.lit(True))
    if name == "all words":
        return found.filter("full").join(whole, "row", "left").select("row", F.when(F.col("phrase"), PHRASE).otherwise(ALL_WORDS).alias("score"), F.lit(name).alias("match_type"))
    if name != "smart":
        raise ValueError(f"no postings answer {method}")
    # A phrase may begin and end inside words, so that a row may have it and none of the query's words.
    both = found.join(whole, "row", "full")
    score = F.when(F.col("phrase"), 1.0).when(F.col("full"), SMART_ALL).otherwise(SMART_ANY + PER_WORD * F.col("ratio"))
    kind = F.when(F.col("phrase"), "exact").when(F.col("full"), "all words").otherwise("lexical")
    return both.select("row", score.alias("score"), kind.alias("match_type"))


def search(index: Index, q: str, method: str = "any word", least: float = 0.55, top_k: int = 20, query_type: str = "auto", where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The best rows of a query that is normalised as texts are: what is indexed (or `columns` of it), score and match_type; ties in the order of the index.

    where: a condition on columns of the rows, which cuts the scope before the best are chosen.
    """
    stored = index.table("rows")
    names = columns or [c for c in stored.columns if c not in ("row", "block")]
    if not q.split():
        return stored.select(*names, F.lit(0.0).alias("score"), F.lit("").alias("match_type")).limit(0)
    hits = scores(index, q, method, query_type).filter(F.col("score") >= least)
    if where is not None:
        hits = hits.join(stored.filter(where).select("row"), "row", "left_semi")
    top = hits.orderBy(F.desc("score"), "row").limit(max(1, top_k))
    if top_k <= MOST_LITERALS:
        found = top.collect()  # at most top_k numbers
        top = index.spark.createDataFrame(found, top.schema)
        stored = stored.filter(F.col("block").isin(sorted({r.row >> 33 for r in found})) & F.col("row").isin([r.row for r in found]))
    return stored.join(top, "row").orderBy(F.desc("score"), "row").select(*names, "score", "match_type")
