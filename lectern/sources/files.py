"""Readers and writers of the file formats that transcripts come in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import ship
from lectern.sources import parsing

WORD = "struct<start: double, end: double, word: string, prob: double, speaker_id: bigint, assignment_method: string, coarse: boolean>"
FUSED = (
    "schema_version string, episode_id string, diarization_provider string, asr_model string, overlap_policy string, assignment string,"
    "stats struct<n_words: bigint, n_utterances: bigint, unassigned_words: bigint, coarse_tokens: bigint>,"
    f"words array<{WORD}>,"
    "utterances array<struct<utterance_id: string, episode_id: string, speaker_id: bigint, start_sec: double, end_sec: double, text_verbatim: string, text_normalized: string,"
    f"words: array<{WORD}>, entity_restorations: array<struct<alias: string, canonical: string, target_type: string>>>>"
)
PRUNED = ("_source_runs", ".git", "__pycache__", ".ipynb_checkpoints")  # fixed values: archived folders


def read_documents(spark: SparkSession, path: str, schema: str = FUSED) -> DataFrame:
    """One JSON document per file, with its path; broken files have a null schema and their text in _corrupt_record."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("path", F.input_file_name())


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, warnings): files that could be read, and the paths of those that couldn't."""
    bad = F.col("_corrupt_record").isNotNull()
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad).select("path")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Lines of JSON; broken and empty ones are left out, or with strict fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", columns: list[str] | None = None) -> DataFrame:
    """All columns as strings; quoted fields may have line breaks; a byte-order mark before the first name is cut. columns: of the empty table that a missing file gives; without, it fails."""
    try:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    except AnalysisException:
        if columns is None:
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, start, end, label of SPEAKER lines with eight fields or more."""
    f = F.split(F.btrim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).filter((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    at = lambda k: F.get("f", F.lit(k))
    return rows.select(at(1).alias("episode_id"), at(3).cast("double").alias("start"), (at(3).cast("double") + at(4).cast("double")).alias("end"), at(7).alias("label"))


def rttm_line(episode: Column, start: Column, end: Column, label: Column) -> Column:
    return F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", episode, start, F.greatest(F.lit(0.0), end - start), label)


def write_rttm(rows: DataFrame, path: str) -> None:
    """rows: episode_id, start, end, label."""
    rows.select(rttm_line(F.col("episode_id"), F.col("start").cast("double"), F.col("end").cast("double"), F.col("label")).alias("value")).write.mode("overwrite").text(path)


def read_articles(spark: SparkSession, path: str, encodings: tuple[str, ...] = parsing.ENCODINGS) -> DataFrame:
    """article_id, title, text, source_file of CSV files with an article each: its first row, and of its columns the first whose names say title, and news, body or article.

    Files may have different columns, so that headers are read as data. Quoted fields may have line breaks and commas; texts are UTF-8 with or without a mark, or in the next of the encodings that fits. An empty file gives no row.
    """
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            found = [parsing.article(parsing.decoded(c, encodings)) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(parsing.stem, paths), pa.string()), pa.array([t for t, _ in found], pa.string()), pa.array([t for _, t in found], pa.string()), b.column(0)], names=["article_id", "title", "text", "source_file"])

    return raw.mapInArrow(run, "article_id string, title string, text string, source_file string")


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, bytes of files below a folder, without archived folders."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    keep = ~F.col("path").rlike("/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")
    return rows.filter(keep).select("path", F.col("length").alias("bytes"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes of every file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def collection_of(path: Column) -> Column:
    """The folder above .../[data/]fused/."""
    return F.regexp_extract(path, r"([^/]+)/(?:data/)?fused/[^/]+$", 1)


def best_copy(files: DataFrame, stem: str) -> DataFrame:
    """Of files (path, bytes) whose names begin with each stem: the largest, the plainly named one of equals."""
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    plain = F.regexp_replace(name, r"( \(\d+\)|_copy\d*)$", "")
    return files.withColumn(stem, plain).groupBy(stem).agg(F.max_by("path", F.struct("bytes", (name == plain), "path")).alias("path"))


def bundles(files: DataFrame) -> DataFrame:
    """bundle, episodes: folders that have JSON files in fused/ or data/fused/, archived ones left out; files: path."""
    keep = ~F.col("path").rlike("/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/")
    root = F.regexp_extract("path", r"^(.*?)/(?:data/)?fused/[^/]+\.json$", 1)
    return files.filter(keep).select(root.alias("bundle")).filter("bundle != ''").groupBy("bundle").agg(F.count("*").alias("episodes"))


# Other names of stages' folders.
STAGE_NAMES = {"annotation_drafts": ("annotation_drafts", "drafts"), "weak_labels": ("weak_labels", "weak")}


def stage_folders(folders: DataFrame, stages: list[str], data_first: bool = True) -> DataFrame:
    """bundle, stage, folder: where each bundle has a stage, of folders (bundle, folder relative to it) that exist.

    A stage's first name comes before its others, and under each name data/<name> before <name>, or behind it. Where none exists, data/<stage> stands for it.
    """
    rank = []
    for stage in stages:
        for name in STAGE_NAMES.get(stage, (stage,)):
            both = (f"data/{name}", name)
            rank += [(stage, f, len(rank) + k) for k, f in enumerate(both if data_first else both[::-1])]
    wanted = F.broadcast(folders.sparkSession.createDataFrame(rank, "stage string, folder string, rank long"))  # a few names
    found = folders.join(wanted, "folder").groupBy("bundle", "stage").agg(F.min_by("folder", "rank").alias("folder"))
    every = folders.select("bundle").distinct().select("bundle", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    return every.join(found, ["bundle", "stage"], "left").select("bundle", "stage", F.coalesce("folder", F.concat(F.lit("data/"), "stage")).alias("folder"))


def registry_file(files: DataFrame) -> DataFrame:
    """folder, path: of each folder's registry*.csv the one of the plain name, else the shortest name, the first of equals."""
    name = F.regexp_extract("path", r"/(registry[^/]*\.csv)$", 1)
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), name.alias("name"), "path").filter("name != ''")
    return rows.groupBy("folder").agg(F.min_by("path", F.struct(F.col("name") != "registry.csv", F.length("name"), "name")).alias("path"))


def source_files(files: DataFrame, generated: DataFrame, suffixes: list[str]) -> DataFrame:
    """files (owner, path) of these suffixes that don't stand below a generated folder (owner, root) of their owner."""
    ends = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)
    below = F.startswith(F.col("path"), F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")))
    return files.filter(ends).join(generated.withColumnRenamed("owner", "_o"), (F.col("owner") == F.col("_o")) & below, "left_anti").select(*files.columns)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, mark: bool = False) -> bool:
    """CSV with a header, and with mark a byte-order mark before it; an empty table writes nothing. Whether it was written."""
    if rows.isEmpty():
        return False
    out = rows.select(*[F.col(c).alias("\ufeff" + c if mark and k == 0 else c) for k, c in enumerate(rows.columns)])
    out.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A row on each line; sets and lists as they are, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
