"""Publishing by key: what is there and unchanged is left alone, what is new, changed or lost is written, and a killed run goes on where it stopped.

Below a folder stand `data/run=<run>/` (Parquet, partitioned by nothing else), `manifest/v=<n>/` (for each key its content's fingerprint and the run that wrote it), and
CURRENT, a small file that names the manifest that holds. A run writes its keys in batches: rows, then a manifest with them, then CURRENT in one
move. So readers see a batch whole or not at all; what a killed run wrote and didn't commit is in no manifest, and is written again under another run. Manifests are
tables, joined with the rows, so that any number of keys may be published.

A null key is a key. Rows of a key are a set with repeats: their order is no content. A key that the new rows don't have stays, unless `drop` is given.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.session import exists, read_text, stored, write_text

MANIFEST = "count long, sum_a decimal(38,0), sum_b decimal(38,0), run string"


def current(spark: SparkSession, path: str) -> dict | None:
    """What CURRENT says: version, key, schema of the rows."""
    name = f"{path}/CURRENT"
    return json.loads(read_text(spark, name)) if exists(spark, name) else None


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(key columns, count, sum_a, sum_b, run) of all that is published."""
    now = current(spark, path)
    if now is None:
        return None
    kinds = StructType([f for f in StructType.fromJson(now["schema"]) if f.name in now["key"]])
    for f in spark.createDataFrame([], MANIFEST).schema:
        kinds = kinds.add(f)
    return spark.read.schema(kinds).parquet(f"{path}/manifest/v={now['version']}")


def same(key: list[str], a: DataFrame, b: DataFrame):
    cond = a[key[0]].eqNullSafe(b[key[0]])
    for k in key[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, count, sum_a, sum_b: sums of two hashes of each row, whatever the order."""
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    hashes = rows.select(*key, *[F.xxhash64(F.lit(k), text).cast("decimal(38,0)").alias(k) for k in "ab"])
    return hashes.groupBy(*key).agg(F.count("*").alias("count"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))


def there(spark: SparkSession, path: str, run: str) -> bool:
    """Whether a run's files are there: a finished write leaves its mark."""
    return exists(spark, f"{path}/data/run={run}/_SUCCESS")


def plan(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """(key, count, sum_a, sum_b, run, status) of each key of rows: same, new, changed, or lost (its run's files are gone); run: of what is the same."""
    spark = rows.sparkSession
    own = fingerprints(rows, key)
    had = manifest(spark, path)
    if had is None:
        return own.select("*", F.lit(None).cast("string").alias("run"), F.lit("new").alias("status"))
    runs = [r.run for r in had.select("run").distinct().collect()]  # one for each batch that was ever published
    gone = [r for r in runs if not there(spark, path, r)]
    old = had.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("count").alias("_n"), F.col("sum_a").alias("_a"), F.col("sum_b").alias("_b"), "run")
    cond = own[key[0]].eqNullSafe(old[f"_{key[0]}"])
    for k in key[1:]:
        cond = cond & own[k].eqNullSafe(old[f"_{k}"])
    equal = (F.col("count") == F.col("_n")) & (F.col("sum_a") == F.col("_a")) & (F.col("sum_b") == F.col("_b"))
    status = F.when(F.col("run").isNull(), "new").when(F.col("run").isin(gone), "lost").when(equal, "same").otherwise("changed")
    both = own.join(old, cond, "left").withColumn("status", status)
    return both.select(*key, "count", "sum_a", "sum_b", F.when(F.col("status") == "same", F.col("run")).alias("run"), "status")


def publish(rows: DataFrame, path: str, key: list[str], batches: int = 1, drop: bool = False, after=None) -> DataFrame:
    """Publish rows by key; gives (key, status) of each key: same, new, changed or lost, as it was found.

    batches: commits, each of a part of the keys by their hashes. drop: forget keys that rows don't have. after(batch): called behind each commit (tests stop there).
    """
    spark = rows.sparkSession
    todo = stored(plan(rows, path, key), "publish")
    work = todo.filter("status != 'same'").withColumn("_batch", F.pmod(F.xxhash64(*key), F.lit(batches)))
    for batch in range(batches):
        mine = work.filter(F.col("_batch") == batch)
        now = current(spark, path)
        if mine.isEmpty() and now is not None and not (drop and batch == batches - 1):
            continue
        run = uuid.uuid4().hex
        keys = mine.select(*key)
        rows.join(keys, same(key, rows, keys), "left_semi").write.parquet(f"{path}/data/run={run}")
        new = mine.select(*key, "count", "sum_a", "sum_b", F.lit(run).alias("run"))
        had = manifest(spark, path)
        if had is not None:
            kept = had.join(keys, same(key, had, keys), "left_anti")
            if drop and batch == batches - 1:
                kept = kept.join(todo, same(key, kept, todo), "left_semi")
            new = kept.unionByName(new)
        version = (now["version"] if now else 0) + 1
        new.write.mode("overwrite").parquet(f"{path}/manifest/v={version}")
        write_text(spark, f"{path}/CURRENT", json.dumps({"version": version, "key": key, "schema": rows.schema.jsonValue()}))
        if after is not None:
            after(batch)
    return todo.select(*key, "status")


def published(spark: SparkSession, path: str) -> DataFrame:
    """All published rows: of each key those of the run that its manifest names."""
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing is published below {path}")
    kinds = StructType.fromJson(now["schema"])
    has = manifest(spark, path).select(*now["key"], F.col("run").alias("_run"))
    rows = spark.read.schema(kinds.add("run", "string")).option("basePath", f"{path}/data").parquet(f"{path}/data")
    cond = same(now["key"], rows, has) & (rows["run"] == has["_run"])
    return rows.join(has, cond, "left_semi").drop("run")


def missing(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Keys of rows that aren't published as they are: key, status (new, changed or lost)."""
    return plan(rows, path, key).filter("status != 'same'").select(*key, "status")
