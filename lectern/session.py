"""What every query needs of its session."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each context, so that they need no install of it."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._lectern_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Only where that is unset and Spark runs in this process alone (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    held = getattr(sc, "_lectern_shared", None)
    if held:
        return held
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lectern-")
    folder = f"{base.rstrip('/')}/lectern-shared-{sc.applicationId}"
    fs, path = _at(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    sc._lectern_shared = folder
    return folder


def _at(spark: SparkSession, path: str):
    """The Hadoop file system and path of a location."""
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(sc._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _at(spark, path)
    return fs.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    fs, there = _at(spark, path)
    fs.delete(there, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Whether the file was moved; a target that is there stays."""
    fs, there = _at(spark, source)
    return bool(fs.rename(there, _at(spark, target)[1]))


def read_text(spark: SparkSession, path: str) -> str:
    fs, there = _at(spark, path)
    stream = fs.open(there)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its place and moved there."""
    fs, there = _at(spark, path)
    beside = f"{path}.part"
    stream = fs.create(_at(spark, beside)[1], True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(there):
        fs.delete(there, False)
    if not rename(spark, beside, path):
        raise OSError(f"{path} can't be written")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: what is read several times is made once, and lineage ends there."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fingerprint(table: DataFrame) -> str:
    """What tells the files of a table that was read from others: their names, lengths and times."""
    parts = []
    for name in sorted(table.inputFiles()):
        fs, there = _at(table.sparkSession, name)
        status = fs.getFileStatus(there)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]
