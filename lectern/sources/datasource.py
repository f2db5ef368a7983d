"""A data source for folders of transcripts and their companions: spark.read.format("lectern").option("kind", ...).load(folder).

Kinds: csv (every record of every file, as a map of its columns), articles (one a file), rttm (speaker lines), bundle (episodes in fused/ or data/fused/ of every
bundle below the folder). Each file is a partition, read by the task that has it; filters on path, and on the columns that a path says (collection, stem), are
applied before any file is opened. Files are reached by pyarrow's file systems, so that a folder may be local, shared or in a store that
these know; where only Spark's own readers reach it, use lectern.sources.files, which parses the same way.

What can't be parsed is a row with `error` set, never a failure: broken JSON, bytes of no known encoding are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from lectern.session import ship
from lectern.sources import parsing
from lectern.sources.files import PRUNED

SCHEMAS = {
    "csv": "path string, stem string, record long, fields map<string,string>, error string",
    "articles": "path string, stem string, title string, text string, error string",
    "rttm": "path string, stem string, episode_id string, start double, end double, label string, error string",
    "bundle": "path string, stem string, collection string, episode_id string, utterances long, content string, error string",
}
SUFFIX = {"csv": ".csv", "articles": ".csv", "rttm": ".rttm", "bundle": ".json"}
FUSED = re.compile(r"([^/]+)/(?:data/)?fused/[^/]+$")


@dataclass
class File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


def store_of(path: str):
    """(file system, path in it) of a location."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" not in path and not path.startswith("file:"):
        return LocalFileSystem(), path
    return FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Files(DataSourceReader):
    """Partitions by file; what a path alone decides is decided before files are opened."""

    def __init__(self, kind: str, folder: str):
        self.kind, self.folder = kind, folder
        self.wanted: list[tuple[str, str, tuple]] = []  # (column, test, values)

    def of_path(self, path: str) -> dict[str, str]:
        found = FUSED.search(path)
        return {"path": path, "stem": parsing.stem(path), "collection": found[1] if found else ""}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        known = {"path", "stem"} | ({"collection"} if self.kind == "bundle" else set())
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in tests and name in known:
                self.wanted.append((name, tests[type(f)], f.value if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def wants(self, path: str) -> bool:
        facts = self.of_path(path)
        holds = {"is": lambda x, v: x in v, "in": lambda x, v: x in v, "starts": lambda x, v: x.startswith(v[0]), "ends": lambda x, v: x.endswith(v[0]), "has": lambda x, v: v[0] in x}
        return all(holds[test](facts[name], values) for name, test, values in self.wanted)

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, at = store_of(self.folder)
        info = fs.get_file_info(at)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(at, recursive=True))
        paths = sorted(f.path for f in found if f.type == FileType.File and f.path.lower().endswith(SUFFIX[self.kind]) and not set(f.path.split("/")) & set(PRUNED))
        return [File(p) for p in paths if (self.kind != "bundle" or FUSED.search(p)) and self.wants(p)]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # no file was left
            return
        path = partition.path
        fs, _ = store_of(self.folder)
        with fs.open_input_stream(path) as f:
            text = parsing.decoded(f.read())
        facts = self.of_path(path)
        head = (path, facts["stem"])
        if self.kind == "csv":
            rows = parsing.records(text)
            names = next(rows, [])
            for k, row in enumerate(rows):
                extra = None if len(row) <= len(names) else f"{len(row)} fields for {len(names)} columns"
                yield (*head, k, dict(zip(names, [*row, *[None] * len(names)], strict=False)), extra)
        elif self.kind == "articles":
            if text:  # Spark's readers don't open empty files either
                yield (*head, *parsing.article(text), None)
        elif self.kind == "rttm":
            for row in parsing.rttm(text):
                yield (*head, *row, "a number can't be read" if row[2] is None else None)
        else:
            found = parsing.document(text)
            if found is None:
                yield (*head, facts["collection"], None, None, None, "no JSON object")
            else:
                yield (*head, facts["collection"], str(found.get("episode_id") or facts["stem"]), len(found.get("utterances") or []), json.dumps(found, ensure_ascii=False), None)


class Transcripts(DataSource):
    """The format `lectern`; options: kind, path."""

    @classmethod
    def name(cls) -> str:
        return "lectern"

    def kind(self) -> str:
        kind = self.options.get("kind", "bundle").lower()
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self.kind()]

    def reader(self, schema) -> DataSourceReader:
        return Files(self.kind(), self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Transcripts)
