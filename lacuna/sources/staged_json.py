"""Where a stage puts its rows: sorted JSON lines in a folder for each year, of which readers see a whole run or the one before.

A Spark data source writer. Tasks write files of a run's own folder and say which; the commit writes the run's list of files with its summary,
and, as its last act, the pointer to it. A run that breaks off leaves the pointer as it was; what it wrote is taken away by abort(), or lies where nothing points to.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

POINTER = "_current.json"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it, of a path with a scheme or a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _read(system: pafs.FileSystem, path: str) -> dict | None:
    if system.get_file_info(path).type != pafs.FileType.File:
        return None
    with system.open_input_stream(path) as stream:
        return json.loads(stream.read())


def _write(system: pafs.FileSystem, path: str, value: dict) -> None:
    """Whole or not at all: a file of another name, and then its name."""
    other = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(other) as stream:
        stream.write(json.dumps(value, ensure_ascii=False, sort_keys=True).encode())
    system.move(other, path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (slice, file, rows, first key, last key) of each file."""

    files: list[tuple[str, str, int, int, int]]


class Writer(DataSourceArrowWriter):
    """slice, key and line of rows that are sorted by slice and key in each task."""

    def __init__(self, options: dict):
        self.root, self.summary, self.run = options["path"], json.loads(options.get("summary", "{}")), options.get("run") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place(self.root)
        files, stream, now = [], None, None
        try:
            for batch in iterator:
                for part, key, line in zip(*(batch.column(c).to_pylist() for c in ("slice", "key", "line")), strict=True):
                    if part != now or stream is None:
                        if stream is not None:
                            stream.close()
                        # A name of its own for each try of a task.
                        folder = posixpath.join(root, f"run-{self.run}", f"slice={part}")
                        system.create_dir(folder, recursive=True)
                        name = f"{uuid.uuid4().hex}.jsonl"
                        stream, now = system.open_output_stream(posixpath.join(folder, name)), part
                        files.append([str(part), posixpath.join(f"run-{self.run}", f"slice={part}", name), 0, key, key])
                    stream.write(line.encode() + b"\n")
                    files[-1][2] += 1
                    files[-1][4] = key
        finally:
            if stream is not None:
                stream.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.root)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[0], f[3]))
        slices: dict[str, int] = {}
        for part, _, n, _, _ in files:
            slices[part] = slices.get(part, 0) + n
        system.create_dir(root, recursive=True)
        _write(system, posixpath.join(root, POINTER), {"run": self.run, "files": [f[1] for f in files], "rows": slices, "summary": self.summary})

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.root)
        folder = posixpath.join(root, f"run-{self.run}")
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class StagedJson(DataSource):
    """format("staged_json"), options path, summary (JSON) and run; it is written, and read by read()."""

    @classmethod
    def name(cls) -> str:
        return "staged_json"

    def schema(self) -> str:
        return "slice string, key long, line string"

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def _sorted(value: Column, kind: T.DataType) -> Column:
    """value with the fields of all structs in it in order of their names."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def lines(rows: DataFrame) -> Column:
    """A JSON object for each row: keys in order, nulls written out."""
    named = F.struct(*[_sorted(F.col(f.name), f.dataType).alias(f.name) for f in sorted(rows.schema.fields, key=lambda f: f.name)])
    return F.to_json(named, {"ignoreNullFields": "false"})


def write(rows: DataFrame, path: str, key: str, part: Column, summary: dict | None = None) -> None:
    """Put rows in the place of what path holds: in order of key in each slice (part), the summary with them. A null slice or key is an error.

    A third of all rows may be one slice: rows are dealt by ranges of slice and key.
    """
    spark = rows.sparkSession
    spark.dataSource.register(StagedJson)
    said = lambda what: F.raise_error(F.lit(f"a row has no {what}"))
    named = rows.select(F.coalesce(part.cast("string"), said("slice")).alias("slice"), F.coalesce(F.col(key).cast("long"), said(key).cast("long")).alias("key"), lines(rows).alias("line"))
    ordered = named.repartitionByRange("slice", "key").sortWithinPartitions("slice", "key")
    ordered.write.format("staged_json").option("path", path).option("summary", json.dumps(summary or {}, default=str)).option("run", uuid.uuid4().hex).mode("append").save()


def current(path: str) -> dict | None:
    """The run that path holds: run, files, rows of each slice, summary; None before the first."""
    system, root = place(path)
    return _read(system, posixpath.join(root, POINTER))


def read(spark: SparkSession, path: str, schema, slices: list[str] | None = None) -> DataFrame:
    """The rows of the run that path holds, of these slices alone if any are named; a damaged line is an error, and so is a path without a run."""
    run = current(path)
    if run is None:
        raise FileNotFoundError(f"nothing was committed to {path}")
    chosen = [f"{path.rstrip('/')}/{f}" for f in run["files"] if slices is None or f.split("slice=")[1].split("/")[0] in slices]
    return spark.read.schema(schema).option("mode", "FAILFAST").json(chosen) if chosen else spark.createDataFrame([], schema)


def remove_others(path: str) -> int:
    """Delete the runs that path does not hold any more; their readers must be done. Gives how many went."""
    system, root = place(path)
    run = current(path)
    others = [f for f in system.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("run-") and (run is None or f.base_name != f"run-{run['run']}")]
    for f in others:
        system.delete_dir(f.path)
    return len(others)
