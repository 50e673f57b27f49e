"""Source archives (tar, gzip or plain LaTeX) as tables."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 200 << 20


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def unpack(raw: bytes) -> tuple[str, dict[str, str]]:
    """(kind, LaTeX files by name). kind: pdf, tex, empty or error. Unsafe names, more than MAX_BYTES, and what is cut off or damaged are an error."""
    if raw[:4] == b"%PDF":
        return "pdf", {}
    if raw[:2] == b"\x1f\x8b":
        try:
            with gzip.open(io.BytesIO(raw)) as file:
                raw = file.read(MAX_BYTES + 1)
        except (EOFError, OSError, zlib.error):
            return "error", {}
        if len(raw) > MAX_BYTES:
            return "error", {}
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            files, total = {}, 0
            for member in tar:
                path = PurePosixPath(member.name)
                if path.is_absolute() or ".." in path.parts:
                    return "error", {}
                if member.isfile() and path.suffix == ".tex":
                    total += member.size
                    if total > MAX_BYTES:
                        return "error", {}
                    files[str(path)] = _text(tar.extractfile(member).read())
            return ("tex" if files else "empty"), files
    except tarfile.ReadError:
        # Not an archive at all, or one that is cut off.
        if raw[257:262] == b"ustar":
            return "error", {}
    except (tarfile.TarError, EOFError, OSError):
        return "error", {}
    text = _text(raw)
    return ("tex", {"main.tex": text}) if "\\documentclass" in text or "\\begin{document}" in text else ("error", {})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """arxiv_id (the file's name), kind, tex_files (map) of each archive of a folder."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                kind, files = unpack(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([kind]), pa.array([list(files.items())], pa.map_(pa.string(), pa.string()))], names=["arxiv_id", "kind", "tex_files"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.tar)?(?:\.gz)?$", 1).alias("arxiv_id"), "content")
    return files.mapInArrow(unpacked, "arxiv_id string, kind string, tex_files map<string,string>")
