"""Prompts of a published dataset as a Spark data source: Parquet files at a pinned revision, read by row groups from any position.

    spark.dataSource.register(PinnedPrompts)
    spark.read.format("pinned_prompts").options(path=..., revision=..., start=0).load()

A revision is the digest of the files' names, sizes and footers, so that planning reads no rows; another one than the pinned is an
error, as positions would not mean the same rows. A row's position counts the rows of all files in the order of their names.
A partition is one row group; one that lies wholly before ``start`` is not read, so an interrupted scan goes on where it stopped.
Only the columns asked for are read. The path is one that Arrow opens: local, or a URI of an object store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = "pos bigint, key bigint, text string, domain string"
BATCH_ROWS = 1024


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[fs.FileInfo]:
    """The Parquet files of a file or folder, by name; a missing path is an error."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._"), key=lambda f: f.path)


def revision(path: str) -> str:
    """The digest of all files' names, sizes and footers."""
    system, at = opened(path)
    digest = hashlib.sha256()
    for f in files(path):
        with system.open_input_file(f.path) as data:
            data.seek(max(0, f.size - 8))
            tail = data.read()
            data.seek(max(0, f.size - 8 - int.from_bytes(tail[:4], "little")))
            digest.update(f"{f.path[len(at) :]}\0{f.size}\0".encode() + hashlib.sha256(data.read()).digest())
    return digest.hexdigest()


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    first: int


class PromptReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("pinned_prompts needs a path")
        self.path, self.pinned, self.start = options["path"], options.get("revision"), int(options.get("start", 0))
        self.columns = {"key": options.get("key", "key"), "text": options.get("text", "text"), "domain": options.get("domain", "")}

    def partitions(self) -> list[RowGroup]:
        """The row groups with rows from start on; checks the revision first."""
        if not self.pinned:
            raise ValueError(f"no revision is pinned; the present one is {revision(self.path)}")
        if (now := revision(self.path)) != self.pinned:
            raise ValueError(f"the dataset is at revision {now}, pinned is {self.pinned}")
        system, _ = opened(self.path)
        out, first = [], 0
        for f in files(self.path):
            with system.open_input_file(f.path) as data:
                about = pq.ParquetFile(data).metadata
            for group in range(about.num_row_groups):
                n = about.row_group(group).num_rows
                if n and first + n > self.start:
                    out.append(RowGroup(f.path, group, first))
                first += n
        return out

    def read(self, part: RowGroup | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            # a scan without row groups
            return
        system, _ = opened(self.path)
        names = [c for c in self.columns.values() if c]
        with system.open_input_file(part.path) as data:
            first = part.first
            for batch in pq.ParquetFile(data).iter_batches(BATCH_ROWS, row_groups=[part.group], columns=names):
                n, skip = batch.num_rows, max(0, self.start - first)
                if skip < n:
                    of = lambda c: batch.column(c) if c else pa.nulls(n)  # noqa: B023, E731
                    cast = [pa.array(range(first, first + n), pa.int64()), of(self.columns["key"]).cast(pa.int64()), of(self.columns["text"]).cast(pa.string()), of(self.columns["domain"]).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cast, names=["pos", "key", "text", "domain"]).slice(skip)
                first += n


class PinnedPrompts(DataSource):
    """Options: path, revision, start (0), and the names of the columns key, text and domain (empty: null)."""

    @classmethod
    def name(cls) -> str:
        return "pinned_prompts"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PromptReader:
        return PromptReader(self.options)
