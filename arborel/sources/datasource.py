"""spark.read.format("arborel_xml"): files straight to one typed table.

Options: path (a folder, file or glob), mapping (YAML text) or mapping_file,
table (default: the first with columns), extension (default ".xml", folders).
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.quick import typed
from ..operators.shred import BATCH, Reader, texts_of
from ..plans.mapping import Mapping
from ..plans.program import compile_mapping
from ..shipping import ensure


#: Bytes of the files that one partition reads, but for a larger file.
TOGETHER = 8 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str], uri: str):
        self.paths, self.uri = paths, uri


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else posixpath.abspath(uri))


def listed(uri: str, extension: str) -> list[tuple[str, int]]:
    """Files, with their sizes, of a folder (recursively, by extension), of a glob, or the file itself."""
    head = uri
    while any(c in head for c in "*?["):
        head = posixpath.dirname(head)
    filesystem, base = _open(head)
    if head != uri:
        _, pattern = _open(head.rstrip("/") + "/")[0], base.rstrip("/") + uri[len(head) :]
        found = filesystem.get_file_info(pafs.FileSelector(base, recursive=True))
        return sorted((f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.path, pattern))
    info = filesystem.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [(base, info.size or 0)]
    found = filesystem.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size or 0) for f in found if f.type == pafs.FileType.File and f.path.endswith(extension))


class XmlSource(DataSource):
    """The data source; a file is read whole, small ones together in one partition."""

    @classmethod
    def name(cls) -> str:
        return "arborel_xml"

    def _mapping(self) -> Mapping:
        return Mapping.from_yaml_file(self.options["mapping_file"]) if "mapping_file" in self.options else Mapping.from_yaml_text(self.options["mapping"])

    def _table(self) -> str:
        return self.options.get("table") or next(t.name for t in self._mapping().tables if t.fields)

    def schema(self) -> StructType:
        return self._mapping().table(self._table()).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return XmlReader(self._mapping(), self._table(), self.options["path"], self.options.get("extension", ".xml"))


class XmlReader(DataSourceReader):
    def __init__(self, mapping: Mapping, table: str, path: str, extension: str):
        self.mapping, self.table, self.path, self.extension = mapping, table, path, extension

    def partitions(self) -> list[InputPartition]:
        groups, held = [], TOGETHER
        for path, size in listed(self.path, self.extension):
            if held + size > TOGETHER:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g, self.path) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        program = compile_mapping(self.mapping)
        plan = next(p for p in program.plans if p.table.name == self.table)
        head = partition.uri
        while any(c in head for c in "*?["):
            head = posixpath.dirname(head)
        filesystem, _ = _open(head)
        documents = []
        for path in partition.paths:
            with filesystem.open_input_stream(path) as file:
                documents.append(file.read())
        data, offsets = np.frombuffer(b"".join(documents), np.uint8), np.cumsum([0, *map(len, documents)])
        names = [f.name for f in plan.table.schema()]
        for _, whose, _, levels, cells in Reader(program, [plan]).rows(data, offsets):
            levels = [*levels, *[np.zeros(len(whose), np.int64)] * (len(plan.table.levels) - plan.levels)]
            for a in range(0, len(whose), BATCH):
                part = [pa.array(x[a : a + BATCH], pa.int64()) for x in levels] + [typed(f, texts_of(c.slice(a, BATCH), f)) for c, f in zip(cells, plan.table.fields, strict=True)]
                yield pa.RecordBatch.from_arrays(part, names=names)


def register(spark: SparkSession) -> None:
    ensure(spark).dataSource.register(XmlSource)
