"""The `mp4` data source: spark.read.format("mp4") and df.write.format("mp4"), and a stream sink of fragments.

Reading gives the boxes of a file, or of all .mp4 files under a directory, that executors can open as local or mounted
paths, one partition for each file; kinotable.sources.media.decode makes tracks and samples of them. For other stores use
kinotable.sources.media.read. Writing takes rows (file, content), as mux() makes them, and puts each file in
its place only when its task ends.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from kinotable.sources import boxes


@dataclass
class _File(InputPartition):
    path: str


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _local(options["path"])

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(at, n)) for at, _, names in sorted(os.walk(self.path)) for n in sorted(names) if n.endswith(".mp4")]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from boxes._walk(partition.path, memoryview(f.read(boxes.MAX_BYTES + 1)))


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Files:
    """Writes rows (file, content) beside their places, and puts them there on commit."""

    def __init__(self, options: dict, overwrite: bool = True):
        self.path, self.overwrite = _local(options["path"]), overwrite

    def write(self, rows) -> _Written:
        done = []
        for row in rows:
            name = os.path.normpath(row["file"])
            if name.startswith("..") or os.path.isabs(name):
                raise ValueError(f"a file must lie within the output path: {row['file']}")
            to = os.path.join(self.path, name if name.endswith(".mp4") else f"{name}.mp4")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(bytes(row["content"]))
            done.append((part, to))
        return _Written(done)

    def _commit(self, messages) -> None:
        found = [x for m in messages if m for x in m.files]
        if not self.overwrite and any(os.path.exists(to) for _, to in found):
            self._abort(messages)
            raise FileExistsError(self.path)
        for part, to in found:
            os.replace(part, to)

    def _abort(self, messages) -> None:
        for part, _ in (x for m in messages if m for x in m.files):
            if os.path.exists(part):
                os.remove(part)


class _Writer(_Files, DataSourceWriter):
    def commit(self, messages) -> None:
        self._commit(messages)

    def abort(self, messages) -> None:
        self._abort(messages)


class _StreamWriter(_Files, DataSourceStreamWriter):
    """Appends rows (file, sequence, content) as <file>/<sequence>.m4s; a repeated batch writes the same files."""

    def write(self, rows) -> _Written:
        return super().write({"file": f"{r['file']}/{r['sequence']:09d}.m4s.mp4", "content": r["content"]} for r in rows)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self._commit(messages)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class Mp4DataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return boxes.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mp4DataSource)
