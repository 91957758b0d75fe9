"""Lines of text files with their place, as a table or a stream.

`seq` is the file's number of arrival and the byte at which the line starts, so it orders lines as they came, however
the files are cut up: a file larger than a split is read by several tasks. A stream writes down the files it has
found, in the order in which it found them, in a `log` folder in shared storage; an offset is a number of files in that log, so a
restart reads the same lines under the same numbers, and no file is missed whatever its time. Files have to be
complete when they appear (renamed into the folder) and are not changed after.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bits of `seq` for the place in a file; the others count files.
PLACE_BITS = 36
SPLIT_BYTES = 64 << 20
_BATCH_LINES = 10_000
_SCHEMA = pa.schema([("value", pa.string()), ("timestamp", pa.timestamp("us", tz="UTC")), ("seq", pa.int64())])


@dataclass(frozen=True)
class _File:
    path: str
    size: int
    modified_us: int


@dataclass
class _Split(InputPartition):
    path: str
    number: int
    modified_us: int
    start: int
    end: int


def _storage(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _files(uri: str) -> list[_File]:
    """The files of a folder, or one file, by time and name; hidden ones are left out."""
    storage, path = _storage(uri)
    info = storage.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else storage.get_file_info(fs.FileSelector(path))
    whole = [f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._"]
    return sorted((_File(f.path, f.size, (f.mtime_ns or 0) // 1000) for f in whole), key=lambda f: (f.modified_us, f.path))


def _splits(files: list[_File], first: int, split_bytes: int) -> list[_Split]:
    return [
        _Split(file.path, number, file.modified_us, start, min(start + split_bytes, file.size))
        for number, file in enumerate(files, first)
        for start in range(0, file.size, split_bytes)
    ]


def _lines(uri: str, split: _Split) -> Iterator[pa.RecordBatch]:
    """The lines that start inside a split."""
    storage, _ = _storage(uri)
    values, places = [], []

    def batch() -> pa.RecordBatch:
        times = pa.array([split.modified_us] * len(values), pa.int64()).cast(_SCHEMA.field(1).type)
        numbers = pa.array([split.number << PLACE_BITS | place for place in places], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), times, numbers], schema=_SCHEMA)

    with storage.open_input_file(split.path) as opened, io.BufferedReader(opened, 1 << 20) as file:
        at = split.start
        if at:  # what is before the first end of a line belongs to the split before
            file.seek(at - 1)
            at += len(file.readline()) - 1
        while at < split.end and (line := file.readline()):
            values.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
            places.append(at)
            at += len(line)
            if len(values) == _BATCH_LINES:
                yield batch()
                values, places = [], []
    if values:
        yield batch()


class _Table(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int):
        self._uri, self._split_bytes = uri, split_bytes

    def partitions(self) -> list[_Split]:
        return _splits(_files(self._uri), 0, self._split_bytes)

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return _lines(self._uri, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str, split_bytes: int, log: str):
        self._uri, self._split_bytes = uri, split_bytes
        self._storage, self._log = _storage(log)
        self._storage.create_dir(self._log, recursive=True)
        self._known: list[_File] = []
        self._read_log()

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        known = {file.path for file in self._known}
        new = [file for file in _files(self._uri) if file.path not in known]
        if new:
            # a page appears whole, under the number of its first file
            page = f"{self._log}/{len(self._known):012d}.json"
            with self._storage.open_output_stream(f"{self._log}/_new") as out:
                out.write("\n".join(json.dumps(asdict(file)) for file in new).encode())
            self._storage.move(f"{self._log}/_new", page)
            self._known += new
        return {"files": len(self._known)}

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        return _splits(self._known[start["files"] : end["files"]], start["files"], self._split_bytes)

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return _lines(self._uri, partition)

    def commit(self, end: dict) -> None:
        pass

    def _read_log(self) -> None:
        pages = [f.path for f in self._storage.get_file_info(fs.FileSelector(self._log)) if f.base_name.endswith(".json")]
        for page in sorted(pages):
            with self._storage.open_input_stream(page) as file:
                self._known += [_File(**json.loads(line)) for line in file.read().decode().splitlines()]

    def __getstate__(self) -> dict:
        # tasks read splits and need neither the log nor the files known
        return {"_uri": self._uri, "_split_bytes": self._split_bytes}


class LinesSource(DataSource):
    """Format `lines`: options `path`, `split_bytes` and, for streams, `log`."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return "value string, timestamp timestamp, seq bigint"

    def _split_bytes(self) -> int:
        return int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.options["path"], self._split_bytes())

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "log" not in self.options:
            raise ValueError("a stream of lines needs the option log, a folder of its own in shared storage")
        return _Stream(self.options["path"], self._split_bytes(), self.options["log"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)
