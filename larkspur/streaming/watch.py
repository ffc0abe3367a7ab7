"""A folder as a stream of changes: files created, changed and removed, with the contents of those that are there.

The source's offset is the number of a listing (path, size, time of each file), which is kept as a file below the stream's own folder; a batch is what differs between
two listings. The driver lists and writes; a task finds the differences of its part of the paths, by a hash, and reads those files. A batch that runs again finds the
same differences. Listings before the last one that was committed are removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

FORMAT = "folder_changes"
SCHEMA = "path string, change string, modified timestamp, file_size long, content binary"
PARTITIONS = 8
_listing = pa.schema([("path", pa.string()), ("size", pa.int64()), ("time", pa.timestamp("us", "UTC"))])
_rows = pa.schema([("path", pa.string()), ("change", pa.string()), ("modified", pa.timestamp("us", "UTC")), ("file_size", pa.int64()), ("content", pa.binary())])
#: What a task hands on at once.
READ_ROWS, READ_BYTES = 1000, 16 << 20


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), f.type) for column, f in zip(zip(*rows), _rows)], schema=_rows)


def _open(uri: str) -> tuple[pa.fs.FileSystem, str, str]:
    """(file system, path in it, what stands before paths in names): a path without a scheme is a local one."""
    import pyarrow.fs  # where it is used: it starts threads, which a process that forks workers should not have

    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri.rstrip("/"), "file:"
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/").rstrip("/"), "file:"
    fs, path = pa.fs.FileSystem.from_uri(uri)
    path = path.rstrip("/")
    return fs, path, uri.rstrip("/").removesuffix(path)


def listing(uri: str) -> pa.Table:
    """Path, size and time of each file below a folder, by path; names that begin with a dot or an underscore are left out."""
    fs, path, before = _open(uri)
    found = fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True, recursive=True))
    files = [f for f in found if f.is_file and not any(part[:1] in "._" for part in f.path.removeprefix(path).strip("/").split("/"))]
    files.sort(key=lambda f: f.path)
    return pa.table([[before + f.path for f in files], [f.size for f in files], [f.mtime for f in files]], schema=_listing)


class _Part(InputPartition):
    def __init__(self, start: int, end: int, part: int):
        self.start, self.end, self.part = start, end, part


class FolderReader(DataSourceStreamReader):
    def __init__(self, path: str, state: str):
        self.path, self.state = path, state.rstrip("/")

    def _name(self, n: int) -> str:
        return f"{_open(self.state)[1]}/listing-{n:09d}.parquet"

    def _read(self, n: int) -> pa.Table:
        from pyarrow.parquet import read_table

        return _listing.empty_table() if n < 0 else read_table(self._name(n), filesystem=_open(self.state)[0])

    def _last(self) -> int:
        fs, path, _ = _open(self.state)
        names = [f.base_name for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("listing-") and f.base_name.endswith(".parquet")]
        return max((int(n[8:17]) for n in names), default=-1)

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        """The number of the last listing; of a new one, if anything differs from that."""
        from pyarrow.parquet import write_table

        last, now = self._last(), listing(self.path)
        if not now.equals(self._read(last)):
            fs, path, _ = _open(self.state)
            fs.create_dir(path, recursive=True)
            last += 1
            write_table(now, self._name(last) + ".new", filesystem=fs)
            fs.move(self._name(last) + ".new", self._name(last))
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(start["listing"], end["listing"], p) for p in range(PARTITIONS)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        """Changes in batches of READ_ROWS rows and about READ_BYTES of contents: many files are never held at once."""
        held, size = [], 0
        for row in self._changes(partition):
            held.append(row)
            size += row[3] or 0
            if len(held) >= READ_ROWS or size >= READ_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _changes(self, partition: _Part) -> Iterator[tuple]:
        mine = lambda t: {p: (s, at) for p, s, at in zip(*(t.column(c).to_pylist() for c in ("path", "size", "time"))) if zlib.crc32(p.encode()) % PARTITIONS == partition.part}
        old, new = mine(self._read(partition.start)), mine(self._read(partition.end))
        fs, _, before = _open(self.path)
        for path in sorted(old.keys() | new.keys()):
            if old.get(path) == new.get(path):
                continue
            change = "created" if path not in old else "removed" if path not in new else "changed"
            if change != "removed":
                try:
                    content = fs.open_input_stream(path.removeprefix(before)).read()
                except FileNotFoundError:  # it has gone since; the next listing tells
                    continue
                yield path, change, new[path][1], new[path][0], content
            else:
                yield path, change, None, None, None

    def commit(self, end: dict) -> None:
        fs, path, _ = _open(self.state)
        for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith("listing-") and f.base_name.endswith(".parquet") and int(f.base_name[8:17]) < end["listing"]:
                fs.delete_file(f.path)


class FolderChanges(DataSource):
    """Options: ``path``, the folder; ``state``, where listings are kept."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options["state"])


def watch(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], seconds: float | None = None) -> StreamingQuery:
    """Start a stream of a folder's changes; ``each`` gets a batch (SCHEMA) and its number. Without ``seconds`` it ends when it has what is there now."""
    spark.dataSource.register(FolderChanges)
    stream = spark.readStream.format(FORMAT).option("path", folder).option("state", f"{checkpoint.rstrip('/')}/listings").load()
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def finished(query: StreamingQuery, seconds: float = 600) -> None:
    """Wait for a stream that ends by itself; an error if it has not ended in time."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream has not ended in {seconds} seconds")
