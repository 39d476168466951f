"""A streaming source over logs that grow: JSON lines or text that is appended to files of a folder.

An offset is the length of every file up to its last line's end, so a line is read once, when it is whole, and a
stream goes on from its checkpoint. A file that was cut or replaced by a shorter one is read from its beginning.
Paths are of any file system that pyarrow opens by its URI.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task, and those that are looked through at once for a line's end.
STEP, BACK = 64 << 20, 1 << 16


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _line_end(files: fs.FileSystem, path: str, size: int, least: int = 0) -> int:
    """Where the last whole line of the first size bytes ends."""
    with files.open_input_file(path) as f:
        while size > least:
            begin = max(least, size - BACK)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return least


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, path = _open(self.uri)
        found = [i for i in files.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
        return {i.path: _line_end(files, i.path, i.size) for i in sorted(found, key=lambda i: i.path)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Pieces of at most STEP bytes that end with a line (a longer line is a piece of its own)."""
        files, _ = _open(self.uri)
        out = []
        for path, stop in end.items():
            at = start.get(path, 0) if start.get(path, 0) <= stop else 0
            while at < stop:
                cut = stop if stop - at <= STEP else _line_end(files, path, at + STEP, at)
                if cut == at:
                    cut = self._next_line(files, path, at + STEP, stop)
                out.append(Piece(path, at, cut))
                at = cut
        return out or [Piece("", 0, 0)]

    @staticmethod
    def _next_line(files: fs.FileSystem, path: str, at: int, stop: int) -> int:
        with files.open_input_file(path) as f:
            while at < stop:
                f.seek(at)
                end = f.read(min(BACK, stop - at)).find(b"\n")
                if end >= 0:
                    return at + end + 1
                at += BACK
        return stop

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        files, _ = _open(self.uri)
        with files.open_input_file(piece.path) as f:
            f.seek(piece.start)
            at, rest = piece.start, b""
            while f.tell() < piece.end:
                lines = (rest + f.read(min(1 << 20, piece.end - f.tell()))).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    yield piece.path, at, line.decode("utf-8", "replace").rstrip("\r")
                    at += len(line) + 1


class LogTail(DataSource):
    """spark.readStream.format("log_tail").load(folder): file, at (the byte at which a line begins), line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTail)
