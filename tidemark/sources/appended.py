"""Streams of the lines that are appended to text files, which the file source, whose files never change, can't follow."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.histories import parsed


class Range(InputPartition):
    """The lines of a file that begin at `start` or behind it, before `end`; one begins at each of these."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _last_end(fs, file: str, start: int, size: int, step: int = 1 << 16) -> int:
    """Where the last whole line of the bytes from `start` on ends; `start` if there is none."""
    with fs.open_input_file(file) as f:
        at = size
        while at > start:
            low = max(start, at - step)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


class AppendedReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, part_bytes: int):
        self.path, self.pattern, self.part_bytes = path, pattern, part_bytes
        self.known: dict[str, int] = {}

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The bytes of whole lines by file. A line that is still being written waits for its end."""
        fs, root = self._fs()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        for x in sorted(found, key=lambda x: x.path):
            if x.type == pafs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern):
                done = self.known.get(x.path, 0)
                self.known[x.path] = _last_end(fs, x.path, done, x.size) if x.size > done else done
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Byte ranges of what is new; long ones are cut, wherever that falls."""
        self.known = {**end, **{k: max(v, end.get(k, 0)) for k, v in self.known.items()}}
        return [Range(file, a, min(a + self.part_bytes, stop)) for file, stop in sorted(end.items()) for a in range(start.get(file, 0), stop, self.part_bytes)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """A range's lines are those that begin in it, so a cut line is read by the range with its beginning."""
        fs, _ = self._fs()
        with fs.open_input_file(partition.file) as raw:
            if partition.start:
                raw.seek(partition.start - 1)
            at, rest = max(0, partition.start - 1), b""
            skip = partition.start > 0  # up to the first line that begins in the range
            while True:
                block = raw.read(1 << 16)
                if not block:
                    return
                rest += block
                while (cut := rest.find(b"\n")) >= 0:
                    line, begun, rest = rest[:cut], at, rest[cut + 1 :]
                    at += cut + 1
                    if skip:
                        skip = False
                    else:
                        yield partition.file, begun, line.removesuffix(b"\r").decode("utf-8", "replace")
                    if at >= partition.end:
                        return

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Format `appended_lines`: options path (a folder), pattern (of file names) and partBytes."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("partBytes", 128 << 20)))


def appended_lines(spark: SparkSession, path: str, *, pattern: str = "*", part_bytes: int = 128 << 20) -> DataFrame:
    """A stream (file, at, line) of the whole lines of a folder's files, each once, `at` being the byte where it begins.

    The place up to which each file was read is the stream's offset, so what is appended later comes later, also after a
    restart. Files only grow; a long stretch is read by many tasks. Empty folders and files give nothing.
    """
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("path", path).option("pattern", pattern).option("partBytes", part_bytes).load()


def follow_history(spark: SparkSession, path: str, schema: str, *, pattern: str = "*.jsonl", skip_malformed: bool = True, part_bytes: int = 128 << 20) -> DataFrame:
    """JSON lines as they are appended to histories, with `file` and `at`, by which a history's rows are in order."""
    return parsed(appended_lines(spark, path, pattern=pattern, part_bytes=part_bytes), schema, skip_malformed=skip_malformed)
