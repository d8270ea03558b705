"""Logs that are appended to, as a batch and as a stream: hook events and numstat lines.

Spark's file source takes each file once; a log goes on growing after it was read. The
source ``appended_lines`` reads the lines of all files below a folder, each with its file and
the byte at which it begins, which name it for good. Its offset in a stream is, for each
file, the end of the last whole line, so a restart from a checkpoint loses and repeats
nothing, and a line that is still being written waits for its end. Ranges of files are
partitions: a line belongs to the range in which it begins.

Options: ``path`` (a folder or URI that pyarrow and all executors know), ``pattern`` (of names, ``*``), ``rangeBytes``
(of a partition, 64 MiB). A batch also takes a last line that has no end. Lines end with ``\\n`` or
``\\r\\n``; bytes that are no UTF-8 are replaced. Hidden files (``.``, ``_``) are left out. A file that is
removed ends its part of the stream, and one of its name begins a new one; a file that got
shorter than what was read of it raises, as nobody can tell which lines it lost. An offset names
every file, so closed logs, when they are many, belong elsewhere.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from memspan.sources import parsers

NAME = "appended_lines"
RANGE_BYTES = 64 << 20
#: Bytes of lines in one batch of rows, and bytes that are looked at at once for the end of a line.
BATCH_BYTES, LOOK_BYTES = 4 << 20, 64 << 10
SHAPE = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string())])


@dataclass
class Range(InputPartition):
    """Lines of ``file`` that begin at ``start`` or later and before ``end``; no byte from ``stop`` on is read."""

    file: str
    start: int
    end: int
    stop: int
    first: bool  # whether a line begins at ``start`` for certain

    def __init__(self, file: str, start: int, end: int, stop: int, first: bool):
        super().__init__((file, start))
        self.file, self.start, self.end, self.stop, self.first = file, start, end, stop, first


class Logs:
    """The files below a folder; what readers have in common."""

    def __init__(self, options: Mapping[str, str]):
        if not options.get("path"):
            raise ValueError("appended_lines needs a path")
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.range_bytes = int(options.get("rangeBytes", options.get("rangebytes", RANGE_BYTES)))
        if self.range_bytes < 1:
            raise ValueError("rangeBytes must be positive")

    def opened(self) -> tuple[stores.FileSystem, str]:
        return stores.FileSystem.from_uri(self.path) if ":" in self.path else (stores.LocalFileSystem(), self.path)

    def sizes(self) -> dict[str, int]:
        store, root = self.opened()
        found = store.get_file_info(stores.FileSelector(root, recursive=True, allow_not_found=True))
        shown = [i for i in found if i.is_file and not i.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(i.base_name, self.pattern)]
        return {i.path: i.size for i in shown}

    def whole(self, file: str, size: int, known: int) -> int:
        """The end of the last whole line, looked for from the file's end back to what is known."""
        store, _ = self.opened()
        with store.open_input_file(file) as log:
            while size > known:
                begin = max(known, size - LOOK_BYTES)
                found = log.read_at(size - begin, begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                size = begin
        return known

    def ranges(self, file: str, start: int, stop: int) -> list[Range]:
        cuts = range(start, stop, self.range_bytes)
        return [Range(file, cut, min(cut + self.range_bytes, stop), stop, cut == start) for cut in cuts]

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = self.opened()
        with io.BufferedReader(store.open_input_file(part.file), LOOK_BYTES) as log:
            if part.first:
                log.seek(part.start)
            else:  # a line begins here if one ends just before
                log.seek(part.start - 1)
                while (piece := log.readline(LOOK_BYTES)) and not piece.endswith(b"\n"):
                    if log.tell() > part.end:
                        return
            places, texts, held = [], [], 0
            while (at := log.tell()) < part.end:
                line = log.readline(part.stop - at)
                if not line:
                    break
                places.append(at)
                texts.append(line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                held += len(line)
                if held >= BATCH_BYTES:
                    yield self.batch(part.file, places, texts)
                    places, texts, held = [], [], 0
            if places:
                yield self.batch(part.file, places, texts)

    @staticmethod
    def batch(file: str, places: list[int], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=SHAPE)


class LinesReader(DataSourceReader):
    def __init__(self, logs: Logs):
        self.logs = logs

    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(self.logs.sizes().items()) for r in self.logs.ranges(file, 0, size)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return self.logs.lines(partition) if partition else iter(())


class LinesStream(DataSourceStreamReader):
    """Offsets are the end of what was read of each file."""

    def __init__(self, logs: Logs):
        self.logs, self.seen = logs, {}

    def initialOffset(self) -> dict[str, int]:  # noqa: N802 - names that Spark calls
        return {}

    def latestOffset(self) -> dict[str, int]:  # noqa: N802
        sizes = self.logs.sizes()
        for file, size in sizes.items():
            if size < self.seen.get(file, 0):
                raise RuntimeError(f"{file} has {size} bytes, of which {self.seen[file]} were read")
        self.seen = {file: self.logs.whole(file, size, self.seen.get(file, 0)) for file, size in sorted(sizes.items())}
        return self.seen

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for file, stop in sorted(end.items()):
            if stop < start.get(file, 0):
                raise RuntimeError(f"{file} has whole lines up to byte {stop}, and was read up to {start[file]}")
            out += self.logs.ranges(file, start.get(file, 0), stop)
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return self.logs.lines(partition) if partition else iter(())


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(Logs(self.options))

    def streamReader(self, schema: StructType) -> LinesStream:  # noqa: N802
        return LinesStream(Logs(self.options))


def lines(spark: SparkSession, path: str, stream: bool = False, **options: object) -> DataFrame:
    """``file, at, line`` of all logs below a folder."""
    spark.dataSource.register(AppendedLines)
    reader = spark.readStream if stream else spark.read
    return reader.format(NAME).options(**options).load(path)


def number_of(name: Column) -> Column:
    """A session's number: its name if that is one, else a hash of it."""
    return F.coalesce(name.try_cast("bigint"), F.when(name.isNotNull(), F.xxhash64(name)))


def hook_log(logged: DataFrame) -> DataFrame:
    """Events ``id, session_id, project, ts_us, hook, data`` of logged lines, one JSON object each, as ingest takes them.

    An event's id is a hash of where it was logged, so it is the same each time it is read.
    Blank lines and lines that are no JSON object tell no event.
    """
    posted = logged.withColumn("_event", F.from_json("line", parsers.HOOK_SCHEMA, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "mode": "PERMISSIVE"}))
    told = posted.where("_event is not null and coalesce(_event.hookType, _event.hook_type) is not null")
    events = told.select(F.xxhash64("file", "at").alias("id"), "_event.*")
    hook = F.coalesce("hookType", "hook_type")
    return events.select("id", number_of(F.coalesce("sessionId", "session_id")).alias("session_id"), F.coalesce("project", "cwd").alias("project"), F.unix_micros("timestamp").alias("ts_us"), hook.alias("hook"), F.coalesce("data", F.lit("{}")).alias("data"))


def numstat_log(logged: DataFrame) -> DataFrame:
    """``sha, insertions, deletions, path`` of logged lines ``sha <tab> insertions <tab> deletions <tab> path``; ``-`` counts as 0, other lines tell nothing."""
    parts = F.split("line", "\t", 4)
    count = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
    return logged.where(F.size(parts) == 4).select(F.get(parts, F.lit(0)).alias("sha"), count(1).alias("insertions"), count(2).alias("deletions"), F.get(parts, F.lit(3)).alias("path"))
