"""Result trees and growing event logs as data sources with partitions of their own.

`result_tree` reads <root>/<stage>/<task>/<file>. Filters on stage and task reach the listing: `stage = 'x'` and `task_id IN (...)` open no other
folder. The driver lists stages and tasks; the files of a task's folder are listed and read where the rows are made.

`event_log` follows logs that grow. Spark's own file streams read a file once, when it appears; here an offset says of every file up to which byte it
has been read, always just after a line's end, so a line that is still being written waits for the batch in which it is whole. Ranges of bytes of an append-only
file can be read again, so a query that restarts from its checkpoint neither loses nor repeats a line. The offset has an entry for each file present:
a log that is taken away after it has been read leaves it, one that has become shorter stops the query, and one that vanishes between offset and reading does too.

Files are opened through the file system that their URI names, as for large artifacts.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull

#: Task folders of one partition; bytes of a log that one partition reads; lines of one batch; bytes looked at once for the last line's end.
FOLDERS, SLICE, LINES, TAIL = 64, 64 << 20, 4096, 64 << 10
TREE = "path string, stage string, task_id string, value string"
LOG = "path string, at long, value string"


def located(path: str):
    """The file system of a path and the path inside it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path.split("/")[0] else "file://" + path)


def listed(system, folder: str, kind, recursive: bool = False) -> list:
    """The entries of a folder, without the hidden ones that writers leave; none if there is no such folder."""
    found = system.get_file_info(fs.FileSelector(folder, recursive=recursive, allow_not_found=True))
    return sorted((f for f in found if f.type == kind and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


@dataclass
class Folders(InputPartition):
    """Task folders, each as stage, task and path."""

    folders: list


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Takes equality and membership of stage and task; neither is ever null."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if name not in ("stage", "task_id"):
                yield f
            elif not isinstance(f, IsNotNull):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values

    def _inside(self, system, folder: str, name: str) -> list:
        """Folders of the wanted names: looked up one by one if the names are given, else listed."""
        if name not in self.wanted:
            return listed(system, folder, fs.FileType.Directory)
        plain = sorted(x for x in self.wanted[name] if x and "/" not in x and not x.startswith(("_", ".")))
        found = system.get_file_info([f"{folder}/{x}" for x in plain]) if plain else []
        return [f for f in found if f.type == fs.FileType.Directory]

    def partitions(self):
        system, root = located(self.root)
        found = [(s.base_name, t.base_name, t.path) for s in self._inside(system, root.rstrip("/"), "stage") for t in self._inside(system, s.path, "task_id")]
        # An empty list would give a partition without folders to ask for.
        return [Folders(found[i : i + FOLDERS]) for i in range(0, len(found) or 1, FOLDERS)]

    def read(self, partition):
        system, _ = located(self.root)
        for stage, task, folder in partition.folders:
            for f in listed(system, folder, fs.FileType.File):
                with system.open_input_stream(f.path) as stream:
                    content = stream.read()
                try:
                    value = content.decode()
                except UnicodeDecodeError:
                    value = None
                yield f.path, stage, task, value


class ResultTree(DataSource):
    @classmethod
    def name(cls):
        return "result_tree"

    def schema(self):
        return TREE

    def reader(self, schema):
        return TreeReader(self.options["path"])


@dataclass
class Bytes(InputPartition):
    """The lines of a file that begin in [start, end); `first` says that a line begins at `start`."""

    path: str
    start: int
    end: int
    first: bool


def line_end(system, path: str, size: int) -> int:
    """The place after the last line's end before `size`; 0 if there is none."""
    with system.open_input_file(path) as f:
        while size > 0:
            begin = max(0, size - TAIL)
            f.seek(begin)
            at = f.read(size - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            size = begin
    return 0


class LogReader(DataSourceStreamReader):
    def __init__(self, root: str, slice_bytes: int):
        self.root, self.slice_bytes = root, slice_bytes
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        """Only files whose size has changed since the last call are opened."""
        system, root = located(self.root)
        now = {}
        for f in listed(system, root.rstrip("/"), fs.FileType.File, recursive=True):
            size, end = self.seen.get(f.path, (-1, 0))
            now[f.path] = (f.size, end if f.size == size else line_end(system, f.path, f.size))
        self.seen = now
        return {path: end for path, (_, end) in now.items() if end}

    def partitions(self, start, end):
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:
                raise ValueError(f"{path} has become shorter: {begin} bytes were read, and its lines now end at {stop}")
            out += [Bytes(path, a, min(a + self.slice_bytes, stop), a == begin) for a in range(begin, stop, self.slice_bytes)]
        return out

    def read(self, partition):
        system, _ = located(self.root)
        with system.open_input_file(partition.path) as raw:
            raw.seek(partition.start if partition.first else partition.start - 1)
            lines = io.BufferedReader(raw, 1 << 20)
            # A slice that may begin inside a line leaves that line to the slice before it.
            at = partition.start if partition.first else partition.start - 1 + len(lines.readline())
            starts, values = [], []
            while at < partition.end:
                line = lines.readline()
                if not line:
                    raise ValueError(f"{partition.path} ends at {at}; it was read up to {partition.end} before")
                starts.append(at)
                values.append(line.rstrip(b"\r\n").decode(errors="replace"))
                at += len(line)
                if len(starts) == LINES or at >= partition.end:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(starts)), pa.array(starts, pa.int64()), pa.array(values)], names=["path", "at", "value"])
                    starts, values = [], []


class EventLog(DataSource):
    @classmethod
    def name(cls):
        return "event_log"

    def schema(self):
        return LOG

    def streamReader(self, schema):
        return LogReader(self.options["path"], int(self.options.get("slicebytes", SLICE)))


def result_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, stage, task_id and `doc` of a tree of JSON documents; an unreadable one has a null `doc`. Filters on stage and task open only their folders; for this the session's setting for filters of Python sources is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultTree)
    rows = spark.read.format("result_tree").load(path)
    doc = F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return rows.withColumn("d", doc).select("path", "stage", "task_id", F.when(F.col("d._broken").isNull(), F.col("d").dropFields("_broken")).alias("doc"))


def follow_events(spark: SparkSession, path: str, schema: str, strict: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """A stream of the events of all logs under a folder, lines that are appended later included, with the file and the byte at which each line begins as `log` and `at`. Blank lines fall out; malformed ones are dropped, or with `strict` an error."""
    spark.dataSource.register(EventLog)
    lines = spark.readStream.format("event_log").option("slicebytes", slice_bytes).load(path).filter(F.trim("value") != "")
    if strict:
        return lines.select(F.col("path").alias("log"), "at", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("log", "at", "e.*")
    parsed = lines.withColumn("e", F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return parsed.filter("e._broken IS NULL").select(F.col("path").alias("log"), "at", F.col("e").dropFields("_broken").alias("e")).select("log", "at", "e.*")
