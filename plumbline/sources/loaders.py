"""Source loaders as a data source of Spark's: files in byte ranges, filters and a limit that reach the reader, a hook a suite."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

FORMAT = "suite-lines"
SCHEMA = "suite string, id long, split string, source string, expected string, text string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
ARROW = pa.schema([(n, pa.int64() if n == "id" else pa.string()) for n in FIELDS])

#: How a suite makes a record of a raw line: a dictionary with the fields of the schema, or None to leave the line out.
HOOKS: dict[str, Callable[[dict], dict | None]] = {}


def to_record(suite: str):
    """Registers a suite's hook; a suite has one."""

    def keep(f):
        if suite in HOOKS:
            raise ValueError(f"suite {suite} has a hook")
        HOOKS[suite] = f
        return f

    return keep


@to_record("plain")
def plain(raw: dict) -> dict | None:
    return {n: raw.get(n) for n in FIELDS if n != "suite"}


@to_record("labelled")
def labelled(raw: dict) -> dict | None:
    """Rows with a label alone; yes and no in small letters."""
    return plain(raw) | {"expected": raw["expected"].lower()} if raw.get("expected") else None


@to_record("prompts")
def prompts(raw: dict) -> dict | None:
    """The first line of a text is the prompt."""
    return plain(raw) | {"text": raw["text"].split("\n", 1)[0]} if raw.get("text") else None


def opened(path: str):
    store, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
    return store, at


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class LinesReader(DataSourceReader):
    """Reads the lines that begin in a byte range of a file; conditions of equality and the limit stop rows here."""

    def __init__(self, options: dict[str, str]):
        self.suite, self.path = options.get("suite", "plain"), options["path"]
        self.limit = int(options["limit"]) if "limit" in options else None
        self.size = int(options.get("rangebytes", options.get("rangeBytes", 32 << 20)))
        self.equal: dict[str, object] = {}
        if self.suite not in HOOKS:
            raise KeyError(f"no suite {self.suite}; there are {', '.join(sorted(HOOKS))}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FIELDS and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f  # Spark checks it

    def partitions(self) -> list[Range]:
        store, at = opened(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        prefix = "" if self.path.startswith(("file:", "/")) else self.path.split("://", 1)[0] + "://"
        ranges = [Range(prefix + p, b, min(b + self.size, n)) for p, n in files for b in range(0, n, self.size)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        hook, rows, given = HOOKS[self.suite], [], 0
        for line in lines(partition):
            record = hook(json.loads(line)) if line.strip() else None
            if record is None:
                continue
            record = {"suite": self.suite, **record}
            if any(record.get(k) != v for k, v in self.equal.items()):
                continue
            rows.append({n: record.get(n) for n in FIELDS})
            given += 1
            if len(rows) == 1024 or given == self.limit:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows = []
            if given == self.limit:
                return
        yield pa.RecordBatch.from_pylist(rows, ARROW)


def lines(partition: Range) -> Iterator[bytes]:
    """The lines that begin in a range: of those that go over its end the whole, of the one before its begin nothing."""
    if not partition.path:
        return
    store, at = opened(partition.path)
    with store.open_input_file(at) as f:
        begin = partition.begin
        if begin:  # a line begins here only if a newline stands before
            f.seek(begin - 1)
            rest = b""
            while (piece := f.read(1 << 16)) and b"\n" not in piece:
                begin += len(piece)
            rest = piece
            if not rest:
                return
            begin += rest.index(b"\n")
        f.seek(begin)
        held, place = b"", begin
        while place < partition.end or held:
            piece = f.read(1 << 20)
            held += piece
            *whole, tail = held.split(b"\n")
            for line in whole:
                if place >= partition.end:
                    return
                yield line
                place += len(line) + 1
            held = tail
            if not piece:
                if held and place < partition.end:
                    yield held
                return
            if place >= partition.end:
                return


class SuiteLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


def load(spark: SparkSession, suite: str, path: str, limit: int | None = None, range_bytes: int = 32 << 20) -> DataFrame:
    """A suite's records out of the lines of JSON below ``path``: as many partitions as the files have ranges of
    ``range_bytes``; conditions of equality on columns are checked as lines are read, and each partition stops at ``limit``.

    Files are opened by the tasks (local and shared folders, HDFS, S3, GCS). Blank lines are passed over; a line that is no
    JSON fails, a field that is missing is null; a folder without files has no rows."""
    spark.dataSource.register(SuiteLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"suite": suite, "rangeBytes": str(range_bytes)} | ({} if limit is None else {"limit": str(limit)})
    rows = spark.read.format(FORMAT).options(**options).load(path)
    return rows if limit is None else rows.limit(limit)
