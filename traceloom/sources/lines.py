"""Trace lines as a Python data source: splits of files planned by size, a pushed-down program filter, a writer and a stream reader.

A file holds traces, each after a line `BEGIN {...}` with the trace's keys and the number of its first event there; events are lines
`TRACE (ENTER|EXIT|EXCEPTION) name depth=N [type]`. White space and percent signs in names are percent-encoded. A long trace
is written in stretches with a BEGIN line each, so any split of the file can begin there.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from traceloom.sources.tables import JAVA_LINE
from traceloom.sources.traces import TRACE

SCHEMA = "program_id string, run_idx int, input_idx int, seq long, event_type string, function_name string, depth int, exception_type string"
ARROW = pa.schema([("program_id", pa.string()), ("run_idx", pa.int32()), ("input_idx", pa.int32()), ("seq", pa.int64()), ("event_type", pa.string()), ("function_name", pa.string()), ("depth", pa.int32()), ("exception_type", pa.string())])
KINDS = {"ENTER": "call", "EXIT": "return", "EXCEPTION": "exception"}
WORDS = {kind: word for word, kind in KINDS.items()}
LINE = re.compile(JAVA_LINE)
SPLIT_BYTES, FILE_BYTES, STRETCH, ROWS = 32 << 20, 256 << 20, 10_000, 8192


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def encoded(name: str | None) -> str:
    """A name without white space; the empty one is a lone percent sign."""
    return re.sub(r"[%\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name or "") or "%"


def decoded(name: str) -> str:
    return "" if name == "%" else unquote(name)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def listed(root: str) -> list[pafs.FileInfo]:
    system, path = store(root)
    found = system.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((x for x in found if x.base_name.endswith(".trace") and x.base_name[0] not in "._"), key=lambda x: x.path)


def splits(files: Iterable[pafs.FileInfo], size: int) -> list[Split]:
    return [Split(x.path, at, min(at + size, x.size)) for x in files for at in range(0, x.size, size)]


def lines_from(file: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin at ``start`` or later, each with its place."""
    at = max(0, start - 1)
    file.seek(at)
    held, skip = b"", start > 0  # the byte before tells whether a line begins at ``start``
    while block := file.read(1 << 20):
        *whole, held = (held + block).split(b"\n")
        for line in whole:
            if not skip:
                yield at, line
            at, skip = at + len(line) + 1, False
    if held and not skip:
        yield at, held


def read_split(root: str, split: Split, programs: set[str] | None) -> Iterator[pa.RecordBatch]:
    """Events of the stretches that begin in the split. Of programs that aren't wanted only the BEGIN lines are parsed."""
    system, _ = store(root)
    columns: list[list] = [[] for _ in ARROW]
    keys, seq = None, 0
    with system.open_input_file(split.path) as file:
        for at, raw in lines_from(file, split.start):
            if raw.startswith(b"BEGIN "):
                if at >= split.end:
                    break
                head = json.loads(raw[6:])
                keys = (head["program_id"], head["run_idx"], head["input_idx"]) if programs is None or head["program_id"] in programs else None
                seq = head["seq"]
            elif keys is not None and (m := LINE.search(raw.decode("utf-8", "replace"))):
                for column, value in zip(columns, (*keys, seq, KINDS[m[1]], decoded(m[2]), int(m[3]), m[4] and decoded(m[4])), strict=True):
                    column.append(value)
                seq += 1
                if len(columns[0]) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
                    columns = [[] for _ in ARROW]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.programs: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  a name of the interface
        """Take over equality and IN on program_id; hand the rest back."""
        for f in filters:
            if f.attribute == ("program_id",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = {*f.value} if isinstance(f, In) else {f.value}
                self.programs = values if self.programs is None else self.programs & values
            elif f.attribute != ("program_id",) or not isinstance(f, IsNotNull):
                yield f
            elif self.programs is None:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return splits(listed(self.root), self.size)

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # a folder without files
            yield from read_split(self.root, partition, self.programs)


class LineStream(DataSourceStreamReader):
    """New files by the time they were changed last, and by name; a file is complete when it has its name. One that comes with an older time than what was read is missed."""

    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def keyed(self) -> list[tuple[int, str, pafs.FileInfo]]:
        return sorted((x.mtime_ns or 0, x.path, x) for x in listed(self.root))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self.keyed()
        return {"changed": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return splits([x for t, p, x in self.keyed() if after < (t, p) <= upto], self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return read_split(self.root, partition, None)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class LineWriter(DataSourceArrowWriter):
    """Files are hidden under the job's name until the whole job is done."""

    def __init__(self, options: dict):
        self.root, self.job = options["path"], uuid.uuid4().hex
        system, root = store(self.root)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = store(self.root)
        files, out, size, before, held = [], None, 0, None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                key = (r["program_id"], r["run_idx"], r["input_idx"])
                begins = (*key, r["seq"] - 1) != before or held >= STRETCH
                if begins and out is not None and size >= FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.trace")
                    out, size = system.open_output_stream(posixpath.join(root, f".{self.job}-{files[-1]}"), compression=None), 0
                told = f"TRACE {WORDS[r['event_type']]} {encoded(r['function_name'])} depth={r['depth'] or 0}" + (f" {encoded(r['exception_type'])}" if r["exception_type"] is not None else "") + "\n"
                if begins:
                    told, held = "BEGIN " + json.dumps(dict(zip(("program_id", "run_idx", "input_idx", "seq"), (*key, r["seq"]), strict=True))) + "\n" + told, 0
                size += out.write(told.encode())
                before, held = (*key, r["seq"]), held + 1
        if out is not None:
            out.close()
        return Written(files)

    def left(self) -> None:
        system, root = store(self.root)
        for x in system.get_file_info(pafs.FileSelector(root)):
            if x.base_name.startswith(f".{self.job}-"):
                system.delete_file(x.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = store(self.root)
        for name in (x for m in messages if m for x in m.files):
            system.move(posixpath.join(root, f".{self.job}-{name}"), posixpath.join(root, name))
        self.left()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.left()


class TraceLines(DataSource):
    """format("trace_lines"); option splitBytes: size of a split."""

    @classmethod
    def name(cls) -> str:
        return "trace_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader({k.lower(): v for k, v in dict(self.options).items()})

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LineStream({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LineWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session; predicates reach Python sources only with this setting, which stays on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceLines)


def write_lines(events: DataFrame, path: str) -> None:
    """Write canonical events (with depth, and exception_type if they have it) as trace lines. A trace may be spread over files, in stretches."""
    register(events.sparkSession)
    kind = F.col("exception_type") if "exception_type" in events.columns else F.lit(None).cast("string")
    rows = events.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")) if c != "exception_type"], kind.alias("exception_type"))
    stretch = F.floor(F.col("seq") / STRETCH)
    rows.repartition(*TRACE, stretch).sortWithinPartitions(*TRACE, "seq").write.format("trace_lines").mode("append").save(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("trace_lines").load(path)
