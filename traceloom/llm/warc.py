"""WARC archives as a Python data source, with pushed-down predicates.

Each record is a gzip member of its own. Members carry their compressed length
in the gzip header's extra field, so a reader inflates the first bytes of a
member, parses the record's headers, and jumps to the next member if the record
or its payload isn't wanted. Members without that field are read through.

Reading plans one partition per file; the writer starts a new file beyond
``FILE_BYTES``. Files get their final name when the whole write is committed.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from traceloom.llm.common import shared_dir, small_batches, stage

FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Payloads shorter than this are stored again rather than revisited.
REVISIT_BYTES = 1000
SCHEMA = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"
NAMES = ("record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder, local or in any store that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(row: dict) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    body = row["payload"] or b"" if row["record_type"] == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], SAFE)}")
    if row["page_id"] is not None:
        head.append(f"Page-ID: {row['page_id']}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """One gzip member whose extra field SL tells its whole length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"SL", 4, 20 + len(packed) + 8)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


#: Bytes inflated at once while a record's headers are looked for.
HEAD_BYTES = 512


class Member:
    """A gzip member at a place in a file, inflated only as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.at, self.length = file, at, None
        file.seek(at)
        first = file.read(4096)
        self.empty = not first
        if self.empty:
            return
        if first[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        if first[3] & 4:
            size = struct.unpack_from("<H", first, 10)[0]
            while len(first) < 12 + size:
                first += file.read(4096)
            extra = first[12 : 12 + size]
            while len(extra) >= 4:
                n = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"SL":
                    self.length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + n :]
        self.inflate, self.packed, self.data = zlib.decompressobj(31), first, bytearray()

    def more(self, most: int) -> bool:
        """Inflate at most so many bytes; False at the member's or the file's end."""
        packed = self.packed or self.file.read(1 << 16)
        if self.inflate.eof or not packed:
            return False
        self.data += self.inflate.decompress(packed, most)
        self.packed = self.inflate.unconsumed_tail
        return True

    def headers(self) -> dict[str, str]:
        """The record's headers; ``body`` is where its block starts. No more is inflated than a few hundred bytes behind them."""
        while (end := self.data.find(b"\r\n\r\n")) < 0:
            if not self.more(HEAD_BYTES):
                raise ValueError(f"the record at byte {self.at} ends early")
        self.body = end + 4
        return parse_headers(bytes(self.data[:end]))

    def block(self, size: int) -> bytes:
        while (lacks := self.body + size - len(self.data)) > 0:
            if not self.more(max(lacks, HEAD_BYTES)):
                raise ValueError(f"the record at byte {self.at} ends early")
        return bytes(self.data[self.body : self.body + size])

    def next_at(self) -> int:
        if self.length is not None:
            return self.at + self.length
        while not self.inflate.eof:
            self.data.clear()
            if not self.more(1 << 20):
                raise ValueError(f"the member at byte {self.at} ends early")
        return self.file.tell() - len(self.inflate.unused_data)


def parse_headers(data: bytes) -> dict[str, str]:
    """Names in lower case; the first line is left out."""
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def number(text: str | None) -> int | None:
    return None if text is None else int(text)


@dataclass
class WarcFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take over equality and IN on what the record's headers tell; hand the rest back."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in ("record_type", "page_id", "url", "payload_digest", "refers_to") and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = {*f.value} if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name == "record_type" and isinstance(f, IsNotNull):
                continue  # every record has a type
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = store(self.root)
        files = [x for x in system.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".warc.gz") and x.base_name[0] not in "._"]
        return [WarcFile(x.path) for x in sorted(files, key=lambda x: x.path)]

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        system, _ = store(self.root)
        rows, held, at = [], 0, 0
        with system.open_input_file(partition.path) as file:
            while not (member := Member(file, at)).empty:
                head = member.headers()
                row = {"record_type": head.get("warc-type"), "page_id": number(head.get("page-id")), "payload_digest": head.get("warc-payload-digest", ":").partition(":")[2], "refers_to": number(head.get("refers-to-page-id"))}
                row["url"] = unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None
                if all(row[k] in v for k, v in self.wanted.items()):
                    whole = self.with_payload and row["record_type"] == "response"
                    size = int(head["content-length"])
                    block = member.block(size if whole else min(size, 4096))
                    told, _, payload = block.partition(b"\r\n\r\n")
                    row |= {"payload_bytes": int(parse_headers(told)["content-length"]), "payload": payload if whole else None}
                    rows.append(row)
                    held += len(payload)
                at = member.next_at()
                if len(rows) >= 4096 or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    """Files are hidden under the job's name until the whole job is done; what failed or repeated tasks left goes then."""

    def __init__(self, options: dict):
        self.root, self.job = options["path"], uuid.uuid4().hex
        system, root = store(self.root)
        system.create_dir(root, recursive=True)

    def hidden(self, root: str, name: str) -> str:
        return posixpath.join(root, f".{self.job}-{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = store(self.root)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(self.hidden(root, files[-1]), compression=None), 0
                member = gzip_member(build_record(row))
                out.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def left(self) -> None:
        """Delete the job's files that are still hidden."""
        system, root = store(self.root)
        for x in system.get_file_info(pafs.FileSelector(root)):
            if x.base_name.startswith(f".{self.job}-"):
                system.delete_file(x.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = store(self.root)
        for name in (x for m in messages if m for x in m.files):
            system.move(self.hidden(root, name), posixpath.join(root, name))
        self.left()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.left()


class WarcSource(DataSource):
    """format("warc"); option payload=false leaves every payload undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame) -> DataFrame:
    """The records to write: one response per long payload, that of the largest page_id, and revisits of it.

    The payloads that repeat are found from digests alone and written as a
    table. Spark broadcasts it if it is small by its own threshold; else the
    pages are sorted and merged with it, where a hot payload's rows can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long = F.col("payload_bytes") >= REVISIT_BYTES
    repeated = sized.where(long).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    repeated = stage(repeated.select(F.col("payload_digest").alias("same"), "keeper"), "warc-repeated")
    joined = sized.join(repeated, (F.col("payload_digest") == F.col("same")) & long, "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "url", "payload_bytes", "payload_digest",
        F.when(revisit, F.col("keeper")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame) -> str:
    """Write the pages' records as WARC files to a new shared folder; returns the folder."""
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    path = shared_dir(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    return path


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_report(pages: DataFrame) -> DataFrame:
    """Write the pages to WARC files, read them back, and describe each record.

    Responses are described by the payload read back, revisits by their headers
    alone: their records are asked for by type and no payload is decoded.

    Edge cases: a null html is an empty payload and a response; a null url has no
    header; rows that repeat the largest page_id are responses all; a null
    page_id revisits the largest id that isn't null; an empty table gives no rows.
    """
    path = write_archive(pages)
    spark = pages.sparkSession
    whole = read_archive(spark, path).where("record_type = 'response'")
    whole = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    short = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    return whole.unionByName(short.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
