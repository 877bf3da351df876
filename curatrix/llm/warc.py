"""WARC archives (operator 12) as a PySpark Python data source, for reading and writing.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load(folder).where("warc_type = 'response'")
    rows.write.format("warc").mode("append").save(folder)

Reading plans one partition for each stretch of files: small files share one, and files are never cut, as a record can't be
found from within. Filters on record type, header fields that have a column, and presence of a value are pushed down and decided on
a record's header lines alone; a block that no filter lets through, or whose payload the wanted schema lacks, is passed over (by
seeking where the file isn't compressed) and never decoded. The wanted columns are those of .schema(...), all by default.

Writing makes a file of gzip members, one a record, for each task and each file_bytes of records. When all tasks have ended, the job
writes a manifest of its files, and reading leaves out files of a job that its manifest doesn't list: what a lost executor, a
task's second run or a failed job left is never read, and nothing is moved or renamed.

Paths are opened by pyarrow's file systems, on the executors: file, hdfs, s3, gs and what else it knows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.llm.common import BROADCAST_BYTES, ensure_checkpoint_dir, short_batches

SCHEMA = (
    "warc_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, content_type string, "
    "content_length long, headers map<string,string>, http_headers map<string,string>, payload binary"
)
#: Columns that hold a header field, by the field's name in lower case (fixed values of the format).
FIELDS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
_READ = 1 << 20
#: How the names of written files and of their manifests begin.
_OWN, _MANIFEST = "curatrix-", "_manifest-curatrix-"


def open_system(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it). Hadoop writes local addresses with one slash, which pyarrow doesn't take."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Stream:
    """Bytes of a plain or gzip-compressed file, read in pieces: lines, blocks, and blocks passed over."""

    def __init__(self, source, compressed: bool):
        self.source, self.compressed = source, compressed
        self.held, self.at = b"", 0  # what is read and not yet taken: held from at on
        self.inflate, self.raw = None, b""

    def _more(self) -> bytes:
        if not self.compressed:
            return self.source.read(_READ)
        while True:
            if not self.raw:
                self.raw = self.source.read(_READ)
                if not self.raw:
                    if self.inflate is not None and not self.inflate.eof:
                        raise ValueError("the archive ends within a compressed record")
                    return b""
            if self.inflate is None or self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            made = self.inflate.decompress(self.raw, _READ)
            self.raw = self.inflate.unconsumed_tail if not self.inflate.eof else self.inflate.unused_data
            if made:
                return made

    def _refill(self) -> bool:
        more = self._more()
        self.held, self.at = self.held[self.at :] + more, 0
        return bool(more)

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the file."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._refill():
                last, self.at = self.held[self.at :], len(self.held)
                return last or None
        made, self.at = self.held[self.at : end], end + 1
        return made.removesuffix(b"\r")

    def _take(self, size: int) -> bytes:
        """At most size of the next bytes, some at least."""
        if self.at == len(self.held) and not self._refill():
            raise ValueError("the archive ends within a record")
        made = self.held[self.at : self.at + size]
        self.at += len(made)
        return made

    def block(self, size: int) -> bytes:
        pieces = []
        while size:
            pieces.append(self._take(size))
            size -= len(pieces[-1])
        return b"".join(pieces)

    def skip(self, size: int) -> None:
        inside = min(size, len(self.held) - self.at)
        self.at += inside
        size -= inside
        if size and not self.compressed:
            self.source.seek(size, 1)
            return
        while size:
            size -= len(self._take(size))


def header_fields(stream: Stream) -> dict[str, str]:
    """Fields by their names in lower case, up to the empty line; folded lines belong to the field before."""
    found: dict[str, str] = {}
    name = None
    while line := stream.line():
        if line[:1] in b" \t" and name:
            found[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, _, value = line.partition(b":")
            name = key.decode("utf-8", "replace").strip().lower()
            found[name] = value.decode("utf-8", "replace").strip()
    return found


def records(stream: Stream) -> Iterator[dict[str, str]]:
    """The header fields of each record. Whoever takes one reads or skips the record's block before the next."""
    while (line := stream.line()) is not None:
        if not line:
            continue  # the two line ends behind a block
        if line not in _VERSIONS:
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        yield header_fields(stream)


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """(HTTP header fields, payload) of the block of a request, response or revisit record."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    found = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        found[key.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found, payload if gap else b""


@dataclass
class Files(D.InputPartition):
    paths: list[str]


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str] = field(default_factory=list)


def _plain(value: str | None, column: str) -> str | None:
    """A header field as its column shows it: addresses without brackets, digests without the algorithm's name."""
    if value is None:
        return None
    if column in ("record_id", "refers_to", "target_uri"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


class WarcReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kinds = {D.EqualTo: "in", D.In: "in", D.StringStartsWith: "starts", D.IsNotNull: "there"}
            if column in FIELDS and type(f) in kinds:
                value = getattr(f, "value", None)
                self.tests.append((column, kinds[type(f)], {value} if isinstance(f, D.EqualTo) else set(value) if isinstance(value, (list, tuple)) else value))
            else:
                yield f

    def partitions(self):
        system, root = open_system(self.options["path"])
        found = [i for i in system.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file] if system.get_file_info(root).type == pafs.FileType.Directory else [system.get_file_info(root)]
        listed = {line for i in found if i.base_name.startswith(_MANIFEST) for line in system.open_input_file(i.path).read().decode().split("\n")}
        found = [i for i in found if i.base_name.endswith((".warc", ".warc.gz")) and (i.base_name in listed or not i.base_name.startswith(_OWN))]
        most = int(self.options.get("partition_bytes", 128 << 20))
        made, room = [], 0
        for info in sorted(found, key=lambda i: i.path):
            if not made or room < info.size:
                made.append(Files([]))
                room = most
            made[-1].paths.append(info.path)
            room -= info.size
        return made or [Files([])]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            own = _plain(fields.get(FIELDS[column]), column)
            if own is None or (kind == "in" and own not in value) or (kind == "starts" and not own.startswith(value)):
                return False
        return True

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        verify = self.options.get("verify", "false").lower() == "true"
        system, _ = open_system(self.options["path"])
        held: list[tuple] = []
        size = 0
        for path in partition.paths:
            with system.open_input_file(path) as source:
                stream = Stream(source, path.endswith(".gz"))
                for fields in records(stream):
                    length = int(fields.get("content-length", 0))
                    if not self._wanted(fields):
                        stream.skip(length)
                        continue
                    row = {c: _plain(fields.get(n), c) for c, n in FIELDS.items()}
                    row |= {"content_length": length, "headers": list(fields.items()), "http_headers": None, "payload": None}
                    check = verify and row["warc_type"] == "response" and row["payload_digest"] is not None
                    if check or "payload" in names or "http_headers" in names:
                        block = stream.block(length)
                        if fields.get("content-type", "").startswith("application/http"):
                            http, block = split_http(block)
                            row["http_headers"] = list(http.items())
                        if check and payload_digest(block) != row["payload_digest"]:
                            raise ValueError(f"the payload of {row['record_id']} in {path} has another digest than its header says")
                        row["payload"] = block if row["warc_type"] != "revisit" else None
                    else:
                        stream.skip(length)
                    held.append(tuple(row[n] for n in names))
                    size += 1024 + (length if "payload" in names else 0)
                    if size >= 8 << 20:
                        yield self._batch(names, held)
                        held, size = [], 0
        if held:
            yield self._batch(names, held)

    def _batch(self, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "http_headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _line_safe(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(row: dict) -> bytes:
    """One record, compressed as a gzip member of its own."""
    payload = row["payload"] or b""
    if isinstance(payload, str):
        payload = payload.encode()
    revisit = row["warc_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {_line_safe(row.get('content_type') or 'text/html; charset=utf-8')}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row.get('date') or '1970-01-01T00:00:00Z'}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_line_safe(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"{k}: {_line_safe(v)}" for k, v in row.get("headers") or ()]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class WarcWriter(D.DataSourceArrowWriter):
    """Rows with warc_type (response or revisit), record_id, payload and, where they are there, date, target_uri, refers_to, content_type, headers.

    A revisit's payload is digested and measured, and not stored.
    """

    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("archives are only added to: use mode append and a folder of their own")
        self.options, self.job = dict(options), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_system(self.options["path"])
        most = int(self.options.get("file_bytes", 1 << 30))
        system.create_dir(root, recursive=True)
        made, sink = [], None
        try:
            for batch in iterator:
                names = batch.schema.names
                for at in range(batch.num_rows):
                    if sink is None:
                        made.append(f"{_OWN}{self.job}-{uuid.uuid4().hex}.warc.gz")
                        sink = system.open_output_stream(f"{root}/{made[-1]}", compression=None)
                    sink.write(record_bytes({n: c[at].as_py() for n, c in zip(names, batch.columns, strict=True)}))
                    if sink.tell() >= most:
                        sink.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
        return Written(made)

    def commit(self, messages) -> None:
        system, root = open_system(self.options["path"])
        names = [name for message in messages if message for name in message.names]
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{_MANIFEST}{self.job}", compression=None) as sink:
            sink.write("\n".join(names).encode())

    def abort(self, messages) -> None:
        system, root = open_system(self.options["path"])
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(f"{root}/{name}")


class WarcDataSource(D.DataSource):
    """The format "warc". Options: path, partition_bytes (of small files read by one task), file_bytes (of a written file), verify (compare payloads with their digests)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_rows(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The records to write: of pages with equal payloads that of the largest page_id is the response, and the others are revisits of it.

    Equal payloads have one SHA-256. Payloads that stand once need no partner: only the repeated ones' digests (32 bytes and an id each) meet the
    pages, by broadcast while they are under the byte bound, else in a join that adaptive execution can split at a hot digest.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    repeated = rows.groupBy("same").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1").select("same", "first").checkpoint()
    if repeated.count() * 64 <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    placed = rows.join(repeated.withColumn("again", F.lit(True)), "same", "left")
    later = F.coalesce(F.col("again") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return placed.select(
        F.when(later, "revisit").otherwise("response").alias("warc_type"),
        name(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.when(later, name(F.col("first"))).alias("refers_to"),
        "payload",
    )


def write_and_read_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archive's records, after pages were written to it.

    Every page is a record; its payload is the html in UTF-8, of no bytes where it is null. Responses are read whole and compared with
    their digests; a revisit's size is that of the HTTP header it keeps. A row that repeats the largest page_id of its payload is
    the same page and a response too. A null page_id is smaller than any, and stays null. An empty table gives an empty result and no file;
    further columns are left out.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    register(spark)
    short_batches(spark)
    archive_rows(pages, page_id, url, html).write.format("warc").mode("append").save(folder)
    read = spark.read.format("warc").option("verify", "true").schema("warc_type string, record_id string, refers_to string, payload_digest string, http_headers map<string,string>").load(folder)
    own = lambda c: F.nullif(F.substring(F.col(c), len("urn:page:") + 1, 1 << 20), F.lit("")).cast(pages.schema[page_id].dataType)
    return read.select(own("record_id").alias("page_id"), F.col("http_headers")["content-length"].cast("long").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), own("refers_to").alias("refers_to"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


ORACLE = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
hexed AS (SELECT page_id, first, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM sized),
fives AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, (5 * k + 1)::INT, 5))::BIGINT) AS parts FROM hexed),
spelled AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[(k // 4 + 1)::INT] >> (15 - 5 * (k % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest
  FROM fives)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM spelled
"""
