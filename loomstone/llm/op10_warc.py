"""WARC archives: a Python data source that reads and writes them.

``spark.read.format("warc").load(folder)`` plans partitions of byte ranges of files; each is streamed record by record.
Headers come first: predicates on the record type, record id, target URI, payload digest and content type reach the
reader, which skips the block of a record that they exclude. With the option ``payload`` set to ``false`` no block is
decoded at all and the schema has no payload.

The writer makes every record a gzip member of its own, whose header states the member's length (the extra field ``sl``). So a
reader inflates the first bytes of a member, which hold the record's headers, and seeks from there to the next member; and a
file can be read from any byte on, as the next member is told by its mark. Of archives without that field, and of
uncompressed ones, a file is one partition; in uncompressed ones blocks are skipped by seeking, in others by inflating.
Tasks write to a hidden folder, whose files are moved when all are done, so a lost task leaves no half-written archive;
readers pass over hidden folders.

Payload groups: payloads are equal if their SHA-1, their length and a second hash are. Each group is aggregated to the
largest page_id that has it, and pages meet that by group and page_id, so that a payload which a third of the pages share is
in no one task. Pages move once.

Defined results: a null html is an empty payload, and equal to other empty ones; a null page_id is smaller than others;
of rows equal in page_id and payload one is the response and the others revisit it; a null url gives no target URI, and
control characters in one become a space; smaller payloads than ``least_bytes`` are always responses; a long payload is one
record, which a task holds once as text and once compressed; other columns may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, Not, WriterCommitMessage
from pyspark.sql.types import StructType

from loomstone.llm.common import Scratch, table

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Header fields with a column of their own.
FIELDS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
COLUMNS = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, headers map<string,string>, http_length long, file string, offset long"
BATCH_BYTES = 8 << 20
PIECE = 1 << 20


#: How a member with a stated length begins: magic, method, flags (extra field), then time, and an extra field "sl" of 8 bytes.
MARK = re.compile(rb"\x1f\x8b\x08\x04......\x0c\x00sl\x08\x00", re.DOTALL)
MEMBER = struct.Struct("<4s6xH2sHLL")  # ..., length of the member, length of what is in it
FILE_BYTES = 1 << 30


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def _filesystem(path: str):
    """A pyarrow file system and the path in it; None for this machine's own."""
    if re.match(r"file:|/", path) or "://" not in path:
        return None, re.sub(r"^file:(//)?", "", path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _seen(path: str) -> bool:
    return not any(part[:1] in ("_", ".") for part in path.split("/") if part)


def _listed(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, but for those that are hidden or in a hidden folder below path."""
    files, at = _filesystem(path)
    if files is None:
        if os.path.isfile(at):
            return [(at, os.path.getsize(at))]
        found = [os.path.join(d, f) for d, _, names in os.walk(at) for f in names]
        return sorted((f, os.path.getsize(f)) for f in found if _seen(os.path.relpath(f, at)))
    from pyarrow import fs

    scheme = path.split("://")[0]
    info = files.get_file_info(fs.FileSelector(at, recursive=True)) if files.get_file_info(at).type == fs.FileType.Directory else [files.get_file_info(at)]
    return sorted((f"{scheme}://{x.path}", x.size) for x in info if x.is_file and _seen(x.path.removeprefix(at)))


def _opened(path: str) -> io.BufferedIOBase:
    """The bytes of a file, uncompressed."""
    raw = _raw(path)
    return gzip.open(raw, "rb") if raw.read(2) == b"\x1f\x8b" and not raw.seek(0) else (raw.seek(0), raw)[1]


def _raw(path: str):
    files, at = _filesystem(path)
    return open(at, "rb") if files is None else files.open_input_file(at)


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that states its length (0 if that takes more than 32 bits)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = MEMBER.size + len(body) + 8
    lengths = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    return MEMBER.pack(b"\x1f\x8b\x08\x04", 12, b"sl", 8, *lengths) + body + struct.pack("<LL", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Member:
    """The stream of one member's bytes, inflated no further than they are asked for. size: of its compressed bytes, if stated."""

    def __init__(self, f, size: int | None, first: int = 1024):
        self.f, self.left, self.held, self.next = f, 1 << 62 if size is None else size, bytearray(), first
        self.z, self.taken = zlib.decompressobj(-15), 0

    def _inflate(self) -> bool:
        if not self.left or self.z.eof:
            return False
        got = self.f.read(min(self.left, self.next))
        self.left, self.next, self.taken = self.left - len(got), min(4 * self.next, PIECE), self.taken + len(got)
        self.held += self.z.decompress(got)
        if not got:
            raise ValueError("a member ends early")
        return True

    def readline(self, limit: int = 1 << 62) -> bytes:
        at = 0
        while (end := self.held.find(b"\n", at)) < 0 and len(self.held) < limit:
            at = len(self.held)
            if not self._inflate():
                break
        return self.read(min(limit, end + 1 if end >= 0 else len(self.held)))

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._inflate():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


    def compressed(self) -> int:
        """How many compressed bytes it has, found by inflating the rest."""
        while self._inflate():
            self.held.clear()
        return self.taken - len(self.z.unused_data)


def record(f, start: int, wanted, payload: bool) -> tuple[dict, bytes | None, int | None, int, int, bool] | None:
    """One record from a stream: headers, payload (None if not asked for), the length that the HTTP header states, bytes of
    the block that are not read yet, bytes of the headers, and whether it is wanted, which is decided by the headers before
    anything of the block is read. None at the end."""
    at = 0
    while not (line := f.readline()).strip():
        if not line:
            return None
        at += len(line)
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at byte {start + at}: {line[:40]!r}")
    begins, headers, last = at, {}, None
    at += len(line)
    while (line := f.readline()).strip():
        at += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            headers[last] += " " + text.strip()
        else:
            last, _, value = text.partition(":")
            last = last.strip().lower()
            headers[last] = value.strip()
    at += len(line)
    left, body, stated = int(headers["content-length"]), None, None
    if not (takes := wanted(headers)):
        return headers, None, None, left, (begins, at), False
    if headers.get("content-type", "").startswith("application/http"):  # up to the blank line
        while left > 0 and (line := f.readline(left)):
            left -= len(line)
            if not line.strip():
                break
            if line.lower().startswith(b"content-length:"):
                stated = int(line.split(b":", 1)[1])
    if payload:
        body = f.read(left)
        if len(body) < left:
            raise ValueError(f"the record at byte {start} ends early")
        left = 0
    return headers, body, stated, left, (begins, at), takes


def parse(f: io.BufferedIOBase, wanted, payload: bool) -> Iterator[tuple[int, dict, bytes | None, int | None]]:
    """Records of one archive from its beginning: offset, headers, payload, and the length that the HTTP header states."""
    at, compressed = 0, isinstance(f, gzip.GzipFile)
    while found := record(f, at, wanted, payload):
        headers, body, stated, left, (begins, ends), takes = found
        if left and not compressed:
            f.seek(left, 1)
        while left and compressed:
            if not (got := f.read(min(left, PIECE))):
                raise ValueError(f"the record at byte {at} ends early")
            left -= len(got)
        if takes:
            yield at + begins, headers, body, stated
        at += ends + int(headers["content-length"])


def parse_members(f, begin: int, end: int, wanted, payload: bool) -> Iterator[tuple[int, dict, bytes | None, int | None]]:
    """Records whose members begin in a range of bytes; the offset is that of the member."""
    at = begin
    if begin:  # the first member from there on
        f.seek(begin)
        held, base = b"", begin
        while not (m := MARK.search(held)):
            if base + len(held) >= end + 32 or not (got := f.read(PIECE)):
                return
            keep = held[-32:]
            base, held = base + len(held) - len(keep), keep + got
        at = base + m.start()
    while at < end:
        f.seek(at)
        head = f.read(MEMBER.size)
        if not head:
            return
        if not MARK.match(head):
            raise ValueError(f"no member at byte {at}")
        size = MEMBER.unpack(head)[4]
        m = Member(f, size - MEMBER.size - 8 if size else None)
        found = record(m, at, wanted, payload)
        if found and found[-1]:
            yield at, found[0], found[1], found[2]
        at += size or MEMBER.size + m.compressed() + 8


def parse_range(path: str, begin: int, end: int, wanted, payload: bool) -> Iterator[tuple[int, dict, bytes | None, int | None]]:
    """Records of a range of a file. A file whose members do not state their lengths belongs to the range that begins it."""
    with _raw(path) as f:
        head = f.read(MEMBER.size)
        if MARK.match(head) and MEMBER.unpack(head)[4]:
            yield from parse_members(f, begin, end, wanted, payload)
            return
    if not begin:
        with _opened(path) as f:
            yield from parse(f, wanted, payload)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.fields = options["path"], schema.fieldNames()
        self.per = int(options.get("partitionbytes", 16 << 20))
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, IN and their negations on header columns; leaves the rest to Spark."""
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
            column = inner.attribute[0] if len(getattr(inner, "attribute", ())) == 1 else None
            if column in FIELDS and isinstance(inner, (EqualTo, In)):
                self.tests.append((FIELDS[column], tuple(inner.value) if isinstance(inner, In) else (inner.value,), negated))
            elif column in FIELDS and isinstance(inner, EqualNullSafe) and not negated:
                self.tests.append((FIELDS[column], (inner.value,), False))
            elif column in FIELDS and isinstance(inner, IsNotNull) and not negated:
                self.tests.append((FIELDS[column], (None,), True))
            else:
                yield f

    def wanted(self, headers: dict) -> bool:
        for name, values, negated in self.tests:
            value = headers.get(name)
            if negated and (value is None or value in values) or not negated and value not in values:
                return False
        return True

    def partitions(self) -> list[Ranges]:
        """Ranges of files, small ones together."""
        out, size = [], 0
        for path, n in _listed(self.path):
            for begin in range(0, max(n, 1), self.per):
                part = min(n - begin, self.per)
                if not out or size + part > self.per:
                    out.append([])
                    size = 0
                out[-1].append((path, begin, begin + part))
                size += part
        return [Ranges(x) for x in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = {"content_length": pa.int64(), "http_length": pa.int64(), "offset": pa.int64(), "payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        rows, held = {c: [] for c in self.fields}, 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.string())) for c in self.fields], self.fields)

        for path, begin, end in partition.ranges:
            for start, h, body, stated in parse_range(path, begin, end, self.wanted, self.payload):
                own = {"content_length": int(h["content-length"]), "http_length": stated, "offset": start, "payload": body, "headers": list(h.items()), "file": path}
                for c in self.fields:
                    rows[c].append(own[c] if c in own else h.get(FIELDS[c]))
                held += 1000 + len(body or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = {c: [] for c in self.fields}, 0
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes the one column of a frame, whole records as text, a member each; files of about ``filebytes``."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        self.most, self.level = int(options.get("filebytes", FILE_BYTES)), int(options.get("level", 6))
        self.most_records = int(options.get("recordsperfile", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, out, held = [], None, 0
        files, at = _filesystem(self.staging)
        if files is None:
            os.makedirs(at, exist_ok=True)
        else:
            files.create_dir(at)
        for batch in iterator:
            for text in batch.column(0):
                if out is None or out.tell() >= self.most or 0 < self.most_records <= held:
                    if out:
                        out.close()
                    held = 0
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = open(f"{at}/{names[-1]}", "wb") if files is None else files.open_output_stream(f"{at}/{names[-1]}")
                out.write(member(text.as_buffer().to_pybytes(), self.level))
                held += 1
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m for n in m.files]
        files, at = _filesystem(self.path)
        _, staging = _filesystem(self.staging)
        if files is None:
            os.makedirs(at, exist_ok=True)
        else:
            files.create_dir(at)
        for n in names:
            (os.replace if files is None else files.move)(f"{staging}/{n}", f"{at}/{n}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, staging = _filesystem(self.staging)
        if files is None:
            shutil.rmtree(staging, ignore_errors=True)
        elif files.get_file_info(staging).type.name == "Directory":
            files.delete_dir(staging)


class WarcDataSource(DataSource):
    """Options: path; for reading payload (true) and partitionbytes (16 MB of a file a partition); for writing filebytes (1 GB),
    recordsperfile (0: any number) and level (6, of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS + (", payload binary" if self.options.get("payload", "true").lower() != "false" else "")

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to a folder")
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 16 << 20) -> DataFrame:
    """Registers the source with the session and turns on Spark's setting that lets predicates reach Python sources, which Spark
    reads when it plans a query and which therefore stays on."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitionbytes", partition_bytes).load(path)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's or binary's bytes in base32: each 10 hexadecimal digits are 8 digits of base 32."""
    digits = F.sha1(payload.cast("binary"))
    part = lambda i: F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, payload, payload_bytes, digest, response (the page_id of its payload's response),
    is_response."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col("page_id"), F.lit(-(2**63)))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("key", key)
    p = p.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("other", F.xxhash64("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    group = ["digest", "other", "payload_bytes"]
    light = p.select(*group, "key")
    first = light.groupBy(*group).agg(F.max("key").alias("response_key"))
    of_page = light.distinct().join(first, group)
    rank = F.row_number().over(W.partitionBy(*group, "key").orderBy("url"))
    p = p.join(of_page, [*group, "key"]).withColumn("rank", rank)
    alone = F.col("payload_bytes") < least_bytes
    return p.withColumn("is_response", alone | ((F.col("key") == F.col("response_key")) & (F.col("rank") == 1)))


def record_text(date: str = DATE) -> Column:
    """A WARC record but for the separator that follows it, of a row of ``records``."""
    uid = lambda *c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", *c)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    is_response = F.col("is_response")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    length = F.octet_length(http) + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    original = F.when(F.col("response_key") != -(2**63), F.col("response_key")).cast("string")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(is_response, "response").otherwise("revisit")), line("WARC-Record-ID", uid(F.col("digest"), F.col("key"), F.col("rank"))),
        F.lit(f"WARC-Date: {date}{CRLF}"), maybe("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_response, "").otherwise(F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"), line("WARC-Refers-To", uid(F.col("digest"), F.col("response_key"), F.lit(1))), maybe("Refers-To-Page-ID", original))),
        maybe("Page-ID", F.col("page_id").cast("string")), F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), line("Content-Length", length.cast("string")), F.lit(CRLF), http, F.when(is_response, F.col("payload")).otherwise(""),
    )


def write_warc(rows: DataFrame, path: str, records_per_file: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a row of ``records`` as a record. A task begins another file after so many records (0: any number) or bytes."""
    rows.sparkSession.dataSource.register(WarcDataSource)
    rows.select(F.concat(record_text(), F.lit(CRLF + CRLF)).alias("record")).write.format("warc").option("filebytes", file_bytes).option("recordsperfile", records_per_file).mode("append").save(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, reads them back, and reports each record. Responses are read with their payloads, from which length
    and digest are taken; revisits by their headers only. Either read skips the blocks of the other's records."""
    path = Scratch(spark, "warc").path("archives")
    write_warc(records(table(spark, sf_dir, "pages")), path)
    page = F.col("headers")["page-id"].cast("long").alias("page_id")
    responses = read_warc(spark, path).where(F.col("warc_type") == "response").select(
        page, F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    )
    revisits = read_warc(spark, path, payload=False).where(F.col("warc_type") == "revisit").select(
        page, F.col("http_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.col("headers")["refers-to-page-id"].cast("long").alias("refers_to")
    )
    return responses.unionByName(revisits)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM r
"""
QUERIES = {"op10_warc": op10_warc}
ORACLE_SQL = {"op10_warc": SQL}
