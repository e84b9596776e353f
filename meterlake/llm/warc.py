"""Legacy archive converter: ARC files of versions 1 and 2 become WARC 1.1 files.

Archives are written by Spark's text writer (gzip, one file for a partition) and read by its
binary-file reader, so they can live in any store that Spark reaches and a lost executor's files are
written again. A parser sees one archive at a time and unpacks it piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, remove, small_batches, spread_join, table

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Carries a record's key through both formats.
KEY_HEADER = b"X-Record-Key"
#: When the synthetic legacy archives say that they were made.
LEGACY_DATE = "20010203040506"
READ = 1 << 16


class Stream:
    """Bytes of a plain or gzip archive (any number of members), unpacked as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.unpack = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.done = 0

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + READ]
        self.at += len(part)
        if self.unpack is None:
            self.buffer += part
            return True
        while part:
            self.buffer += self.unpack.decompress(part)
            part = self.unpack.unused_data
            if part:
                self.unpack = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """Up to and without the next line feed; None at the end."""
        while (i := self.buffer.find(b"\n")) < 0:
            if not self.more():
                if not self.buffer:
                    return None
                i = len(self.buffer)
                break
        out = bytes(self.buffer[:i])
        self.skip(i + 1)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        self.skip(n)
        return out

    def skip(self, n: int) -> None:
        n = min(n, len(self.buffer))
        self.done += n
        del self.buffer[:n]


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with the empty line) and payload of an HTTP response; without one, all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(i, n) for sep, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(sep)) >= 0]
    if not ends:
        return block, b""
    i, n = min(ends)
    return block[: i + n], block[i + n :]


def http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


# -- legacy archives ---------------------------------------------------------------------------


def arc_head(version: int, name: str) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 meterlake\n{ARC_FIELDS[version]}\n".encode()
    line = [f"filedesc://{name}", "0.0.0.0", LEGACY_DATE, "text/plain"]
    if version == 2:
        line += ["200", "-", "-", "0", name]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body


def record_key(text: str | None) -> int | None:
    """A key header's value, if it is a 64-bit number."""
    key = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return key if key is not None and -(2**63) <= key < 2**63 else None


def arc_record(version: int, name: str, key: int | None, url: str | None, payload: bytes) -> bytes:
    named = b"" if key is None else b"%s: %d\r\n" % (KEY_HEADER, key)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%sContent-Length: %d\r\n\r\n" % (named, len(payload)) + payload
    line = [quote(url or "-", safe="!#$%&'()*+,/:;=?@[]~"), "0.0.0.0", LEGACY_DATE, "text/html"]
    if version == 2:
        line += ["200", "-", "-", "0", name]
    return " ".join([*line, str(len(body))]).encode() + b"\n" + body


def write_arc(df: DataFrame, path: str, key: str, url: str, payload: str) -> None:
    """Rows as legacy archives, one for a partition; partitions take turns at the two versions.

    Null payloads are written as empty ones, null urls as `-`, null keys not at all. Keys may repeat;
    an empty table gives no archive; columns but the three named are ignored, whatever they are called.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, first = 1 + part % 2, f"legacy-{part:05d}.arc", True
        for batch in batches:
            out = [arc_head(version, name)] if first and batch.num_rows else []
            first = first and not batch.num_rows
            for k, u, p in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(arc_record(version, name, k, u, (p or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


ARC_SCHEMA = "archive string, offset long, version int, url string, ip string, date string, mime string, key long, head binary, payload binary, payload_bytes long, payload_digest string, problem string"


def parse_arc(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """Rows of ARC_SCHEMA for one archive; payload is deflated. The version block has version and no url.

    A header line that its version doesn't allow, or a record that is cut short, gives a row with
    problem set and ends the archive, as the place of the next record is unknown.
    """
    stream = Stream(data)
    archive, version = None, 1
    while True:
        at = stream.done
        line = stream.line()
        if line is None:
            return
        line = line.strip(b"\r")
        if not line:
            continue
        text = line.decode("utf-8", "replace")
        opening = text.startswith("filedesc://")
        if opening:
            fields = text.split(" ")
            archive = fields[0][len("filedesc://") :]
        else:
            fields = text.rsplit(" ", 4 if version == 1 else 9)  # an unescaped url may hold spaces
        if len(fields) < 5 or not fields[-1].isdigit() or len(fields) not in (5, 10):
            yield (archive, at, version, None, None, None, None, None, None, None, None, None, f"bad header line: {text[:200]}")
            return
        size = int(fields[-1])
        block = stream.take(size)
        if len(block) < size:
            yield (archive, at, version, fields[0], fields[1], fields[2], fields[3], None, None, None, None, None, f"{len(block)} of {size} bytes")
            return
        if opening:
            number = block.split(b" ", 1)[0]
            version = int(number) if number in (b"1", b"2") else version
            yield (archive, at, version, None, fields[1], fields[2], fields[3], None, block, None, None, None, None)
            continue
        head, payload = http_parts(block)
        key = http_field(head, KEY_HEADER)
        yield (archive, at, version, fields[0], fields[1], fields[2], fields[3], record_key(key), head, zlib.compress(payload, 1) if with_payload else None, len(payload), sha1(payload), None)


def rows_to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most `size` rows, or as many as hold some 16 MB."""
    held: list[tuple] = []
    weight = 0
    for r in rows:
        held.append(r)
        weight += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if len(held) >= size or weight > 16_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(", ")])


def read_files(spark: SparkSession, path: str, ddl: str, parse) -> DataFrame:
    """Rows of parse(content of a file) for the files of a folder."""
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_to_batches((r for batch in batches for i in range(batch.num_rows) for r in parse(batch.column(0)[i].as_py())), schema, 500)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return read_files(spark, path, ARC_SCHEMA, lambda data: parse_arc(data, with_payload))


# -- conversion --------------------------------------------------------------------------------


def warc_date(date: str | None) -> str:
    """14 digits, or fewer from the year on, as a WARC date; others as the start of 1970."""
    digits = (date or "")[:14]
    if not re.fullmatch(r"\d{4,14}", digits):
        return "1970-01-01T00:00:00Z"
    digits += "00000101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(archive: str | None, offset: int) -> str:
    """The same for a record however often it is converted."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def warc_record(archive, offset, version, url, ip, date, mime, key, head, payload, payload_digest, payload_bytes, first_key, first_id, first_url, first_date) -> bytes:
    head = head or b""
    if url is None:
        kind, content, block = "warcinfo", "application/warc-fields", f"software: meterlake\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version {version}\r\n".encode()
    elif first_id is not None:
        kind, content, block = "revisit", "application/http; msgtype=response", head
    else:
        body = zlib.decompress(payload)
        if head:
            kind, content, block = "response", "application/http; msgtype=response", head + body
        else:
            kind, content, block = ("response" if url.startswith("dns:") else "resource"), mime or "application/octet-stream", body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(archive, offset)}>", f"WARC-Date: {warc_date(date)}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {archive}")
    else:
        lines.append(f"WARC-Target-URI: {url}")
        if ip and ip != "0.0.0.0" and re.fullmatch(r"[0-9a-fA-F.:]+", ip):
            lines.append(f"WARC-IP-Address: {ip}")
        lines.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{first_id}>", f"WARC-Refers-To-Target-URI: {first_url}", f"WARC-Refers-To-Date: {warc_date(first_date)}"]
        if first_key is not None:
            lines.append(f"X-Refers-To-Key: {first_key}")
        lines.append(f"X-Payload-Length: {payload_bytes}")
    lines += [f"WARC-Block-Digest: sha1:{sha1(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """ARC archives of a folder as WARC archives in another.

    Of records with equal payloads of at least least_bytes bytes, that with the smallest key (then
    archive and offset) is a response, the others are revisits of it. Only digests are gathered
    to decide that. Few decisions go to the payloads; of many, payloads move once, deflated, to meet that of
    their digest, and the records of a digest that very many share are dealt over all tasks.
    Records with a problem are left out; read_arc shows them. Records without a key count as after all others,
    records that repeat a key are told apart by archive and offset; no archives give no archives.
    """
    small_batches(spark)
    seen = read_arc(spark, arc_path, with_payload=False).filter(F.col("problem").isNull() & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("key").isNull().alias("unnamed"), F.col("key").alias("order"), "archive", "offset", "key", "url", "date")
    first = seen.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("times")).filter("times > 1")
    rows = read_arc(spark, arc_path).filter(F.col("problem").isNull())
    rows = spread_join(rows, materialize(first, "payload-digests"), ["payload_digest", "payload_bytes"], "times", F.xxhash64("archive", "offset"))
    own = (F.col("first.archive") == F.col("archive")) & (F.col("first.offset") == F.col("offset"))
    again = F.col("first").isNotNull() & ~own
    when = lambda x: F.when(again, F.col(f"first.{x}"))
    rows = rows.select(
        "archive", "offset", "version", "url", "ip", "date", "mime", "key", "head", F.when(~again, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes",
        when("key").alias("first_key"), when("archive").alias("first_archive"), when("offset").alias("first_offset"), when("url").alias("first_url"), when("date").alias("first_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *own, key, archive, offset, url, date in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(warc_record(*own, key, record_id(archive, offset) if archive is not None else None, url, date))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(warc_path)


# -- reading back ------------------------------------------------------------------------------

WARC_SCHEMA = "record_id string, record_type string, date string, url string, key long, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key long, payload binary"


def parse_warc(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """Rows of WARC_SCHEMA of one archive. Digests of responses are computed again and must agree."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.done}: {line[:80]!r}")
        fields: dict[str, str] = {}
        while line := (stream.line() or b"").strip(b"\r"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.take(size)
        if len(block) < size:
            raise ValueError(f"a record ends after {len(block)} of {size} bytes")
        kind = fields["warc-type"]
        if kind == "warcinfo":
            continue
        head, payload = http_parts(block)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind != "revisit" and sha1(payload) != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} has another digest")
        key = http_field(head, KEY_HEADER)
        length = int(fields["x-payload-length"]) if kind == "revisit" else len(payload)
        first = fields.get("x-refers-to-key")
        yield (fields["warc-record-id"].strip("<>"), kind, fields.get("warc-date"), fields.get("warc-target-uri"), record_key(key), length, digest, fields.get("warc-refers-to", "").strip("<>") or None, int(first) if first else None, payload if with_payload and kind != "revisit" else None)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    return read_files(spark, path, WARC_SCHEMA, lambda data: parse_warc(data, with_payload))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, converted, read back: a row for each row of pages.

    Null htmls are empty payloads, null urls `-`; rows that repeat a page_id and payload are a response
    and its revisits; an empty table gives no rows; other columns are ignored.
    """
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc, "page_id", "url", "html")
    convert(spark, arc, warc)
    remove(spark, arc)
    out = read_warc(spark, warc)
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
