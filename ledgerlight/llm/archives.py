"""Legacy ARC archives, and their conversion to WARC.

An ARC file starts with a version block that names the fields of its record header lines; version 1
has five fields, version 2 ten. A header line ends with the length of the block that follows, which
is all that delimits records. :func:`parse_arc` reads both versions; :func:`convert` turns records
into WARC records with identifiers, timestamps, types and digests made from the old fields, storing
equal payloads once and referring to that record from the others. The old HTTP header (status line and
all fields) and the IP address are carried over, and every file begins with a ``warcinfo`` record.

Files are written by Spark's text writer, one row and so one file of at most ``FILE_BYTES`` of records
(or a single longer one) after the other, whatever the length of the pages, and read whole by its
binary reader, so a file fits a task. Block boundaries are found by declared lengths alone, so payloads may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import scratch
from ledgerlight.llm.arrow_text import slices

# The header fields of the two ARC versions and the types they are read as.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
# Options of the text writer: archives are read back soon, so compression favours speed.
_PACKED = {"zlib.compress.level": "BEST_SPEED"}
ID_HEADER = "X-Archive-Item"
#: Bytes of records in a file.
FILE_BYTES = 8 << 20
RECORD_COLUMNS = "item long, url string, stamp string, mime string, ip string, head binary, payload binary"
WARC_COLUMNS = "item long, record_id string, record_type string, url string, warc_date string, payload_bytes long, payload_digest string, refers_to long, ip string, head binary, payload binary"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(item: int) -> str:
    """A version 8 UUID that holds the item's number, so a reference can be read back from it."""
    n = item & (1 << 64) - 1
    return str(uuid.UUID(int=0xA4C0 << 112 | 8 << 76 | (n >> 62) << 64 | 2 << 62 | n & (1 << 62) - 1))


def item_of(urn: str) -> int:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    item = (n >> 64 & 3) << 62 | n & (1 << 62) - 1
    return item - (1 << 64) if item >> 63 else item


def _token(text: str | None) -> str:
    """A header field: percent-encoded where it would end the field or the line."""
    return re.sub(r"[\s%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text) if text else "-"


def _plain(field: str) -> str | None:
    return None if field == "-" else re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(errors="replace"), field)


def arc_version_block(version: int, name: str) -> str:
    body = f"{version} 0 ledgerlight\n{' '.join(ARC_FIELDS[version])}\n"
    fields = [f"filedesc://{name}", "0.0.0.0", "19960923000000", "text/plain", "200", "-", "-", "0", name] if version == 2 else [f"filedesc://{name}", "0.0.0.0", "19960923000000", "text/plain"]
    return f"{' '.join(fields)} {len(body)}\n{body}"


def arc_record(version: int, item: int | None, url: str | None, payload: str, stamp: str, name: str) -> str:
    """Header line and block: an HTTP response whose body is the payload."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += "" if item is None else f"{ID_HEADER}: {item}\r\n"
    body = f"{head}Content-Length: {len(payload.encode())}\r\n\r\n{payload}"
    fields = [_token(url), "0.0.0.0", stamp, "text/html"] + ([] if version == 1 else ["200", "-", "-", "0", name])
    return f"{' '.join(fields)} {len(body.encode())}\n{body}"


def _http(status: int | str, mime: str, length: int) -> bytes:
    return f"HTTP/1.1 {status} {'OK' if str(status) == '200' else 'Archived'}\r\nContent-Type: {mime}\r\nContent-Length: {length}".encode()


def parse_arc(data: bytes) -> Iterator[tuple[int | None, str | None, str, str, str | None, bytes, bytes]]:
    """(item, url, stamp, mime, ip, head, payload) of every record of one ARC file, gzipped or plain.

    ``head`` is the record's own HTTP header without its end, lines ended by CRLF; a block without one gets
    a header from the record's result code (200 if there is none) and type. The version block decides how many
    fields a header line has; further version blocks (files put together) change it. A header line
    without a valid length, or a block that is cut short, is an error: nothing after it can be found.
    """
    data = gunzip(data)
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode(errors="replace").rstrip("\r").split(" ")
        if end < 0 or not line[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        block = data[end + 1 : end + 1 + int(line[-1])]
        if len(block) < int(line[-1]):
            raise ValueError(f"the ARC record at byte {at} is cut short")
        at = end + 1 + len(block)
        if line[0].startswith("filedesc:"):
            fields = ARC_FIELDS[int(block.split(b" ", 1)[0])]
            continue
        if len(line) != len(fields):
            raise ValueError(f"{len(line)} fields in an ARC header line of {len(fields)}")
        named = dict(zip(fields, line))
        mark = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
        if mark:
            lines, body = re.split(rb"\r?\n", block[: mark.start()]), block[mark.end() :]
        else:
            code, body = named.get("Result-code", "200"), block
            lines = _http(code if re.fullmatch(r"[1-5]\d\d", code) else 200, named["Content-type"], len(body)).split(b"\r\n")
        item = None
        for field in lines[1:]:
            name, _, value = field.partition(b":")
            if name.lower() == ID_HEADER.lower().encode() and re.fullmatch(rb"-?\d+", value.strip()):
                item = int(value)
        head = b"\r\n".join(x for x in lines if not x.lower().startswith(ID_HEADER.lower().encode() + b":"))
        ip = named["IP-address"]
        yield item, _plain(named["URL"]), named["Archive-date"], named["Content-type"], None if ip in ("-", "0.0.0.0") else ip, head, body


def warc_date(stamp: str) -> str:
    """The 14 digits of an ARC date as an ISO timestamp; short ones are filled with first days."""
    s = (stamp + "00000101000000"[len(stamp) :])[:14] if stamp.isdigit() and len(stamp) >= 4 else "19700101000000"
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def warc_info(name: str, date: str) -> bytes:
    """The record that begins a file, without the end mark."""
    body = f"software: ledgerlight\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\nisPartOf: {name}\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + body).encode()


def warc_record(key: int, item: int | None, url: str | None, stamp: str, ip: str | None, head: bytes, payload: bytes, refers_to: int | None, refers_item: int | None) -> bytes:
    """One WARC record without the end mark; a revisit has the HTTP header only.

    ``key`` and ``refers_to`` make the identifiers; the item numbers, and the payload's length, which the
    old header need not tell, stand in fields of their own.
    """
    block = head + b"\r\n\r\n" if refers_to is not None else head + b"\r\n\r\n" + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_uuid(key)}>", f"WARC-Date: {warc_date(stamp)}"]
    lines += [f"WARC-Target-URI: {_token(url)}"] if url else []
    lines += [f"WARC-IP-Address: {ip}"] if ip else []
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to)}>"]
        lines += [f"X-Refers-To-Item: {refers_item}"] if refers_item is not None else []
    lines += [f"{ID_HEADER}: {item}"] if item is not None else []
    lines += [f"X-Payload-Length: {len(payload)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block


def parse_warc(data: bytes) -> Iterator[tuple]:
    """Rows of ``WARC_COLUMNS`` for every response and revisit of one WARC file, gzipped or plain."""
    data, at = gunzip(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        named = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        length = int(named["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} does not end where it says")
        at = end + 8 + length
        if named["WARC-Type"] == "warcinfo":
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        revisit = named["WARC-Type"] == "revisit"
        declared, digest = int(named["X-Payload-Length"]), named["WARC-Payload-Digest"].removeprefix("sha1:")
        if not revisit and (len(payload) != declared or digest_of(payload) != digest):
            raise ValueError(f"the payload of {named['WARC-Record-ID']} does not match its digest")
        url = _plain(named["WARC-Target-URI"]) if "WARC-Target-URI" in named else None
        number = lambda field: int(named[field]) if field in named else None
        yield (
            number(ID_HEADER), named["WARC-Record-ID"], named["WARC-Type"], url, named["WARC-Date"], declared, digest,
            number("X-Refers-To-Item"), named.get("WARC-IP-Address"), head, None if revisit else payload,
        )


def gunzip(data: bytes) -> bytes:
    """The content of one or more gzip members; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out) + data if out else data


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _in_files(records: Iterator[bytes], mark: bytes, file_bytes: int, head: bytes = b"") -> Iterator[pa.RecordBatch]:
    """One row per file: ``head`` and consecutive records, separated by ``mark``."""
    held, size = [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": pa.array([mark.join([head, *held] if head else held)], pa.binary())})

    for record in records:
        if held and size + len(record) > file_bytes:
            yield row()
            held, size = [], 0
        held.append(record)
        size += len(record)
    if held:
        yield row()


def _write_files(rows: DataFrame, path: str, mark: str, codec: str) -> None:
    """Each ``value`` as a file of its own, ended by ``mark``."""
    writer = rows.select(F.col("value").cast("string")).write.option("lineSep", mark).option("maxRecordsPerFile", 1)
    writer.options(**_PACKED, compression=codec).text(path)


def write_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", stamp: str = "20240501000000", file_bytes: int = FILE_BYTES, codec: str = "gzip") -> str:
    """Write rows as ARC files, version 1 and 2 by turns of the tasks, and return their folder."""
    picked = pages.select(F.col(page_id).cast("bigint").alias("item"), F.col(url).alias("url"), F.col(html).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"
        rows = (row for batch in batches for piece in slices(batch, "html") for row in zip(*(piece.column(k).to_pylist() for k in ("item", "url", "html"))))
        records = (arc_record(version, item, target, page or "", stamp, name).encode() for item, target, page in rows)
        yield from _in_files(records, b"\n", file_bytes, arc_version_block(version, name).encode())

    path = scratch.new_path(pages.sparkSession, "arc")
    _write_files(picked.mapInArrow(write, "value binary"), path, "\n", codec)
    return path


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORD_COLUMNS`` from all ARC files of a folder."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.int64()), ("url", pa.string()), ("stamp", pa.string()), ("mime", pa.string()), ("ip", pa.string()), ("head", pa.binary()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(parse_arc(content.as_py()), schema)

    return _files(spark, path).mapInArrow(records, RECORD_COLUMNS)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``WARC_COLUMNS`` from all WARC files of a folder, digests checked."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in WARC_COLUMNS.split(", ")])
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(parse_warc(content.as_py()), schema)

    return _files(spark, path).mapInArrow(records, WARC_COLUMNS)


def convert(spark: SparkSession, arc_path: str, min_bytes: int = 0, codec: str = "gzip", file_bytes: int = FILE_BYTES) -> str:
    """Write the records of ARC files as WARC files and return their folder.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest item
    number becomes a response, the others revisits of it; smaller ones are all responses. Records
    without an item number come after all that have one, and get identifiers from the negative hash of their
    URL, date and digest. Which record is which is settled on (item, digest) alone: groups are counted before
    the shuffle, the digests of groups with several members are stored, and payloads meet only their own,
    unique decision. Headers and addresses are carried over. A file is one gzip member.
    """
    digest = F.expr("sha1(payload)")
    substitute = -F.abs(F.xxhash64("url", "stamp", "digest") % F.lit(1 << 61)) - 1
    parsed = read_arc(spark, arc_path).withColumn("digest", digest).withColumn("known", F.col("item").isNotNull()).withColumn("key", F.coalesce("item", substitute))
    small = scratch.keep(parsed.select("known", "key", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes), "arc-digests")
    first = F.max(F.struct("known", "key")).alias("first")
    groups = scratch.keep(small.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "first"), "arc-groups")
    revisits = small.join(groups, "digest").where("key <> first.key or known <> first.known")
    revisits = scratch.keep(revisits.select("known", "key", "digest", F.col("first.key").alias("refers_to"), F.when(F.col("first.known"), F.col("first.key")).alias("refers_item")).distinct(), "arc-revisits")
    path, date = scratch.new_path(spark, "warc"), datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        columns = ("key", "item", "url", "stamp", "ip", "head", "payload", "refers_to", "refers_item")
        rows = (row for batch in batches for piece in slices(batch, "payload") for row in zip(*(piece.column(k).to_pylist() for k in columns)))
        info = warc_info(f"{path.rsplit('/', 1)[-1]}-{TaskContext.get().partitionId():05d}.warc", date)
        yield from _in_files((warc_record(*row) for row in rows), b"\r\n\r\n", file_bytes, info)

    joined = parsed.join(revisits, ["known", "key", "digest"], "left").select("key", "item", "url", "stamp", "ip", "head", "payload", "refers_to", "refers_item")
    _write_files(joined.mapInArrow(write, "value binary"), path, "\r\n\r\n", codec)
    scratch.drop(small, groups, revisits)
    return path


def archive_pages(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages to ARC files to WARC files, read back: one row of ``WARC_COLUMNS`` per page.

    A null page has an empty payload, a null URL no target; a null ID comes back as null, and is never
    the response of a group that has an ID (``refers_to`` is null where the response has none). Repeated rows (equal ID and text) are
    responses both, as neither precedes the other. Only the ID, URL and text columns are read.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, page_id, url, html)
    warc = convert(spark, arc, min_bytes)
    scratch.remove(spark, arc)
    return read_warc(spark, warc)
