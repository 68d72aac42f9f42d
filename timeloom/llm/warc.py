"""WARC archives out of legacy ARC archives, and back to rows.

An ARC file starts with a version block whose second line gives the version
and whose third names the fields of every record's header line; version 1 has
five of them, version 2 ten.  The last field is the record's length, so
records are read by that and not by searching.  ARC has neither record
identifiers nor types nor ISO timestamps nor (in version 1) digests: the
converter makes all four up from what the record holds, always in the same way,
so that converting twice gives the same WARC.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialise, small_batches

#: Header fields of a record by ARC version (fixed values).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records go into a file in chunks: one of at most so many bytes, or a single larger record; and chunks of a file.
CHUNK_BYTES, CHUNKS_PER_FILE = 16 << 20, 16
#: The response's page id, in the revisits of its payload.
ORIGINAL = "X-Refers-To-Page-Id"
DATE = "20240101000000"
SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class ArchiveError(ValueError):
    """An archive that breaks its format."""


@dataclass
class ArcRecord:
    version: int
    header: dict[str, str]
    block: bytes
    #: The first record of a file tells its version; whatever its address looks like, no other does.
    first: bool = False


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""


def clean_field(value: str | None) -> str:
    """A header field: blanks and controls would end it, so they are percent-encoded; empty is ``-``."""
    out = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")
    return out or "-"


def arc_file(version: int, records: Iterable[dict[str, str | bytes]], name: str = "legacy.arc", date: str = DATE) -> bytes:
    """An ARC file of ``version`` with a record for each mapping of ``url``, ``mime`` and ``block``."""
    body = f"{version} 0 timeloom\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = io.BytesIO()

    def put(url: str, mime: str, block: bytes) -> None:
        known = {
            "URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200",
            "Checksum": hashlib.md5(block).hexdigest(), "Location": "-", "Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(block)),
        }
        out.write(" ".join(known[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n")

    put(f"filedesc://{name}", "text/plain", body)
    for r in records:
        put(clean_field(r["url"]), r.get("mime", "text/html"), r["block"])
    return out.getvalue()


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, ArcRecord]]:
    """(Offset, record) of an ARC file, the version block first; no more than one record is held."""
    at, version = 0, 0
    while line := stream.readline():
        begins, at = at, at + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        if not line.endswith(b"\n"):
            raise ArchiveError("a header line without an end")
        first = not version
        fields = text.rsplit(" ", 1)
        if len(fields) < 2 or not fields[-1].isdigit():
            raise ArchiveError(f"a header line without a length: {text[:40]!r}")
        length = int(fields[-1])
        block = stream.read(length)
        at += len(block)
        if len(block) < length:
            raise ArchiveError("a record shorter than its declared length")
        if first:  # the version block's own header has the fields of either version
            if not (told := block.split(b" ", 1)[0]).isdigit() or int(told) not in ARC_FIELDS:
                raise ArchiveError(f"ARC version {told[:20]!r}")
            version = int(told)
        names = ARC_FIELDS[version]
        values = text.rsplit(" ", len(names) - 1)  # from the right, as old URLs may hold blanks
        if len(values) != len(names):
            raise ArchiveError(f"a header line of {len(values)} fields")
        yield begins, ArcRecord(version, dict(zip(names, values, strict=True)), block, first)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records of an ARC file, the version block first."""
    return (record for _, record in arc_records(io.BytesIO(data)))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", block)


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def warc_date(date: str) -> str:
    """ISO 8601 of ARC's 14 digits, or of fewer, as old tools wrote."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def identifier(url: str, date: str, kind: str, block: bytes) -> str:
    """The identifier of a record, from its address, date, type and the block that its ARC record held."""
    return record_id(url, date, kind, base32_sha1(block))


def convert(record: ArcRecord, revisit_of: dict[str, str] | None = None) -> WarcRecord:
    """The WARC record equivalent to an ARC record.

    Identifier, timestamp, type and digests come from the record alone.  With ``revisit_of`` (headers that
    name the record that holds the payload) it becomes a revisit that keeps the HTTP head only.
    """
    h = record.header
    url, date = h["URL"], warc_date(h["Archive-date"])
    head, payload = split_http(record.block) if record.block.startswith(b"HTTP/") else (b"", record.block)
    if record.first:
        kind, mime = "warcinfo", "application/warc-fields"
    elif head:
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind, mime = "resource", h["Content-type"]
    block = record.block
    headers = {"WARC-Type": kind, "WARC-Target-URI": url, "WARC-Date": date, "WARC-IP-Address": h["IP-address"]}
    if kind == "warcinfo":
        headers = {"WARC-Type": kind, "WARC-Date": date, "WARC-Filename": url.removeprefix("filedesc://")}
        block = f"software: timeloom\r\nformat: WARC File Format 1.1\r\nisPartOf: ARC version {record.version}\r\n".encode()
    else:
        headers["WARC-Payload-Digest"] = f"sha1:{base32_sha1(payload)}"
    if revisit_of and kind == "response":
        headers |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, **revisit_of}
        block = head
    headers["WARC-Block-Digest"] = f"sha1:{base32_sha1(block)}"
    headers["WARC-Record-ID"] = identifier(url, date, headers["WARC-Type"], record.block)
    return WarcRecord(headers | {"Content-Type": mime}, block)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = [f"{k}: {v}" for k, v in (record.headers | {"Content-Length": str(len(record.block))}).items()]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + record.block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    """The records of a WARC file, each read by its declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC version line: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ArchiveError("a record shorter than its declared length")
        yield WarcRecord(headers, block)


def http_block(page_id: int | None, payload: bytes) -> bytes:
    known = "" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {known}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_fields(head: bytes) -> dict[str, str]:
    rows = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in rows if k}


def planned(pages: DataFrame, min_bytes: int, key: str, url: str, html: str) -> DataFrame:
    """Rows with the largest page id of their payload, and its address, where another row must revisit it.

    Only digests, ids and addresses are grouped; a payload that a third of all pages share is one row of
    the grouped side, and the join's other side can be split.
    """
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].alias("url"), pages[html].alias("html"))
    rows = rows.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html")
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy(F.col("sha").alias("of")).agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
    first = first.where("n > 1").select("of", "top.page_id", "top.url").toDF("of", "top", "top_url")
    joined = rows.join(first, rows["sha"] == first["of"], "left")
    later = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    return joined.select("page_id", "url", "payload", F.when(later, F.col("top")).alias("revisits"), "top_url")


def original(top: int, url: str | None, payload: bytes) -> dict[str, str]:
    """The headers by which a revisit names the response of page ``top``, whose record holds the payload."""
    address, date = clean_field(url), warc_date(DATE)
    found = identifier(address, date, "response", http_block(top, payload))
    return {"WARC-Refers-To": found, "WARC-Refers-To-Target-URI": address, "WARC-Refers-To-Date": date, ORIGINAL: str(top)}


def chunks(records: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Records in a row, up to ``limit`` bytes together."""
    held, size = [], 0
    for r in records:
        if held and size + len(r) > limit:
            yield b"".join(held)
            held, size = [], 0
        held.append(r)
        size += len(r)
    if held:
        yield b"".join(held)


def write(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the pages as WARC files under ``path``, gzip-compressed, by way of ARC records.

    Each page becomes an ARC record (of version 1 or 2 in turn) and is converted from that.
    Spark's committer writes the files, so a lost task leaves no torn archive.  A file holds at most ``CHUNKS_PER_FILE``
    chunks, so its size is bounded whatever the pages' sizes.
    """
    small_batches(pages.sparkSession)

    def converted(batch: pa.RecordBatch) -> Iterator[bytes]:
        ids, urls, payloads, tops, top_urls = (c.to_pylist() for c in batch.columns)
        for version in ARC_FIELDS:
            mine = range(version - 1, len(ids), len(ARC_FIELDS))
            records = read_arc(arc_file(version, ({"url": urls[i], "block": http_block(ids[i], payloads[i])} for i in mine)))
            yield warc_bytes(convert(next(records)))
            for i, record in zip(mine, records, strict=True):
                yield warc_bytes(convert(record, None if tops[i] is None else original(tops[i], top_urls[i], payloads[i])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(x for batch in batches for x in converted(batch)):
            # the writer ends every row with the line feed that is cut off here
            yield pa.RecordBatch.from_arrays([pa.array([chunk[:-1]], pa.binary())], names=["record"])

    records = planned(pages, min_bytes, key, url, html).mapInArrow(run, "record binary")
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path)


def read(spark, path: str) -> DataFrame:
    """A row for each page in the WARC files under ``path``; see :func:`round_trip` for the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for r in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    if r.headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(r.block)
                    about = http_fields(head)
                    revisit = r.headers["WARC-Type"] == "revisit"
                    digest = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base32_sha1(payload) != digest:
                        raise ArchiveError(f"payload digest of {r.headers['WARC-Record-ID']}")
                    size = int(about["content-length"]) if revisit else len(payload)
                    of = int(r.headers[ORIGINAL]) if revisit else None
                    rows.append((int(about["x-page-id"]) if about["x-page-id"] else None, size, digest, r.headers["WARC-Type"], of))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write WARC archives of all pages to the shared folder and read them back.

    Columns ``page_id``, ``payload_bytes``, ``payload_digest`` (bare base32 SHA-1), ``record_type`` and
    ``refers_to``.  Of records with equal payloads of at least ``min_bytes`` bytes that of the largest
    page id is the response and those of smaller ids revisit it; rows that repeat the largest id are
    responses too, and rows without an id revisit any that has one.  Null html is an empty
    payload, a null URL is written as ``-``.  An empty table gives no archive and no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, min_bytes, key, url, html)
    return read(spark, path)


ARC_SCHEMA = "file string, offset bigint, version int, first boolean, header map<string,string>, block binary"


def plain(content: bytes) -> io.BufferedIOBase:
    """The bytes of a file, unpacked if it is gzip: as a whole, or a member a record."""
    stream = io.BytesIO(content)
    return gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream


def bounded(rows: Iterator[tuple], kinds: list, names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last values are no more than ``CHUNK_BYTES`` together, or one larger."""
    held, total = [], 0
    for row in rows:
        if held and total + len(row[size]) > CHUNK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, total = [], 0
        held.append(row)
        total += len(row[size])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_arc_files(spark, path: str) -> DataFrame:
    """A row for each record of the ARC files under ``path``: ``file, offset`` (before compression)``, version, first, header, block``.

    Files may be plain or gzip, of version 1 or 2, and are told by their content.  One that breaks the format fails the
    read with its name; empty ones have no rows.  A file is one value of Spark's, 2 GB at most; its records are unpacked one after the other.
    """
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            for offset, r in arc_records(plain(content)):
                yield name, offset, r.version, r.first, list(r.header.items()), r.block
        except (ArchiveError, OSError, EOFError) as e:
            raise ArchiveError(f"{name}: {e}") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                yield from bounded(rows(name.as_py(), content.as_py()), kinds, ["file", "offset", "version", "first", "header", "block"], 5)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, ARC_SCHEMA)


def convert_folder(spark, arc: str, to: str, min_bytes: int = 0) -> None:
    """Convert all ARC files under ``arc`` to WARC files under ``to``.

    Of HTTP records with equal payloads of at least ``min_bytes`` bytes the first by date, address, file and offset is the response, the
    others revisit it and keep their HTTP heads; all other records are kept whole.  Only digests and headers are grouped.
    Converting twice gives records with the same identifiers.
    """
    small_batches(spark)
    records = read_arc_files(spark, arc)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [split_http(b) if b.startswith(b"HTTP/") else None for b in batch.column(2).to_pylist()]
            shas = [None if h is None or first or len(h[1]) < min_bytes else base32_sha1(h[1]) for h, first in zip(halves, batch.column(3).to_pylist(), strict=True)]
            blocks = [base32_sha1(b) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(shas, pa.string()), pa.array(blocks, pa.string())], names=["file", "offset", "header", "sha", "block_sha"])

    known = records.select("file", "offset", "block", "first", "header").mapInArrow(digests, "file string, offset bigint, header map<string,string>, sha string, block_sha string")
    place = F.struct(F.col("header")["Archive-date"].alias("date"), F.col("header")["URL"].alias("url"), "file", "offset", "block_sha")
    known = materialise(known.where("sha IS NOT NULL").select("sha", place.alias("place")), "payloads")
    tops = known.groupBy(F.col("sha").alias("of")).agg(F.min("place").alias("top"), F.count("*").alias("n")).where("n > 1")
    later = known.join(tops, known["sha"] == tops["of"]).where("place <> top").select(F.col("place.file").alias("file"), F.col("place.offset").alias("offset"), "top")
    rows = records.join(later, ["file", "offset"], "left").select("version", "first", "header", "block", F.col("top.date").alias("date"), F.col("top.url").alias("url"), F.col("top.block_sha").alias("sha"))

    def converted(batch: pa.RecordBatch) -> Iterator[bytes]:
        for version, first, header, block, date, url, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of = None if date is None else {"WARC-Refers-To": record_id(url, warc_date(date), "response", sha), "WARC-Refers-To-Target-URI": url, "WARC-Refers-To-Date": warc_date(date)}
            yield warc_bytes(convert(ArcRecord(version, dict(header), block, first), of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(x for batch in batches for x in converted(batch)):
            yield pa.RecordBatch.from_arrays([pa.array([chunk[:-1]], pa.binary())], names=["record"])

    text = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(to)


def read_warc_files(spark, path: str) -> DataFrame:
    """``headers, block`` of every record of the WARC files under ``path``, plain or gzip."""
    kinds = [pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from bounded(((list(r.headers.items()), r.block) for r in read_warc(plain(content.as_py()))), kinds, ["headers", "block"], 1)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "headers map<string,string>, block binary")
