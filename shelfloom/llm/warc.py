"""WARC archives: writing, and a reader that salvages what it can.

Every record is a gzip member of its own, so damage to one leaves the others
readable. Tasks write whole files to a folder that all executors share, each
under a name of its own, and hand back one row per file; the table of these
rows, which Spark commits once, is the archive. A task that is run again after
a lost executor leaves at most files that no row names. Equal payloads are
stored once: the page with the smallest id is a response, the others are
revisits that refer to it.

Reading takes a whole file (the writer bounds its bytes) as bytes. A record must
have a version line, well-formed ASCII header names, record id, type and length
once each, a length that fits and the terminator; if it names a block digest,
the block must match. After a failed check the reader looks for the next good
record, plain or in a gzip member, whichever comes first, goes on there, and
logs the bytes between as quarantined. A member that breaks off gives the
records that its readable part holds. What a look has found out is remembered,
so the work stays linear in the file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_classes, materialize, shared_folder, sliced

END = "\r\n\r\n"
#: Files hold at most this many bytes (a larger record is alone); they are read whole.
FILE_BYTES = 32 << 20
#: A member that inflates to more is read on only as far as its records' headers say they go.
MEMBER_BYTES = 1 << 30
#: Largest record that the writer and Arrow can hold.
RECORD_BYTES = 1 << 31
#: Bytes in which a record's headers end.
HEADER_BYTES = 1 << 16
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT = re.compile(rb"\nWARC/1\.[01]\r\n")
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_GZIP = b"\x1f\x8b\x08"
_REQUIRED = ("warc-record-id", "warc-type", "content-length")


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class Archive:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class _Source:
    """Bytes, and what earlier looks at them have found out."""

    def __init__(self, data: bytes):
        self.data = data
        self._end = (0, -1)  # no blank line in between, and its place
        self._plain: tuple[int, int] | None = None

    def header_end(self, at: int) -> int:
        """Place of the first blank line from here on, -1 if there is none."""
        since, found = self._end
        if not (since <= at and (found < 0 or at <= found)) or self._end == (0, -1):
            found = self.data.find(b"\r\n\r\n", at)
            self._end = (at, found) if found >= 0 else (at or 1, -1)
        return found

    def record(self, at: int) -> tuple[Record, int] | str:
        """The record at a version line and its end, or what is wrong with it."""
        data = self.data
        version = _VERSION.match(data, at)
        if not version:
            return "no version line"
        stop = self.header_end(version.end() - 2)
        if stop < 0:
            return "headers without end"
        if _NEXT.search(data, version.end() - 1, stop):
            return "version line inside headers"  # looked for first: many such records may follow each other
        headers: dict[str, str] = {}
        for line in data[version.end() : stop].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if not colon or not _NAME.fullmatch(name) or b"\r" in value or b"\n" in value:
                return "malformed header"
            name = name.decode("ascii").lower()
            if name in headers and name != "warc-concurrent-to":
                return "repeated header"  # cut inside its headers, another's follow
            headers[name] = value.decode("utf-8", "replace").strip()
        for name in _REQUIRED:
            if not headers.get(name):
                return f"no {name}"
        size = headers["content-length"]
        if not size.isascii() or not size.isdigit() or len(size) > 18:
            return "no content length"
        start = stop + 4
        end = start + int(size)
        if end > len(data):
            return "truncated block"
        if data[end : end + 4] != b"\r\n\r\n":
            return "no terminator"
        block = data[start:end]
        if (digest := headers.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != sha1_base32(block):
            return "block digest differs"
        return Record(at, headers, block), end + 4

    def next_plain(self, at: int) -> int:
        """Place of the next good plain record, the end if there is none."""
        if self._plain and self._plain[0] <= at <= self._plain[1]:
            return self._plain[1]
        # a version line inside a broken record may belong to a good one: try each
        found = _VERSION.search(self.data, at)
        while found and isinstance(self.record(found.start()), str):
            found = _VERSION.search(self.data, found.start() + 1)
        self._plain = (at, found.start() if found else len(self.data))
        return self._plain[1]

    def next_good(self, at: int) -> int:
        """Place of the next good record or of a member with one, else the end."""
        plain = self.next_plain(at)
        packed = self.data.find(_GZIP, at, plain)
        while packed >= 0:
            if _member_at(self.data, packed)[0].records:
                return packed
            packed = self.data.find(_GZIP, packed + 1, plain)
        return plain


def read_plain(data: bytes) -> Archive:
    """Records of uncompressed bytes."""
    source, out, at = _Source(data), Archive(), 0
    while at < len(data):
        got = source.record(at)
        if not isinstance(got, str):
            out.records.append(got[0])
            at = got[1]
            continue
        end = source.next_plain(at + 1)
        out.gaps.append(Gap(at, end - at, got))
        at = end
    return out


def _promised(plain: bytes) -> int:
    """Where the record that the bytes break off in ends by its own length (a little
    further on if they break off in its headers), 0 if they are no sound records."""
    at = 0
    while (version := _VERSION.match(plain, at)) and (stop := plain.find(b"\r\n\r\n", version.end() - 2)) >= 0:
        size = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", plain[at : stop + 2], re.IGNORECASE)
        if not size or int(size[1]) > RECORD_BYTES:
            return 0
        at = stop + 4 + int(size[1]) + 4
        if at >= len(plain):
            return at
    return at + HEADER_BYTES if at and len(plain) - at < HEADER_BYTES else 0


def _inflated(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at a place holds, as far as it can be read, and its
    end, None if it breaks off. Input is fed in pieces, so a small member costs
    little however long the file."""
    inflater = zlib.decompressobj(31)
    parts, size, step, most = [], 0, 1 << 14, MEMBER_BYTES
    while at < len(data) and not inflater.eof:
        if size >= most:
            parts = [b"".join(parts)]
            if (more := _promised(parts[0])) < size:
                break
            most = max(more, size + MEMBER_BYTES // 4)
        piece = data[at : at + step]
        before = inflater.copy()
        try:
            parts.append(inflater.decompress(piece))
        except zlib.error:
            for i in range(len(piece)):  # up to the byte that breaks it
                try:
                    parts.append(before.decompress(piece[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(parts), None
        size += len(parts[-1])
        at += len(piece)
        step = min(2 * step, 1 << 20)
    return b"".join(parts), at - len(inflater.unused_data) if inflater.eof else None


def _member_at(data: bytes, at: int) -> tuple[Archive, int | None]:
    """The records of the gzip member at a place and its end, None if it is
    broken. They have the member's offset in the file; a gap inside it counts
    inflated bytes, its place there is in the reason."""
    plain, end = _inflated(data, at)
    inner = read_plain(plain)
    for record in inner.records:
        record.offset = at
    inner.gaps = [Gap(at, g.length, f"in member at {g.offset}: {g.reason}") for g in inner.gaps]
    return inner, end


def read_archive(data: bytes) -> Archive:
    """Records of plain bytes and of gzip members (one or more records each), in
    any mixture. Where neither begins, the next record that holds or the next
    member that holds one is sought; a packed payload holds none. A broken member
    is one gap, whatever records its readable part gives."""
    source, out, at = _Source(data), Archive(), 0
    while at < len(data):
        if data.startswith(_GZIP, at):
            inner, end = _member_at(data, at)
            out.records += inner.records
            if end is not None:
                out.gaps += inner.gaps
                at = end
                continue
            why = f"broken member, {len(inner.records)} records recovered" if inner.records else "broken member"
        else:
            got = source.record(at)
            if not isinstance(got, str):
                out.records.append(got[0])
                at = got[1]
                continue
            why = got
        end = source.next_good(at + 1)
        out.gaps.append(Gap(at, end - at, why))
        at = end
    return out


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of SHA-1: each five hex digits are four base-32 digits."""
    digest = F.sha1(c)
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(id, record)``: the text of one WARC record per row, without terminator.

    Payloads of at least ``least_bytes`` that are equal (by SHA-256) refer to the
    smallest id. Null html is an empty payload, a null url is left out, a row
    without id is always a response; rows that share the smallest id and the
    payload are all responses. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    same = F.sha2("html", 256)
    # written first: small, so its true size decides how the pages meet it
    first = materialize(rows.groupBy(same.alias("same")).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    rows = join_classes(rows.withColumn("same", same), first, "same", "n").withColumns({"digest": base32_sha1(F.col("html")), "bytes": F.octet_length("html").cast("long")})
    again = F.coalesce((F.col("id") > F.col("first")) & (F.col("bytes") >= least_bytes), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.when(again, head).otherwise(F.concat(head, F.col("html")))
    clean = F.regexp_replace("url", r"[\r\n]+", " ")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        line("WARC-Record-ID", name(F.col("id"))), F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line("WARC-Refers-To", name(F.col("first"))))).otherwise(""),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(block))), line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END), block,
    )
    return rows.select("id", record.alias("record"))


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, file_bytes: int | None = None, **columns) -> DataFrame:
    """Write the rows as ``.warc.gz`` files to a folder that executors share and
    return the table of files: ``(path, records, bytes)``."""
    most = file_bytes or FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        sink, path, records, size = None, "", 0, 0

        def finished() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in sliced(batches, "record"):
            for text in batch.column("record"):
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(text.as_py().encode() + END.encode()) + packer.flush()
                if sink and size + len(member) > most:
                    yield finished()
                    sink = None
                if not sink:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(path, compression=None)
                sink.write(member)
                records, size = records + 1, size + len(member)
        if sink:
            yield finished()

    return materialize(records_of(pages, **columns).select("record").mapInArrow(run, "path string, records long, bytes long"))


_SCHEMA = "file string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, gap_bytes long, reason string, payload binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]
#: Rows of one Arrow batch of the reader's output.
_OUT_ROWS = 1000


def _number(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,18})>", uri)
    return int(found[1]) if found else None


def _rows(path: str, data: bytes, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The reader's output for one file."""
    archive, made = read_archive(data), []
    for r in archive.records:
        h = r.headers
        body = r.block.partition(b"\r\n\r\n")[2]
        kind = h["warc-type"]
        if kind == "revisit":
            length = h.get("x-payload-length", "")
            size, digest, body = int(length) if re.fullmatch(r"[0-9]{1,18}", length) else None, h.get("warc-payload-digest", "").removeprefix("sha1:"), b""
        else:
            size, digest = len(body), sha1_base32(body)
        made.append((path, r.offset, _number(h["warc-record-id"]), h.get("warc-target-uri"), kind, size, digest, _number(h.get("warc-refers-to", "")), None, None, body if payloads else None))
    made += [(path, g.offset, None, None, None, None, None, None, g.length, g.reason, None) for g in archive.gaps]
    for start in range(0, len(made), _OUT_ROWS):
        part = zip(*made[start : start + _OUT_ROWS], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, _KINDS, strict=True)], names=_NAMES)


def read_files(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of the files that a table from ``write_archives`` names,
    with the columns of ``read_archives``. Tasks open the files themselves, no
    list of them passes the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = _place(path)
                with system.open_input_stream(place, compression=None) as source:
                    data = source.read()
                yield from _rows(path, data, payloads)

    return files.select("path").repartition(F.col("path")).mapInArrow(run, _SCHEMA)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False, pattern: str = "*") -> DataFrame:
    """Records and gaps of every archive in the folder (gzip or plain).

    A record row has the payload's size and digest (taken from the payload
    itself for responses, from the headers for revisits; null if a header is no
    number); a gap row has ``gap_bytes`` and ``reason`` and no record. With
    ``payloads`` the bytes too. A file beyond 2 GB can't be read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield from _rows(path, data, payloads)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInArrow(run, _SCHEMA)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to a new folder among the shared ones, read the archives
    back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html and url, null ids, repeated rows and ties: see ``records_of``. A
    page of any length is one record, alone in its file beyond ``FILE_BYTES``
    (up to 2 GB, the bound of a string). An empty table gives an empty result.
    """
    folder = f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    rows = read_files(write_archives(pages, folder, **columns)).where("record_type is not null")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
