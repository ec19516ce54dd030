"""WARC archives: a writer with revisit records and a reader that salvages what damaged archives still hold."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, written

#: Bytes after which an archive file is closed and another begun.
FILE_BYTES = 256 << 20
#: Rows of one payload beyond which they are joined with their group's response apart from all others, and such payloads
#: that are broadcast at most.
HOT_ROWS, MOST_HOT, SALTS = 100_000, 10_000, 64
_READ = 1 << 20
_VERSION = b"WARC/1."
_GZIP = b"\x1f\x8b\x08"
_FIRST_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
_DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_TO_32 = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuv")
_BLANK = re.compile(r"[\x00-\x20\x7f]")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system for any URI that Arrow knows; a bare path is a local file."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://")) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, compress: bool = True) -> bytes:
    """One record, as a gzip member of its own if compress. A revisit has no block; its digest is the full payload's.

    Blanks and control characters of the url, which a header can't hold, are percent-encoded. Headers may be of any length.
    """
    clean = _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    """offset and length are those of the member or record in the file."""

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes = field(repr=False, default=b"")


@dataclass
class Gap:
    """Bytes that no record could be read from."""

    offset: int
    length: int
    reason: str


class _Window:
    """A seekable file read forward. Places are offsets in the file; bytes before `at` are given up a megabyte at a time."""

    def __init__(self, source) -> None:
        self.source, self.base, self.at, self.data, self.ended = source, 0, 0, bytearray(), False
        self.size = source.seek(0, io.SEEK_END)
        self.hits: dict[bytes, int] = {}
        source.seek(0)

    def more(self) -> bool:
        if self.at - self.base > _READ:
            del self.data[: self.at - self.base]
            self.base = self.at
        if self.ended:
            return False
        got = self.source.read(_READ)
        self.ended = not got
        self.data += got
        return bool(got)

    def upto(self, end: int) -> bool:
        """Whether the bytes before `end` are there; reads as far as that takes."""
        while self.base + len(self.data) < end and self.more():
            pass
        return self.base + len(self.data) >= end

    def get(self, start: int, end: int) -> bytes:
        return bytes(self.data[start - self.base : end - self.base])

    def peek(self, start: int, n: int) -> bytes:
        """n bytes from `start` on; what lies between isn't read. Fewer at the end of the file."""
        if start + n <= self.base + len(self.data) or start >= self.size:
            return self.get(start, start + n)
        here = self.source.tell()
        self.source.seek(start)
        got = self.source.read(n)
        self.source.seek(here)
        return got

    def find(self, mark: bytes, start: int, read: bool = True) -> int:
        """The first place from `start` on where mark is, or -1. A hit is kept, so that many searches before it cost one.

        Without `read` only bytes that are there already are searched; else it reads until there is a hit.
        """
        clear, hit = self.hits.get(mark, (0, 0))  # no place from clear on and before hit has the mark
        if clear <= start <= hit:
            if self.data.startswith(mark, hit - self.base):
                return hit
            place = hit
        else:
            clear = place = start
        while True:
            if (hit := self.data.find(mark, max(0, place - self.base))) >= 0:
                self.hits[mark] = clear, self.base + hit
                return self.base + hit
            place = max(place, self.base + len(self.data) - len(mark) + 1)
            self.hits[mark] = clear, place
            if not read or not self.more():
                return -1


def _content_length(headers: dict[str, str]) -> int | None:
    said = headers.get("content-length", "")
    return int(said) if said.isascii() and said.isdigit() and len(said) <= 15 else None


def _line(line: str, headers: dict[str, str]) -> bool:
    """Adds a header line; False if it is none."""
    name, colon, value = line.partition(":")
    if colon:
        headers[name.strip(" \t").lower()] = value.strip(" \t")
    return bool(colon)


def _parse(raw: bytes | bytearray, end: int) -> dict[str, str] | str:
    """Headers of the bytes before `end`, or what is wrong."""
    if not _FIRST_LINE.match(raw):
        return "no version line"
    headers: dict[str, str] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if not _line(line, headers):
            return "bad header line"
    return headers if _content_length(headers) is not None else "bad content length"


def _checked(headers: dict[str, str], block: bytes) -> str:
    """What is wrong with a record, if anything: its digest must hold unless it is a revisit."""
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and said.startswith("sha1:"):
        said = said[5:]
        if len(said) != 32 or not said.isascii() or set(said) - _DIGITS or int(said.translate(_TO_32), 32) != int.from_bytes(hashlib.sha1(block).digest()):
            return "payload digest differs"
    return ""


def _deflated(w: _Window, at: int) -> int:
    """Where the compressed bytes of the gzip member at `at` begin, after its optional fields; -1 if its header isn't one."""
    w.upto(at + 12)
    head = w.get(at, at + 12)
    if len(head) < 12 or head[3] & 0xE0:
        return -1
    place = at + 10
    if head[3] & 4:
        place += 2 + head[10] + 256 * head[11]
    for flag in (8, 16):
        if head[3] & flag:
            if (zero := w.find(b"\0", place)) < 0:
                return -1
            place = zero + 1
    return place + 2 * bool(head[3] & 2)


def _member(w: _Window, failed: dict[int, str]) -> tuple[Record, int] | str:
    """The gzip member at the window's start.

    It is decompressed piece by piece and given up as soon as it can't be a record: another first line, a bad header, or
    more bytes than the content length and a line end. So a false member costs little time and memory. failed has the
    last place where compressed bytes began that are none: several false headers may lead to it.
    """
    start = w.at
    used = data_at = _deflated(w, start)
    if used < 0:
        return "bad member: header"
    if data_at in failed:
        return failed[data_at]
    got = _inflated(w, start, used)
    if isinstance(got, str):
        failed.clear()
        failed[data_at] = got
    return got


def _inflated(w: _Window, start: int, used: int) -> tuple[Record, int] | str:
    z, raw, piece, crc, size = zlib.decompressobj(-15), bytearray(), 4096, 0, 0
    headers: dict[str, str] | None = None
    seen = end = total = 0
    waiting = b""
    try:
        while not z.eof:
            if not waiting:
                if not w.upto(used + 1):
                    return "member cut short"
                waiting = w.get(used, used + piece)
                used += len(waiting)
                piece = min(4 * piece, _READ)
            got = z.decompress(waiting, _READ)
            waiting = z.unconsumed_tail
            crc, size = zlib.crc32(got, crc), size + len(got)
            if headers is not None and len(raw) >= total:
                if got.strip(b"\r\n"):
                    return "content length differs"
                continue
            raw += got
            if len(raw) >= 10 and seen == 0 and not _FIRST_LINE.match(raw):
                return "no version line"
            if headers is None:
                end = raw.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(raw)
                if end >= 0:
                    headers = _parse(raw, end)
                    if isinstance(headers, str):
                        return headers
                    total = end + 4 + _content_length(headers)
            if headers is not None and len(raw) > total:
                if raw[total:].strip(b"\r\n"):
                    return "content length differs"
                del raw[total:]
    except zlib.error as e:
        return f"bad member: {e}"
    used -= len(z.unused_data)
    if not w.upto(used + 8):
        return "member cut short"
    if w.get(used, used + 8) != struct.pack("<II", crc, size & 0xFFFFFFFF):
        return "bad member: checksum or size differs"
    if headers is None:
        return "no end of headers"
    if len(raw) < total:
        return "content length differs"
    block = bytes(raw[end + 4 :])
    return _checked(headers, block) or (Record(start, used + 8 - start, headers, block), used + 8 - start)


def _plain(w: _Window, bad: list[int]) -> tuple[Record, int] | str:
    """The uncompressed record at the window's start.

    bad has the place up to which a start that was tried before has shown every header to fail: the header that is
    open at a later start before it has the same bad line, or the same end and length.
    """
    start = w.at
    w.upto(start + 10)
    if not _FIRST_LINE.match(w.get(start, start + 10)):
        return "no version line"
    if start < bad[0]:
        return "bad header line"
    place, headers = start + 10, {}
    while True:
        line_end = w.find(b"\r\n", place)
        if line_end < 0:
            bad[0] = w.size
            return "no end of headers"
        if line_end == place:
            break
        if not _line(w.get(place, line_end).decode("utf-8", "replace"), headers):
            bad[0] = place
            return "bad header line"
        place = line_end + 2
    block_at = place + 2
    n = _content_length(headers)
    bad[0] = place
    if n is None:
        return "bad content length"
    if block_at + n + 4 > w.size:
        return "record cut short"
    if w.peek(block_at + n, 4) != b"\r\n\r\n":  # a wrong length is told before its bytes are read
        return "content length differs"
    w.upto(block_at + n + 4)
    block = w.get(block_at, block_at + n)
    if wrong := _checked(headers, block):
        return wrong
    bad[0] = 0
    length = block_at + n + 4 - start
    return Record(start, length, headers, block), length


def salvage(source) -> Iterator[Record | Gap]:
    """Records of an archive (a seekable binary file), and the byte gaps where none could be read.

    After a check fails (member CRC, version line, header form, content length, payload digest), the reader looks from
    the next byte on for a gzip member or version line whose record passes every check, and goes on there. All that
    was passed over is one gap. Memory is a record and a read-ahead. Time is linear: searches go on from the last
    hit, false members are given up at once, and a header that failed isn't read again from within.
    """
    w, gap_at, why, bad, failed = _Window(source), -1, "", [0], {}
    while w.upto(w.at + 1):
        w.upto(w.at + 12)
        head = w.get(w.at, w.at + 7)
        if head.startswith(_GZIP):
            got = _member(w, failed)
        elif head == _VERSION:
            got = _plain(w, bad)
        else:
            got = "neither member nor version line"
        if not isinstance(got, str):
            if gap_at >= 0:
                yield Gap(gap_at, w.at - gap_at, why)
                gap_at = -1
            yield got[0]
            w.at += got[1]
            continue
        if gap_at < 0:
            gap_at, why = w.at, got
        place = w.at + 1
        while True:
            found = [k for k in (w.find(_GZIP, place, False), w.find(_VERSION, place, False)) if k >= 0]
            if found:
                w.at = min(found)
                break
            w.at = place = max(place, w.base + len(w.data) - len(_VERSION) + 1)
            if not w.more():
                w.at = w.size
                break
    if gap_at >= 0:
        yield Gap(gap_at, w.size - gap_at, why)


def write_archives(pages: DataFrame, *, least_bytes: int = 0, path: str | None = None, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest (path, bytes, records).

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of least_bytes or more, that with the
    largest page_id is the response and the others revisit it; smaller payloads are all responses. Rows without
    page_id are responses. A row that repeats its group's largest page_id is a response too. Other columns are ignored,
    whatever their names; pages and urls may be of any length, one record at a time is in memory. An empty table gives
    an empty manifest. Files have fresh names; only those in the manifest, written once every task has ended, count, so
    retried tasks leave no double records.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = base.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts, "firsts")
    refers = F.when((F.octet_length("payload") >= least_bytes) & (F.col("page_id") < F.col("first")), F.col("first"))
    # a payload that a large share of the pages have is joined by broadcast; its rows get keys of their own for the other join
    hot = firsts.where(F.col("n") > HOT_ROWS).select("sha", F.col("first").alias("hot"))  # total / HOT_ROWS rows at most
    if not (few := hot.count()):
        rows = base.join(firsts.select("sha", "first"), "sha", "left")
    else:
        on = ["sha"]
        if few <= MOST_HOT:
            hot = F.broadcast(hot)
        else:  # too many to broadcast: each hot payload's rows go to SALTS places
            on = ["sha", "salt"]
            hot = hot.select("sha", "hot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            base = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        key = F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
        rows = base.join(hot, on, "left").withColumn("sha", key).join(firsts.where(F.col("n") <= HOT_ROWS).select("sha", "first"), "sha", "left").withColumn("first", F.coalesce("hot", "first"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))
    folder = path or new_path(spark, "warc")
    file_system, at = opened(folder)
    file_system.create_dir(at, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        out, name, size, count = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", size, count))
            out = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                body = payload.as_py()
                raw = record(page_id.as_py(), url.as_py(), body, digest(body), refers_to.as_py(), compress)
                if out is None:
                    name, size, count = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return written(rows.mapInArrow(write, "path string, bytes long, records long"), "manifest")


RECORDS = "path string, offset long, length long, gap string, type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def read_archives(files: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Rows RECORDS of the archives at files.path: one for each record, and one with `gap` set for each quarantined gap.

    Each file is read by one task, streamed; without payloads only headers and digests leave it. A revisit's
    payload_bytes and payload_digest are those that its headers give; a header that isn't there is null. Files that
    repeat are read each time; no files give no rows.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_file(at) as source:
                    for x in salvage(source):
                        if isinstance(x, Gap):
                            rows.append((path, x.offset, x.length, x.reason, *[None] * 7))
                        else:
                            h = x.headers
                            revisit = h.get("warc-type") == "revisit"
                            n = number(h.get("x-payload-length")) if revisit else len(x.block)
                            said = h.get("warc-payload-digest", "")
                            sha = said[5:] if said.startswith("sha1:") else said or None if revisit else digest(x.block)
                            rows.append((path, x.offset, x.length, None, h.get("warc-type"), number(h.get("x-page-id")), number(h.get("x-refers-to-page-id")), h.get("warc-target-uri"), n, sha, x.block if payloads else None))
                            held += len(x.block) * payloads
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path").repartition(max(n, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, RECORDS)


def salvage_bytes(raw: bytes) -> list[Record | Gap]:
    return list(salvage(io.BytesIO(raw)))


#: DuckDB: what the archives of all pages give back.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p
"""
