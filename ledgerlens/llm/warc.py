"""WARC: a writer of one gzip member a record, and a sequential reader.

The reader takes an archive in chunks and inflates member by member, never further than the
record's own Content-Length says; it frames each record by that length, checks the trailing
blank lines, and verifies block and payload digests (SHA-1, SHA-256 or MD5, in base32 or
hexadecimal digits; other algorithms are left unverified).  After a damaged member it goes on
at the next gzip member that begins a WARC record.  Archives are rows of bytes, of ``ARCHIVE``
bytes or so each, so Spark's own commit protocol writes them to the shared folder and a lost
task is simply run again; files on any store that Spark reads come in through
``spark.read.format("binaryFile")``, whose files of 2 GB at most bound an archive.

Cases: a null html or url is an empty one; payloads, urls and headers of any length are kept
whole (``LIMIT`` is what a cell of bytes can hold, so no longer record is written, and written
archives tell their longest header; headers of other archives end within ``HEADER``); a null page_id is never a revisit's target unless all pages
of that payload lack one; rows that repeat the least page_id of a payload are all responses;
an empty table gives an empty result; a null or empty archive has no records; a damaged member
gives one row with an error; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import base64
import hashlib
import string
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, likely, settle

ARCHIVE, CHUNK, LEVEL = 8 << 20, 1 << 16, 6
#: Bytes of the longest header that is looked for in archives that do not tell theirs, of the
#: longest record, and of payloads in one Arrow batch.
HEADER, LIMIT, BATCH = 1 << 20, (1 << 31) - 1, 4 << 20
MAGIC = b"\x1f\x8b\x08"
#: Repeated payloads up to this many (some 60 bytes each) are sent to every task; more are joined by shuffle.
SMALL_REPEATS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, target: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member.  A revisit holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}", f"WARC-Payload-Digest: sha1:{sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{target}>", f"WARC-Profile: {PROFILE}"]
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode() + BREAK + block + BREAK) + made.flush()


class Reader:
    """(offset, compressed length, headers, block) of each record of a stream of chunks, or
    (offset, bytes skipped, None, message) for what is damaged."""

    def __init__(self, chunks: Iterable[bytes], limit: int = LIMIT, header: int = HEADER) -> None:
        # raw begins where a member does, at offset ``at`` of the stream
        self.chunks, self.raw, self.at, self.limit, self.header = iter(chunks), bytearray(), 0, limit, header

    def _fill(self, n: int) -> bool:
        """Have ``n`` bytes from the member's start on, if the stream goes so far."""
        while len(self.raw) < n:
            more = next(self.chunks, None)
            if more is None:
                return False
            self.raw += more
        return True

    def _drop(self, n: int) -> None:
        del self.raw[:n]
        self.at += n

    def _record(self) -> tuple[int, dict[str, str], bytes]:
        tool, plain, fed = zlib.decompressobj(31), bytearray(), 0

        def inflate(upto: int) -> bool:
            """Have ``upto`` bytes of the record; False if the member ends before."""
            nonlocal fed, plain
            while len(plain) < upto and not tool.eof:
                data = tool.unconsumed_tail
                if not data:
                    known = self._fill(fed + 1)
                    data = bytes(self.raw[fed : fed + CHUNK])
                    fed += len(data)
                got = tool.decompress(data, upto - len(plain))
                if not (data or got or known or tool.eof):
                    raise ValueError("member is cut off")
                plain += got
            return len(plain) >= upto

        if not inflate(5) or plain[:5] != b"WARC/":
            raise ValueError("not a WARC record")
        seen = 0
        while (end := plain.find(BREAK, max(seen - 3, 0))) < 0:
            seen = len(plain)
            if seen >= self.header or not inflate(min(2 * seen + 512, max(self.header, HEADER))) and len(plain) == seen:
                raise ValueError("record has no header end")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in plain[:end].decode("utf-8", "replace").split("\r\n")[1:])}
        if not (size := headers.get("content-length", "")).isdigit():
            raise ValueError("record has no Content-Length")
        begin, stop = end + 4, end + 4 + int(size)
        if stop > self.limit:
            raise ValueError(f"record is longer than {self.limit} bytes")
        if not inflate(stop + 4):
            raise ValueError("record is shorter than its Content-Length")
        if inflate(stop + 5) or plain[stop:] != BREAK:
            raise ValueError("record is not framed by its Content-Length")
        return fed - len(tool.unused_data), headers, bytes(plain[begin:stop])

    def _resume(self) -> None:
        """Go to the next member that begins a record, or to the end."""
        at = 1
        while True:
            if (i := self.raw.find(MAGIC, at)) >= 0:
                self._drop(i)
                self._fill(512)
                try:
                    if zlib.decompressobj(31).decompress(self.raw, 5) == b"WARC/":
                        return
                except zlib.error:
                    pass
                at = 1
            else:
                gone = max(len(self.raw) - 2, 0)  # the magic may go on in the next chunk
                self._drop(gone)
                at = max(at - gone, 0)
                if not self._fill(len(self.raw) + 1):
                    self._drop(len(self.raw))
                    return

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
        while self._fill(1):
            at = self.at
            try:
                size, headers, block = self._record()
            except (ValueError, zlib.error) as e:
                self._resume()
                yield at, self.at - at, None, str(e)
            else:
                self._drop(size)
                yield at, size, headers, block


def agrees(said: str | None, data: bytes) -> bool | None:
    """Whether a digest header ("sha1:...") is that of the data; None if that cannot be told."""
    kind, _, value = (said or "").partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5") or not value:
        return None
    raw = hashlib.new(kind, data).digest()
    if len(value) == 2 * len(raw) and set(value) <= set(string.hexdigits):
        return value.lower() == raw.hex()
    return value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def understood(headers: dict[str, str], block: bytes) -> tuple[bytes, int | None, str, bool | None, str | None]:
    """A record's (payload, payload bytes, its digest, whether digests agree, error).  A revisit's payload is that of what it revisits: its size
    and digest are those that the headers tell."""
    http = headers.get("content-type", "").lower().startswith("application/http")
    head, _, payload = block.partition(BREAK) if http else (b"", b"", block)
    said = headers.get("warc-payload-digest")
    told = [agrees(headers.get("warc-block-digest"), block)]
    if headers.get("warc-type") == "revisit":
        fields = dict(x.lower().partition(":")[::2] for x in head.decode("latin-1").split("\r\n")[1:])
        size = fields.get("content-length", "").strip()
        size, digest = int(size) if size.isdigit() else None, (said or "").rpartition(":")[2] or None
    else:
        told.append(agrees(said, payload))
        size, digest = len(payload), sha1(payload)
    error = next((f"{k} digest differs" for k, t in zip(("block", "payload"), told) if t is False), None)
    known = [t for t in told if t is not None]
    return payload, size, digest, all(known) if known else None, error


RECORDS = "offset bigint, length bigint, record_id string, record_type string, target_uri string, date string, content_type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string, verified boolean, error string"
NAMED = ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "content-type", "warc-refers-to")


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True, limit: int = LIMIT) -> DataFrame:
    """A row (``RECORDS``) for each record of archives in a binary column, and one with an
    error for each damaged part.  A column ``header`` tells an archive's longest header, if any.  Without ``payloads`` their bytes are verified, but not kept.
    The digest is the SHA-1 in base32, for a revisit the one that its header tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], names)

        rows, held = [], 0
        for batch in batches:
            for x, header in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = memoryview(x.as_buffer()) if x.is_valid else b""
                for at, size, headers, block in Reader((bytes(data[i : i + CHUNK]) for i in range(0, len(data), CHUNK)), limit, max(header or 0, HEADER)):
                    if headers is None:
                        rows.append((at, size, *[None] * 10, block))
                    else:
                        payload, *told = understood(headers, block)
                        rows.append((at, size, *map(headers.get, NAMED), payload if payloads else None, *told))
                        held += len(payload) * payloads
                    if held >= BATCH or len(rows) >= 1000:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    header = F.col("header").cast("bigint") if "header" in archives.columns else F.lit(HEADER).cast("bigint")
    return arrow_rows(archives.select(content, header.alias("header")), run, RECORDS)


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives (name, content, header) of pages (page_id, url, payload, target, revisit);
    ``header`` bounds the bytes of the longest header in an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size, header = TaskContext.get().partitionId(), 0, [], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary()), pa.array([header], pa.int64())], ["name", "content", "header"])

        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, *rest = [x.as_py() for x in row]
                held.append(record(page_id, url, *rest))
                size += len(held[-1])
                # A quoted byte takes three; all other fields together are below a kilobyte.
                header = max(header, 3 * len(url.encode()) + 1024)
                if size >= ARCHIVE:
                    yield archive()
                    n, held, size, header = n + 1, [], 0, 0
        if held:
            yield archive()

    return arrow_rows(pages.select("page_id", "url", "payload", "target", "revisit"), run, "name string, content binary, header bigint")


def with_targets(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with what they revisit: the least page_id of an equal payload of ``least`` bytes
    or more, where it is another page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    slim = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("target"))
    repeats = settle(slim.filter("n > 1").select("digest", "target"), "repeated-payloads")
    if repeats.count() <= SMALL_REPEATS:
        found = rows.join(F.broadcast(repeats), "digest", "left")
    else:  # only pages whose payload may be repeated are shuffled
        maybe = likely(rows.withColumn("likely", F.lit(False)), repeats, "digest", flag="likely")
        met = maybe.filter("likely").join(repeats, "digest", "left")
        found = met.unionByName(maybe.filter("not likely").withColumn("target", F.lit(None).cast("bigint")))
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    return found.withColumn("revisit", revisit).withColumn("target", F.when(F.col("revisit"), F.col("target")))


def roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write every page as a record, read the archives back, and tell what they hold."""
    archives = settle(write_archives(with_targets(pages, least)), "archives")
    out = read_archives(archives, payloads=False)
    whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("archive does not read back: "), "error")))

    def page(urn: str):
        number = F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1)
        return F.when(number != "", number).cast("bigint")

    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), page("refers_to").alias("refers_to"))
