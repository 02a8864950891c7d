"""WARC archives: a writer of gzip members and a salvage reader.

The reader checks each gzip member (header, deflate stream, CRC) and each record (version line, header
block, declared length, closing blank lines, block digest). After a failed check it searches for the next
valid member, or in plain archives and in a member's inflated bytes for the next version line, goes on from
there, and reports the bytes in between as a gap. What a faulty member inflates to before its fault is searched
as well. Nothing that can still be read is lost to an earlier fault. A damaged record whose frame can be trusted
is passed over whole, so that a record which its payload quotes is not taken for one of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

#: Archives are closed at the first record beyond this size.
ARCHIVE_BYTES = 16 << 20
RECORD_SCHEMA = "archive string, byte_offset long, inner_offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_from long, gap_to long, gap_reason string"

_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_HEAD_END = re.compile(rb"\r\n\r\n|\r\nWARC/1\.")
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _flat(value: str) -> str:
    """A header value on one line: CR and LF would end it."""
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record. A revisit has the digest and length of the full payload, but not the payload."""
    block = b"" if is_revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Date: {_DATE}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_flat(url)}")
    if is_revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Bad(NamedTuple):
    """What is wrong at a byte, and where the damaged record ends if its frame can be trusted, else 0."""

    reason: str
    stop: int


class Found(NamedTuple):
    """A record: the archive bytes of it, or of the gzip member around it, and then its place in the inflated bytes."""

    at: int
    stop: int
    inner: tuple[int, int] | None
    head: dict
    block: bytes


class Gap(NamedTuple):
    """Quarantined bytes of the archive; or, with member set, of what the gzip member at that byte inflates to."""

    member: int | None
    start: int
    stop: int
    reason: str


def _same_digest(said: str, block: bytes) -> bool | None:
    """Whether a digest header fits the block; None for other algorithms and without one."""
    name, _, value = said.partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() == hashlib.sha1(block).hexdigest() if len(value) == 40 else value.upper() == sha1_base32(block)


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int] | Bad:
    """The record at a byte of data: its headers, block and end; or what is wrong with it.

    A version line within a line is taken only if the block's digest proves the record. A frame is trusted when
    it closes where its length says and a record, a member or the end follows.
    """
    if not data.startswith(_VERSION, at):
        return Bad("no version line", 0)
    end = _HEAD_END.search(data, at)
    if not end or end[0] != b"\r\n\r\n":
        return Bad("header block not closed", 0)
    version, *lines = data[at : end.start()].decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", version):
        return Bad("version line not closed", 0)
    head = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            return Bad("header line without a colon", 0)
        head[name.strip().lower()] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", head.get("content-length", "")):
        return Bad("no content length", 0)
    start = end.end()
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return Bad("record not closed where its length says", 0)
    block = data[start:stop]
    stop += 4
    same = _same_digest(head.get("warc-block-digest", ""), block)
    if same is False:
        return Bad("block digest differs", stop if stop == len(data) or data.startswith((_VERSION, _MAGIC), stop) else 0)
    if at and data[at - 1] != 10 and not same and not (at >= 4 and data[at - 4 : at] == b"\r\n\r\n"):
        return Bad("version line within a line", 0)
    return head, block, stop


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The bytes of the gzip member at a byte of data, to the byte before a fault; where it ends or breaks; and what is wrong, if anything.

    It is fed in slices, so that reading costs what the member holds, whatever follows it.
    """
    d, out, view, step, why = zlib.decompressobj(31), [], memoryview(data), 512, ""
    while at < len(data):
        before = d.copy()
        try:
            out.append(d.decompress(view[at : at + step]))
        except zlib.error as e:
            d, why = before, f"gzip: {e}"
            if step == 1:
                break
            step = max(1, step // 16)
            continue
        at = min(at + step, len(data))
        if d.eof:
            return b"".join(out), at - len(d.unused_data), ""
        if not why:
            step = min(2 * step, 1 << 20)
    if not why:
        return b"".join(out), len(data), "gzip: member cut short"
    tail = data[at : at + 1]
    try:
        while (piece := d.decompress(tail, 1)) or d.unconsumed_tail:
            out.append(piece)
            tail = d.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out), at, why


class _Ahead:
    """The next place of a byte string at or after a byte; asked for rising bytes, it scans the data once."""

    def __init__(self, data: bytes, what: bytes):
        self.data, self.what, self.at = data, what, -1

    def __call__(self, at: int) -> int:
        if self.at < at:
            self.at = self.data.find(self.what, at)
            if self.at < 0:
                self.at = len(self.data)
        return self.at


def _records(plain: bytes) -> tuple[list[tuple[int, int, dict, bytes]], list[tuple[int, int, str]]]:
    """The records (start, stop, headers, block) of inflated bytes and the gaps (start, stop, reason) between them: together all of the bytes."""
    found, gaps, at, bad, why, ahead = [], [], 0, -1, "", _Ahead(plain, _VERSION)
    while at < len(plain):
        got = _parse(plain, at)
        if isinstance(got, Bad):
            if bad < 0:
                bad, why = at, got.reason
            at = got.stop or ahead(at + 1)
            continue
        if bad >= 0:
            gaps.append((bad, at, why))
            bad = -1
        found.append((at, got[2], got[0], got[1]))
        at = got[2]
    if bad >= 0:
        gaps.append((bad, len(plain), why))
    return found, gaps


def _number(value: str | None) -> int | None:
    """A header's number, if it is one of 64 bits."""
    if not re.fullmatch(r"-?[0-9]{1,19}", value or ""):
        return None
    return n if -(1 << 63) <= (n := int(value)) < 1 << 63 else None


def _id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return _number(found[1]) if found else None


def salvage(data: bytes) -> Iterator[Found | Gap]:
    """Records and gaps of an archive's bytes, in order.

    Gaps of the archive, plain records and members that records were read in cover the archive without overlap;
    so do the records and gaps inside a member what it inflates to. A member with a fault ends at the fault, or where the next
    valid place begins if that is before; it always has a gap inside, at its end, which tells the fault. Members without a
    record are gaps. An empty archive yields nothing.
    """
    at, bad, why = 0, -1, ""
    broken: tuple | None = None  # the last member with a fault, as long as its end is open: at, fault's place, reason, records, gaps
    known: set = set()  # its records: its stored blocks show them once more
    members, versions = _Ahead(data, _MAGIC), _Ahead(data, _VERSION)

    def told(start: int, stop: int, found: list, gaps: list) -> Iterator[Found | Gap]:
        for a, b, *x in sorted([*found, *gaps], key=lambda e: e[:2]):
            yield Found(start, stop, (a, b), x[0], x[1]) if len(x) == 2 else Gap(start, a, b, x[0])

    def settled(end: int) -> Iterator[Found | Gap]:
        """What is pending before a valid place at end."""
        start, reason = bad, why
        if broken:
            first, fault, reason, found, gaps = broken
            start = min(fault, end)
            yield from told(first, start, found, gaps)
        if 0 <= start < end:
            yield Gap(None, start, end, reason)

    while at < len(data):
        stop, wrong, found, gaps = 0, "", [], []
        gz = data.startswith(_MAGIC, at)
        if gz:
            plain, stop, wrong = _member(data, at)
            found, gaps = _records(plain)
            if wrong:
                last = max((b for _, b, *_ in found), default=0)
                gaps = [g for g in gaps if g[0] < last] + [(last, len(plain), wrong)]
        elif isinstance(got := _parse(data, at), Bad):
            wrong, stop = got
        else:
            found, stop = [(at, got[2], got[0], got[1])], got[2]
        fresh = [f for f in found if not known or (tuple(f[2].items()), f[3]) not in known]
        if not fresh:
            if bad < 0 and not broken:
                bad, why = at, wrong or (gaps[0][2] if gaps else "member without records")
            whole = stop and not (gz and wrong)
            at = stop if whole else min(members(at + 1), versions(at + 1))
            continue
        yield from settled(at)
        bad, broken, known = -1, None, set()
        if gz and wrong:
            broken, known = (at, stop, wrong, found, gaps), {(tuple(f[2].items()), f[3]) for f in found}
            at = min(members(at + 1), versions(at + 1))
            continue
        if gz:
            yield from told(at, stop, found, gaps)
        else:
            yield Found(at, stop, None, found[0][2], found[0][3])
        at = stop
    yield from settled(len(data))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows (path, content) of archives with a record per row of pages (page_id, url, payload binary, first_id, is_revisit).

    Each task fills archives of about archive_bytes, so memory holds one archive whatever the table's size.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [f"part-{part:06d}-{n:06d}.warc.gz"], "content": pa.array([b"".join(held)], pa.binary())})

        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for i in range(b.num_rows):
                page, url, payload, first, again = (c[i].as_py() for c in cols)
                held.append(gzip_member(record(page, url, payload, first if again else None, again)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    n, held, size = n + 1, [], 0
        if held:
            yield close()

    return pages.select("page_id", "url", "payload", "first_id", "is_revisit").mapInArrow(fill, "path string, content binary")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of archives given as rows (path, content), such as the binaryFile source reads.

    byte_offset is where the record, or the gzip member around it, begins, inner_offset its place in what the
    member inflates to. A gap has gap_from, gap_to and gap_reason set and no record columns; its bytes are the
    archive's, or with byte_offset set those that the member there inflates to. Digest and length of a response
    are computed from the bytes read; those of a revisit are what its headers say of the full payload, null
    where they don't. Foreign ids and numbers that aren't of 64 bits are null. Null contents have no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                out, size = [], 0
                for x in salvage(data or b""):
                    if isinstance(x, Gap):
                        out.append((path, x.member, *[None] * 8, x.start, x.stop, x.reason))
                    else:
                        h = x.head.get
                        revisit = h("warc-type") == "revisit"
                        n = _number(h("x-payload-length")) if revisit else len(x.block)
                        digest = h("warc-payload-digest", "").removeprefix("sha1:") or None if revisit else sha1_base32(x.block)
                        out.append((path, x.at, x.inner and x.inner[0], _id(h("warc-record-id")), h("warc-target-uri"), h("warc-type"), _id(h("warc-refers-to")), n, digest, x.block if with_payload else None, None, None, None))
                        size += len(x.block)
                    if size > 8 << 20 or len(out) >= 10_000:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return files.select("path", "content").mapInArrow(read, RECORD_SCHEMA)


_ARROW = pa.schema([("archive", pa.string()), ("byte_offset", pa.int64()), ("inner_offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("gap_from", pa.int64()), ("gap_to", pa.int64()), ("gap_reason", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def log_gaps(found: DataFrame, path: str) -> int:
    """Writes the gaps among stored rows of read_archives() to a JSON log, if there are any, and says how many there are."""
    gaps = found.where("gap_from is not null")
    n = gaps.count()
    if n:
        gaps.select("archive", "byte_offset", "gap_from", "gap_to", "gap_reason").write.mode("overwrite").json(path)
        logging.getLogger(__name__).warning("%d gaps quarantined, log in %s", n, path)
    return n


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload, first_id and is_revisit.

    Of rows with equal payloads of at least min_bytes the one with the smallest page_id is the response, the others
    are revisits; of rows repeated under that id, the first in the order read. A null html is an empty payload; a null page_id counts as larger than any other, and a revisit of such a
    response refers to nothing. Digests are grouped before the join, so a hot payload is one row of its right side,
    and adaptive execution may split the left.
    """
    pages = stored(pages, Scratch(pages.sparkSession), "pages")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"_key": F.sha2("payload", 256), "_row": F.monotonically_increasing_id()})
    first = rows.groupBy("_key").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row")).alias("_first"))
    again = (F.octet_length("payload") >= min_bytes) & (F.col("_row") != F.col("_first._row"))
    return rows.join(first.hint("merge"), "_key").withColumns({"first_id": F.col("_first.page_id"), "is_revisit": again}).drop("_key", "_row", "_first")
