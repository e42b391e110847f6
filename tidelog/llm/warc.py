"""WARC archives: a writer on Spark's text files and a reader that salvages.

Writing: one record per page. Pages of equal payloads of at least ``shared``
bytes are stored once: the smallest page id is the response, the others revisit
it. A record is a line of Spark's text writer whose line separator is the empty
lines that end a record, so the files are plain WARC, written with Spark's
commit on any store. Ids are URNs; a revisit names its payload's digest and its
size (``Content-Length`` of its HTTP head).

Reading: an archive is plain or a row of gzip members. Each record is checked
(version line, head, length, end, digests of payload and block). After a failed
check the reader searches for the next version line, or the next gzip member, that
begins a record that passes, logs the bytes between as a gap, and goes on from
there. A gzip member may hold many records: those that pass are kept, also those
before the place where it breaks off, and its gaps name their places within it.

Cases: a null payload is empty; a null page id is an empty id and takes no part
as a revisited one; rows that repeat the response's id and payload are responses
too; a null url is left out, control characters in it are escaped; an empty
table makes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import q, stored

END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
_URN = "urn:page:"
_DIGESTS = {"sha256": "sha256", "sha-256": "sha256", "sha1": "sha1", "sha-1": "sha1", "md5": "md5"}
_DIGESTS |= {"sha512": "sha512", "sha-512": "sha512"}
_CHUNKED = re.compile(rb"(?im)^transfer-encoding:[^\r\n]*chunked").search
_CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]{0,999}\r\n").match
# Fixed values of the format.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    begin: int
    end: int
    head: dict[str, str]
    block: bytes


@dataclass
class Gap:
    """Bytes of an archive that no record could be read from, and why."""

    begin: int
    end: int
    reason: str


class Damaged(ValueError):
    pass


def _parse_head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    stop = data.find(END, version.end() - 2)
    if stop < 0:
        raise Damaged("head without end")
    head = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("head line without colon")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return head, stop + len(END)


def payload_of(record: Record) -> bytes:
    """What follows the HTTP head, or the whole block of other records."""
    if record.head.get("content-type", "").startswith("application/http"):
        return record.block.partition(END)[2]
    return record.block


def _digests(head: dict[str, str]) -> list[tuple[str, str]]:
    """(of what, digest) of the digests that can be checked; a revisit's payload isn't there."""
    names = ("block",) if head.get("warc-type") == "revisit" else ("payload", "block")
    told = [(name, head.get(f"warc-{name}-digest", "")) for name in names]
    return [(name, x) for name, x in told if x.partition(":")[0].lower() in _DIGESTS]


def _is_digest(told: str, content: bytes) -> bool:
    """Whether ``algorithm:value`` is the content's, the value being base 16 or 32."""
    name, _, value = told.partition(":")
    found = hashlib.new(_DIGESTS[name.lower()], content).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes:
    """A chunked HTTP body's content; some writers take the payload's digest of it."""
    out, at = [], 0
    while size := _CHUNK_SIZE(body, at):
        n = int(size[1], 16)
        out.append(body[size.end() : size.end() + n])
        at = size.end() + n + 2
        if not n:
            break
    return b"".join(out)


def parse_record(data: bytes, at: int, base: int = 0) -> Record:
    """The record at a place of ``data``, checked; raises ``Damaged``."""
    head, begin = _parse_head(data, at)
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    stop = begin + int(length)
    if data[stop : stop + len(END)] != END:
        raise Damaged("record without end")
    record = Record(base + at, base + stop + len(END), head, data[begin:stop])
    for name, told in _digests(head):
        payload = name == "payload"
        contents = [payload_of(record)] if payload else [record.block]
        if payload and record.block is not contents[0] and _CHUNKED(record.block.partition(END)[0]):
            contents.append(_unchunked(contents[0]))
        if not any(_is_digest(told, x) for x in contents):
            raise Damaged(f"wrong {name} digest")
    return record


def _plain_records(data: bytes) -> Iterator[Record | Gap]:
    at = 0
    while at < len(data):
        try:
            record = parse_record(data, at)
            yield record
            at = record.end
            continue
        except Damaged as problem:
            reason = str(problem)
        begin, at, found = at, at + 1, None
        while found is None and (version := _VERSION.search(data, at)):
            at = version.start()
            try:
                found = parse_record(data, at)
            except Damaged:
                at += 1
        at = found.begin if found else len(data)
        yield Gap(begin, at, reason)


# Bytes of an archive given to zlib at once.
CHUNK = 1 << 16


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """A gzip member's content, its end, and why it breaks off, if it does.

    Of a broken member the content is what came out before, and the end is where
    the unpacking stopped.
    """
    unpack, view, out = zlib.decompressobj(wbits=31), memoryview(data), []
    while at < len(data):
        step = CHUNK
        while True:
            kept = unpack.copy() if step > 1 else None
            try:
                out.append(unpack.decompress(view[at : at + step]))
                break
            except zlib.error as problem:
                # What a chunk gives before the broken byte comes out by halves.
                if kept is None:
                    return b"".join(out), at, f"gzip: {problem}"
                unpack, step = kept, step // 2
        at += min(step, len(data) - at)
        if unpack.eof:
            return b"".join(out), at - len(unpack.unused_data), None
    out.append(unpack.flush())
    return b"".join(out), at, "gzip member without end"


def _in_member(data: bytes, at: int) -> tuple[list[Record | Gap], int, str | None]:
    """Records and gaps of a member's content, its end, and why it breaks off."""
    content, end, broken = _member(data, at)
    found: list[Record | Gap] = []
    for x in _plain_records(content):
        if isinstance(x, Record) and broken and end < len(data) and not _digests(x.head):
            # Wrong bytes may come out before zlib sees it.
            x = Gap(x.begin, x.end, "no digest in a damaged gzip member")
        found.append(x)
    if broken and found and isinstance(found[-1], Gap) and found[-1].end == len(content):
        found.pop()
    return found, end, broken


def _gzip_records(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps with the places of their members.

    Of a member that breaks off, the records before the break are kept, and it
    reaches to the next member that gives a record.
    """
    gap = at = 0
    reason, held = "no gzip member", []

    def ended(stop: int) -> Iterator[Record | Gap]:
        for x in held:
            x.end = stop
            yield x
        if not held and gap < stop:
            yield Gap(gap, stop, reason)

    while (at := data.find(_GZIP, at)) >= 0:
        found, end, broken = _in_member(data, at)
        if not any(isinstance(x, Record) for x in found) and (broken or found):
            if at == gap and not held:
                reason = broken or found[0].reason
            at = at + 1 if broken else end
            continue
        yield from ended(at)
        placed: list[Record | Gap] = []
        for x in found:
            if isinstance(x, Gap):
                placed.append(Gap(at, end, f"{x.reason}, bytes {x.begin} to {x.end} of the member"))
            else:
                placed.append(Record(at, end, x.head, x.block))
        if broken:
            last = max(x.end for x in found)
            held = [*placed, Gap(at, end, f"{broken}, from byte {last} of the member")]
            gap, at = at, at + 1
        else:
            yield from placed
            held, gap, at, reason = [], end, end, "no gzip member"
    yield from ended(len(data))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in order; together they cover it."""
    packed = data.find(_GZIP) if not _VERSION.match(data) else -1
    plain = _VERSION.search(data)
    if packed >= 0 and (not plain or packed < plain.start()):
        return _gzip_records(data)
    return _plain_records(data)


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def record_text(page: Column, url: Column, payload: Column, digest: Column, first: Column) -> Column:
    """A record without its end. ``first``: the page it revisits, or null."""
    urn = lambda x: F.concat(F.lit(f"<{_URN}"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", _bytes(payload)),
        F.lit("\r\n"),
    )
    # What could end a head line is written as in an address.
    safe = F.regexp_replace(F.regexp_replace(url, "[\\x00-\\x20\\x7f]", "%20"), "[<>]", "%3E")
    block = F.when(first.isNull(), F.concat(http, payload)).otherwise(http)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first.isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn(page)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(first.isNull(), F.lit("")).otherwise(
            F.concat(line("WARC-Refers-To", urn(first)), line("WARC-Profile", F.lit(_REVISIT)))
        ),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", _bytes(block)),
        F.lit("\r\n"),
        block,
    )


def write_archives(
    df: DataFrame,
    path: str,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    shared: int = 100,
    records_per_file: int = 20_000,
) -> None:
    """Write pages as plain WARC files under ``path``.

    Payloads that occur more than once are found from digests alone and written
    as a small table first, so pages meet it as Spark judges its size by.
    """
    payload = F.coalesce(q(payload_column).cast("string"), F.lit(""))
    pages = df.select(
        q(id_column).cast("long").alias("page"),
        q(url_column).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    copies = (
        pages.where(F.octet_length("payload") >= shared)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    copies = stored(copies.select("digest", "first"), "warc-copies")
    first = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    record = record_text(F.col("page"), F.col("url"), F.col("payload"), F.col("digest"), first)
    (
        pages.join(copies, "digest", "left")
        .select(record.alias("value"))
        .write.option("lineSep", END.decode())
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


RECORDS = (
    "archive string, begin long, end long, record_type string, record_id string, "
    "refers_to string, uri string, payload_bytes long, payload_digest string, "
    "gap string"
)


def read_archives(files: DataFrame) -> DataFrame:
    """Records and gaps of archives given as (path, content) rows.

    A gap has its reason in ``gap`` and no record columns. The digest is that of
    the payload as read; a revisit carries its head's.
    """
    names = [part.split()[0] for part in RECORDS.split(",")]

    def row(path: str, found: Record | Gap) -> tuple:
        if isinstance(found, Gap):
            return (path, found.begin, found.end, *[None] * 6, found.reason)
        head, payload = found.head, payload_of(found)
        kind = head.get("warc-type")
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if kind == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
            length = re.search(rb"(?im)^content-length:\s*(\d+)", found.block)
            size = int(length[1]) if length else None
        ids = [head.get(x, "").strip("<>") or None for x in ("warc-record-id", "warc-refers-to")]
        uri = head.get("warc-target-uri")
        return (path, found.begin, found.end, kind, *ids, uri, size, digest, None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        kinds += [pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [row(path.as_py(), found) for found in salvage(content.as_py() or b"")]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
                )

    return files.select("path", "content").mapInArrow(read, RECORDS)


def page_number(urn: Column) -> Column:
    """The page id in a record id, null for other ids."""
    return F.substring(urn, len(_URN) + 1, 20).try_cast("long")
