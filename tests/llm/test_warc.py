"""WARC writing, reading and salvage."""

import base64
import gzip
import hashlib
import random

import pytest

from tidelog.llm import warc
from tidelog.llm.queries import QUERIES, page_rows
from tidelog.llm.tables import table
from tidelog.sources.shared import shared_folder


def record(number, payload=b"hello", digest=None):
    digest = digest or hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\n"
        f"WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def read(data):
    found = [*warc.salvage(data)]
    at = 0
    for x in found:  # records and gaps cover the archive without overlap
        assert x.begin in (at, getattr(found[found.index(x) - 1], "begin", None)) or x.begin == at
        at = x.end
    assert at == len(data)
    ids = [x.head["warc-record-id"][10:-1] for x in found if isinstance(x, warc.Record)]
    gaps = [(x.begin, x.end, x.reason) for x in found if isinstance(x, warc.Gap)]
    return ids, gaps


def test_whole_archives():
    plain = [record(i, b"WARC/1.0\r\n" * i) for i in range(4)]
    assert read(b"".join(plain)) == (list("0123"), [])
    assert read(b"".join(map(gzip.compress, plain))) == (list("0123"), [])
    assert read(b"") == ([], [])


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_only_its_record(packed):
    pack = gzip.compress if packed else bytes
    parts = [pack(record(i, b"some payload %d" % i * 9)) for i in range(5)]
    begin = len(parts[0])
    cut = parts[0] + parts[1][:-20] + b"".join(parts[2:])
    ids, gaps = read(cut)
    assert ids == list("0234") and [g[:2] for g in gaps] == [(begin, begin + len(parts[1]) - 20)]
    broken = bytearray(b"".join(parts))
    broken[begin + len(parts[1]) // 2] ^= 0x55
    ids, gaps = read(bytes(broken))
    assert ids == list("0234") and [g[:2] for g in gaps] == [(begin, begin + len(parts[1]))]
    ids, gaps = read(b"noise" + b"".join(parts[:2]) + parts[2][:30])
    assert ids == list("01") and gaps[0][:2] == (0, 5) and len(gaps) == 2


def test_wrong_digest_length_and_head():
    bad = record(1, digest="0" * 64)
    assert read(bad + record(2)) == (["2"], [(0, len(bad), "wrong payload digest")])
    bad = record(1).replace(b"Content-Length: 4", b"Content-Length: 5", 1)
    ids, gaps = read(record(0) + bad + record(2))
    assert ids == ["0", "2"] and len(gaps) == 1
    assert read(b"just text")[1] == [(0, 9, "no version line")]


def stored_pages(spark, rows):
    path = shared_folder(spark, "warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    warc.write_archives(df, path)
    records = warc.read_archives(spark.read.format("binaryFile").load(path))
    return [tuple(r) for r in page_rows(records).collect()], records


def test_written_pages(spark):
    same, long = "é" * 60, "x\r\n\r\nWARC/1.1\r\n" * 30_000
    pages = [
        (5, "http://a\r\nb", same, "d"),
        (3, None, same, None),
        (9, "u", same, None),
        (None, "u", same, None),
        (1, "u", "short", None),
        (2, "u", "short", None),
        (4, "u", None, None),
        (6, "u", "", None),
        (7, "u", long, None),
        (8, "u", "x" * 100, None),
        (10, "u", "x" * 100, None),
    ]
    rows, records = stored_pages(spark, pages)

    def digest(text):
        data = (text or "").encode()
        return len(data), hashlib.sha256(data).hexdigest()

    first = {same: 3, "x" * 100: 8}
    wanted = []
    for page, _, html, _ in pages:
        to = first.get(html)
        kind = "response" if to is None or to == page else "revisit"
        wanted.append((page, *digest(html), kind, to if kind == "revisit" else None))
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted))
    assert not records.where("gap IS NOT NULL").count()
    assert stored_pages(spark, [])[0] == []
    rows, _ = stored_pages(spark, [(1, "u", same, "")] * 2)
    assert [r[3] for r in rows] == ["response"] * 2


def test_query_on_pages(spark, folder):
    rows = QUERIES["op10_warc"](spark, folder).collect()
    html = {r["page_id"]: r["html"] or "" for r in table(spark, folder, "pages").collect()}
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {
        i: hashlib.sha256(h.encode()).hexdigest() for i, h in html.items()
    }


def test_records_of_one_long_member():
    noise = random.Random(1)
    parts = [record(i, noise.randbytes(40_000)) for i in range(6)]
    parts[2] = record(2, b"wrong", digest="0" * 64)
    one = gzip.compress(b"".join(parts))
    begin = sum(map(len, parts[:2]))
    place = f"wrong payload digest, bytes {begin} to {begin + len(parts[2])} of the member"
    assert read(one) == (list("01345"), [(0, len(one), place)])
    # cut short by a broken download, and followed by a whole member
    cut = one[: len(one) // 2]
    ids, gaps = read(cut)
    assert ids == list("01") and [g[:2] for g in gaps[-1:]] == [(0, len(cut))] and "without end" in gaps[-1][2]
    assert read(cut + gzip.compress(record(9)))[0] == list("019")
    # a wrong byte in the last third
    broken = bytearray(one)
    broken[len(one) * 4 // 5] ^= 0x55
    ids, gaps = read(bytes(broken) + gzip.compress(record(9)))
    assert ids[:3] == list("013") and ids[-1] == "9" and gaps
    # a wrong checksum only
    broken = bytearray(one)
    broken[-6] ^= 1
    assert read(bytes(broken))[0] == list("01345")


@pytest.mark.parametrize("what", ["Payload", "Block"])
@pytest.mark.parametrize("name", ["sha1", "sha256", "md5"])
def test_digests(what, name):
    data = record(1, b"some text").replace(b"WARC-Payload-Digest: sha256:", b"X-Other: ")
    of = data.partition(b"\r\n\r\n")[2][:-4] if what == "Block" else b"some text"
    digest = hashlib.new(name, of).digest()
    for value in (digest.hex(), base64.b32encode(digest).decode()):
        line = f"WARC-Type: response\r\nWARC-{what}-Digest: {name}:{value}".encode()
        good = data.replace(b"WARC-Type: response", line)
        assert read(good) == (["1"], [])
        bad = good.replace(b"some text", b"some test")
        assert read(bad + record(2)) == (["2"], [(0, len(bad), f"wrong {what.lower()} digest")])


def test_digest_of_a_chunked_payload():
    body = b"4\r\nsome\r\n5;x=1\r\n text\r\n0\r\n\r\n"
    data = record(1, body, digest=hashlib.sha256(b"some text").hexdigest())
    chunked = data.replace(b"Content-Length: %d\r\n\r\n" % len(body), b"Transfer-Encoding:chunked\r\n\r\n")
    block = chunked.split(b"\r\n\r\n", 1)[1][:-4]
    old = data.split(b"\r\n\r\n", 1)[1][:-4]
    whole = chunked.replace(b"Content-Length: %d\r\n" % len(old), b"Content-Length: %d\r\n" % len(block))
    assert read(whole) == (["1"], [])
