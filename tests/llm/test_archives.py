"""WARC archives: round trip, revisits, and records that are not right."""

from __future__ import annotations

import base64
import hashlib
import struct

import pytest

from sparkloom.llm import warc

ROWS = [(1, "http://a/1", "<html>same page</html>"), (2, None, "<html>same page</html>"), (3, "http://a/\r\n3", None), (4, "u", ""), (5, "u", "é" * 200_000), (2, None, "<html>same page</html>"), (None, "n", "<html>same page</html>"), (6, "u", "x" * 300)]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, payload int")
    got = warc.read(warc.write(pages, min_bytes=least, archive_bytes=1000)).collect()
    assert len(got) == len(ROWS)
    for page, url, html in ROWS:
        data = (html or "").encode()
        mine = [r for r in got if r["page_id"] == page]
        equal = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        first = min(equal, default=page)
        revisit = len(data) >= least and page != first
        assert len(mine) == sum(p == page for p, _, _ in ROWS)
        for r in mine:
            assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))
            assert revisit or r["payload"] == data


def test_empty(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def archive(*records: bytes) -> bytes:
    import zstandard

    raw = b"some dictionary content " * 20
    c = zstandard.ZstdCompressor(dict_data=warc._dictionary(raw), write_checksum=True)
    return struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + b"".join(map(c.compress, records))


def test_reader_checks_records():
    good = warc.record(7, "u", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), 3, None, b"abc")
    assert [r["page_id"] for _, r in warc.records(archive(good, good))] == [7, 7]
    for bad, what in (
        (good.replace(b"Content-Length: 3", b"Content-Length: 4"), "length"),
        (good.replace(b"abc", b"abd"), "digest"),
        (good.replace(b"WARC/1.1", b"WARC/x"), "version"),
        (good.replace(b"WARC-Date", b"X-Date"), "missing"),
        (good.replace(b"X-Payload-Length: 3", b"X-Payload-Length: 9"), "payload"),
    ):
        with pytest.raises(ValueError, match=what):
            list(warc.records(archive(good, bad)))
    with pytest.raises(ValueError, match="dictionary"):
        list(warc.records(b"12345678" + good))
    with pytest.raises(ValueError):
        list(warc.records(archive(good)[:-3]))
