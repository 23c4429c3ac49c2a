"""WARC archives in Zstandard: written with a shared dictionary, read one frame a record.

An archive is a skippable frame with the dictionary, then one frame for each record. Archives are rows (path,
content), as Spark's binaryFile source gives them, so the reader takes real files too; the writer's archives
go to a table in the shared folder, since no executor has a file system of its own that others see.

The reader loads the dictionary from the leading skippable frame, finds the frames by their block headers,
and checks of each record: version line, needed headers, content length, record end, and for responses the
payload's length and digest. A record that fails raises ValueError with its archive and place.

Of payloads of at least min_bytes that are equal, the smallest page_id is the response and others revisit it.

Defined cases: a null html is an empty payload; a null url leaves the target header out, line ends in a url
become blanks; rows of equal page_id and payload are all responses if their id is the smallest; a null page_id
counts as greater than others; equal rows give records of one WARC-Record-ID, as an id is made of a row's contents and a retried
task must make the same; an html of any length is one record of one row; an empty table gives no archive and no row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize, spread, table

#: Fixed values of the formats.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_PAGES, DICTIONARY_BYTES = 400, 32 << 10
ARCHIVE_BYTES = 8 << 20
LEVEL = 3
ARCHIVES = "path string, content binary"


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the sample pages of smallest hash (bounded); plain content where too few are there."""
    import zstandard

    mine = pages.where("page_id is not null and length(html) > 0")
    ids = mine.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)  # ids first, so that no task sends pages in vain
    rows = mine.join(F.broadcast(ids), "page_id", "left_semi").select("page_id", F.substring("html", 1, 1 << 16).alias("h")).orderBy("page_id", "h").limit(sample).collect()
    samples = [r["h"].encode() for r in rows]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title></title></head><body></body></html>"


def _dictionary(raw: bytes):
    import zstandard

    full = len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == DICTIONARY
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def record(page_id, url: str | None, digest: str, size: int, refers_to, payload: bytes | None) -> bytes:
    """A record's bytes; payload None makes a revisit."""
    head = [
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", " ").replace("\n", " "))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = payload or b""
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of a record for each row of pages, as a table of (path, content) in the shared folder."""
    import zstandard

    raw = train(pages)
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), key.alias("key")).withColumn("n", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    # Who revisits whom, without payloads; these then move once, to the tasks that write them.
    large = p.where(F.col("n") >= min_bytes).select("page_id", "key", "sha1")
    same = large.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select("sha1", "first")
    later = large.join(same, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("key", "sha1", "first").distinct()
    rows = spread(p, "key", "sha1").join(later, ["key", "sha1"], "left")
    rows = rows.select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "n", "sha1", "first")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        lead = struct.pack("<II", SKIPPABLE, len(raw)) + raw
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True, write_content_size=True)
        frames, size, made = [lead], 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{made:04d}.warc.zst"]), pa.array([b"".join(frames)], pa.binary())], ["path", "content"])

        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("page_id", "url", "html", "n", "sha1", "first")]
            for page_id, url, html, n, sha1, first in zip(*cols):
                payload = None if html is None else html.encode()
                frames.append(c.compress(record(page_id, url, base64.b32encode(bytes.fromhex(sha1)).decode(), n, first, payload)))
                size += len(payload or b"")
                if size >= archive_bytes:
                    yield done()
                    frames, size, made = [lead], 0, made + 1
        if len(frames) > 1:
            yield done()

    return materialize(rows.mapInArrow(run, ARCHIVES), "warc")


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at a place ends, by its block headers."""
    import zstandard

    parameters = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    last = 0
    while not last:
        head = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * parameters.has_checksum


def parse(raw: bytes) -> dict:
    """The checked fields of a record."""
    if not raw.startswith(VERSION):
        raise ValueError("no version line")
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise ValueError("headers without an end")
    headers = {}
    for line in raw[len(VERSION) : cut].decode().split("\r\n"):
        name, sep, value = line.partition(":")
        if not sep:
            raise ValueError(f"no header: {line[:80]}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"{name} is missing")
    size = int(headers["content-length"])
    block = raw[cut + 4 : cut + 4 + size]
    if len(block) != size or raw[cut + 4 + size :] != b"\r\n\r\n":
        raise ValueError("the length is wrong")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response":
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
            raise ValueError("the digest is wrong")
        if int(headers.get("x-payload-length", size)) != size:
            raise ValueError("the payload's length is wrong")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    return {
        "page_id": number(headers["warc-record-id"]), "payload_bytes": int(headers.get("x-payload-length", size)), "payload_digest": digest, "record_type": kind,
        "refers_to": number(headers.get("warc-refers-to")), "target_uri": headers.get("warc-target-uri"), "payload": block,
    }


def records(content: bytes):
    """Place and fields of each record of an archive."""
    import zstandard

    data = memoryview(content).cast("B")
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
        raw = zstandard.ZstdDecompressor().decompress(raw)
    d = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield at, parse(d.decompress(data[at:end]))
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"record at {at}: {e}") from e
        at = end


FIELDS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "target_uri": pa.string()}


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of archives (path, content): archive, place, fields and on request the payload."""
    fields = FIELDS | ({"payload": pa.binary()} if with_payload else {})

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    got = list(records(content.as_buffer()))
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                cols = [pa.array([path] * len(got), pa.string()), pa.array([at for at, _ in got], pa.int64()), *(pa.array([r[f] for _, r in got], t) for f, t in fields.items())]
                yield pa.RecordBatch.from_arrays(cols, ["path", "place", *fields])

    schema = "path string, place long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string" + (", payload binary" if with_payload else "")
    return archives.select("path", "content").mapInArrow(run, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    archives = write(table(spark, sf_dir, "pages"), min_bytes=0)
    return read(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, min(page_id) AS f FROM p GROUP BY h),
d AS (SELECT page_id, payload_bytes, h, f, list_transform(range(0, 8), lambda j: ('0x' || h[j * 5 + 1:j * 5 + 5])::BIGINT) AS w FROM p JOIN m USING (h))
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((w[(k // 4 + 1)::BIGINT] >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM d
"""
