"""WARC archives in Zstandard with an embedded dictionary, one frame a record, and their reader.

A dictionary is built from a bounded sample of the records (``sample_pages``, ``dictionary_bytes``).
Every archive file begins with it in a skippable frame (magic 0x184D2A5D), so a file can be read by
itself; a warcinfo record and one compressed frame for each record follow. Files go to a
folder all executors share, each under a name no other attempt uses; the tasks return a manifest of
file, byte range and records, and only ranges of the manifest that Spark has committed are read, so a task that is run
again leaves no double records.

Of pages with equal payloads of ``revisit_bytes`` or more, the one with the largest id is a response
and the others are revisits that refer to it. Duplicates are found on 20-byte digests and joined as a table
of the repeated digests only; Spark broadcasts it if its size allows and splits a hot digest if not.

Defined results: a null payload is empty; a null url is written as urn:page:<id>; a null id is
written without one and, among equal payloads, refers to the largest id there is, being a response
when there is none; rows that repeat the largest id are all responses; an empty table gives no
records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import arrow_fs, materialize, qualified, scratch_path, ship_package

DICTIONARY_MAGIC = 0x184D2A5D
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MANIFEST = "path string, start long, length long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page-{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header alone."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = (url if url is not None else f"urn:page:{page}").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if url is None:
        lines.append("X-No-Url: 1")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, 'info')}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a decompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record cut off")
        yield headers, block


def build_dictionary(pages: DataFrame, sample_pages: int = 600, dictionary_bytes: int = 64 << 10, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A dictionary of the records of a bounded sample of pages (at most 16 KB of each); empty when there is too little to learn from."""
    rows = pages.count()
    some = pages.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_pages / max(1, rows))))
    some = some.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, 8000).alias("html")).limit(2 * sample_pages).collect()
    records = [record(r["page_id"], r["url"], r["html"].encode()[:16384], None, date) for r in some]
    size = min(dictionary_bytes, sum(map(len, records)) // 8)
    if len(records) < 20 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:  # too little variety for a dictionary
        return b""


def _writer(folder: str, dictionary: bytes, date: str, level: int, file_bytes: int, range_bytes: int):
    def write(batches):
        fs, root = arrow_fs(folder)
        fs.create_dir(root, recursive=True)
        code = zstandard.ZstdCompressor(level=level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, path, at, begun, count, ranges = None, "", 0, 0, 0, []

        def close_range():
            nonlocal begun, count
            if count:
                ranges.append((path, begun, at - begun, count))
            begun, count = at, 0

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for page, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(arrow_fs(path)[1], compression=None)  # the name must not make it compress once more
                    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
                    head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed + code.compress(info_record(date))
                    out.write(head)
                    at = begun = len(head)
                frame = code.compress(record(page, url, (html or "").encode(), refers_to, date))
                out.write(frame)
                at, count = at + len(frame), count + 1
                if at - begun >= range_bytes:
                    close_range()
                if at >= file_bytes:
                    close_range()
                    out.close()
                    out = None
        if out is not None:
            close_range()
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "length", "records"), r, strict=True)) for r in ranges],
                                         schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("records", pa.int64())]))

    return write


def write_archives(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 1000, level: int = 3, file_bytes: int = 256 << 20,
                   range_bytes: int = 4 << 20, date: str = "2024-01-01T00:00:00Z", **dictionary) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under a shared ``folder``; the written manifest."""
    spark = pages.sparkSession
    ship_package(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    folder = qualified(folder or scratch_path(spark, "archives"))
    learnt = build_dictionary(pages, date=date, **dictionary)
    large = F.octet_length("html") >= revisit_bytes
    digest = F.unhex(F.sha1(F.col("html").cast("binary")))
    again = pages.filter(large).select("page_id", digest.alias("digest")).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(again.filter("n > 1 and first is not null").select("digest", "first"), "repeated-payloads")
    rows = pages.withColumn("_digest", F.when(large, digest)).join(again, F.col("_digest") == F.col("digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "html", refers.alias("refers_to"))
    return materialize(rows.mapInArrow(_writer(folder, learnt, date, level, file_bytes, range_bytes), MANIFEST), "archive-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the manifest's ranges. Payloads are checked against their digests, and passed on if asked for."""
    def read(batches):
        known = ("", None, None)
        for batch in batches:
            for path, start, length, records in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if known[0] != path:
                    fs, local = arrow_fs(path)
                    with fs.open_input_file(local) as f:
                        magic, size = struct.unpack("<II", f.read(8))
                        if magic != DICTIONARY_MAGIC:
                            raise ValueError(f"{path}: no dictionary frame")
                        learnt = zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=1 << 24)
                    known = (path, fs, zstandard.ZstdCompressionDict(learnt) if learnt else None)
                with known[1].open_input_file(arrow_fs(path)[1]) as f:
                    f.seek(start)
                    raw = f.read(length)
                stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known[2]).stream_reader(raw, read_across_frames=True), 1 << 20)
                seen, rows, held = 0, [], 0
                for h, block in parse(stream):
                    seen += 1
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    whole = h["warc-type"] == "response"
                    if whole and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
                        raise ValueError(f"{path}: payload of {h['warc-record-id']} does not match its digest")
                    page, refers_to = h.get("x-page-id"), h.get("x-refers-to-page")
                    url = None if "x-no-url" in h else h["warc-target-uri"]
                    rows.append((None if page is None else int(page), url, size, digest.hex(), h["warc-type"], None if refers_to is None else int(refers_to),
                                 payload if payloads and whole else None))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 4096 or held > 1 << 22:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{path}: {seen} records where {records} were written")
                if rows:
                    yield _record_batch(rows)

    ranges = manifest.select("path", "start", "length", "records")
    return ranges.repartition(max(1, min(manifest.count(), 1 << 16))).mapInArrow(read, RECORD)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages and read the archives back."""
    return read_archives(write_archives(pages))
