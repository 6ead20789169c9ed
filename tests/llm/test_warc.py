"""Archives: round trip, the file format itself, revisits and edge cases."""
import hashlib
import io
import struct

import zstandard

from tessera.llm import warc
from tessera.session import local_path

from .common import SF

LONG = "é" * 600
ROWS = [(1, "http://a", "<p>x</p>"), (2, "http://b", LONG), (9, "http://c", LONG), (5, None, LONG), (6, "http://e", None), (7, "http://f", ""), (8, "http://g\r\nX: 1", "<p>x</p>"),
        (None, "http://h", LONG), (None, "http://i", "y" * 2000), (11, "http://j", "z" * 300_000), (9, "http://c", LONG)]


def rows(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, digest string, first int").repartition(3)


def test_round_trip(spark):
    manifest = warc.write_archives(rows(spark))
    got = warc.read_archives(manifest, payloads=True).collect()
    assert len(got) == len(ROWS)
    payload = lambda h: (h or "").encode()
    want = []
    for page, url, html in ROWS:
        p = payload(html)
        again = html == LONG and page != 9
        want.append((page, None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 9 if again else None, None if again else p))
    key = lambda r: str(r[:6])
    assert sorted([tuple(r)[:6] + (None if r["payload"] is None else bytes(r["payload"]),) for r in got], key=key) == sorted(want, key=key)


def test_file_format(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    manifest = warc.write_archives(pages, file_bytes=60_000, range_bytes=20_000)
    ranges = manifest.collect()
    assert sum(r["records"] for r in ranges) == pages.count()
    for path in {r["path"] for r in ranges}:
        data = open(local_path(path), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        learnt = zstandard.ZstdDecompressor().decompress(data[8:8 + size], max_output_size=1 << 24)
        assert len(learnt) > 1000
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learnt))
        stream = io.BufferedReader(one.stream_reader(data[8 + size:], read_across_frames=True))
        kinds = [h["warc-type"] for h, _ in warc.parse(stream)]
        assert kinds[0] == "warcinfo" and len(kinds) - 1 == sum(r["records"] for r in ranges if r["path"] == path)
    first = ranges[0]
    part = spark.createDataFrame([tuple(first)], warc.MANIFEST)
    assert warc.read_archives(part).count() == first["records"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, none).count() == 0
