import glob
import struct

import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from loomwright.llm import warc
from loomwright.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string"
ROWS = [(1, "http://a/ b\r\n", "same"), (5, None, "same"), (3, "http://c", "same"), (2, "http://d", "é\r\n\r\nWARC/1.1"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 300_000), (8, "u", "own"), (8, "u", "own"), (None, "u", "same"), (None, "u", "alone")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumns({"key": F.lit("clash"), "size": F.lit(1)})
    out = warc.archive_pages(pages).collect()
    assert len(out) == len(ROWS)
    largest = {}
    for i, _, html in ROWS:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    want = []
    for i, _, html in ROWS:
        keeper = largest.get(html or "")
        again = keeper is not None and (i is None or i < keeper)
        body = (html or "").encode()
        want.append((str(i), len(body), warc.digest(body), "revisit" if again else "response", keeper if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    assert {r.html for r in out if r.record_type == "response"} == {"same", "é\r\n\r\nWARC/1.1", "", "x" * 300_000, "own", "alone"}
    assert next(r.url for r in out if r.page_id == 1) == "http://a/%20b%0D%0A"


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    out = warc.read_archives(warc.write_archives(pages, fresh_path(spark, "warc"), min_revisit_bytes=5)).collect()
    assert {r.record_type for r in out} == {"response"}


def test_layout_of_an_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<html><title>{i}</title><p>{'some common text ' * 30}{i * 7919}</p></html>") for i in range(300)], SCHEMA)
    folder = fresh_path(spark, "warc")
    manifest = warc.write_archives(pages.coalesce(1), folder)
    assert manifest.agg(F.sum("records")).first()[0] == 300
    paths = glob.glob(folder.removeprefix("file://") + "/*.warc.zst")
    assert len(paths) == manifest.count()
    frames = 0
    for path in paths:
        data = open(path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME
        book, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
        while at < len(data):
            one = zstandard.ZstdDecompressor(dict_data=book).decompressobj()
            text = one.decompress(data[at:])
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            at, frames = len(data) - len(one.unused_data), frames + 1
        assert len(list(warc.parse(fs.LocalFileSystem(), path))) > 0
    assert frames == 300
    assert warc.read_archives(manifest).select("page_id").distinct().count() == 300


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
