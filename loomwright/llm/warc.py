"""WARC archives with a Zstandard dictionary: each archive starts with a skippable frame that holds the
dictionary, and every record is a frame of its own."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small_batches

# Fixed values of the formats: magic number of the dictionary frame, profile of revisit records.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: A dictionary is built from an archive's first records, up to so many bytes.
SAMPLE_BYTES = 4 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, body: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit holds the HTTP header alone, whose Content-Length is the full payload's."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(body)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or, where there are too few records to train one, their own bytes."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 10))
    try:
        return zstandard.train_dictionary(size, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Writer:
    """Writes one task's archives; a new one is begun after ARCHIVE_BYTES."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.count, self.waiting, self.waiting_bytes, self.out, self.done = folder, name, 0, [], 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            self.waiting_bytes += len(data)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._begin()
            return
        self._put(data)

    def _begin(self) -> None:
        store, folder = fs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        name = f"{self.name}-{self.count:05d}.warc.zst"
        self.path = f"{self.folder}/{name}"
        self.out, self.size, self.records = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
        built = _dictionary(self.waiting)
        data = built.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_content_size=True)
        for x in self.waiting:
            self._put(x)
        self.waiting, self.waiting_bytes = [], 0

    def _put(self, data: bytes) -> None:
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1
        if self.size >= ARCHIVE_BYTES and not self.waiting:
            self.close()

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._begin()
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.size))
            self.out, self.count = None, self.count + 1


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) to archives in folder, a location that driver and
    executors reach; returns the manifest (path, records, size) of the archives of the tasks that succeeded.

    Of equal payloads of at least min_revisit_bytes, that with the largest page_id is the response and the
    others revisit it; of smaller ones each is a response. A null html is an empty payload, a null url becomes
    urn:unknown, a null page_id is the least and, in a group of nulls alone, each row is a response. Rows
    repeated with the largest page_id are responses, too. Further columns are left out. An empty table makes no archive."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("body"))
    rows = rows.select("*", F.sha2("body", 256).alias("key"), F.octet_length("body").alias("size"))
    # The groups' largest ids, joined on one more column than they are grouped by: both sides are shuffled
    # for the join itself, so that adaptive execution splits the partition of a hot payload.
    largest = rows.groupBy("key").agg(F.max("page_id").alias("keeper"), F.max("size").alias("size"))
    rows = rows.join(largest, ["key", "size"])
    revisit = F.coalesce((F.col("page_id") < F.col("keeper")) | (F.col("page_id").isNull() & F.col("keeper").isNotNull()), F.lit(False))
    rows = rows.select("page_id", "url", "body", "keeper", (revisit & (F.col("size") >= min_revisit_bytes)).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = _Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}")
        for batch in batches:
            for page_id, url, body, keeper, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "keeper", "revisit")), strict=True):
                out.add(record(page_id, url, body, keeper, again))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out.done, strict=True)], ["path", "records", "size"])

    return materialize(rows.mapInArrow(write, "path string, records long, size long"), "manifest")


def parse(store: fs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    with store.open_input_stream(path, compression=None) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} doesn't start with a dictionary")
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw.read(size)))
        with unpack.stream_reader(raw, read_across_frames=True, closefd=False) as text:
            data = b""
            while True:
                while (end := data.find(b"\r\n\r\n")) < 0:
                    more = text.read(1 << 16)
                    if not more:
                        if data:
                            raise ValueError(f"{path} ends within a record")
                        return
                    data += more
                first, *lines = data[:end].decode().split("\r\n")
                if first != "WARC/1.1":
                    raise ValueError(f"{path} has a record that starts with {first!r}")
                headers = dict(x.split(": ", 1) for x in lines)
                data, parts, need = data[end + 4 :], [], int(headers["Content-Length"]) + 4
                while need > len(data):
                    parts.append(data)
                    need -= len(data)
                    data = text.read(1 << 20)
                    if not data:
                        raise ValueError(f"{path} ends within a record")
                parts.append(data[:need])
                data = data[need:]
                yield headers, b"".join(parts)[:-4]


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, html) of every record of the
    manifest's archives. A response's digest is computed anew and must agree with its header; a revisit has a null html."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            store, at = fs.FileSystem.from_uri(path)
            for headers, block in parse(store, at):
                http, _, body = block.partition(b"\r\n\r\n")
                kind, told = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if kind == "response" and (digest(body) != told or len(body) != size):
                    raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} is damaged")
                rows.append((_page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], kind, _page(headers.get("WARC-Refers-To")), size, told, body.decode() if kind == "response" else None))
                held += len(body)
                if held > 4 << 20 or len(rows) >= 5000:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    parts = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(parts).mapInArrow(read, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    return read_archives(write_archives(pages, fresh_path(pages.sparkSession, "warc")))
