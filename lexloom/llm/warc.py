"""Operator 10: WARC archives as seekable Zstandard bundles.

Records go into independent frames of about FRAME_BYTES each; a footer in a skippable frame
lists every frame's compressed and plain size and checksum (the public seekable format). The
index maps each record's page to its file, frame, offset in the frame and length, so one
record costs one frame. Of pages with equal payloads of at least ``min_bytes`` bytes the one
with the smallest id is a response, others are revisits that name it and carry no payload.

A null payload is empty. Repeated rows of a response's id are all responses. A row with a
null id is a response if no page of its payload has an id. A null url is written as
``about:blank``; control characters and spaces of urls are percent-encoded in the archive.
Other columns are ignored. An empty table writes nothing and gives an empty result. A task
names its own files, closes each after ARCHIVE_BYTES bytes and reports them in the index, so
repeated or lost tasks do no harm and neither a file nor its index grows with the task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fresh_dir, open_fs, put_file, written

FRAME_BYTES = 1 << 20
#: Bytes of records after which an archive is closed and the task begins another.
ARCHIVE_BYTES = 1 << 29
LEVEL = 6
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX_SCHEMA = "page_id long, path string, frame int, offset int, length int"
PAGE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE = "urn:lexloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record: response, or revisit if refers_to is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_PAGE}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_PAGE}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}


def _page(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(_PAGE)
    return None if number == "null" else int(number)


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a place of a frame, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    head = _fields(data[at:end])
    start = end + 4
    stop = start + int(head["content-length"])
    cut = data.index(b"\r\n\r\n", start, stop)
    http = _fields(data[start:cut])
    found = {
        "page_id": _page(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "payload_bytes": int(http["content-length"]),
        "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": head["warc-type"],
        "refers_to": _page(head["warc-refers-to"]) if "warc-refers-to" in head else None,
        "payload": None,
    }
    if found["record_type"] == "response":
        payload = data[cut + 4 : stop]
        if len(payload) != found["payload_bytes"] or base64.b32encode(hashlib.sha1(payload).digest()).decode() != found["payload_digest"]:
            raise ValueError(f"payload of page {found['page_id']} differs from its digest")
        found["payload"] = payload
    return found, stop + 4


class Bundle:
    """Writes records into frames of a seekable file."""

    def __init__(self, out):
        self.out, self.held, self.size, self.table, self.total = out, [], 0, [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in it, length."""
        if self.held and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.table), self.size, len(data)
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.compressor.compress(plain)
            self.out.write(packed)
            self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        foot = struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(rows) + len(foot)) + rows + foot)


def seek_table(stream, size: int) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, plain size, checksum) of each frame."""
    stream.seek(size - 9)
    frames, descriptor, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE or descriptor != 0x80:
        raise ValueError("no seek table at the end of the file")
    stream.seek(size - 9 - 12 * frames)
    found, at = [], 0
    for row in struct.iter_unpack("<III", stream.read(12 * frames)):
        found.append((at, *row))
        at += row[0]
    return found


def read_frame(stream, row: tuple[int, int, int, int]) -> bytes:
    start, packed, plain, check = row
    stream.seek(start)
    data = zstandard.ZstdDecompressor().decompress(stream.read(packed), max_output_size=plain)
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError("checksum of a frame differs")
    return data


def fetch(path: str, frame: int, offset: int, length: int) -> dict:
    """One record by its index entry: reads the footer and one frame."""
    filesystem, local = open_fs(path)
    with filesystem.open_input_file(local) as stream:
        data = read_frame(stream, seek_table(stream, stream.size())[frame])
    return parse(data[offset : offset + length])[0]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; their index (INDEX_SCHEMA), itself a table in the shared folder."""
    payload = F.coalesce(pages["html"].cast("binary"), F.lit(b""))
    picked = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # A minimum per digest, combined before the shuffle; the join may split a hot digest's rows.
    first = picked.groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = picked.join(first, "digest")
    again = (F.col("first") != F.coalesce("page_id", F.col("first") - 1)) & (F.length("payload") >= min_bytes)
    rows = joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))

    def run(batches):
        held = ((batch, i) for batch in batches for i in range(batch.num_rows))
        row = next(held, None)
        while row is not None:  # one archive more
            index = []

            def fill(out):
                nonlocal row
                bundle = Bundle(out)
                while row is not None and bundle.total < ARCHIVE_BYTES:
                    key, url, data, refers = (row[0][c][row[1]].as_py() for c in ("page_id", "url", "payload", "refers_to"))
                    index.append((key, *bundle.add(record(key, url, data, refers, date))))
                    row = next(held, None)
                bundle.close()

            path = put_file(folder, f"pages-{uuid.uuid4().hex}.warc.zst", fill)
            for at in range(0, len(index), 10_000):
                columns = [list(c) for c in zip(*index[at : at + 10_000])]
                arrays = [pa.array(columns[0], pa.int64()), pa.array([path] * len(columns[0])), *(pa.array(c, pa.int32()) for c in columns[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "path", "frame", "offset", "length"])

    return written(rows.mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read_archives(spark: SparkSession, paths: list[str], with_payload: bool = False) -> DataFrame:
    """PAGE_SCHEMA (and the payload) of every record of the archives, frame by frame."""
    schema = PAGE_SCHEMA + ", payload binary" * with_payload
    if not paths:
        return spark.createDataFrame([], schema)
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                filesystem, local = open_fs(path)
                with filesystem.open_input_file(local) as stream:
                    for row in seek_table(stream, stream.size()):
                        data, at, found = read_frame(stream, row), 0, []
                        while at < len(data):
                            one, at = parse(data, at)
                            found.append(one)
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, types)], names=names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(len(paths), "path")
    return files.mapInArrow(run, schema)


def write_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    index = write_archives(pages, fresh_dir(spark, "warc"), min_bytes)
    paths = sorted(r[0] for r in index.select("path").distinct().collect())  # one for each file
    return read_archives(spark, paths)
