"""Operator 4: token ids in binary files, compressed by ``range_coder``.

``write_ids`` deals documents in ascending id order to range partitions of about
PARTITION_BYTES of text; a task writes its documents to files of about FILE_IDS ids, whole
documents each. File: magic; groups (starting table, then the blocks' words); footer; magic.
The footer lists the groups (place and check of the table), the blocks (place, words, ids,
CRC-32, group) and the documents (id, length), and has a CRC-32 of its own. So one block
costs the footer, its group's table and its words (``read_block``), one document the blocks
it lies in (``read_document``). Ids are below 2**16. A task writes under names of its own
and returns them, so a repeated or lost task does no harm; only files in the returned
manifest count. ``read_ids`` takes a task for each file.

Null text is empty and gives the end id alone. Null ids come first. Repeated ids stay, each
with its own row; equal ids, however many, are cut between partitions by text and row.
Empty tables give no file and no row. Other columns are ignored.

Words cut at ASCII white space can be encoded one by one when the tokenizer drops white
space and lower-cases (``by_word=True``, see ``word_ids``).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import range_coder
from lexloom.llm.common import fresh_dir, open_fs, put_file, text_batches
from lexloom.llm.merges import PieceMerger
from lexloom.llm.word_ids import WordIds

MAGIC = b"LXTOKID2"
#: Text of a range partition, and ids after which a file is closed (most partitions have one).
PARTITION_BYTES = 32_000_000
FILE_IDS = 24_000_000
DOCS_SCHEMA = "{id} long, start long, n_tokens long, ids_crc32 long"
_GROUP, _BLOCK, _TAIL = np.dtype("<u8,<u4,<u4"), np.dtype("<u8,<u4,<u4,<u4,<u4"), struct.Struct(f"<QQQQQI{len(MAGIC)}s")


class WordEncoder:
    """Ids of whole texts, as uint16 arrays; ``by_word``: by ``word_ids``, where the vocabulary allows it."""

    def __init__(self, path: str, by_word: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 2**16 and more don't fit this format")
        merger = PieceMerger(path) if by_word else None
        self.words = WordIds(merger, self._encode) if merger and merger.usable else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H", e.ids).tobytes() for e in found]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.words:
            return self.words.encode(texts)
        return [np.frombuffer(x, np.uint16) for x in self._encode([t or "" for t in texts])]


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool) -> WordEncoder:
    return WordEncoder(path, by_word)


def _pack_table(table: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Ids in order of frequency, then the steps down from one frequency to the next."""
    return zlib.compress(table[0].astype("<u2").tobytes() + (-np.diff(table[1], prepend=1 << 17)).astype("<u4").tobytes(), 6)


def _unpack_table(data: bytes, check: int) -> tuple[np.ndarray, np.ndarray]:
    if zlib.crc32(data) != check:
        raise ValueError("checksum of a starting table differs")
    plain = zlib.decompress(data)
    n = len(plain) // 6
    return np.frombuffer(plain, "<u2", n), (1 << 17) - np.cumsum(np.frombuffer(plain, "<u4", n, 2 * n).astype(np.int64))


class TokenFile:
    """Writes documents; ``close`` codes what is held and adds the footer."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.keys, self.sizes, self.groups, self.blocks = [], [], [], []
        self.held, self.n_held, self.total = [], 0, 0
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        self.keys.append(key)
        self.sizes.append(n)
        self.held.append(ids)
        self.n_held += n
        self.total += n
        if self.n_held >= FILE_IDS:
            self._code()

    def _code(self) -> None:
        """Code what is held in groups of about equal size, no wider than the state in step allows."""
        ids = np.concatenate([np.zeros(0, np.uint16), *self.held])
        self.held, self.n_held = [], 0
        blocks = -(-len(ids) // range_coder.BLOCK)
        groups = -(-blocks // range_coder.max_lanes(len(range_coder.start_table(ids)[0]))) if blocks else 0
        for i in range(groups):
            a, b = (range_coder.BLOCK * (blocks * j // groups) for j in (i, i + 1))
            self._group(ids[a:b], range_coder.start_table(ids[a:b]))

    def _group(self, ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> None:
        words, crc, payload = range_coder.encode_blocks(ids, table)
        packed = _pack_table(table)
        self.groups.append((self.at, len(packed), zlib.crc32(packed)))
        self.out.write(packed)
        self.out.write(payload.astype("<u2").tobytes())
        start = self.at + len(packed)
        for i, (n, check) in enumerate(zip(words.tolist(), crc.tolist())):
            size = min(range_coder.BLOCK, len(ids) - i * range_coder.BLOCK)
            self.blocks.append((start, n, size, check, len(self.groups) - 1))
            start += 2 * n
        self.at = start

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._code()
        null = np.array([k is None for k in self.keys], "u1")
        keys, sizes = np.array([k or 0 for k in self.keys], "<i8"), np.array(self.sizes, "<u8")
        parts = [np.array(self.groups, _GROUP), np.array(self.blocks, _BLOCK), keys, sizes, null]
        index = zlib.compress(b"".join(p.tobytes() for p in parts), 6)
        self.out.write(index + _TAIL.pack(self.at, len(index), len(self.groups), len(self.blocks), len(self.keys), zlib.crc32(index), MAGIC))
        return len(self.keys), self.total


class Footer:
    """What a file's footer lists: groups, blocks, and each document's id and length."""

    def __init__(self, stream, size: int):
        stream.seek(size - _TAIL.size)
        at, length, groups, blocks, docs, crc, magic = _TAIL.unpack(stream.read(_TAIL.size))
        stream.seek(at)
        index = stream.read(length)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("the footer of a token file is damaged")
        plain, place = zlib.decompress(index), 0
        found = []
        for kind, n in ((_GROUP, groups), (_BLOCK, blocks), (np.dtype("<i8"), docs), (np.dtype("<u8"), docs), (np.dtype("u1"), docs)):
            found.append(np.frombuffer(plain, kind, n, place))
            place += kind.itemsize * n
        self.stream, (self.groups, self.blocks, keys, sizes, null) = stream, found
        self.keys = [None if gone else k for k, gone in zip(keys.tolist(), null.tolist())]
        self.sizes = sizes.astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from first up to last, all of one group; nothing else is read."""
        blocks = self.blocks[first:last]
        at, length, check = self.groups[blocks["f4"][0]].tolist()
        self.stream.seek(at)
        table = _unpack_table(self.stream.read(length), check)
        words = blocks["f1"].astype(np.int64)
        self.stream.seek(int(blocks["f0"][0]))
        payload = np.frombuffer(self.stream.read(2 * int(words.sum())), "<u2")
        return range_coder.decode_blocks(int(blocks["f2"].sum()), table, words, blocks["f3"], payload)

    def runs(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Ids of blocks from first up to last, a group at a time."""
        cuts = [first, *(np.flatnonzero(np.diff(self.blocks["f4"][first:last])) + first + 1).tolist(), last]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield self.ids(a, b)


def read_block(stream, size: int, block: int) -> np.ndarray:
    """The ids of one block."""
    return Footer(stream, size).ids(block, block + 1)


def read_document(stream, size: int, place: int) -> tuple[int | None, np.ndarray]:
    """Id and ids of the document at a place of the file; decodes the blocks it lies in."""
    foot = Footer(stream, size)
    start, n = int(foot.sizes[:place].sum()), int(foot.sizes[place])
    stops = np.cumsum(foot.blocks["f2"].astype(np.int64))
    first, last = np.searchsorted(stops, start, "right"), np.searchsorted(stops, start + n, "left") + 1
    if not n:
        return foot.keys[place], np.zeros(0, np.uint16)
    start -= int(stops[first - 1]) if first else 0
    return foot.keys[place], np.concatenate(list(foot.runs(int(first), int(last))))[start : start + n]


def read_file(stream, size: int):
    """(id, ids as a uint16 array) of each document of a file."""
    foot = Footer(stream, size)
    runs, held, start = foot.runs(0, len(foot.blocks)), np.zeros(0, np.uint16), 0
    for key, n in zip(foot.keys, foot.sizes.tolist()):
        if len(held) - start < n:
            parts, have = [held[start:]], len(held) - start
            while have < n:
                parts.append(next(runs))
                have += len(parts[-1])
            held, start = np.concatenate(parts), 0
        yield key, held[start : start + n]
        start += n


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_word: bool, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, str, int, int]]:
    """Write the files; the manifest (partition, file in it, path, documents, ids) in order of ids."""
    end = np.array([end_id], np.uint16)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer, by_word).encode
        # Ids as they come: what is not yet taken of the last batch goes on into the next file.
        rows = ((key, np.concatenate([ids, end])) for keys, texts in text_batches(batches, "key", "text") for key, ids in zip(keys, encode(texts)))
        number, row = 0, next(rows, None)
        while row is not None:  # one file more
            got = {}

            def fill(out):
                nonlocal row
                file = TokenFile(out)
                while row is not None and file.total < FILE_IDS:
                    file.add(*row)
                    row = next(rows, None)
                got["n"] = file.close()

            path = put_file(folder, f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok", fill)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, number, path, *got["n"])], names=["part", "number", "path", "docs", "ids"])
            number += 1

    picked = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].alias("text"))
    size = picked.select(F.sum(F.octet_length("text") + 8)).first()[0]
    if size is None and picked.isEmpty():
        return []
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    # Row numbers follow from the input's splits, so a repeated task deals its rows alike.
    dealt = picked.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-(size or 0) // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    manifest = dealt.select("key", "text").mapInArrow(run, "part long, number long, path string, docs long, ids long")
    return sorted(tuple(r) for r in manifest.collect())  # a row for each file


def read_ids(spark: SparkSession, manifest: list[tuple[int, int, str, int, int]], id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the files: id, place of the first of its ids, ids with the end id, their CRC-32."""
    schema = DOCS_SCHEMA.format(id=f"`{id_col}`") + ", ids array<int>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    rows, start = [], 0
    for *_, path, _, ids in manifest:
        rows.append((path, start))
        start += ids
    files = spark.createDataFrame(rows, "path string, start long").repartitionByRange(len(rows), "start")

    def run(batches):
        for batch in batches:
            for path, at in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                filesystem, local = open_fs(path)
                columns = [[], [], [], [], []]
                with filesystem.open_input_file(local) as stream:
                    for key, ids in read_file(stream, stream.size()):
                        values = (key, at, len(ids), zlib.crc32(ids.astype("<u4")), ids.astype(np.int32) if with_ids else None)
                        for c, v in zip(columns, values):
                            c.append(v)
                        at += len(ids)
                        if len(columns[0]) == 1000:
                            yield _batch(columns)
                            columns = [[], [], [], [], []]
                yield _batch(columns)

    def _batch(columns):
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.int32()))] * with_ids
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return files.mapInArrow(run, schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = 1, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs' ids to a new folder of the shared one and return what reading them back gives."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "tokens")
    manifest = write_ids(docs, folder, tokenizer, end_id, by_word, id_col, text_col)
    if manifest:
        put_file(folder, "manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return read_ids(spark, manifest, id_col)
