"""Shared helpers: scratch tables in the shared folder, files, Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from lexloom.sources.scratch import shared_dir, written  # noqa: F401

#: Characters of text that a Python stage holds decoded at once, besides one document.
BATCH_CHARS = 4_000_000


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/lexloom-{kind}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so long texts don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or an absolute path (file, hdfs, s3, gs...)."""
    return pafs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, write: Callable) -> str:
    """Write a file under a name no other attempt uses; the caller records the name.

    A lost or repeated task leaves at most an unreferenced file behind.
    """
    filesystem, path = open_fs(folder)
    filesystem.create_dir(path, recursive=True)
    with filesystem.open_output_stream(f"{path}/{name}", compression=None) as out:
        write(out)
    return f"{folder}/{name}"


def text_batches(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int = BATCH_CHARS):
    """(keys, texts) lists of at most ``limit`` characters, or one longer document."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for k, t in zip(batch[key].to_pylist(), batch[text].to_pylist()):
            n = len(t) if t else 0
            if keys and size + n > limit:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += n
        if keys:
            yield keys, texts


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at those six only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
