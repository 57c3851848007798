"""Streams of requests: files of events or lines in, results and running counters out."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.scratch import shared_dir


def file_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder (or one file) as a stream, with the schema of what is there now."""
    schema = spark.read.parquet(path).schema
    # As a pattern, a path may name a file too.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of new text files."""
    return spark.readStream.text(path)


def running_counts(events: DataFrame, keys: list[str], value: str, ts: str | None = None, late: str | None = None, window: str | None = None) -> DataFrame:
    """Counts and sums by key, by time window if asked, so far (W17); rows later than ``late`` are dropped."""
    if late:
        events = events.withWatermark(ts, late)
    groups = [F.col(k) for k in keys] + ([F.window(ts, window).start.alias("window_start")] if window else [])
    return events.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, only_ok: bool = False, checkpoint: str | None = None):
    """Each micro-batch through ``work`` into JSON lines of ``out``, in a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so no result comes twice.
    """
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        done = work(batch)
        if only_ok:
            done = done.filter("status = 'ok'")
        done.write.mode("overwrite").json(f"{out}/batch={number}")

    # A digest of the folder's name: the same in every process, so a restarted driver goes on where the last one stopped.
    where = checkpoint or f"{shared_dir(spark)}/lexloom-stream-{sha1(out.encode()).hexdigest()}"
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", where).trigger(availableNow=True).start()


def counted_once(spark: SparkSession, path: str, keys: list[str], value: str, name: str) -> DataFrame:
    """Running counts over all files of a folder, read as a stream to its end.

    Each trigger writes the counts so far to a folder of its own, in the shared folder; the last one is the result.
    """
    out = f"{shared_dir(spark)}/lexloom-counts-{name}"
    counts = running_counts(file_stream(spark, path), keys, value)
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last[:] = [number]

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/batch={last[0]}") if last else spark.createDataFrame([], counts.schema)
