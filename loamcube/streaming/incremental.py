"""Incremental ingest: batches of arriving products, those already stored left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamcube.operators.joins import skip_existing


def ingest_new(spark: SparkSession, incoming: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, on: tuple[str, ...] = ("product_id",)):
    """Start a query that appends the products of ``incoming`` (a stream) that ``target`` lacks, then stops.

    The ids that the stream has seen are keyed state in its checkpoint, looked up for arriving ones alone; ``target`` is read
    in a checkpoint's first batch only, for what others have stored before. A batch is written aside and its files are moved to
    names of the query and the batch: one that runs again after a failure takes away what it had moved and moves the same rows.
    """
    sc = spark.sparkContext
    path = lambda *parts: sc._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs = path(target).getFileSystem(sc._jsc.hadoopConfiguration())

    def write(batch: DataFrame, number: int) -> None:
        prefix = f"{sc.getLocalProperty('sql.streaming.queryId')}-{number}-"
        fs.mkdirs(path(target))
        for old in fs.globStatus(path(target, f"{prefix}*")):
            fs.delete(old.getPath(), True)
        if number == 0 and fs.globStatus(path(target, "[!_.]*")):
            batch = skip_existing(batch, spark.read.parquet(target).select(*on), on)
        aside = path(target, f".{prefix}aside")
        fs.delete(aside, True)
        transform(batch).write.parquet(aside.toString())
        for n, part in enumerate(sorted(f.getPath().getName() for f in fs.globStatus(path(aside.toString(), "part-*")))):
            fs.rename(path(aside.toString(), part), path(target, f"{prefix}{n:05d}.parquet"))
        fs.delete(aside, True)

    return incoming.dropDuplicates(list(on)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
