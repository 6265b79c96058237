"""Sources and sinks of areas, product indices, observations and metrics."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube.functions.scalars import export_value, path_tail
from loamcube.schemas import AOI_JSON, INDEX_TSV


def read_aoi(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(AOI_JSON).option("multiLine", True).json(path)
    return raw.select("name", *(F.col("aoi")[i].alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))), "crs", "start_date", "end_date")


def read_product_index(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """Tab-separated indices ``root/site/sensor/*.csv``, folders named by value or ``key=value``; a site without any gives no rows."""
    paths = [f"{root}/*/*/{n}" for n in names] if names else [f"{root}/*/*/*.csv"]
    raw = spark.read.schema(INDEX_TSV).csv(paths, sep="\t", header=True).select("*", "_metadata.file_path")
    part = lambda n: F.regexp_replace(F.element_at(F.split("file_path", "/"), n), "^(site|sensor)=", "")
    return raw.withColumns({"site": part(-3), "sensor": part(-2), "index_file": part(-1), "bands": path_tail(F.col("bands")), "mask": path_tail(F.col("mask"))}).drop("file_path")


def read_observations(spark: SparkSession, path: str, bands: list[str], sites: list | None = None, sensor: str | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """A window of observations: sites and sensor prune folders, rows and columns skip row groups, bands prune columns."""
    df = spark.read.parquet(path)
    if sites is not None:
        df = df.where(F.col("site").isin(sites))
    if sensor is not None:
        df = df.where(F.col("sensor") == sensor)
    for name, span in (("r", rows), ("c", cols)):
        if span is not None:
            df = df.where((F.col(name) >= span[0]) & (F.col(name) < span[1]))
    keep = [c for c in ("site", "sensor", "acquisition_date", "doy", "px", "r", "c", "masked") if c in df.columns]
    return df.select(*keep, *bands)


def z_order(r: Column, c: Column, bits: int = 16) -> Column:
    """Bits of two numbers in turn: rows near each other in both lie near each other in this order."""
    bit = lambda x, i, to: F.shiftleft(F.shiftright(x.cast("long"), i).bitwiseAND(1), to)
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(x, i, 2 * i + n) for i in range(bits) for n, x in enumerate((c, r))])


def write_observations(df: DataFrame, path: str, mode: str = "overwrite", group_bytes: int = 8 << 20, page_rows: int = 4000) -> None:
    """Observations by site and sensor; those with rows and columns clustered by both, in row groups and pages of small ranges.

    A window of rows and columns then reads the pages that it meets: their statistics tell. Ranges of the order are files, so
    no site is written by one task alone.
    """
    out = df
    if {"r", "c"} <= set(df.columns):
        out = df.withColumn("_z", z_order(F.col("r"), F.col("c")))
        out = out.repartitionByRange("site", "sensor", "_z").sortWithinPartitions("site", "sensor", "_z").drop("_z")
    out.write.mode(mode).option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).partitionBy("site", "sensor").parquet(path)


def write_product_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("site", "sensor").csv(path, sep="\t", header=True)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One file, by date: metric tables have a row for each date and band."""
    metrics.orderBy("doy").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_predictions(pred: DataFrame, path: str, bands: list[str], origin: str, scale: float = 10000.0, reference: DataFrame | None = None, keys: tuple[str, ...] = ("site", "px", "sensor", "doy")) -> None:
    """Predictions as shorts, by site, sensor, mode (``mae`` for hidden dates, ``clr`` for given ones) and date.

    With a ``reference`` its values stand beside them as ``ref_<band>``, no-data where it is masked or missing.
    """
    out = pred
    if reference is not None:
        shown = [F.when(~F.col("masked"), F.col(b)).alias(f"ref_{b}") for b in bands]
        out = out.join(reference.select(*keys, *shown), list(keys), "left")
        out = out.withColumns({f"ref_{b}": export_value(F.col(f"ref_{b}"), scale) for b in bands})
    out = out.withColumns({**{b: export_value(F.col(b), scale) for b in bands}, "mode": F.when(F.col("clear"), "clr").otherwise("mae"), "acq_date": F.date_add(F.to_date(F.lit(origin)), F.col("doy"))})
    out.write.mode("overwrite").partitionBy("site", "sensor", "mode", "acq_date").parquet(path)


def write_samples(obs: DataFrame, path: str, bands: list[str], origin: str, rows: tuple[int, int], cols: tuple[int, int], scale: float = 1.0) -> None:
    """Raw dates of one patch (half-open rows and columns) as shorts, by site, sensor and date; hidden pixels stay."""
    inside = (F.col("r") >= rows[0]) & (F.col("r") < rows[1]) & (F.col("c") >= cols[0]) & (F.col("c") < cols[1])
    out = obs.where(inside).withColumns({**{b: export_value(F.col(b), scale) for b in bands}, "acq_date": F.date_add(F.to_date(F.lit(origin)), F.col("doy"))})
    out.select("site", "sensor", "acq_date", "r", "c", *bands).write.mode("overwrite").partitionBy("site", "sensor", "acq_date").parquet(path)


def write_features(df: DataFrame, path: str, features: list[str]) -> None:
    df.withColumns({f: F.col(f).cast("float") for f in features}).write.mode("overwrite").partitionBy("site", "sensor").parquet(path)


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, inputs: list[str]) -> str:
    """A name for what the input folders and files hold now: paths, lengths and times of all files below them."""
    found = []
    for path in inputs:
        root, fs = _files(spark, path)
        listed = fs.listFiles(root, True)
        while listed.hasNext():
            f = listed.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, root: str, parameters: dict, compute: Callable[[], DataFrame], inputs: list[str] = ()) -> DataFrame:
    """The stored result of these parameters over these inputs; computed and stored at first.

    The name hashes all parameters and the inputs' manifest, so a file that is added, removed or written anew gives another result.
    A result is written aside and then renamed: readers meet whole ones, and of two writers the second keeps the first's.
    """
    key = {"parameters": parameters, "inputs": manifest(spark, list(inputs))} if inputs else parameters
    path = f"{root}/{hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:32]}"
    done, fs = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        aside, _ = _files(spark, f"{root}/.{uuid.uuid4().hex}")
        compute().write.parquet(aside.toString())
        # a rename onto a folder that is there would move into it
        if fs.exists(done) or not fs.rename(aside, done.getParent()):
            fs.delete(aside, True)
        inside, _ = _files(spark, f"{path}/{aside.getName()}")
        fs.delete(inside, True)
    return spark.read.parquet(path)
