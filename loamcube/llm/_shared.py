"""What the operators of this subpackage share: tables, shared storage, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session (``local[...]``) may go without; it gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="loamcube-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of each ``passing`` that is open, the innermost last.
_PASSING: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` writes inside is deleted on leaving, and shuffle files of plans done are let go of.

    What is read later is stored by ``kept``.
    """
    stored: list[DataFrame] = []
    before = _PASSING.set((*_PASSING.get(), stored))
    try:
        yield
    finally:
        _PASSING.reset(before)
        for df in stored:
            discard(df)
        stored.clear()
        let_go(spark)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``materialize`` for what is to stay when the innermost ``passing`` is left."""
    before = _PASSING.set(_PASSING.get()[:-1])
    try:
        return materialize(df, tag)
    finally:
        _PASSING.reset(before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _PASSING.get():
        _PASSING.get()[-1].append(out)
    return out


def materialize_by(df: DataFrame, key: str, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder as a table in buckets of ``key``: grouping by it later moves no row of it.

    There are as many buckets as a shuffle has partitions. ``drop`` takes the table away.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{name}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.stored_at, out.stored_as = path, name
    return out


def drop(df: DataFrame) -> None:
    """Take away what ``materialize_by`` made, once nothing reads it any more."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
    discard(df)


def let_go(spark: SparkSession) -> None:
    """Have shuffle files deleted of plans that nothing refers to any more.

    Spark deletes them once the driver has collected a plan, which a driver with memory to spare puts off for a long time.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: With fewer edges than this, all edges of a node fit one task.
FEW_EDGES = 1_000_000


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b``. Returns ``node``, ``component`` for each node that
    has an edge to another; the component is its smallest node. Alternates the large-star and small-star
    steps until the edges form stars; every round is a few joins and grouped minima on the edge list. With more than
    ``few`` edges the minima are stored before they are joined: then both sides of a join are plain shuffles,
    of which Spark splits the crowded one of a node with very many edges.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = materialize(edges, "edges"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, stored = mark, [now]

        def least_of(rows: DataFrame, least, many: bool = mark[0] > few, stored: list = stored) -> DataFrame:
            out = rows.groupBy("u").agg(least.alias("m"))
            if many:
                stored.append(out := materialize(out, "minima"))
            return out

        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_of(both, F.least(F.min("v"), F.col("u"))), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        if mark[0] > few:
            stored.append(large := materialize(large, "large-star"))
        small = large.join(least_of(large, F.min("v")), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.where("u <> v").distinct(), "edges")
        for old in stored:
            discard(old)
    raise RuntimeError("components did not settle")
