"""Set operations on dates and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    return a.select(*keys, "doy").union(b.select(*keys, "doy")).distinct()


def padded_date_union(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Dates of both for each key as arrays of one length: 0 and ``valid`` false behind the end.

    Only the greatest length, one number, is common to all keys.
    """
    each = date_union(a, b, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("doy")).alias("doy"))
    most = each.agg(F.max(F.size("doy")).alias("_most"))
    out = each.crossJoin(F.broadcast(most))
    short = F.col("_most") - F.size("doy")
    return out.select(*keys, F.concat("doy", F.array_repeat(F.lit(0), short)).alias("doy"), F.concat(F.array_repeat(F.lit(True), F.size("doy")), F.array_repeat(F.lit(False), short)).alias("valid"))


def common_dates(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    return a.select(*keys, "doy").intersect(b.select(*keys, "doy"))


def uncommon_dates(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Dates of the second that the first lacks."""
    return b.select(*keys, "doy").exceptAll(a.select(*keys, "doy")).distinct()


def stack_sensors(lr: DataFrame, hr: DataFrame) -> DataFrame:
    return lr.withColumn("sensor", F.lit("lr")).unionByName(hr.withColumn("sensor", F.lit("hr")))


def stack_experiments(runs: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label, df in runs.items():
        one = df.withColumn("experiment", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out
