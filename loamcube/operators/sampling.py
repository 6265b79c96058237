"""Seeded sampling, splits, padding. A sample hashes keys with the seed; partitioning never shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.functions.scalars import hashed_order, hashed_unit
from loamcube.schemas import SERIES


def random_dates(dates: DataFrame, rate: float, seed: int = 0, keys: tuple[str, ...] = SERIES, date_col: str = "doy") -> DataFrame:
    """``ceil(n * rate)`` dates of each series."""
    w = W.partitionBy(*keys)
    order = hashed_order(seed, *[F.col(k) for k in (*keys, date_col)])
    out = dates.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    return out.where(F.col("_r") <= F.ceil(F.col("_n") * rate)).drop("_r", "_n")


def cap_dates(dates: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Each sensor keeps its share of ``most`` dates of the site."""
    order = hashed_order(seed, *[F.col(k) for k in (*SERIES, "doy")])
    out = dates.withColumns({"_n": F.count("*").over(W.partitionBy(*SERIES)), "_all": F.count("*").over(W.partitionBy("site")), "_r": F.row_number().over(W.partitionBy(*SERIES).orderBy(order))})
    keep = (F.col("_all") <= most) | (F.col("_r") <= F.floor(F.col("_n") * F.lit(most) / F.col("_all")))
    return out.where(keep).drop("_n", "_all", "_r")


def random_split(df: DataFrame, ratios: dict[str, float], keys: tuple[str, ...], seed: int = 0) -> DataFrame:
    """``split`` by ratio of the hash range; what the ratios leave is ``rest``."""
    u = hashed_unit(seed, *[F.col(k) for k in keys])
    part, upto = None, 0.0
    for name, r in ratios.items():
        upto += r
        part = F.when(u < upto, name) if part is None else part.when(u < upto, name)
    return df.withColumn("split", part.otherwise("rest"))


def fixed_split(df: DataFrame, validation: DataFrame, on: str) -> DataFrame:
    flag = validation.select(on).distinct().withColumn("_v", F.lit("validation"))
    return df.join(flag, on, "left").withColumn("split", F.coalesce("_v", F.lit("training"))).drop("_v")


def site_split(df: DataFrame, training: list, testing: list) -> DataFrame:
    return df.withColumn("split", F.when(F.col("site").isin(training), "training").when(F.col("site").isin(testing), "testing")).where("split is not null")


def pad(df: DataFrame, values: list[str], length: int, keys: tuple[str, ...], fill: float = 0.0) -> DataFrame:
    """One row for each series with date-ordered arrays of ``length``; null arrays where it is longer."""
    item = F.struct("doy", *values, "masked")
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    short = F.size("_s") <= length
    missing = F.lit(length) - F.size("_s")

    def padded(name: str, value):
        return F.when(short, F.concat(F.transform("_s", lambda x: x[name]), F.array_repeat(value, F.greatest(missing, F.lit(0))))).alias(name)

    return out.select(*keys, F.size("_s").alias("n"), padded("doy", F.lit(0)), *(padded(v, F.lit(float(fill))) for v in values), padded("masked", F.lit(True)))
