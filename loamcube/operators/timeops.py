"""Gap filling, slices, patches, target calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.operators.joins import bracket
from loamcube.schemas import PIXEL


def interpolate(df: DataFrame, band: str) -> Column:
    """Value of ``band`` at ``doy`` from the columns of ``bracket``."""
    p, n = F.col(f"prev_{band}"), F.col(f"next_{band}")
    share = (F.col("doy") - F.col("prev_doy")) / (F.col("next_doy") - F.col("prev_doy"))
    return F.when(F.col("next_doy").isNull(), p).when(F.col("prev_doy").isNull() | (F.col("next_doy") == F.col("doy")), n).otherwise(p + (n - p) * share)


def linear_gapfilling(df: DataFrame, targets: DataFrame, bands: list[str], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Values at target dates from the clear ones around them.

    A clear date gives its own value, one side alone its nearest value, no clear date null. ``targets`` has the
    keys and ``doy``. The result has no mask.
    """
    out = bracket(df.where("not masked"), targets, bands, keys)
    return out.select(*keys, "doy", *(interpolate(out, b).alias(b) for b in bands))


def time_slices(df: DataFrame, days: int, doy_col: str = "doy") -> DataFrame:
    return df.withColumn("slice_idx", F.floor(F.col(doy_col) / days).cast("int"))


def dense_slices(df: DataFrame, least: int) -> DataFrame:
    """Slices of a site in which both sensors have more than ``least`` dates."""
    n = lambda s: F.countDistinct(F.when(F.col("sensor") == s, F.col("doy")))
    return df.groupBy("site", "slice_idx").agg(n("lr").alias("n_lr"), n("hr").alias("n_hr")).where((F.col("n_lr") > least) & (F.col("n_hr") > least))


def patches(spark: SparkSession, aoi: DataFrame, size: float) -> DataFrame:
    """Upper-left corners of ``floor(extent / size)`` patches on each axis, evenly spaced over the extent."""
    n = lambda lo, hi: F.greatest(F.floor((F.col(hi) - F.col(lo)) / size), F.lit(1)).cast("int")
    out = aoi.withColumns({"nx": n("xmin", "xmax"), "ny": n("ymin", "ymax")})
    out = out.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    at = lambda lo, hi, k, i: F.col(lo) + F.col(i) * ((F.col(hi) - F.col(lo)) / F.col(k))
    out = out.withColumns({"patch_idx": F.col("ix") * F.col("ny") + F.col("iy"), "x0": at("xmin", "xmax", "nx", "ix"), "y0": at("ymin", "ymax", "ny", "iy")})
    return out.select(F.col("name").alias("site"), "patch_idx", "x0", "y0", (F.col("x0") + size).alias("x1"), (F.col("y0") + size).alias("y1"))


def number_examples(n_patches: int, n_slices: int, idx: Column) -> tuple[Column, Column]:
    """(patch, slice) of an example's number."""
    return F.floor(idx / n_slices).cast("int"), (idx % n_slices).cast("int")


def hidden_by_gaps(doy: Column, gap: int, horizon: int = 365) -> Column:
    """Is the date strictly inside one of the alternating gaps that open at gap, 3 gap, 5 gap, ... before ``horizon``?"""
    p = F.pmod(doy - gap, F.lit(2 * gap))
    return (doy > gap) & (p > 0) & (p < gap) & (doy - p < horizon)


def half_month_calendar(spark: SparkSession, year: int, origin: str) -> DataFrame:
    """Offsets of the 1st and 15th of each month."""
    months = spark.range(12).select(F.make_date(F.lit(year), (F.col("id") + 1).cast("int"), F.lit(1)).alias("first"))
    days = months.select(F.explode(F.array("first", F.date_add("first", 14))).alias("d"))
    return days.select(F.datediff("d", F.to_date(F.lit(origin))).alias("doy"))


def regular_calendar(spark: SparkSession, step: int = 10, start: int = 0, end: int = 360) -> DataFrame:
    return spark.range(start, end + 1, step).select(F.col("id").cast("int").alias("doy"))


def listed_calendar(spark: SparkSession, dates: tuple[int, ...]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(int(d)) for d in dates])).alias("doy"))


def sheet_position(index: DataFrame, per_row: int = 8, keys: tuple[str, ...] = ("site", "sensor"), date_col: str = "acquisition_date") -> DataFrame:
    """Row and column of each valid product on a contact sheet."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(date_col)) - 1
    return index.where("valid").withColumn("_n", n).withColumns({"sheet_row": F.floor(F.col("_n") / per_row).cast("int"), "sheet_col": (F.col("_n") % per_row).cast("int")}).drop("_n")
