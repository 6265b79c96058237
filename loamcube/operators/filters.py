"""Filters on products, dates, pixels and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.schemas import SERIES


def valid_products(index: DataFrame) -> DataFrame:
    """Products of dates that are valid in every index file that lists them."""
    good = index.groupBy(*SERIES, "acquisition_date").agg(F.bool_and("valid").alias("_ok")).where("_ok").drop("_ok")
    return index.join(good, [*SERIES, "acquisition_date"], "left_semi")


def min_clear_rate(index: DataFrame, rate: float = 0.25) -> DataFrame:
    return index.where(F.col("clear_pixel_rate") >= rate)


def keep_dates(df: DataFrame, dates: DataFrame, on: tuple[str, ...] = (*SERIES, "doy")) -> DataFrame:
    return df.join(dates, list(on), "left_semi")


def drop_masked_dates(df: DataFrame, keys: tuple[str, ...] = (*SERIES, "doy")) -> DataFrame:
    """Observations of dates that have at least one clear pixel."""
    blind = df.groupBy(*keys).agg(F.bool_and("masked").alias("_blind")).where("_blind")
    return df.join(blind, list(keys), "left_anti")


def trim(df: DataFrame, keys: tuple[str, ...] = SERIES) -> tuple[DataFrame, DataFrame]:
    """(observations of dates with a clear pixel, series of which nothing is left)."""
    kept = drop_masked_dates(df, (*keys, "doy"))
    return kept, df.select(*keys).distinct().join(kept.select(*keys).distinct(), list(keys), "left_anti")


def inside_margin(row: str, col: str, size: int, margin: int) -> Column:
    if 2 * margin + 1 >= size:
        raise ValueError("the margin leaves nothing")
    return F.col(row).between(margin, size - 1 - margin) & F.col(col).between(margin, size - 1 - margin)


def crop(df: DataFrame, size: int, margin: int, row: str = "r", col: str = "c") -> DataFrame:
    return df.where(inside_margin(row, col, size, margin)).withColumns({row: F.col(row) - margin, col: F.col(col) - margin})


def scored(df: DataFrame, size: int, margin: int, row: str = "r", col: str = "c") -> DataFrame:
    """``scored``: clear and away from the border."""
    return df.withColumn("scored", ~F.col("masked") & inside_margin(row, col, size, margin))


def clip_to_aoi(cells: DataFrame, aoi: DataFrame, most: int) -> DataFrame:
    """Cells inside the site's box where the projections agree, else its first ``most`` rows and columns."""
    out = cells.join(aoi.withColumnRenamed("name", "site"), "site")
    same = F.col("epsg") == F.col("crs")
    box = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    # a site's few distinct rows and columns are ranked, not its cells
    nth = lambda axis, order: cells.select("site", axis).distinct().select("site", axis, F.row_number().over(W.partitionBy("site").orderBy(order)).alias(f"_n{axis}"))
    out = out.join(nth("x", F.col("x")), ["site", "x"]).join(nth("y", F.desc("y")), ["site", "y"])
    return out.where(F.when(same, box).otherwise((F.col("_nx") <= most) & (F.col("_ny") <= most))).select(*cells.columns)


def cloud_ceiling(catalogue: DataFrame, most: float = 75.0, start: str | None = None, end: str | None = None) -> DataFrame:
    out = catalogue.where(F.col("cloud_cover") <= most)
    return period(out, "acquisition_date", start, end)


def period(df: DataFrame, date_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open period."""
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(date_col) < F.lit(end).cast("date"))


def eligible(df: DataFrame, keys: tuple[str, ...], least: float = 0.5, most_difference: float | None = None, difference: Column | None = None) -> DataFrame:
    """Rows of groups that are clear enough, optionally with a bounded difference."""
    out = df.withColumn("_rate", F.avg(F.when(~F.col("masked"), 1.0).otherwise(0.0)).over(W.partitionBy(*keys))).where(F.col("_rate") >= least).drop("_rate")
    return out.where(F.abs(difference) <= most_difference) if most_difference is not None and difference is not None else out


def drop_nan(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(col))
