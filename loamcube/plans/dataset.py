"""Patch datasets and ingest of products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamcube.functions import scalars
from loamcube.operators import columns, filters, joins, tiles, timeops
from loamcube.schemas import SERIES


def training_table(index: DataFrame, obs: DataFrame, days: int = 365, least_dates: int = 5, only_conjunctions: bool = False, origin: str | None = None) -> DataFrame:
    """Observations of valid dates common to all index files, in slices dense enough in both sensors, with joint masks."""
    ok = joins.common_dates(filters.valid_products(index)).select(*SERIES, F.col("acquisition_date")).distinct()
    if only_conjunctions:
        ok = joins.conjunctions(ok, "lr", "acquisition_date").unionByName(joins.conjunctions(ok, "hr", "acquisition_date"))
    kept = timeops.time_slices(columns.day_offset(obs.join(ok, [*SERIES, "acquisition_date"], "left_semi"), origin=origin), days)
    dense = timeops.dense_slices(kept, least_dates).select("site", "slice_idx")
    return columns.joint_mask(kept.join(dense, ["site", "slice_idx"], "left_semi"))


def patch_dataset(table: DataFrame, aoi: DataFrame, size: float) -> DataFrame:
    """Rows of a training table (site, x, y, ``slice_idx``) with the number of their patch and of their example.

    A site's patches are evenly spaced, so a pixel's patch follows from its place: rows don't multiply. Pixels between patches
    go. Examples of a site are numbered by patch, then slice.
    """
    n = lambda lo, hi: F.greatest(F.floor((F.col(hi) - F.col(lo)) / size), F.lit(1)).cast("int")
    box = aoi.select(F.col("name").alias("site"), "xmin", "xmax", "ymin", "ymax").withColumns({"nx": n("xmin", "xmax"), "ny": n("ymin", "ymax")})
    step = {"sx": (F.col("xmax") - F.col("xmin")) / F.col("nx"), "sy": (F.col("ymax") - F.col("ymin")) / F.col("ny")}
    out = table.join(box.withColumns(step), "site").where((F.col("x") >= F.col("xmin")) & (F.col("y") >= F.col("ymin")))

    def at(v: str, lo: str, d: str, k: str) -> Column:
        """The last corner at or before the pixel; the quotient may miss it by one where the pixel lies on a corner."""
        i, corner = F.floor((F.col(v) - F.col(lo)) / F.col(d)).cast("int"), lambda i: F.col(lo) + i * F.col(d)
        i = F.when(F.col(v) < corner(i), i - 1).when(F.col(v) >= corner(i + 1), i + 1).otherwise(i)
        return F.least(i, F.col(k) - 1)

    out = out.withColumns({"ix": at("x", "xmin", "sx", "nx"), "iy": at("y", "ymin", "sy", "ny")})
    inside = (F.col("x") < F.col("xmin") + F.col("ix") * F.col("sx") + size) & (F.col("y") < F.col("ymin") + F.col("iy") * F.col("sy") + size)
    out = out.where(inside).withColumn("patch_idx", F.col("ix") * F.col("ny") + F.col("iy"))
    slices = table.groupBy("site").agg((F.max("slice_idx") + 1).alias("n_slices"))
    out = out.join(slices, "site").withColumn("example", F.col("patch_idx") * F.col("n_slices") + F.col("slice_idx"))
    return out.select(*table.columns, "patch_idx", "example")


def resample_at_read(px: DataFrame, size: int, stored: float, wanted: float, keys: tuple[str, ...], value: str = "v", mask: str = "masked", mtf: float = 0.4) -> DataFrame:
    """Pixels stored at one resolution on the grid of another: bicubic to a finer one, as shorts; blurred by a
    kernel of half width 3 to a coarser one. The mask by the nearest cell.

    A value that a missing pixel reaches into is the no-data value, and masked, on a finer grid; NaN or null on a coarser one. What
    overshoots the range of shorts is cut to it.
    """
    if stored == wanted:
        return px
    factor = wanted / stored
    if factor < 1:
        out = tiles.resample(px, size, factor, keys, value, mask=mask)
        return out.withColumns({mask: F.col(mask) | F.col(value).isNull() | F.isnan(value), value: scalars.export_value(F.col(value))})
    blurred = tiles.convolve(px, size, tiles.psf_kernel(stored, wanted, mtf, 3), keys, value, value).join(px.select(*keys, "r", "c", mask), [*keys, "r", "c"])
    return tiles.resample(blurred, size, factor, keys, value, mask=mask)


def time_range(index: DataFrame, date_col: str = "acquisition_date") -> DataFrame:
    return index.groupBy("site").agg(F.min(date_col).alias("first"), F.max(date_col).alias("last"), F.countDistinct(date_col).alias("n_dates"))


def ingest(pixels: DataFrame, mask: Column, keys: tuple[str, ...] = (*SERIES, "acquisition_date"), opening: int = 5, dilation: int = 50, least_clear: float = 0.25, scene: str | None = None, zero_dilation: int = 0) -> tuple[DataFrame, DataFrame]:
    """(product index with the paths of valid products, their reflectances): mask, clean it, rate, decide, export values.

    ``pixels`` has the keys, ``r``, ``c`` and bands ``b*``. With ``zero_dilation`` pixels that are zero in any band, and those
    so near them, are masked before the mask is cleaned; pixels that are missing in any band are masked after it.
    """
    bands = [c for c in pixels.columns if c.startswith("b") and c[1:].isdigit()]
    any_band = lambda test: reduce(lambda a, b: a | b, [test(F.col(b)) for b in bands])
    masked = pixels.withColumn("masked", mask)
    if zero_dilation:
        masked = masked.withColumn("_zero", any_band(lambda b: F.coalesce(b == 0, F.lit(False))))
        masked = tiles.dilate(masked, zero_dilation, keys, "_zero").withColumn("masked", F.col("masked") | F.col("_zero")).drop("_zero")
    masked = tiles.clean_mask(masked, opening, dilation, keys)
    masked = masked.withColumn("masked", F.col("masked") | any_band(lambda b: b.isNull() | F.isnan(b)))
    rates = [F.avg(F.when(F.col("masked"), 0.0).otherwise(1.0)).alias("clear_pixel_rate")]
    if scene:
        rates += [F.avg(F.when(F.col(scene) == 2, 1.0).otherwise(0.0)).alias("dark_pixel_rate"), F.avg(F.when(F.col(scene) == scalars.SCENE_SNOW, 1.0).otherwise(0.0)).alias("snow_pixel_rate")]
    index = masked.groupBy(*keys).agg(*rates)
    index = index.withColumns({"product_id": F.concat_ws("_", "sensor", scalars.product_day(F.col("acquisition_date"))), "valid": F.col("clear_pixel_rate") >= least_clear})
    index = index.withColumns({what: F.when(F.col("valid"), scalars.export_path(F.col("sensor"), what, F.col("acquisition_date"))) for what in ("bands", "mask")})
    good = masked.join(index.where("valid").select(*keys), list(keys), "left_semi")
    return index, good.withColumns({b: scalars.export_value(F.col(b)) for b in bands})
