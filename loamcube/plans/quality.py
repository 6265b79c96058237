"""Data-quality checks: tables of violations, never exceptions over data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamcube.schemas import PIXEL, SERIES


def product_violations(index: DataFrame, pixels: DataFrame, expected: int, keys: tuple[str, ...] = (*SERIES, "doy")) -> DataFrame:
    """Valid products whose number of pixels isn't the expected one."""
    found = pixels.groupBy(*keys).agg(F.count("*").alias("n_found"))
    out = index.where("valid").select(*keys).join(found, list(keys), "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return out.where(F.col("n_found") != expected)


def layer_violations(index: DataFrame, pixels: DataFrame, layers: list[str], expected: int, keys: tuple[str, ...] = (*SERIES, "doy")) -> DataFrame:
    """Valid products of which a layer (bands, mask) doesn't have a value at each of the expected pixels."""
    found = pixels.groupBy(*keys).agg(*[F.count(x).alias(x) for x in layers])
    out = index.where("valid").select(*keys).join(found, list(keys), "left")
    cells = F.array(*[F.struct(F.lit(x).alias("layer"), F.coalesce(x, F.lit(0)).alias("n_found")) for x in layers])
    return out.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*").where(F.col("n_found") != expected)


def projection_violations(cells: DataFrame, aoi: DataFrame) -> DataFrame:
    """Sites whose products have another projection (``epsg``) than the request (``crs``), or several."""
    found = cells.groupBy("site").agg(F.min("epsg").alias("least"), F.max("epsg").alias("most"))
    out = found.join(aoi.select(F.col("name").alias("site"), "crs"), "site")
    return out.where("least <> crs or most <> crs").select("site", F.lit("projection").alias("problem"))


def unread_sites(aoi: DataFrame, dataset: DataFrame) -> DataFrame:
    """Sites whose first patch has no rows in a patch dataset."""
    first = dataset.where("patch_idx = 0").select("site").distinct()
    return aoi.select(F.col("name").alias("site")).distinct().join(first, "site", "left_anti").withColumn("problem", F.lit("no first patch"))


def mask_violations(obs: DataFrame) -> DataFrame:
    """Series of which some dates have masks and some have none."""
    per = obs.groupBy(*SERIES).agg(F.count("masked").alias("n"), F.count("*").alias("of"))
    return per.where("n > 0 and n < of").select(*SERIES, F.lit("mask of some dates").alias("problem"))


def patch_size(size: float, resolution: float, factor: int) -> int:
    """Pixels of a patch; it must hold whole cells of the coarser resolution."""
    n = size / resolution
    if n != int(n) or int(n) % factor:
        raise ValueError(f"a patch of {size} doesn't hold whole cells of {factor} times {resolution}")
    return int(n)


def site_violations(index: DataFrame, aoi: DataFrame) -> DataFrame:
    """Sites without an AOI, and AOIs without a product."""
    a, b = index.select("site").distinct(), aoi.select(F.col("name").alias("site")).distinct()
    return a.join(b, "site", "left_anti").withColumn("problem", F.lit("no aoi")).union(b.join(a, "site", "left_anti").withColumn("problem", F.lit("no product")))


def series_violations(obs: DataFrame, bands: list[str]) -> DataFrame:
    """Keys that occur twice, masks that are null, clear values that are missing."""
    key = (*PIXEL, "doy")
    twice = obs.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("problem"))
    null = obs.where("masked is null").select(*key, F.lit("no mask").alias("problem"))
    empty = [obs.where(~F.col("masked") & (F.col(b).isNull() | F.isnan(b))).select(*key, F.lit(f"no {b}").alias("problem")) for b in bands]
    out = twice.union(null)
    for e in empty:
        out = out.union(e)
    return out
