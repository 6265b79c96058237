"""Long and wide tables, tiles and pixels, patches, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widen(metrics: DataFrame, keys: tuple[str, ...], names: list[str]) -> DataFrame:
    """One row for each key, a column for each listed ``metric_band``."""
    return metrics.withColumn("_k", F.concat_ws("_", "metric", "band")).groupBy(*keys).pivot("_k", names).agg(F.first("value", ignorenulls=True))


def lengthen(wide: DataFrame, keys: tuple[str, ...], names: list[str]) -> DataFrame:
    long = wide.unpivot(list(keys), names, "_k", "value")
    parts = F.split("_k", "_", 2)
    return long.select(*keys, parts[0].alias("metric"), parts[1].alias("band"), "value")


def tile_to_pixels(tiles: DataFrame, array_col: str, width: int, keys: tuple[str, ...]) -> DataFrame:
    return tiles.select(*keys, F.posexplode(array_col).alias("idx", "v")).withColumns({"r": F.floor(F.col("idx") / width).cast("int"), "c": F.col("idx") % width})


def pixels_to_tile(pixels: DataFrame, keys: tuple[str, ...], value: str = "v", to: str = "data") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", value))), lambda x: x[value]).alias(to))


def patchify(pixels: DataFrame, size: int, patch: int, margin: int, keys: tuple[str, ...], fill: float = 0.0, value: str = "v") -> DataFrame:
    """Overlapping square patches of a ``size`` x ``size`` raster, padded by ``fill`` to whole patches and margins.

    A pixel goes to every patch whose halo covers it; the cells no pixel covers are added.
    """
    n = -(-size // patch)
    reach = -(-margin // patch)
    span = patch + 2 * margin
    at = lambda x: F.floor(F.col(x) / patch).cast("int")
    near = lambda x: F.explode(F.sequence(F.greatest(at(x) - reach, F.lit(0)), F.least(at(x) + reach, F.lit(n - 1))))
    out = pixels.select(*keys, "r", "c", value).withColumn("pr", near("r")).withColumn("pc", near("c"))
    out = out.withColumns({"ir": F.col("r") - F.col("pr") * patch + margin, "ic": F.col("c") - F.col("pc") * patch + margin})
    out = out.where(F.col("ir").between(0, span - 1) & F.col("ic").between(0, span - 1)).select(*keys, "pr", "pc", "ir", "ic", value)
    spark = pixels.sparkSession
    cell = spark.range(n * n * span * span).select(*[(F.floor(F.col("id") / d) % m).cast("int").alias(c) for c, d, m in (("pr", n * span * span, n), ("pc", span * span, n), ("ir", span, span), ("ic", 1, span))])
    blank = cell.select("*", (F.col("pr") * patch + F.col("ir") - margin).alias("_r"), (F.col("pc") * patch + F.col("ic") - margin).alias("_c"))
    blank = blank.where(~(F.col("_r").between(0, size - 1) & F.col("_c").between(0, size - 1))).drop("_r", "_c")
    padding = pixels.select(*keys).distinct().crossJoin(F.broadcast(blank)).withColumn(value, F.lit(float(fill)))
    return out.unionByName(padding.select(*keys, "pr", "pc", "ir", "ic", value))


def unpatchify(patches: DataFrame, size: int, patch: int, margin: int, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """Drop the halo, put the patches back."""
    inner = patches.where(F.col("ir").between(margin, margin + patch - 1) & F.col("ic").between(margin, margin + patch - 1))
    out = inner.select(*keys, (F.col("pr") * patch + F.col("ir") - margin).alias("r"), (F.col("pc") * patch + F.col("ic") - margin).alias("c"), value)
    return out.where((F.col("r") < size) & (F.col("c") < size))


def timeline(parts: dict[str, DataFrame], keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """For each date the roles it has: a boolean column for each named set of dates."""
    tagged = None
    for name, df in parts.items():
        one = df.select(*keys, "doy").distinct().withColumn("_role", F.lit(name))
        tagged = one if tagged is None else tagged.union(one)
    return tagged.groupBy(*keys, "doy").agg(*[F.bool_or(F.col("_role") == n).alias(n) for n in parts])
