"""Projections on pixel rows: bands, masks, standardisation, derived bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.schemas import PIXEL, Standardization


def day_offset(df: DataFrame, date_col: str = "acquisition_date", origin: str | None = None, to: str = "doy") -> DataFrame:
    """Days since ``origin``, or since the site's first HR date."""
    if origin:
        return df.withColumn(to, F.datediff(date_col, F.to_date(F.lit(origin))))
    first = df.where("sensor = 'hr'").groupBy("site").agg(F.min(date_col).alias("_first"))
    return df.join(first, "site", "left").withColumn(to, F.datediff(date_col, "_first")).drop("_first")


def select_bands(df: DataFrame, bands: list[str], keep: tuple[str, ...] = (*PIXEL, "doy", "masked")) -> DataFrame:
    return df.select(*keep, *bands)


def bands_of_resolution(band_dim: DataFrame, resolution: float, exact: bool = False) -> DataFrame:
    """Bands at a resolution, or at it and finer ones."""
    return band_dim.where(F.col("res_m") == resolution if exact else F.col("res_m") <= resolution)


def split_bands(df: DataFrame, array_col: str, at: int) -> DataFrame:
    """The first ``at`` bands of an array and the rest."""
    return df.withColumns({f"{array_col}_a": F.slice(array_col, 1, at), f"{array_col}_b": F.slice(F.col(array_col), F.lit(at + 1), F.greatest(F.size(array_col) - at, F.lit(0)))})


def strip_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("masked", F.lit(False))


def standardize(df: DataFrame, stats: Standardization) -> DataFrame:
    def one(band: str):
        v = F.col(band) / stats.scale if stats.scale else F.col(band)
        if stats.clip:
            v = F.least(F.greatest(v, F.lit(stats.clip[0])), F.lit(stats.clip[1]))
        return (v - stats.mean[band]) / stats.std[band]

    return df.withColumns({b: one(b) for b in stats.mean})


def unstandardize(df: DataFrame, stats: Standardization) -> DataFrame:
    def one(band: str):
        v = F.col(band) * stats.std[band] + stats.mean[band]
        return v * stats.scale if stats.scale else v

    return df.withColumns({b: one(b) for b in stats.mean})


def add_ndvi(df: DataFrame, red: str, nir: str, stats: Standardization | None = None, epsilon: float = 1e-6, to: str = "ndvi") -> DataFrame:
    """Vegetation index of de-standardised red and near infrared as one more band."""
    r, n = F.col(red), F.col(nir)
    if stats:
        r, n = r * stats.std[red] + stats.mean[red], n * stats.std[nir] + stats.mean[nir]
    return df.withColumn(to, (n - r) / (r + n + epsilon))


def minmax_by_reference(df: DataFrame, pred: str, ref: str, keys: tuple[str, ...]) -> DataFrame:
    """Scale prediction and reference by the reference's range in each group; a flat group gives null."""
    w = W.partitionBy(*keys)
    low, high = F.min(ref).over(w), F.max(ref).over(w)
    span = F.nullif(high - low, F.lit(0.0))
    return df.withColumns({f"{pred}_scaled": (F.col(pred) - low) / span, f"{ref}_scaled": (F.col(ref) - low) / span})


def joint_mask(df: DataFrame, keys: tuple[str, ...] = (*PIXEL, "doy")) -> DataFrame:
    """One mask for all band groups of an observation: hidden in any is hidden in all."""
    return df.withColumn("masked", F.bool_or("masked").over(W.partitionBy(*keys)))


def read_mask(df: DataFrame, mask_col: str, bands: list[str]) -> DataFrame:
    """Hidden where the stored mask is positive or any selected band is 0."""
    return df.withColumn("masked", reduce(lambda a, b: a | b, [F.col(b) == 0 for b in bands], F.col(mask_col) > 0))


def impute(df: DataFrame, tokens: dict[str, float], strip: bool = False) -> DataFrame:
    """Hidden values become their band's token."""
    out = df.withColumns({b: F.when(F.col("masked"), F.lit(float(t))).otherwise(F.col(b)) for b, t in tokens.items()})
    return strip_mask(out) if strip else out


def force_mask(df: DataFrame, dates: DataFrame, on: tuple[str, ...] = ("site", "sensor", "doy")) -> DataFrame:
    """Hide all observations of the given dates."""
    flag = dates.select(*on).distinct().withColumn("_hit", F.lit(True))
    return df.join(flag, list(on), "left").withColumn("masked", F.col("masked") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def append_tag(df: DataFrame, array_col: str, tag: list[float]) -> DataFrame:
    return df.withColumn(array_col, F.concat(array_col, F.array(*[F.lit(float(x)) for x in tag])))


def sanitise_nan(df: DataFrame, bands: list[str]) -> DataFrame:
    """Rows with NaN in any band are hidden and their NaN become 0."""
    bad = reduce(lambda a, b: a | b, [F.isnan(b) for b in bands])
    return df.withColumn("masked", F.col("masked") | bad).withColumns({b: F.nanvl(b, F.lit(0.0)) for b in bands})


def invert_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("masked", ~F.col("masked"))


def mask_to_null(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.withColumns({b: F.when(~F.col("masked"), F.col(b)) for b in bands})


def label_results(df: DataFrame, sentinel_cols: list[str] = ()) -> DataFrame:
    """``status`` and ``id`` of result rows; scores of 100 and more are sentinels and become null."""
    out = df.withColumns({"status": F.when(F.col("clear"), "clear").otherwise("masked"), "id": F.concat_ws("_", "name", F.col("doy").cast("string"))})
    return out.withColumns({c: F.when(F.col(c) < 100, F.col(c)) for c in sentinel_cols}) if sentinel_cols else out
