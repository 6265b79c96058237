"""Explicit schemas of stored tables, and small parameter classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

AOI_JSON = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("aoi", T.ArrayType(T.DoubleType())),
        T.StructField("crs", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
    ]
)
INDEX_TSV = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("acquisition_date", T.DateType()),
        T.StructField("clear_pixel_rate", T.DoubleType()),
        T.StructField("dark_pixel_rate", T.DoubleType()),
        T.StructField("snow_pixel_rate", T.DoubleType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("bands", T.StringType()),
        T.StructField("mask", T.StringType()),
        T.StructField("snow_mask", T.StringType()),
    ]
)
#: A pixel of one sensor; observations of it differ in ``doy``.
PIXEL = ("site", "px", "sensor")
#: What a sensor's dates are unique in.
SERIES = ("site", "sensor")


@dataclass(frozen=True)
class Standardization:
    """Mean and standard deviation per band; ``scale`` divides raw values first, ``clip`` bounds them."""

    mean: dict[str, float]
    std: dict[str, float]
    scale: float | None = None
    clip: tuple[float, float] | None = (-0.2, 1.0)


@dataclass(frozen=True)
class HidingParameters:
    """Parameters of the date-hiding strategies."""

    strategy: str = "ALL"
    rate: float = 0.5
    seed: int = 0
    gap: int = 30
    horizon: int = 365
    start: int = 120
    reference_size: int = 60
    n_context: int = 3
    dates: tuple[int, ...] = ()
    year: int = 2022
