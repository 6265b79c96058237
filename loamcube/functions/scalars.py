"""Column functions: calendar, masks from bit fields, radiometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of the scene map that hide the ground, and its snow class.
SCENE_HIDDEN = (0, 1, 2, 3, 7, 8, 9, 10)
SCENE_SNOW = 11
#: Cloud probability above which a pixel is hidden.
CLOUD_PROBABILITY = 150
# Bits of the quality layers that hide the ground.
QA_BITS = (0, 1, 2, 3, 4)
AEROSOL_BITS = (1, 6, 7)
SATURATION_BITS = (0, 1, 2, 3, 4, 5, 6, 11)
QA_SNOW_BIT = 5
NO_DATA = -10000


def path_tail(path: Column) -> Column:
    """The last two components of an absolute path; others as they are."""
    return F.when(path.startswith("/"), F.regexp_extract(path, "([^/]+/[^/]+)$", 1)).otherwise(path)


def offset_date(origin: str, doy: Column) -> Column:
    """Date string ``doy`` days after ``origin``."""
    return F.date_format(F.date_add(F.to_date(F.lit(origin)), doy), "yyyy-MM-dd")


def bit(value: Column, n: int) -> Column:
    return F.shiftright(value, n).bitwiseAND(F.lit(1))


def any_bit(value: Column, bits: tuple[int, ...]) -> Column:
    return value.bitwiseAND(F.lit(sum(1 << b for b in bits))) != 0


def scene_mask(scene: Column, data_mask: Column | None = None, cloud_mask: Column | None = None, cloud_probability: Column | None = None) -> Column:
    """Hidden by the scene map, missing, or cloudy; a null layer doesn't hide."""
    tests = [scene.isin(*SCENE_HIDDEN)]
    if data_mask is not None:
        tests.append(data_mask == 0)
    if cloud_mask is not None:
        tests.append(cloud_mask > 0)
    if cloud_probability is not None:
        tests.append(cloud_probability > CLOUD_PROBABILITY)
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def quality_mask(qa: Column, aerosol: Column | None = None, saturation: Column | None = None, bands: list[Column] | None = None) -> Column:
    """Hidden by the quality bits, or zero or missing in any band."""
    tests = [any_bit(qa, QA_BITS)]
    if aerosol is not None:
        tests.append(F.forall(F.array(*[bit(aerosol, b) for b in AEROSOL_BITS]), lambda x: x == 1))
    if saturation is not None:
        tests.append(any_bit(saturation, SATURATION_BITS))
    tests += [b.isNull() | F.isnan(b) | (b == 0) for b in bands or []]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def missing(value: Column) -> Column:
    """Zero, null or not a number."""
    return value.isNull() | F.isnan(value) | (value == 0)


def target_scale(band: Column, value: Column) -> Column:
    """Stored values to reflectance; the thermal band to kelvin."""
    return F.when(band == "lst", value / 10).otherwise(value / 10000)


def thermal_band(bands: list[str]) -> str | None:
    """Name of the thermal band by its place: the eighth of eight or more, or the only one."""
    return bands[7] if len(bands) >= 8 else bands[0] if len(bands) == 1 else None


def target_values(bands: list[str]) -> dict[str, Column]:
    """Stored values of ``bands`` to reflectance, the thermal one by its place to kelvin."""
    thermal = thermal_band(bands)
    return {b: target_scale(F.lit("lst" if b == thermal else "reflectance"), F.col(b)) for b in bands}


def raw_thermal(value: Column) -> Column:
    """The unscaled thermal band at ingest."""
    return value / 1000


def stored_to_celsius(value: Column) -> Column:
    """Stored tenths of a kelvin."""
    return kelvin_to_celsius(value / 10)


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def calendar_features(doy: Column, n: int, div: float = 10000.0, offset: int = 0) -> Column:
    """``n`` sines (even places) and cosines (odd places) of the date at falling frequencies."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    arg = lambda k: doy / F.pow(F.lit(div), 2 * F.floor((k + offset) / 2) / n)
    return F.transform(steps, lambda k: F.when(k % 2 == 0, F.sin(arg(k))).otherwise(F.cos(arg(k))))


def with_calendar(values: Column, doy: Column, mode: str, n: int, div: float = 10000.0, offset: int = 0) -> Column:
    """Calendar features alone (``YIELD``), added to ``values`` (``ADD``) or behind them (``CONCAT``)."""
    pe = calendar_features(doy, n, div, offset)
    if mode == "YIELD":
        return pe
    if mode == "ADD":
        return F.zip_with(values, pe, lambda a, b: a + b)
    if mode == "CONCAT":
        return F.concat(values, pe)
    raise ValueError(f"unknown mode {mode}")


def display_stretch(value: Column, masked: Column, channel: str) -> Column:
    """Display value in [0, 1]; hidden pixels have no green or blue, and full red where red was none."""
    v = F.least(F.greatest(value / 1500, F.lit(0.0)), F.lit(1.0))
    return F.when(~masked, v).when(F.lit(channel == "red") & (v != 0), v).otherwise(F.lit(1.0 if channel == "red" else 0.0))


def export_value(value: Column, scale: float = 1.0) -> Column:
    """Scaled value as short; missing becomes the no-data value, what shorts can't hold the nearest one they can."""
    known = F.coalesce(F.nanvl(value * scale, F.lit(None).cast("double")), F.lit(float(NO_DATA)))
    return F.greatest(F.least(known, F.lit(32767.0)), F.lit(-32768.0)).cast("short")


def product_day(date: Column) -> Column:
    """Name of a date's folder."""
    return F.date_format(date, "yyyyMMdd")


def export_path(sensor: Column, what: str, date: Column) -> Column:
    """Path of a date's export under the folder of its site."""
    day = product_day(date)
    return F.concat(day, F.lit("/"), F.concat_ws("_", sensor, F.lit(what), day))


def smooth_l1(difference: Column, beta: float = 0.1) -> Column:
    d = F.abs(difference)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def squared(difference: Column) -> Column:
    return difference * difference


def hashed_unit(seed: int, *keys: Column) -> Column:
    """Pseudo-random number in [0, 1) of a key; the same in every engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hashed_order(seed: int, *keys: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.md5(text.cast("binary"))
