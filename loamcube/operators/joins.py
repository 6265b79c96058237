"""Calendar, as-of, conjunction and combining joins.

As-of joins are a union of both sides and range windows over each key: one shuffle on the key, n log n, and
never all pairs of dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.functions.scalars import product_day
from loamcube.schemas import PIXEL, SERIES


def common_dates(index: DataFrame, file_col: str = "index_file") -> DataFrame:
    """Products of dates that all index files of the site and sensor list."""
    files = index.groupBy(*SERIES).agg(F.countDistinct(file_col).alias("_files"))
    each = index.groupBy(*SERIES, "acquisition_date").agg(F.countDistinct(file_col).alias("_n"))
    everywhere = each.join(files, list(SERIES)).where("_n = _files").select(*SERIES, "acquisition_date")
    return index.join(everywhere, [*SERIES, "acquisition_date"], "left_semi")


def _dates(df: DataFrame, sensor: str, date_col: str) -> DataFrame:
    return df.where(F.col("sensor") == sensor).select("site", date_col).distinct()


def other_sensor(sensor: str) -> str:
    return {"lr": "hr", "hr": "lr"}[sensor]


def conjunctions(df: DataFrame, sensor: str, date_col: str = "doy") -> DataFrame:
    """Rows of one sensor on dates that the other has too."""
    return df.where(F.col("sensor") == sensor).join(_dates(df, other_sensor(sensor), date_col), ["site", date_col], "left_semi")


def non_conjunctions(df: DataFrame, sensor: str, date_col: str = "doy") -> DataFrame:
    return df.where(F.col("sensor") == sensor).join(_dates(df, other_sensor(sensor), date_col), ["site", date_col], "left_anti")


def conjunction_pairs(df: DataFrame, bands: list[str], keys: tuple[str, ...] = ("site", "px", "doy")) -> DataFrame:
    """LR and HR values of the same pixel and date side by side."""

    def side(sensor: str) -> DataFrame:
        return df.where(F.col("sensor") == sensor).select(*keys, *(F.col(c).alias(f"{sensor}_{c}") for c in (*bands, "masked")))

    return side("lr").join(side("hr"), list(keys))


def query_grid(pixels: DataFrame, dates: DataFrame) -> DataFrame:
    """Every pixel on every query date; dates with keys (as ``site``) meet the pixels of those keys alone."""
    shared = [c for c in dates.columns if c in pixels.columns]
    # a calendar without keys is a few hundred dates, which Spark sees by its size; by site it grows with the sites
    return pixels.join(dates, shared) if shared else pixels.crossJoin(dates)


def calendar_join(df: DataFrame, targets: DataFrame | None, bands: list[str], fill: float = 0.0, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Re-index series on target dates.

    Present dates keep value and mask, absent ones get ``fill`` and are masked. ``targets`` has ``doy`` and any of
    the keys; null means the dates of the site's other pixels of the sensor.
    """
    pixels = df.select(*keys).distinct()
    targets = df.select(*[k for k in SERIES if k in keys], "doy").distinct() if targets is None else targets
    out = query_grid(pixels, targets).join(df.select(*keys, "doy", *bands, "masked"), [*keys, "doy"], "left")
    return out.withColumns({**{b: F.coalesce(b, F.lit(float(fill))) for b in bands}, "masked": F.coalesce("masked", F.lit(True))})


def _both(source: DataFrame, targets: DataFrame, keys: tuple[str, ...], payload: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    none = [F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in carry]
    a = source.select(*keys, "doy", payload.alias("_v"), F.lit(False).alias("_ask"), *none)
    b = targets.select(*keys, "doy", *carry).withColumns({"_v": F.lit(None).cast(a.schema["_v"].dataType), "_ask": F.lit(True)})
    return a.unionByName(b)


def bracket(source: DataFrame, targets: DataFrame, values: list[str], keys: tuple[str, ...] = PIXEL, strict_after: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each target date the last source row strictly before and the first at or after it.

    ``source`` holds usable rows only, one for each key and date. Returns keys, ``doy``, ``prev_doy``,
    ``prev_<value>``, ``next_doy``, ``next_<value>``; null where there is none. Columns of the targets to ``carry`` come along.
    """
    return _sides(_both(source, targets, keys, F.struct("doy", *values), carry), values, keys, strict_after).where("_ask").select(*keys, "doy", *_side_columns(values), *carry)


def bracket_within(df: DataFrame, usable: Column, values: list[str], keys: tuple[str, ...] = PIXEL, strict_after: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``bracket`` of the rows of one table, of which the ``usable`` ones are the source: they are read and moved once."""
    rows = df.select(*keys, "doy", *carry, F.when(usable, F.struct("doy", *values)).alias("_v"))
    return _sides(rows, values, keys, strict_after).select(*keys, "doy", *_side_columns(values), *carry)


def _sides(rows: DataFrame, values: list[str], keys: tuple[str, ...], strict_after: bool) -> DataFrame:
    w = W.partitionBy(*keys)
    # both frames run: one that ends behind would be read again for each row
    return rows.withColumns(
        {
            "_p": F.last("_v", ignorenulls=True).over(w.orderBy("doy").rangeBetween(W.unboundedPreceding, -1)),
            "_n": F.last("_v", ignorenulls=True).over(w.orderBy(F.desc("doy")).rangeBetween(W.unboundedPreceding, -1 if strict_after else 0)),
        }
    )


def _side_columns(values: list[str]) -> list[Column]:
    return [F.col(f"{side}.{v}").alias(f"{name}_{v}") for side, name in (("_p", "prev"), ("_n", "next")) for v in ("doy", *values)]


def nearest_date(source_dates: DataFrame, targets: DataFrame, keys: tuple[str, ...] = ("site",), allow_same_day: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Nearest source date of each target date, the earlier one on ties; null without any.

    ``source_dates`` holds the eligible dates. Columns of the targets to ``carry`` come along.
    """
    return _nearest(bracket(source_dates, targets, [], keys, not allow_same_day, carry), keys, carry)


def nearest_date_within(df: DataFrame, usable: Column, keys: tuple[str, ...] = ("site",), allow_same_day: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """``nearest_date`` of the rows of one table, of which the ``usable`` ones are the eligible dates."""
    return _nearest(bracket_within(df, usable, [], keys, not allow_same_day, carry), keys, carry)


def _nearest(out: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...]) -> DataFrame:
    before, after = F.col("doy") - F.col("prev_doy"), F.col("next_doy") - F.col("doy")
    near = F.when(F.col("next_doy").isNull() | (before <= after), F.col("prev_doy")).otherwise(F.col("next_doy"))
    return out.select(*keys, "doy", near.alias("nearest_doy"), F.abs(near - F.col("doy")).alias("distance"), *carry)


def clear_dates(df: DataFrame, most_masked: float = 1.0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Dates whose share of masked pixels is at most ``most_masked``."""
    rate = df.groupBy(*keys, "doy").agg(F.avg(F.col("masked").cast("int")).alias("_rate"))
    return rate.where(F.col("_rate") <= most_masked).select(*keys, "doy")


def nearest_clear(df: DataFrame, targets: DataFrame, values: list[str], threshold: int = 20, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Nearest clear observation of the same pixel, closer than ``threshold`` days; the earlier one on ties."""
    out = bracket(df.where("not masked"), targets, values, keys)
    before, after = F.col("doy") - F.col("prev_doy"), F.col("next_doy") - F.col("doy")
    earlier = F.col("next_doy").isNull() | (before <= after)
    pick = lambda c: F.when(earlier, F.col(f"prev_{c}")).otherwise(F.col(f"next_{c}"))
    out = out.select(*keys, "doy", pick("doy").alias("near_doy"), *(pick(v).alias(f"near_{v}") for v in values))
    return out.where(F.abs(F.col("near_doy") - F.col("doy")) < threshold)


def previous_clear(source: DataFrame, targets: DataFrame, values: list[str], k: int = 2, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The ``k`` last usable source rows at or before each target: ``first_*`` the latest, then ``second_*``, ...

    The window's frame holds dates of one key; only the last ``k`` of the usable ones are kept along the way.
    """
    names = ("first", "second", "third", "fourth")[:k]
    w = W.partitionBy(*keys).orderBy("doy")
    chained = source
    payload = F.struct("doy", *values)
    for i in range(1, k):
        chained = chained.withColumn(f"_b{i}", F.lag(payload, i).over(w))
    full = F.struct(payload.alias("_b0"), *[F.col(f"_b{i}") for i in range(1, k)])
    at = W.partitionBy(*keys).orderBy("doy").rangeBetween(W.unboundedPreceding, 0)
    out = _both(chained, targets, keys, full).withColumn("_l", F.last("_v", ignorenulls=True).over(at)).where("_ask")
    return out.select(*keys, "doy", *(F.col(f"_l._b{i}.{v}").alias(f"{n}_{v}") for i, n in enumerate(names) for v in ("doy", *values)))


def coalesce_series(a: DataFrame, b: DataFrame, bands: list[str], keys: tuple[str, ...]) -> DataFrame:
    """``a``, or ``b`` where ``a`` is masked and ``b`` isn't; masked where both are."""
    other = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*bands, "masked")))
    out = a.join(other, list(keys))
    take = F.col("masked") & ~F.col("_masked")
    return out.select(*keys, *(F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in bands), (F.col("masked") & F.col("_masked")).alias("masked"))


def combine_series(a: DataFrame, b: DataFrame, bands: list[str], keys: tuple[str, ...], fill: float = 0.0) -> DataFrame:
    """All dates of both: the mean where both are clear, the clear one otherwise, masked where none is."""
    x = a.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in bands), (~F.col("masked")).alias("_a"))
    y = b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in bands), (~F.col("masked")).alias("_b"))
    out = x.join(y, list(keys), "full_outer")
    ok_a, ok_b = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    one = lambda c: F.when(ok_a & ok_b, (F.col(f"_a_{c}") + F.col(f"_b_{c}")) / 2).when(ok_a, F.col(f"_a_{c}")).when(ok_b, F.col(f"_b_{c}")).otherwise(F.lit(float(fill)))
    return out.select(*keys, *(one(c).alias(c) for c in bands), (~ok_a & ~ok_b).alias("masked"))


def align(pred: DataFrame, ref: DataFrame, bands: list[str], keys: tuple[str, ...] = (*PIXEL, "doy")) -> DataFrame:
    """Prediction ``p_*`` and reference ``r_*`` of the same pixel and date, with the reference's mask."""
    p = pred.select(*keys, *(F.col(b).alias(f"p_{b}") for b in bands))
    r = ref.select(*keys, *(F.col(b).alias(f"r_{b}") for b in bands), "masked")
    return p.join(r, list(keys))


def clear_masked_split(dates: DataFrame, input_dates: DataFrame, on: tuple[str, ...] = (*SERIES, "doy")) -> DataFrame:
    """``clear``: was this date among the inputs?"""
    flag = input_dates.select(*on).distinct().withColumn("_hit", F.lit(True))
    return dates.join(flag, list(on), "left").withColumn("clear", F.coalesce("_hit", F.lit(False))).drop("_hit")


def concat_bands(a: DataFrame, b: DataFrame, bands_a: list[str], bands_b: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Bands of two series of the same dates; masked where either is."""
    y = b.select(*keys, *bands_b, F.col("masked").alias("_m"))
    return a.select(*keys, *bands_a, "masked").join(y, list(keys)).withColumn("masked", F.col("masked") | F.col("_m")).drop("_m")


def date_mismatches(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Dates that only one of the two has: ``concat_bands`` wants none."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").withColumn("side", F.lit("a")).union(y.join(x, list(keys), "left_anti").withColumn("side", F.lit("b")))


def reconcile_index(index: DataFrame, other: DataFrame, on: tuple[str, ...] = ("site", "doy")) -> DataFrame:
    """Products that the other index lists too, with its rate and validity; paths of invalid ones become null."""
    o = other.select(*on, F.col("clear_pixel_rate").alias("_rate"), F.col("valid").alias("_valid"))
    out = index.join(o, list(on)).withColumns({"clear_pixel_rate": F.col("_rate"), "valid": F.col("_valid")}).drop("_rate", "_valid")
    paths = [c for c in ("bands", "mask", "snow_mask") if c in index.columns]
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in paths}) if paths else out


def stale_folders(index: DataFrame, other: DataFrame, on: tuple[str, ...] = ("site", "doy"), date_col: str = "acquisition_date") -> DataFrame:
    """Folders (site, day) of products that are invalid or that the other index lacks: to be deleted."""
    lost = index.join(other.select(*on).distinct(), list(on), "left_anti")
    return index.where("not valid").unionByName(lost).select("site", product_day(F.col(date_col)).alias("folder")).distinct()


def skip_existing(incoming: DataFrame, stored: DataFrame, on: tuple[str, ...] = ("product_id",), override: bool = False) -> DataFrame:
    return incoming if override else incoming.join(stored, list(on), "left_anti")


def cross_resolution(fine: DataFrame, coarse: DataFrame, factor: int, keys: tuple[str, ...], values: list[str], row: str = "r", col: str = "c") -> DataFrame:
    """Each fine cell with the values of the coarse cell over it (nearest neighbour)."""
    c = coarse.select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"), *(F.col(v).alias(f"coarse_{v}") for v in values))
    # stored with its coarse cell, a table keeps its buckets
    f = fine if {"_r", "_c"} <= set(fine.columns) else fine.withColumns({"_r": F.floor(F.col(row) / factor).cast("int"), "_c": F.floor(F.col(col) / factor).cast("int")})
    return f.join(c, [*keys, "_r", "_c"]).drop("_r", "_c")
