"""Fusion and gap-filling pipelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.operators import aggs, joins, tiles, timeops
from loamcube.schemas import PIXEL


def naive(obs: DataFrame, bands: list[str], targets: DataFrame | None = None) -> DataFrame:
    """Linear gap filling of both sensors on the union of a site's dates; series of one date give nothing."""
    enough = obs.groupBy(*PIXEL).agg(F.countDistinct("doy").alias("_n")).where("_n > 1").drop("_n")
    dates = obs.select("site", "doy").distinct() if targets is None else targets
    return timeops.linear_gapfilling(obs, joins.query_grid(enough, dates).select(*PIXEL, "doy"), bands)


def stair(obs: DataFrame, band: str, keys: tuple[str, ...] = ("site", "px")) -> DataFrame:
    """Leave-one-out prediction of HR at conjunctions.

    For each conjunction held out, the difference HR - LR at the others is interpolated to it and added to its
    LR value; HR there is gap-filled from the dates left. Rows of LR that are masked stay masked.

    Holding a date out only changes what its neighbours are filled from, so each date carries its two nearest clear HR
    dates to each side, and windows over a pixel's dates do the rest: rows don't multiply.
    """
    lr = obs.where("sensor = 'lr'").select(*keys, "doy", F.col(band).alias("lr"), F.col("masked").alias("lr_masked"))
    hr = obs.where("sensor = 'hr'").select(*keys, "doy", F.col(band).alias("v"), (~F.col("masked")).alias("ok"))
    # both run; a frame that ends behind would be read again for each row
    before, behind = (W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1) for order in (F.asc("doy"), F.desc("doy")))
    out = hr.join(lr, [*keys, "doy"], "left")
    date = F.when(F.col("ok"), F.struct("doy", "v"))
    out = out.withColumns({"p1": F.last(date, True).over(before), "n1": F.last(date, True).over(behind)})
    out = out.withColumns({"p2": F.last(F.when(F.col("ok"), F.struct(F.col("p1.doy").alias("doy"), F.col("p1.v").alias("v"))), True).over(before), "n2": F.last(F.when(F.col("ok"), F.struct(F.col("n1.doy").alias("doy"), F.col("n1.v").alias("v"))), True).over(behind)})
    usable = F.when(~F.col("lr_masked"), F.struct("doy", "v", "ok", "lr", "p1", "p2", "n1", "n2"))
    out = out.withColumns({"a": F.last(usable, True).over(before), "b": F.last(usable, True).over(behind)}).where("lr_masked is not null")

    def filled(side: str, own: str, nearest: str) -> Column:
        """HR - LR at the neighbour ``side``, with the row's own date left out of what HR is filled from."""
        x = F.col(side)
        held = x[nearest]["doy"] == F.col("doy")
        near, far = F.when(held, x[f"{nearest[0]}2"]).otherwise(x[nearest]), x[own]
        v = near["v"] + (far["v"] - near["v"]) * ((x["doy"] - near["doy"]) / (far["doy"] - near["doy"]))
        hr_value = F.when(x["ok"], x["v"]).when(near["doy"].isNull(), far["v"]).when(far["doy"].isNull(), near["v"]).otherwise(v)
        return hr_value - x["lr"]

    out = out.withColumns({"da": filled("a", "p1", "n1"), "db": filled("b", "n1", "p1")})
    between = F.col("da") + (F.col("db") - F.col("da")) * ((F.col("doy") - F.col("a.doy")) / (F.col("b.doy") - F.col("a.doy")))
    diff = F.when(F.col("db").isNull(), F.col("da")).when(F.col("da").isNull(), F.col("db")).otherwise(between)
    out = out.withColumn("diff", diff)
    known = F.col("diff").isNotNull()
    return out.select(*keys, "doy", F.when(known, F.col("lr") + F.col("diff")).otherwise(0.0).alias("pred"), (F.col("lr_masked") | ~known).alias("masked"))


def extrapolate_previous(obs: DataFrame, band: str, most_masked: float = 1.0) -> DataFrame:
    """HR at each LR date, extended linearly through the site's two last usable HR dates before it.

    Site, px, doy, ``hr_pred``, ``lr``, ``masked`` (LR, either date, or no two dates).
    """
    dates = joins.clear_dates(obs.where("sensor = 'hr'"), most_masked)
    lr = obs.where("sensor = 'lr'").select("site", "px", "doy", F.col(band).alias("lr"), F.col("masked").alias("lr_masked"))
    pairs = joins.previous_clear(dates, lr.select("site", "doy").distinct(), [])
    hr = obs.where("sensor = 'hr'").select("site", "px", F.col("doy").alias("d"), F.col(band).alias("v"), F.col("masked").alias("m"))
    side = lambda n: hr.select("site", "px", F.col("d").alias(f"{n}_doy"), F.col("v").alias(f"{n}_v"), F.col("m").alias(f"{n}_m"))
    out = lr.join(pairs, ["site", "doy"]).join(side("first"), ["site", "px", "first_doy"], "left").join(side("second"), ["site", "px", "second_doy"], "left")
    slope = (F.col("second_v") - F.col("first_v")) / (F.col("second_doy") - F.col("first_doy"))
    pred = slope * (F.col("doy") - F.col("second_doy")) + F.col("second_v")
    bad = F.col("lr_masked") | F.coalesce("first_m", F.lit(True)) | F.coalesce("second_m", F.lit(True))
    return out.select("site", "px", "doy", pred.alias("hr_pred"), "lr", bad.alias("masked"))


def add_high_frequency(pred: DataFrame, base: DataFrame, size: int, keys: tuple[str, ...], mtf: float = 0.4) -> DataFrame:
    """High-passed prediction on top of an enlarged coarse tile (both keys, r, c, v)."""
    sharp = tiles.high_pass(pred, size, tiles.psf_kernel(1.0, 1.0, mtf), keys, "v", "_hp")
    return base.join(sharp, [*keys, "r", "c"]).select(*keys, "r", "c", (F.col("v") + F.col("_hp")).alias("v"))


def sen2like(hr: DataFrame, lr: DataFrame, size: int, factor: int, band: str, mtf: float = 0.4, most_masked: float = 1.0) -> DataFrame:
    """HR at each LR date: the sharp part of what the two HR dates before extend to, on top of the enlarged LR.

    ``hr`` has site, doy, r, c, the band and ``masked`` on the fine grid, ``lr`` the same on one ``factor`` times coarser.
    Masked where LR or either date is, or there are no two dates; without two dates the value is null.
    """
    keys = ("site", "doy")
    up = tiles.resample(lr, size // factor, 1 / factor, keys, band, mode="bilinear", mask="masked")
    px = (F.col("r") * size + F.col("c")).alias("px")
    rows = lambda df, sensor: df.select(*keys, px, F.lit(sensor).alias("sensor"), band, "masked")
    ahead = extrapolate_previous(rows(hr, "hr").union(rows(up, "lr")), band, most_masked)
    cell = {"r": F.floor(F.col("px") / size).cast("int"), "c": (F.col("px") % size).cast("int")}
    ahead = ahead.withColumns(cell).withColumn("v", F.col("hr_pred")).select(*keys, "r", "c", "v", "lr", "masked")
    sharp = tiles.high_pass(ahead, size, tiles.psf_kernel(1.0, 1.0, mtf), keys, "v", "_hp")
    out = ahead.join(sharp, [*keys, "r", "c"])
    return out.select(*keys, "r", "c", (F.col("lr") + F.col("_hp")).alias(band), "masked")


def naive_on_fine_grid(lr: DataFrame, size: int, factor: int, band: str, targets: DataFrame) -> DataFrame:
    """LR (site, doy, r, c, band, masked) gap-filled at the target dates, then enlarged to the fine grid."""
    px = (F.col("r") * size + F.col("c")).alias("px")
    obs = lr.select("site", px, F.lit("lr").alias("sensor"), "doy", band, "masked")
    filled = naive(obs, [band], targets).withColumns({"r": F.floor(F.col("px") / size).cast("int"), "c": (F.col("px") % size).cast("int")})
    return tiles.resample(filled.select("site", "doy", "r", "c", band), size, 1 / factor, ("site", "doy"), band)


def residual_compensation(pred: DataFrame, coarse: DataFrame, fine_size: int, factor: int, keys: tuple[str, ...], mtf: float = 0.4) -> DataFrame:
    """Prediction + (enlarged observation - blurred prediction)."""
    up = tiles.resample(coarse, fine_size // factor, 1 / factor, keys).withColumnRenamed("v", "_up")
    low = tiles.convolve(pred, fine_size, tiles.psf_kernel(1.0, float(factor), mtf), keys, "v", "_low")
    return pred.join(up, [*keys, "r", "c"]).join(low, [*keys, "r", "c"]).select(*keys, "r", "c", (F.col("v") + F.col("_up") - F.col("_low")).alias("v"))


def pair_tiles(hr: DataFrame, lr: DataFrame, size: int, band: str, reduce_by: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(LR date and nearest HR date of another day, LR tiles reduced by ``reduce_by``): the inputs of a per-date model."""
    near = joins.nearest_date(hr.select("site", "doy").distinct(), lr.select("site", "doy").distinct(), allow_same_day=False).where("nearest_doy is not null")
    return near, tiles.shrink(lr, size, reduce_by, ("site", "doy"), band)


def pair_inputs(obs: DataFrame, bands: list[str]) -> DataFrame:
    """For each LR date the nearest HR date of another day, as a per-date model wants them: LR and HR rows side by side."""
    hr_dates = joins.clear_dates(obs.where("sensor = 'hr'"))
    lr_dates = obs.where("sensor = 'lr'").select("site", "doy").distinct()
    near = joins.nearest_date(hr_dates, lr_dates, ("site",), allow_same_day=False).where("nearest_doy is not null")
    lr = obs.where("sensor = 'lr'").select("site", "px", "doy", *(F.col(b).alias(f"lr_{b}") for b in bands))
    hr = obs.where("sensor = 'hr'").select("site", "px", F.col("doy").alias("nearest_doy"), *(F.col(b).alias(f"hr_{b}") for b in bands))
    return lr.join(near, ["site", "doy"]).join(hr, ["site", "px", "nearest_doy"])


def filled_calendar(obs: DataFrame, targets: DataFrame, bands: list[str], fill: float = 1.0) -> DataFrame:
    """Series on the union of their own and the target dates (site, doy), missing ones ``fill``."""
    dates = obs.select("site", "doy").union(targets.select("site", "doy")).distinct()
    return joins.calendar_join(obs, dates, bands, fill)


def sharpen_bands(fine: DataFrame, coarse: DataFrame, model: Callable[[DataFrame, DataFrame], DataFrame], fine_bands: list[str], coarse_bands: list[str], order: list[str], keys: tuple[str, ...], scale: float = 2000.0) -> DataFrame:
    """Coarse bands on the fine grid by ``model``, beside the fine ones and in the given order.

    The model gets both tables divided by ``scale`` and returns keys and ``coarse_bands`` on the fine grid.
    """
    scaled = lambda df, bands: df.select(*keys, *((F.col(b) / scale).alias(b) for b in bands))
    sharp = model(scaled(fine, fine_bands), scaled(coarse, coarse_bands))
    sharp = sharp.select(*keys, *((F.col(b) * scale).alias(b) for b in coarse_bands))
    return fine.select(*keys, *fine_bands).join(sharp, list(keys)).select(*keys, *order)


def _by_band(predict: Callable[[DataFrame, str], DataFrame], obs: DataFrame, bands: list[str]) -> DataFrame:
    """A method of one band (site, px, doy, value, masked) on each of several: HR series, null where the method has nothing."""
    out = None
    for b in bands:
        one = predict(obs, b).toDF("site", "px", "doy", "_v", "_m")
        one = one.select("site", "px", F.lit("hr").alias("sensor"), "doy", F.when(~F.col("_m"), F.col("_v")).alias(b))
        out = one if out is None else out.join(one, [*PIXEL, "doy"], "full")
    return out


def _naive(given: DataFrame, target: DataFrame, bands: list[str]) -> DataFrame:
    return naive(given, bands, target.select("site", "doy").distinct())


def _stair(given: DataFrame, target: DataFrame, bands: list[str]) -> DataFrame:
    # each date of the targets is held out by itself
    return _by_band(lambda obs, b: stair(obs, b).select("site", "px", "doy", "pred", "masked"), given.unionByName(target).dropDuplicates([*PIXEL, "doy"]), bands)


def _extrapolated(given: DataFrame, target: DataFrame, bands: list[str]) -> DataFrame:
    return _by_band(lambda obs, b: extrapolate_previous(obs, b).select("site", "px", "doy", "hr_pred", "masked"), given, bands)


def _mean(given: DataFrame, target: DataFrame, bands: list[str]) -> DataFrame:
    members = [m.select(*PIXEL, "doy", *bands) for m in (_naive(given, target, bands), _extrapolated(given, target, bands))]
    return aggs.ensemble_mean(members, bands, (*PIXEL, "doy"))


@dataclass(frozen=True)
class Method:
    """A method's bands, the strategy it is scored with, and what predicts ``bands`` at targets from given dates."""

    bands: tuple[str, ...]
    strategy: str
    predict: Callable[[DataFrame, DataFrame, list[str]], DataFrame]


#: Registry of the methods here: ``evaluation.evaluate_method`` runs them by name.
METHODS = {
    "naive": Method(("b1", "b2", "b3", "b4"), "GAPS", _naive),
    "stair": Method(("b1", "b2", "b3", "b4"), "CONJLRuHR2HR", _stair),
    "sen2like": Method(("b1", "b2", "b3", "b4"), "LRuHRNOCONJ2HR", _extrapolated),
    "ensemble": Method(("b1",), "DEEPHARMO", _mean),
}


def per_tile(tiles_df: DataFrame, fn, array_col: str, width: int, keys: tuple[str, ...], schema: str) -> DataFrame:
    """A user's function on every tile: see ``tiles.dense``."""
    return tiles.dense(tiles_df, fn, array_col, width, keys, schema)


def tiled(px: DataFrame, fn, size: int, patch: int, margin: int, keys: tuple[str, ...]) -> DataFrame:
    """A function of square arrays applied patch by patch with a halo, and put back together."""
    from loamcube.operators import reshape

    span = patch + 2 * margin
    cut = reshape.patchify(px, size, patch, margin, keys).withColumn("idx", F.col("ir") * span + F.col("ic"))
    blocks = reshape.pixels_to_tile(cut, (*keys, "pr", "pc"))

    def run(tile: np.ndarray):
        out = np.asarray(fn(tile), float)
        r, c = np.indices(out.shape)
        return {"ir": r.ravel(), "ic": c.ravel(), "v": out.ravel()}

    types = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in (*keys, "pr", "pc"))
    done = tiles.dense(blocks, run, "data", span, (*keys, "pr", "pc"), f"{types}, ir int, ic int, v double")
    return reshape.unpatchify(done, size, patch, margin, keys)


@dataclass(frozen=True)
class Cube:
    """One sensor's dates of a tile with its halo: ``values`` (date, band, row, column), ``masked`` (date, row, column)."""

    doy: np.ndarray
    values: np.ndarray
    masked: np.ndarray


def _packed(px: DataFrame, patch: int, margin: int, n: int, keys: tuple[str, ...], bands: list[str]) -> DataFrame:
    """Dates of tiles as arrays of (place, masked, bands), packed before they are shuffled; halo pixels go to each tile that reaches them."""
    span, reach = patch + 2 * margin, -(-margin // patch)

    def near(x: str) -> Column:
        at = F.floor(F.col(x) / patch).cast("int")
        return F.explode(F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(n - 1))))

    out = px.withColumn("pr", near("r")).withColumn("pc", near("c"))
    out = out.withColumns({"_ir": F.col("r") - F.col("pr") * patch + margin, "_ic": F.col("c") - F.col("pc") * patch + margin})
    out = out.where(F.col("_ir").between(0, span - 1) & F.col("_ic").between(0, span - 1))
    cell = F.struct((F.col("_ir") * span + F.col("_ic")).cast("int").alias("idx"), F.col("masked").alias("masked"), *(F.col(b).cast("double").alias(b) for b in bands))
    return out.groupBy(*keys, "pr", "pc", F.col("doy").cast("int").alias("doy")).agg(F.collect_list(cell).alias("px"))


def tiled_pair(hr: DataFrame, lr: DataFrame, fn: Callable[[Cube, Cube], Cube], size: int, factor: int, patch: int, margin: int, keys: tuple[str, ...], hr_bands: list[str], lr_bands: list[str], bands: list[str]) -> DataFrame:
    """A function of both sensors, tile by tile, on the fine grid: keys, doy, r, c, ``bands``, masked.

    ``hr`` has keys, doy, r, c, its bands and ``masked`` on a grid of ``size`` rows and columns, ``lr`` the same on one ``factor`` times
    coarser. A tile is ``patch`` fine pixels wide with ``margin`` around it; the coarse tile and its halo are as many times smaller. Both
    tiles meet in one task; pixels outside the image or missing are NaN and masked. ``fn`` returns dates of its own choice on the
    fine tile with halo, of which the halo is dropped. A tile that one sensor has no pixel of gets a cube without dates.
    """
    if patch % factor or margin % factor:
        raise ValueError("tile and halo must be whole coarse pixels")
    n = -(-size // patch)
    tile = [*keys, "pr", "pc"]
    left = _packed(hr, patch, margin, n, keys, hr_bands)
    right = _packed(lr, patch // factor, margin // factor, n, keys, lr_bands)
    types = ", ".join(f"`{k}` {hr.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, doy int, r int, c int, {', '.join(f'`{b}` double' for b in bands)}, masked boolean"

    def cube(table: pa.Table, names: list[str], span: int) -> Cube:
        days = table.column("doy").to_numpy()
        values, masked = np.full((len(days), len(names), span * span), np.nan), np.ones((len(days), span * span), bool)
        px = table.column("px").combine_chunks() if len(days) else []
        for i in range(len(days)):
            own = px[i].values
            at = own.field("idx").to_numpy()
            masked[i, at] = own.field("masked").fill_null(True).to_numpy(zero_copy_only=False)
            for b, name in enumerate(names):
                values[i, b, at] = own.field(name).to_numpy(zero_copy_only=False)
        order = np.argsort(days, kind="stable")
        return Cube(days[order], values[order].reshape(len(days), len(names), span, span), masked[order].reshape(len(days), span, span))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        got = fn(cube(a, hr_bands, patch + 2 * margin), cube(b, lr_bands, (patch + 2 * margin) // factor))
        inner = np.s_[..., margin : margin + patch, margin : margin + patch]
        values, masked = np.asarray(got.values, float)[inner], np.asarray(got.masked, bool)[inner]
        *own, pr, pc = (k.as_py() for k in key)
        day, r, c = (x.ravel() for x in np.indices(masked.shape))
        r, c = r + pr * patch, c + pc * patch
        kept = (r < size) & (c < size)
        columns = {k: pa.array([v] * int(kept.sum()), a.schema.field(k).type) for k, v in zip(keys, own, strict=True)}
        columns |= {"doy": pa.array(np.asarray(got.doy)[day][kept].astype(np.int32)), "r": pa.array(r[kept].astype(np.int32)), "c": pa.array(c[kept].astype(np.int32))}
        columns |= {name: pa.array(values[:, i].ravel()[kept]) for i, name in enumerate(bands)}
        return pa.table(columns | {"masked": pa.array(masked.ravel()[kept])})

    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(run, schema)
