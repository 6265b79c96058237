"""Evaluation: scenario, prediction, scores, tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube.functions import scalars
from loamcube.operators import aggs, filters, joins, reshape, tiles, timeops
from loamcube.plans import fusion
from loamcube.plans.scenarios import make_scenario, seen_rows
from loamcube.schemas import PIXEL, SERIES, HidingParameters


def scenario_parts(obs: DataFrame, p: HidingParameters, origin: str | None = None) -> tuple[DataFrame, DataFrame]:
    both = make_scenario(obs, p, origin)
    return both.where("role = 'input'").drop("role"), both.where("role = 'target'").drop("role")


def gapfill_scenario(obs: DataFrame, bands: list[str], p: HidingParameters) -> DataFrame:
    """Predict the target dates from the input ones; prediction, reference and whether the date was an input.

    Where a row's own sensor and date say whether it is an input, ``obs`` is computed, moved and sorted by pixel once.
    """
    seen = seen_rows(p)
    if seen is not None:
        rows = obs.dropna(subset=[*PIXEL, "doy"]).select(*PIXEL, "doy", *bands, *(F.col(b).alias(f"r_{b}") for b in bands), "masked", F.coalesce(seen, F.lit(False)).alias("clear"))
        references = [f"r_{b}" for b in bands]
        out = joins.bracket_within(rows, F.col("clear") & ~F.col("masked"), bands, PIXEL, carry=(*references, "masked", "clear"))
        return out.select(*SERIES, "doy", "px", *(timeops.interpolate(out, b).alias(f"p_{b}") for b in bands), *references, "masked", "clear")
    given, target = scenario_parts(obs, p)
    pred = timeops.linear_gapfilling(given, target.select(*PIXEL, "doy"), bands)
    out = joins.align(pred, target, bands)
    return joins.clear_masked_split(out, given)


def scores(aligned: DataFrame, bands: list[str], keys: tuple[str, ...] = (*SERIES, "doy", "clear"), angle_bands: list[str] | None = None) -> DataFrame:
    """Long metric rows: rmse, nrmse and mae of each band in one pass, spectral angle of all or of ``angle_bands``."""
    names = {"rmse": aggs.rmse, "nrmse": aggs.nrmse, "mae": aggs.mae}
    wide = aggs.per_band_all(aligned, bands, keys, names)
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    per_band = wide.select(*keys, "band", F.explode(rows).alias("_m")).select(*keys, "band", "_m.value", "_m.metric")
    angle = aggs.spectral_angle(aligned, angle_bands or bands, keys).select(*keys, F.lit("all").alias("band"), F.col("sam").alias("value"), F.lit("sam").alias("metric"))
    return per_band.unionByName(angle)


def scores_on_coarse_grid(pred: DataFrame, target: DataFrame, size: int, factor: int, bands: list[str], keys: tuple[str, ...], transfer: dict[str, tuple[float, float]], res: float = 1.0, margin: int = 5) -> DataFrame:
    """Long metric rows of a prediction on the fine grid, reduced by each band's transfer function (resolution, value) to the target's.

    Both have keys, ``r``, ``c`` and the bands, the target ``masked``. Scores leave a margin of the coarse tile out, and the
    thermal band the spectral angle.
    """
    low = target.select(*keys, "r", "c", "masked", *(F.col(b).alias(f"r_{b}") for b in bands))
    for b in bands:
        reduced = tiles.downsample_mtf(pred, size, res, *transfer[b], float(factor), keys, b)
        low = low.join(reduced.withColumnRenamed(b, f"p_{b}"), [*keys, "r", "c"])
    low = filters.scored(low, size // factor, margin).withColumn("masked", ~F.col("scored"))
    thermal = scalars.thermal_band(bands)
    return scores(low, bands, keys, [b for b in bands if b != thermal or len(bands) == 1])


def spectra(pred: DataFrame, target: DataFrame, size: int, factor: int, band: str, keys: tuple[str, ...], margin: int = 5) -> DataFrame:
    """Frequency restoration of a prediction against the enlarged target, both without a margin of the fine tile."""
    up = tiles.resample(target, size // factor, 1 / factor, keys, band)
    inner = size - 2 * margin

    def profile(px: DataFrame) -> DataFrame:
        block = filters.crop(px, size, margin).select(*keys, (F.col("r") * inner + F.col("c")).alias("idx"), F.col(band).alias("v"))
        return tiles.fft_profile(reshape.pixels_to_tile(block, keys), "data", inner, keys)

    return tiles.frequency_restoration(profile(pred), profile(up), keys)


def filtered_fit(aligned: DataFrame, band: str, size: int, keys: tuple[str, ...], when: str = "PRE", kernel=None, most_masked: float = 0.5, security: float | None = None) -> DataFrame:
    """Regression-fit score of tiles of which the sharp part counts, taken before (``PRE``) or after (``POST``) the regression.

    The sharp part is what the kernel's blur leaves, or without a kernel the squared gradient.
    """
    if when not in ("PRE", "POST"):
        raise ValueError(f"unknown mode {when}")

    def sharp(df: DataFrame, name: str) -> DataFrame:
        if kernel is None:
            return tiles.gradient_magnitude(df, keys, name, "_s").drop(name).withColumnRenamed("_s", name)
        return df.drop(name).join(tiles.high_pass(df, size, kernel, keys, name, name), [*keys, "r", "c"])

    p, r, a = (f"{side}_{band}" for side in "pra")
    if when == "PRE":
        return aggs.regression_fit(sharp(sharp(aligned, p), r), band, keys, most_masked, security)
    fitted = aggs.adapted_reference(aligned, band, keys, most_masked)
    return aggs.fit_loss(sharp(sharp(fitted, p), a).where("not masked"), band, keys, security)


def evaluate(obs: DataFrame, bands: list[str], p: HidingParameters, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of each date, table of results, wanted sites that gave none): scenario, prediction and scores of all sites in one plan."""
    rows = scores(gapfill_scenario(obs.join(wanted.select("site").distinct(), "site", "left_semi"), bands, p), bands)
    return rows, aggs.result_table(rows), skipped_sites(wanted, rows)


def evaluate_method(name: str, obs: DataFrame, bands: list[str] | None = None, p: HidingParameters | None = None) -> DataFrame:
    """Scores of a registered method, by default in its own bands and under its own strategy."""
    method = fusion.METHODS[name]
    bands = list(bands or method.bands)
    given, target = scenario_parts(obs, p or HidingParameters(method.strategy))
    aligned = joins.align(method.predict(given, target, bands), target, bands)
    return scores(joins.clear_masked_split(aligned, given), bands)


def run_by_sites(spark: SparkSession, sites: list, job: Callable[[list], DataFrame], out: str, ledger: str, group: int = 8, attempts: int = 2) -> DataFrame:
    """Run ``job`` over groups of sites, write what it returns (with ``site``) below ``out`` by site, and keep a ledger.

    A group that fails is halved until the site that fails is alone; that is tried ``attempts`` times, over all runs, and entered with its
    error. A site's rows replace those it had, so a run that was cut off is run again, and only for sites that the
    ledger doesn't call done. Returns the state of each wanted site: site, state, attempts, error.
    """
    schema = "site string, state string, at timestamp, error string"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    fs = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    entered = spark.read.schema(schema).parquet(ledger) if fs else spark.createDataFrame([], schema)
    state = entered.groupBy("site").agg(F.bool_or(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed")).collect()
    done, failed = {r["site"] for r in state if r["done"]}, {r["site"]: r["failed"] for r in state}

    def enter(group: list, state: str, error: str | None = None) -> None:
        rows = [(str(s), state, dt.datetime.now(dt.UTC), error) for s in group]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ledger)

    def run(group: list) -> None:
        try:
            job(group).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(out)
        except Exception as error:
            # any error of a site's data is entered, not raised: the other sites go on
            if len(group) > 1:
                run(group[: len(group) // 2])
                run(group[len(group) // 2 :])
                return
            site = str(group[0])
            failed[site] = failed.get(site, 0) + 1
            enter(group, "failed", str(error)[:1000])
            if failed[site] < attempts:
                run(group)
            return
        enter(group, "done")

    left = [s for s in sites if str(s) not in done and failed.get(str(s), 0) < attempts]
    for first in range(0, len(left), group):
        run(left[first : first + group])
    entered = spark.read.schema(schema).parquet(ledger) if left or fs else entered
    wanted = spark.createDataFrame([(str(s),) for s in sites], "site string").distinct()
    states = entered.groupBy("site").agg(F.when(F.bool_or(F.col("state") == "done"), "done").otherwise("failed").alias("state"), F.count("*").alias("attempts"), F.max_by("error", "at").alias("error"))
    return wanted.join(states, "site", "left").withColumn("state", F.coalesce("state", F.lit("left")))


def date_record(aligned: DataFrame, given: DataFrame | None, bands: list[str], bandwidth: float = 10.0) -> DataFrame:
    """One row for each site, sensor and date: clear rate, predicted rate, nearest input date, density, mean RMSE.

    Pixels are aggregated once; the nearest input date is found among the dates' records. Without ``given`` the input dates
    are those of ``aligned`` that are ``clear``.
    """
    keys = (*SERIES, "doy")

    def error(b: str) -> Column:
        p, r = F.col(f"p_{b}"), F.col(f"r_{b}")
        scored = ~F.col("masked") & p.isNotNull() & r.isNotNull() & ~F.isnan(p)
        return aggs.rmse(F.when(scored, p), F.when(scored, r))

    record = aligned.groupBy(*keys, "clear").agg(
        F.avg(F.when(F.col("masked"), 0.0).otherwise(1.0)).alias("clear_pixel_rate"),
        F.avg(F.when(F.col(f"p_{bands[0]}").isNotNull(), 1.0).otherwise(0.0)).alias("predicted_pixel_rate"),
        F.array_compact(F.array(*[error(b) for b in bands])).alias("errors"),
    )
    mean = F.aggregate("errors", F.lit(0.0), lambda total, e: total + e) / F.nullif(F.size("errors"), F.lit(0))
    record = record.select(*keys, "clear", "clear_pixel_rate", "predicted_pixel_rate", mean.alias("rmse"))
    carry = ("clear", "clear_pixel_rate", "predicted_pixel_rate", "rmse")
    if given is None:
        out = joins.nearest_date_within(record, F.col("clear"), SERIES, carry=carry)
    else:
        out = joins.nearest_date(given.select(*keys).distinct(), record, SERIES, carry=carry)
    return out.select(*keys, "clear", "clear_pixel_rate", "predicted_pixel_rate", "distance", aggs.density(F.col("distance"), bandwidth).alias("density"), "rmse")


def invariant_violations(record: DataFrame) -> DataFrame:
    """Dates that break what must hold: input dates are at distance 0 with density 1, rates lie in [0, 1]."""
    bad = (F.col("clear") & ((F.col("distance") != 0) | (F.col("density") != 1))) | ~F.col("clear_pixel_rate").between(0, 1) | ~F.col("predicted_pixel_rate").between(0, 1)
    return record.where(bad)


def skipped_sites(wanted: DataFrame, done: DataFrame) -> DataFrame:
    return wanted.select("site").distinct().join(done.select("site").distinct(), "site", "left_anti")


def composite_score(parts: DataFrame, masked_weight: float = 0.5) -> DataFrame:
    """Weighted sum of loss parts of each site: rows site, sensor, clear, weight, reconstruction, triplet, fit."""
    own = F.coalesce("reconstruction", F.lit(0.0)) + F.coalesce("triplet", F.lit(0.0))
    share = F.when(F.col("clear"), 1.0).otherwise(masked_weight)
    return parts.groupBy("site").agg(F.sum(F.col("weight") * share * own + F.coalesce("fit", F.lit(0.0))).alias("score"))
