"""Masked aggregates and scores."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.functions.scalars import smooth_l1
from loamcube.operators.joins import nearest_clear
from loamcube.schemas import PIXEL, SERIES

#: Least magnitude of a reference in the relative error.
MAPE_FLOOR = 1.17e-6


def clear_rate(df: DataFrame, keys: tuple[str, ...] = (*SERIES, "doy")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_px"), F.avg(F.when(F.col("masked"), 0.0).otherwise(1.0)).alias("clear_pixel_rate"))


def per_band(aligned: DataFrame, bands: list[str], keys: tuple[str, ...], score: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``keys``, ``band``, ``name``: one score for each band, over clear rows; NaN predictions don't count."""
    return per_band_all(aligned, bands, keys, {name: score})


def per_band_all(aligned: DataFrame, bands: list[str], keys: tuple[str, ...], scores: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``per_band`` of several scores, a column for each."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"p_{b}").alias("p"), F.col(f"r_{b}").alias("r")) for b in bands])
    long = aligned.where("not masked").select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.*")
    known = long.where("p is not null and r is not null and not isnan(p)")
    return known.groupBy(*keys, "band").agg(*[score(F.col("p"), F.col("r")).alias(name) for name, score in scores.items()])


def rmse(p: Column, r: Column) -> Column:
    return F.sqrt(F.avg((p - r) * (p - r)))


def nrmse(p: Column, r: Column) -> Column:
    return F.sqrt(F.sum((p - r) * (p - r)) / F.nullif(F.sum(r * r), F.lit(0.0)))


def mae(p: Column, r: Column) -> Column:
    return F.avg(F.abs(p - r))


def mape(p: Column, r: Column) -> Column:
    return F.avg(F.abs(p - r) / F.greatest(F.abs(r), F.lit(MAPE_FLOOR)))


def smooth_l1_score(p: Column, r: Column, beta: float = 0.1) -> Column:
    return F.avg(smooth_l1(p - r, beta))


def spectral_angle(aligned: DataFrame, bands: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Mean angle between predicted and reference spectra of clear rows; undefined angles don't count."""
    dot = lambda a, b: sum((F.col(f"{a}_{x}") * F.col(f"{b}_{x}") for x in bands[1:]), F.col(f"{a}_{bands[0]}") * F.col(f"{b}_{bands[0]}"))
    angle = F.acos(F.least(F.lit(1.0), dot("p", "r") / F.nullif(F.sqrt(dot("p", "p")) * F.sqrt(dot("r", "r")), F.lit(0.0))))
    return aligned.where("not masked").groupBy(*keys).agg(F.avg(F.nanvl(angle, F.lit(None).cast("double"))).alias("sam"))


def pooled_stats(df: DataFrame, bands: list[str], batch: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, and standard deviation pooled within batches, of clear values of each band."""
    values = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands])
    long = df.where("not masked").select(*by, *batch, F.explode(values).alias("_x")).select(*by, *batch, "_x.*")
    first = long.groupBy(*by, "band", *batch).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.var_samp("v").alias("var"))
    within = F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))
    return first.groupBy(*by, "band").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sqrt(within / F.nullif(F.sum("n") - F.count("*"), F.lit(0))).alias("std"))


def masked_mean_std(df: DataFrame, band: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean, and the square root of the sum of squares over n - 1 less the squared mean."""
    v, n = F.col(band), F.count(band)
    mean = F.sum(v) / n
    return df.where("not masked").groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(v * v) / F.nullif(n - 1, F.lit(0)) - mean * mean, F.lit(0.0))).alias("std"))


def covariance(df: DataFrame, bands: list[str], keys: tuple[str, ...], weight: str | None = None) -> DataFrame:
    """Covariance of each pair of bands: unweighted means, weighted products over the weights' sum less one."""
    if weight is None:
        aggs = [F.covar_samp(a, b).alias(f"{a}:{b}") for a, b in combinations_with_replacement(bands, 2)]
        wide = df.groupBy(*keys).agg(*aggs)
    else:
        means = df.groupBy(*keys).agg(*[F.avg(b).alias(f"_m_{b}") for b in bands])
        d = df.join(means, list(keys))
        dev = lambda b: F.col(b) - F.col(f"_m_{b}")
        wide = d.groupBy(*keys).agg(*[(F.sum(F.col(weight) * dev(a) * dev(b)) / F.nullif(F.sum(weight) - 1, F.lit(0.0))).alias(f"{a}:{b}") for a, b in combinations_with_replacement(bands, 2)])
    return _pairs(wide, bands, keys, "cov")


def cross_product(df: DataFrame, bands: list[str], keys: tuple[str, ...], weight: Column) -> DataFrame:
    """Weighted products of each pair of bands, the weight applied to both sides."""
    wide = df.groupBy(*keys).agg(*[F.sum(weight * weight * F.col(a) * F.col(b)).alias(f"{a}:{b}") for a, b in combinations_with_replacement(bands, 2)])
    return _pairs(wide, bands, keys, "product")


def _pairs(wide: DataFrame, bands: list[str], keys: tuple[str, ...], name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(a).alias("band_a"), F.lit(b).alias("band_b"), F.col(f"`{a}:{b}`").alias(name)) for a, b in combinations_with_replacement(bands, 2)])
    return wide.select(*keys, F.explode(cells).alias("_x")).select(*keys, "_x.*")


def decorrelation(df: DataFrame, bands: list[str], least: int = 1000) -> DataFrame:
    """Mean distance of the bands' covariance matrix to identity; null under ``least`` clear rows."""
    cells = [(F.covar_samp(a, b), 1.0 if a == b else 0.0) for a in bands for b in bands]
    mean = sum((F.abs(c - one) for c, one in cells[1:]), F.abs(cells[0][0] - cells[0][1])) / len(cells)
    return df.where("not masked").agg(F.when(F.count("*") >= least, mean).alias("decorrelation"))


def ridge_closed(aligned: DataFrame, band: str, keys: tuple[str, ...], weight: float = 1e-3) -> DataFrame:
    """Regression of the prediction on the reference, one predictor, in standardised form: slope, intercept, n."""
    p, r = F.col(f"p_{band}"), F.col(f"r_{band}")
    m = aligned.where("not masked").groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(r).alias("sr"), F.sum(p * p).alias("spp"), F.sum(r * r).alias("srr"), F.sum(p * r).alias("spr")
    )
    n = F.col("n")
    std = lambda s, ss: F.sqrt(F.greatest(F.col(ss) / F.nullif(n - 1, F.lit(0)) - (F.col(s) / n) * (F.col(s) / n), F.lit(0.0)))
    m = m.withColumns({"mp": F.col("sp") / n, "mr": F.col("sr") / n, "dp": std("sp", "spp"), "dr": std("sr", "srr")})
    xx = (F.col("srr") - n * F.col("mr") * F.col("mr")) / F.nullif(F.col("dr") * F.col("dr"), F.lit(0.0))
    xy = (F.col("spr") - n * F.col("mr") * F.col("mp")) / F.nullif(F.col("dr") * F.col("dp"), F.lit(0.0))
    slope = xy / (xx + weight) * F.col("dp") / F.col("dr")
    return m.withColumn("slope", slope).select(*keys, "n", "slope", (F.col("mp") - F.col("slope") * F.col("mr")).alias("intercept"))


def ridge_multi(aligned: DataFrame, sources: list[str], targets: list[str], keys: tuple[str, ...], weight: float = 1e-3, least_factor: int = 10) -> DataFrame:
    """Ridge regression of several targets on several sources for each group, in standardised form.

    One grouped pass sums the products; the small systems are solved where the sums are. Groups of at most
    ``least_factor * p * q`` rows, and those whose matrix lacks full rank, are left out. Returns ``target``,
    ``source``, ``coefficient`` in original units and the ``intercept``.
    """
    import numpy as np
    import pandas as pd

    cols = [*sources, *targets]
    aggs = [F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a in cols for b in cols]]
    sums = aligned.where("not masked").groupBy(*keys).agg(*aggs).where(F.col("n") > least_factor * len(sources) * len(targets))

    p = len(sources)

    def solve(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy()[:, None]
            mean = pdf[[f"s_{c}" for c in cols]].to_numpy(float) / n
            prod = pdf[[f"s_{a}_{b}" for a in cols for b in cols]].to_numpy(float).reshape(-1, len(cols), len(cols))
            std = np.sqrt(np.maximum(np.diagonal(prod, axis1=1, axis2=2) / (n - 1) - mean**2, 0))
            usable = ~(std == 0).any(axis=1)
            pdf, n, mean, prod, std = pdf[usable], n[usable], mean[usable], prod[usable], std[usable]
            centred = (prod - n[:, :, None] * mean[:, :, None] * mean[:, None, :]) / (std[:, :, None] * std[:, None, :])
            xx = centred[:, :p, :p] + weight * np.eye(p)
            # a matrix that isn't made of numbers has no rank
            known = np.isfinite(xx).all(axis=(1, 2))
            full = known.copy()
            full[known] = np.linalg.matrix_rank(xx[known], hermitian=True) == p
            pdf, mean, std = pdf[full], mean[full], std[full]
            beta = np.linalg.solve(xx[full], centred[full][:, :p, p:]) * std[:, None, p:] / std[:, :p, None]
            offset = mean[:, p:] - (mean[:, :p, None] * beta).sum(axis=1)
            out = [pdf[list(keys)].assign(target=target, source=source, coefficient=beta[:, s, t], intercept=offset[:, t]) for t, target in enumerate(targets) for s, source in enumerate(sources)]
            yield pd.concat(out)

    types = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(solve, f"{types}, target string, source string, coefficient double, intercept double")


def regression_fit(aligned: DataFrame, band: str, keys: tuple[str, ...], most_masked: float = 0.5, security: float | None = None, loss: Callable[[Column], Column] = smooth_l1) -> DataFrame:
    """Loss between the prediction and its regression from the reference, over groups that are clear enough."""
    return fit_loss(adapted_reference(aligned, band, keys, most_masked).where("not masked"), band, keys, security, loss)


def adapted_reference(aligned: DataFrame, band: str, keys: tuple[str, ...], most_masked: float = 0.5) -> DataFrame:
    """Groups that are clear enough, with ``a_<band>``: the reference put through the regression of the prediction on it."""
    rate = aligned.groupBy(*keys).agg(F.avg(F.col("masked").cast("int")).alias("_rate")).where(F.col("_rate") <= most_masked).drop("_rate")
    # groups are joined to groups, so that rows meet theirs once
    fit = ridge_closed(aligned, band, keys).drop("n").join(rate, list(keys), "left_semi")
    return aligned.join(fit, list(keys)).withColumn(f"a_{band}", F.col("slope") * F.col(f"r_{band}") + F.col("intercept")).drop("slope", "intercept")


def fit_loss(adapted: DataFrame, band: str, keys: tuple[str, ...], security: float | None = None, loss: Callable[[Column], Column] = smooth_l1) -> DataFrame:
    """Mean loss against the adapted reference where that is a number; null above ``security``."""
    out = adapted.where(~F.isnan(f"a_{band}")).groupBy(*keys).agg(F.avg(loss(F.col(f"p_{band}") - F.col(f"a_{band}"))).alias("fit_loss"))
    return out if security is None else out.withColumn("fit_loss", F.when(F.col("fit_loss") <= security, F.col("fit_loss")))


def triplet_score(pred: DataFrame, target: DataFrame, band: str, threshold: int = 20, margin: float = 0.1, swap: bool = True, keys: tuple[str, ...] = PIXEL, eps: float = 1e-6) -> DataFrame:
    """Cloud leak: is the prediction of a masked pixel nearer to the nearest clear value than to the masked one?"""
    asked = target.where("masked").select(*keys, "doy", F.col(band).alias("hidden"))
    near = nearest_clear(target, asked, [band], threshold, keys)
    rows = pred.select(*keys, "doy", F.col(band).alias("pred")).join(asked, [*keys, "doy"]).join(near, [*keys, "doy"])
    d = lambda a, b: F.abs(F.col(a) - F.col(b) + eps)
    negative = F.least(d("pred", "hidden"), d(f"near_{band}", "hidden")) if swap else d("pred", "hidden")
    return rows.groupBy(*SERIES).agg(F.avg(F.greatest(F.lit(0.0), d("pred", f"near_{band}") - negative + margin)).alias("triplet"))


def density(distance: Column, bandwidth: float = 10.0) -> Column:
    """Local density of dates from the distance to the nearest; 0 where there is none."""
    q = distance / bandwidth
    return F.coalesce(F.exp(-(q * q)), F.lit(0.0))


def quantiles(df: DataFrame, band: str, keys: tuple[str, ...], exact: bool = True, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """5 % and 95 % quantiles of clear values that aren't NaN, between neighbours in order.

    Exact ones are selected: each of ``rounds`` histograms of a group's values shows in which of its ``bins`` the wanted places lie, and
    only values of these bins go on; what is left is counted by value. A group never holds more than bins or values of
    few bins. The others come from Spark's sketch.
    """
    probs = (0.05, 0.95)
    v = df.where(~F.col("masked") & F.col(band).isNotNull() & ~F.isnan(band)).select(*keys, F.col(band).cast("double").alias("_v"))
    if not exact:
        sketch = F.percentile_approx("_v", F.array(*map(F.lit, probs)))
        return v.groupBy(*keys).agg(sketch.alias("_q")).select(*keys, F.col("_q")[0].alias("q05"), F.col("_q")[1].alias("q95"))
    own = [F.col(k) for k in keys]
    place = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    sizes = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place])))
    wanted = sizes.select(*own, F.explode(ranks).alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_below"))
    line = W.partitionBy(*keys, "_rank")

    def inside(wanted: DataFrame) -> DataFrame:
        return v.join(wanted, list(keys)).where(F.col("_v").between(F.col("_low"), F.col("_high")))

    def with_place(counted: DataFrame, by: str) -> DataFrame:
        before = F.coalesce(F.sum("_m").over(line.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        at = counted.withColumn("_at", F.col("_below") + before)
        return at.where((F.col("_at") <= F.col("_rank")) & (F.col("_rank") < F.col("_at") + F.col("_m")))

    for _ in range(rounds):
        step = F.nullif((F.col("_high") - F.col("_low")) / bins, F.lit(0.0))
        cell = F.coalesce(F.least(F.floor((F.col("_v") - F.col("_low")) / step), F.lit(bins - 1)), F.lit(0))
        hist = inside(wanted).groupBy(*keys, "_rank", "_below", cell.alias("_bin")).agg(F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        wanted = with_place(hist, "_bin").select(*own, "_rank", "_low", "_high", F.col("_at").alias("_below"))
    counted = inside(wanted).groupBy(*keys, "_rank", "_below", "_v").agg(F.count("*").alias("_m"))
    found = with_place(counted, "_v").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_x"))
    found = found.join(sizes.select(*own, "_n"), list(keys))

    def between(x: Column) -> Column:
        low, high = F.col("_x")[F.floor(x)], F.col("_x")[F.ceil(x)]
        return F.when(F.floor(x) == F.ceil(x), low).otherwise(low * (F.ceil(x) - x) + high * (x - F.floor(x)))

    return found.select(*own, between(place[0]).alias("q05"), between(place[1]).alias("q95"))


def band_group_means(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Row-wise mean over groups of columns."""
    return df.withColumns({name: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols) for name, cols in groups.items()})


def result_table(metrics: DataFrame, by: tuple[str, ...] = ("metric", "band", "clear"), value: str = "value") -> DataFrame:
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def result_states(metrics: DataFrame, by: tuple[str, ...] = ("metric", "band", "clear"), value: str = "value") -> DataFrame:
    """Number, mean and squared deviations of each kind of result: what ``result_table`` needs, in a form that can be combined."""
    known = metrics.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("m2"))


def combined_states(states: DataFrame, by: tuple[str, ...] = ("metric", "band", "clear")) -> DataFrame:
    """States of the same kind made one; the order of batches doesn't matter but for rounding.

    Deviations are taken from the combined mean, so means that lie far from 0 cost no digits.
    """
    w = W.partitionBy(*by)
    centre = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    moved = states.withColumn("_c", centre)
    shift = F.col("mean") - F.col("_c")
    return moved.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_c").alias("mean"), F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"))


def table_of_states(states: DataFrame, by: tuple[str, ...] = ("metric", "band", "clear")) -> DataFrame:
    """The ``result_table`` of combined states."""
    return states.select(*by, "mean", F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0))).alias("std"))


def rollup_scores(metrics: DataFrame, value: str = "value") -> DataFrame:
    """Mean over dates of each band, then over the bands of a resolution and over all bands of a sensor."""
    per = metrics.groupBy("sensor", "res", "band").agg(F.avg(value).alias("v"))
    return per.groupingSets([["sensor", "res"], ["sensor"]], "sensor", "res").agg(F.avg("v").alias("mean"))


def role_weights(dates: DataFrame) -> DataFrame:
    """Share of each sensor in the dates of its site."""
    per = dates.groupBy(*SERIES).agg(F.count("*").alias("n_dates"))
    return per.withColumn("weight", F.col("n_dates") / F.sum("n_dates").over(W.partitionBy("site")))


def ensemble_mean(members: list[DataFrame], bands: list[str], keys: tuple[str, ...]) -> DataFrame:
    stacked = members[0].select(*keys, *bands)
    for m in members[1:]:
        stacked = stacked.unionByName(m.select(*keys, *bands))
    return stacked.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands], F.count("*").alias("n_members"))


def never_observed(df: DataFrame, keys: tuple[str, ...] = PIXEL) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and("masked").alias("never_observed"))


def mask_never_observed(grid: DataFrame, observed: DataFrame, bands: list[str], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Query rows of pixels without one clear input date are masked and 0."""
    out = grid.join(never_observed(observed, keys), list(keys), "left").withColumn("masked", F.col("masked") | F.coalesce("never_observed", F.lit(True))).drop("never_observed")
    return out.withColumns({b: F.when(F.col("masked"), F.lit(0.0)).otherwise(F.col(b)) for b in bands})


def macro_profile(profiles: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Mean over the dates of a site, then over sites."""
    return profiles.groupBy("site", *keys).agg(F.avg(value).alias("v")).groupBy(*keys).agg(F.avg("v").alias(value))
