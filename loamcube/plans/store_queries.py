"""Queries of sources and sinks, written to a fresh folder and read back, and of jobs that write; and of tiles on two grids."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube import fixtures as fx
from loamcube.functions import scalars
from loamcube.operators import aggs, columns
from loamcube.plans import dataset, evaluation, fusion, thermal
from loamcube.plans.job_queries import _COARSE, _coarse, _tile
from loamcube.plans.registry import query
from loamcube.plans.temporal_queries import _CLEAR_INPUT, _GAP_PRED, _HIDDEN, _METRICS, GAPS, B, gap_aligned, metrics
from loamcube.plans.tile_queries import KEY, N, _axis_sql
from loamcube.schemas import PIXEL, SERIES
from loamcube.sources import scratch, tables

ORIGIN = "2022-01-01"


def _fresh(spark: SparkSession, tag: str) -> str:
    return f"{scratch.folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _observed(spark, sf) -> DataFrame:
    """Tiles as dates of sites."""
    return _tile(spark, sf).select("site", F.lit("hr").alias("sensor"), F.col("vec_id").cast("int").alias("doy"), "r", "c", F.col("v").alias("b1"), "masked")


# areas, indices, observations


@query("q_store_areas", "q AS (SELECT 'area_' || n_nationkey AS name, n_nationkey * 1.5::DOUBLE AS xmin, n_regionkey + 0.25::DOUBLE AS ymin, n_nationkey * 1.5::DOUBLE + 9900 AS xmax, n_regionkey + 9900.25::DOUBLE AS ymax, 'EPSG:32631' AS crs, DATE '2022-01-01' AS start_date, DATE '2022-12-31' AS end_date FROM nation)")
def q_store_areas(spark, sf):
    """Areas written as one JSON document a file, read with their corners as columns."""
    n, path = fx.read(spark, sf, "nation"), _fresh(spark, "areas")
    corner = lambda c, by, add: F.col(c) * F.lit(by) + F.lit(add)
    box = F.array(corner("n_nationkey", 1.5, 0.0), corner("n_regionkey", 1.0, 0.25), corner("n_nationkey", 1.5, 9900.0), corner("n_regionkey", 1.0, 9900.25))
    area = n.select(F.concat(F.lit("area_"), "n_nationkey").alias("name"), box.alias("aoi"), F.lit("EPSG:32631").alias("crs"), F.lit(ORIGIN).alias("start_date"), F.lit("2022-12-31").alias("end_date"), F.col("n_nationkey").alias("file"))
    area.write.option("maxRecordsPerFile", 1).partitionBy("file").json(path)
    return tables.read_aoi(spark, f"{path}/*")


def _index(spark, sf) -> DataFrame:
    i = fx.product_index(spark, sf)
    day = F.date_add(F.to_date(F.lit(ORIGIN)), F.col("doy"))
    where = lambda what: F.when(F.col("valid"), F.concat(F.lit("/data/"), F.col("site"), F.lit("/"), scalars.export_path(F.col("sensor"), what, day)))
    return i.select("site", "sensor", F.concat_ws("_", "sensor", "doy").alias("product_id"), day.alias("acquisition_date"), "clear_pixel_rate", F.lit(0.0).alias("dark_pixel_rate"), F.lit(0.0).alias("snow_pixel_rate"), "valid", where("bands").alias("bands"), where("mask").alias("mask"), F.lit(None).cast("string").alias("snow_mask"))


@query("q_store_index", """q AS (SELECT CAST(site AS VARCHAR) AS site, sensor, sensor || '_' || doy AS product_id, DATE '2022-01-01' + doy AS acquisition_date, clear_pixel_rate, valid,
    CASE WHEN valid THEN strftime(DATE '2022-01-01' + doy, '%Y%m%d') || '/' || sensor || '_bands_' || strftime(DATE '2022-01-01' + doy, '%Y%m%d') END AS bands FROM product_index)""", "clear_pixel_rate", views="product_index")
def q_store_index(spark, sf):
    """Product indices of all sites as tab-separated text, read as one table with paths cut to their last two parts."""
    path = _fresh(spark, "index")
    tables.write_product_index(_index(spark, sf), path)
    return tables.read_product_index(spark, path).select("site", "sensor", "product_id", "acquisition_date", "clear_pixel_rate", "valid", "bands")


@query("q_path_tail", "q AS (SELECT url, CASE WHEN p[1:1] = '/' THEN regexp_extract(p, '([^/]+/[^/]+)$', 1) ELSE p END AS tail FROM (SELECT url, regexp_replace(url, '^[a-z]+:/', '') AS p FROM pages) t)", views="")
def q_path_tail(spark, sf):
    """Absolute paths cut to their last two parts."""
    p = fx.read(spark, sf, "pages").select("url", F.regexp_replace("url", "^[a-z]+:/", "").alias("p"))
    return p.select("url", scalars.path_tail(F.col("p")).alias("tail"))


@query("q_store_window", "q AS (SELECT site, vec_id::INT AS doy, r, c, v AS b1, masked FROM tile_px WHERE site IN (1, 3, 8) AND r BETWEEN 2 AND 4 AND c BETWEEN 1 AND 5)", "b1:8", views="tile_px")
def q_store_window(spark, sf):
    """A window of some sites from observations clustered by place."""
    path = _fresh(spark, "observations")
    tables.write_observations(_observed(spark, sf), path)
    return tables.read_observations(spark, path, ["b1"], [1, 3, 8], "hr", (2, 5), (1, 6)).select("site", "doy", "r", "c", "b1", "masked")


# sinks


_SHORT = lambda v: f"CAST(trunc(greatest(least({v}, 32767), -32768)) AS SMALLINT)"


@query("q_store_samples", f"q AS (SELECT site, DATE '2022-01-01' + vec_id::INT % 5 AS acq_date, r, c, {_SHORT('v * 10000')} AS b1 FROM tile_px WHERE r BETWEEN 1 AND 3 AND c BETWEEN 2 AND 6)", views="tile_px")
def q_store_samples(spark, sf):
    """Raw samples of one patch as shorts, by site, sensor and date."""
    path = _fresh(spark, "samples")
    tables.write_samples(_observed(spark, sf).withColumn("doy", F.col("doy") % 5), path, ["b1"], ORIGIN, (1, 4), (2, 7), 10000.0)
    return spark.read.parquet(path).select("site", "acq_date", "r", "c", "b1")


@query("q_store_predictions", f"""s AS (SELECT site % 2 AS site, px, sensor, doy // 500 AS doy, round(avg(b1), 6) AS p, round(avg(b2) / 1000, 6) AS r, bool_and(masked) AS masked FROM cube GROUP BY ALL),
    q AS (SELECT site, px, sensor, CASE WHEN doy % 2 = 0 THEN 'clr' ELSE 'mae' END AS mode, DATE '2022-01-01' + doy AS acq_date, {_SHORT('p * 100')} AS b1, {_SHORT('CASE WHEN masked THEN -10000 ELSE r * 100 END')} AS ref_b1 FROM s)""")
def q_store_predictions(spark, sf):
    """Predictions beside their references as shorts, given dates and hidden ones apart."""
    path = _fresh(spark, "predictions")
    c = fx.cube(spark, sf).groupBy((F.col("site") % 2).alias("site"), "px", "sensor", F.floor(F.col("doy") / 500).cast("int").alias("doy"))
    c = c.agg(F.round(F.avg("b1"), 6).alias("p"), F.round(F.avg("b2") / 1000, 6).alias("b1"), F.bool_and("masked").alias("masked"))
    pred = c.select("site", "px", "sensor", "doy", F.col("p").alias("b1"), (F.col("doy") % 2 == 0).alias("clear"))
    tables.write_predictions(pred, path, ["b1"], ORIGIN, 100.0, reference=c.drop("p"))
    return spark.read.parquet(path).select("site", "px", "sensor", "mode", "acq_date", "b1", "ref_b1")


@query("q_store_features", "q AS (SELECT site, sensor, px, doy, CAST(b1 AS FLOAT)::DOUBLE AS b1, CAST(b3 AS FLOAT)::DOUBLE AS b3 FROM cube)", "b1 b3")
def q_store_features(spark, sf):
    path = _fresh(spark, "features")
    tables.write_features(fx.cube(spark, sf), path, ["b1", "b3"])
    return spark.read.parquet(path).select("site", "sensor", "px", "doy", F.col("b1").cast("double").alias("b1"), F.col("b3").cast("double").alias("b3"))


_RMSE = _GAP_PRED + ", q AS (SELECT site, sensor, doy, clear, 'b1' AS band, sqrt(avg((p - r) * (p - r))) AS value FROM sc GROUP BY ALL)"


@query("q_store_metrics", _RMSE, "value:8")
def q_store_metrics(spark, sf):
    """A metric table by date as tab-separated text, read with its schema."""
    path = _fresh(spark, "metrics")
    a = gap_aligned(spark, sf).where("p_b1 is not null")
    tables.write_metrics(aggs.per_band(a, ["b1"], (*SERIES, "doy", "clear"), aggs.rmse, "value"), path)
    return tables.read_metrics(spark, path, "site long, sensor string, doy int, clear boolean, band string, value double")


@query("q_store_cached", "q AS (SELECT site, sensor, count(*) AS n, sum(b1) AS b1 FROM cube GROUP BY ALL)", "b1")
def q_store_cached(spark, sf):
    """A result that is computed once for its parameters and the files it is made of."""
    root, source = _fresh(spark, "cache"), f"{sf}/lineitem.parquet"
    compute = lambda: fx.cube(spark, sf).groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum("b1").alias("b1"))
    tables.cached(spark, root, {"by": "series"}, compute, [source])
    return tables.cached(spark, root, {"by": "series"}, lambda: spark.range(0), [source])


@query("q_resample_missing", "h AS (SELECT vec_id, r, c, CASE WHEN idx % 37 = 5 THEN NULL ELSE v * 40000 END AS v FROM tile_px), " + _axis_sql("x5", N, 0.5) + f""",
    u AS (SELECT vec_id, CAST(x.o AS INT) AS r, CAST(y.o AS INT) AS c, sum(h.v * x.w * y.w) AS v, bool_or(h.v IS NULL) AS gone FROM h JOIN x5 x ON x.i = h.r JOIN x5 y ON y.i = h.c GROUP BY ALL),
    q AS (SELECT u.vec_id, u.r, u.c, CASE WHEN gone THEN -10000 ELSE {_SHORT('u.v')} END::SMALLINT AS v, p.masked OR gone AS masked FROM u JOIN tile_px p ON p.vec_id = u.vec_id AND p.r = u.r // 2 AND p.c = u.c // 2)""", views="tile_px")
def q_resample_missing(spark, sf):
    """Tiles with missing pixels and values beyond shorts, read on a finer grid."""
    px = fx.tile_px(spark, sf).withColumn("v", F.when(F.col("idx") % 37 == 5, float("nan")).otherwise(F.col("v") * 40000))
    return dataset.resample_at_read(px.select("vec_id", "r", "c", "v", "masked"), N, 2.0, 1.0, KEY, "v").select("vec_id", "r", "c", "v", "masked")


# operators that had no query


@query("q_split_bands", "q AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS a, len(embedding[4:]) AS n_b FROM embeddings)", views="")
def q_split_bands(spark, sf):
    e = fx.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return columns.split_bands(e, "x", 3).select("vec_id", F.col("x_a").alias("a"), F.size("x_b").cast("long").alias("n_b"))


@query("q_invariants", _CLEAR_INPUT + f""", i AS (SELECT DISTINCT site, sensor, doy FROM cube WHERE NOT {_HIDDEN}), a AS (SELECT DISTINCT site, sensor, doy FROM cube),
    d AS (SELECT a.site, a.sensor, a.doy, min(abs(i.doy - a.doy)) AS distance FROM a JOIN i USING (site, sensor) GROUP BY ALL),
    n AS (SELECT site, sensor, doy, distance + doy % 2 AS distance FROM d),
    q AS (SELECT n.site, n.sensor, n.doy, n.distance::INT AS distance FROM n JOIN i USING (site, sensor, doy) WHERE n.distance <> 0)""")
def q_invariants(spark, sf):
    """Records of which every second was moved: input dates that are no longer at distance 0."""
    c = fx.cube(spark, sf).select(*PIXEL, "doy", "b1", "masked")
    record = evaluation.date_record(evaluation.gapfill_scenario(c, ["b1"], GAPS), None, ["b1"])
    moved = record.withColumn("distance", F.col("distance") + F.col("doy") % 2)
    return evaluation.invariant_violations(moved).select(*SERIES, "doy", F.col("distance").cast("int").alias("distance"))


_WEIGHTED = "sum(b4 * (b1 - m1) * (b3 - m3)) / (sum(b4) - 1)"


@query("q_covariance_weighted", "k AS (SELECT *, avg(b1) OVER w AS m1, avg(b3) OVER w AS m3 FROM cube WHERE NOT masked WINDOW w AS (PARTITION BY site, sensor)), q AS (" + " UNION ALL ".join(f"SELECT site, sensor, '{a}' AS band_a, '{b}' AS band_b, {_WEIGHTED.replace('b1 - m1', f'{a} - m{a[1]}').replace('b3 - m3', f'{b} - m{b[1]}')} AS cov FROM k GROUP BY ALL" for a, b in (("b1", "b1"), ("b1", "b3"), ("b3", "b3"))) + ")", "cov")
def q_covariance_weighted(spark, sf):
    return aggs.covariance(fx.cube(spark, sf).where("not masked"), ["b1", "b3"], SERIES, "b4")


@query("q_mask_never_observed", f"o AS (SELECT site, px, sensor, bool_and(masked) AS n FROM cube WHERE NOT {_HIDDEN} GROUP BY ALL), q AS (SELECT c.site, c.px, c.sensor, c.doy, CASE WHEN c.masked OR coalesce(n, true) THEN 0 ELSE b1 END AS b1, c.masked OR coalesce(n, true) AS masked FROM cube c LEFT JOIN o USING (site, px, sensor))", "b1")
def q_mask_never_observed(spark, sf):
    c = fx.cube(spark, sf).select(*PIXEL, "doy", "b1", "masked")
    given, _ = evaluation.scenario_parts(c, GAPS)
    return aggs.mask_never_observed(c, given, ["b1"]).select(*PIXEL, "doy", "b1", "masked")


# jobs


@query("q_evaluation_scores", _RMSE, "value:8")
def q_evaluation_scores(spark, sf):
    """RMSE of all sites by the job that runs them in groups, with a ledger."""
    c, path = fx.cube(spark, sf).select(*PIXEL, "doy", "b1", "masked"), _fresh(spark, "evaluation")

    def job(sites: list) -> DataFrame:
        aligned = evaluation.gapfill_scenario(c.where(F.col("site").isin(sites)), ["b1"], GAPS).where("p_b1 is not null")
        return aggs.per_band(aligned, ["b1"], (*SERIES, "doy", "clear"), aggs.rmse, "value")

    # one row a site, of which an evaluation has hundreds
    sites = [r["site"] for r in c.select("site").distinct().orderBy("site").collect()]
    evaluation.run_by_sites(spark, sites, job, f"{path}/scores", f"{path}/ledger", group=5)
    return spark.read.parquet(f"{path}/scores").select(F.col("site").cast("long").alias("site"), "sensor", "doy", "clear", "band", "value")


@query("q_method_naive", _GAP_PRED + """, q AS (SELECT site, sensor, doy, clear, 'b1' AS band, 'rmse' AS metric, sqrt(avg((p - r) * (p - r))) AS value FROM sc GROUP BY ALL)""", "value:8")
def q_method_naive(spark, sf):
    """A method by its name in the registry."""
    out = evaluation.evaluate_method("naive", fx.cube(spark, sf).select(*PIXEL, "doy", *B, "masked"), ["b1"], GAPS)
    return out.where("metric = 'rmse'").select(*SERIES, "doy", "clear", "band", "metric", "value")


@query("q_result_states", _METRICS + ", q AS (SELECT metric, band, clear, avg(value) AS mean, stddev_samp(value) AS std FROM m GROUP BY ALL)", "mean std")
def q_result_states(spark, sf):
    """The table of results from the combined states of batches of sites."""
    m = metrics(spark, sf)
    batches = [aggs.result_states(m.where(F.col("site") % 3 == n)) for n in range(3)]
    return aggs.table_of_states(aggs.combined_states(aggs.combined_states(batches[2].unionByName(batches[0])).unionByName(batches[1])))


# tiles on two grids


@query("q_tiled_pair", _COARSE + """, fm AS (SELECT p.vec_id, p.r, p.c, avg(n.v) AS fine FROM tile_px p JOIN tile_px n ON n.vec_id = p.vec_id AND abs(n.r - p.r) <= 2 AND abs(n.c - p.c) <= 2 AND NOT n.masked GROUP BY ALL),
    cm AS (SELECT p.vec_id, p.r, p.c, avg(n.v) AS coarse FROM d p JOIN d n ON n.vec_id = p.vec_id AND abs(n.r - p.r) <= 1 AND abs(n.c - p.c) <= 1 GROUP BY ALL),
    q AS (SELECT p.vec_id, 0 AS doy, p.r, p.c, fine - coarse AS v, fine IS NULL OR p.masked AS masked FROM tile_px p LEFT JOIN fm USING (vec_id, r, c) JOIN cm ON cm.vec_id = p.vec_id AND cm.r = p.r // 2 AND cm.c = p.c // 2)""", "v:8", views="tile_px")
def q_tiled_pair(spark, sf):
    """Mean of the clear pixels around less that of the coarse ones, tile by tile with halos on both grids."""
    px = _tile(spark, sf).withColumn("doy", F.lit(0))
    hr = px.select("vec_id", "doy", "r", "c", "v", "masked")
    lr = _coarse(px, KEY).select("vec_id", F.lit(0).alias("doy"), "r", "c", "v", "masked")

    def around(v: np.ndarray, half: int) -> np.ndarray:
        wide = np.pad(v, half, constant_values=np.nan)
        views = np.stack([wide[i : i + v.shape[0], j : j + v.shape[1]] for i in range(2 * half + 1) for j in range(2 * half + 1)])
        known = ~np.isnan(views)
        return np.where(known, views, 0).sum(0) / np.where(known.any(0), known.sum(0), np.nan)

    def model(a: fusion.Cube, b: fusion.Cube) -> fusion.Cube:
        fine = around(np.where(a.masked[0], np.nan, a.values[0, 0]), 2)
        coarse = np.kron(around(b.values[0, 0], 1), np.ones((2, 2)))
        return fusion.Cube(a.doy, (fine - coarse)[None, None], np.isnan(fine)[None] | a.masked)

    out = fusion.tiled_pair(hr, lr, model, N, 2, 4, 2, KEY, ["v"], ["v"], ["v"])
    return out.select("vec_id", "doy", "r", "c", F.nanvl("v", F.lit(None).cast("double")).alias("v"), "masked")


# thermal sharpening by trees of one split, for which SQL can stand


@query("q_thermal_stump", _COARSE + """, x AS (SELECT p.vec_id, p.r // 2 AS r, p.c // 2 AS c, avg(p.v * p.v) AS f FROM tile_px p WHERE NOT masked GROUP BY ALL),
    t AS (SELECT x.*, d.v * 40 + 290 AS y FROM x JOIN d USING (vec_id, r, c) WHERE NOT d.masked),
    n AS (SELECT *, y - avg(y) OVER w AS e, min(f) OVER w AS lo, (max(f) OVER w - min(f) OVER w) / 4 AS step FROM t WINDOW w AS (PARTITION BY vec_id)),
    b AS (SELECT *, least(floor((f - lo) / nullif(step, 0)), 3)::INT AS bin FROM n),
    h AS (SELECT vec_id, bin, lo, step, count(*) AS n, sum(e) AS s FROM b WHERE bin IS NOT NULL GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER l AS nl, sum(s) OVER l AS sl, sum(n) OVER a AS na, sum(s) OVER a AS sa FROM h WINDOW a AS (PARTITION BY vec_id), l AS (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, round(sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na, 9) AS gain FROM u WHERE nl >= 4 AND na - nl >= 4),
    s AS (SELECT vec_id, lo + bin * step AS t FROM g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY gain DESC, bin) = 1),
    k AS (SELECT t.*, CASE WHEN s.t IS NULL THEN 0 WHEN f < s.t THEN 1 ELSE 2 END AS leaf FROM t LEFT JOIN s USING (vec_id)),
    m AS (SELECT vec_id, leaf, count(*) AS n, avg(f) AS mf, avg(y) AS my, min(y) AS ylo, max(y) AS yhi, sum(f * f) AS ff, sum(y * y) AS yy, sum(f * y) AS fy FROM k GROUP BY ALL),
    z AS (SELECT *, sqrt(greatest(ff / nullif(n - 1, 0) - mf * mf, 0)) AS df, sqrt(greatest(yy / nullif(n - 1, 0) - my * my, 0)) AS dy FROM m),
    w AS (SELECT *, CASE WHEN n > 1 AND df > 0 AND dy > 0 THEN ((fy - n * mf * my) / (df * dy)) / ((ff - n * mf * mf) / (df * df) + 1e-3) * dy / df END AS slope FROM z),
    o AS (SELECT p.vec_id, p.r, p.c, p.masked, CASE WHEN w.n IS NULL THEN NULL WHEN slope IS NULL THEN my ELSE greatest(least(my - mf * slope + slope * p.v * p.v, yhi + (yhi - ylo) / 4), ylo - (yhi - ylo) / 4) END AS y
        FROM tile_px p LEFT JOIN s ON s.vec_id = p.vec_id LEFT JOIN w ON w.vec_id = p.vec_id AND w.leaf = CASE WHEN s.t IS NULL THEN 0 WHEN p.v * p.v < s.t THEN 1 ELSE 2 END),
    e AS (SELECT o.*, d.masked AS dark, d.v * 40 + 290 - avg(o.y) FILTER (NOT o.masked) OVER (PARTITION BY o.vec_id, o.r // 2, o.c // 2) AS rest FROM o JOIN d ON d.vec_id = o.vec_id AND d.r = o.r // 2 AND d.c = o.c // 2),
    q AS (SELECT vec_id, r, c, greatest(y + coalesce(rest, 0), 0) AS lst, masked OR dark OR y IS NULL AS masked FROM e)""", "lst", views="tile_px")
def q_thermal_stump(spark, sf):
    px = _tile(spark, sf).withColumn("f", F.col("v") * F.col("v")).select("vec_id", "r", "c", "masked", "f")
    low = _coarse(_tile(spark, sf), KEY).select("vec_id", "r", "c", (F.col("v") * 40 + 290).alias("lst"), "masked")
    p = thermal.TreeParameters(depth=1, bins=4, least=4, window=0, homogeneous=1.0, power=1.0)
    return thermal.sharpen(px, low, 2, ["f"], KEY, p)
