"""Queries of single operators: columns, filters, stacking, layout, site checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamcube import fixtures as fx
from loamcube.functions import scalars
from loamcube.operators import columns, filters, sets, tiles, timeops
from loamcube.plans import fusion, quality
from loamcube.plans.registry import query
from loamcube.schemas import PIXEL, SERIES

ORIGIN = "2022-01-01"
_KEY = (*PIXEL, "doy")
_KEYS = "site, px, sensor, doy"


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("acquisition_date", F.date_add(F.to_date(F.lit(ORIGIN)), F.col("doy")))


_DATED = f"p AS (SELECT *, CAST(DATE '{ORIGIN}' + doy AS DATE) AS acquisition_date FROM product_index)"


@query("q_day_offset", _DATED + """, f AS (SELECT site, min(acquisition_date) FILTER (sensor = 'hr') AS first FROM p GROUP BY site),
    q AS (SELECT site, sensor, CAST(acquisition_date AS VARCHAR) AS acquisition_date, CAST(date_diff('day', first, acquisition_date) AS INT) AS doy FROM p JOIN f USING (site))""", views="product_index")
def q_day_offset(spark, sf):
    out = columns.day_offset(_dated(fx.product_index(spark, sf)))
    return out.select(*SERIES, F.col("acquisition_date").cast("string"), "doy")


@query("q_offset_date", f"q AS (SELECT site, sensor, doy, strftime(DATE '{ORIGIN}' + doy, '%Y-%m-%d') AS day FROM product_index)", views="product_index")
def q_offset_date(spark, sf):
    return fx.product_index(spark, sf).select(*SERIES, "doy", scalars.offset_date(ORIGIN, F.col("doy")).alias("day"))


@query("q_select_bands", f"q AS (SELECT {_KEYS}, masked, b3, b1 FROM cube)", "b3 b1")
def q_select_bands(spark, sf):
    return columns.select_bands(fx.cube(spark, sf), ["b3", "b1"])


@query("q_bands_of_resolution", """r AS (SELECT p_size AS res_m, p_brand AS band FROM part GROUP BY ALL),
    q AS (SELECT band, count(*) FILTER (res_m <= 10) AS n_finer, count(*) FILTER (res_m = 10) AS n_exact FROM r WHERE res_m <= 10 GROUP BY band)""")
def q_bands_of_resolution(spark, sf):
    """Sizes of parts stand in for resolutions, brands for bands."""
    dim = fx.read(spark, sf, "part").select(F.col("p_size").alias("res_m"), F.col("p_brand").alias("band")).distinct()
    exact = columns.bands_of_resolution(dim, 10, exact=True).withColumn("hit", F.lit(1))
    out = columns.bands_of_resolution(dim, 10).join(exact, ["res_m", "band"], "left")
    return out.groupBy("band").agg(F.count("*").alias("n_finer"), F.count("hit").alias("n_exact"))


@query("q_target_scale", f"""l AS (SELECT {_KEYS}, band, v FROM (SELECT {_KEYS}, b1, b2 FROM cube) UNPIVOT (v FOR band IN (b1, b2))),
    q AS (SELECT {_KEYS}, band, CASE WHEN band = 'b2' THEN v / 10 ELSE v / 10000 END AS v FROM l)""", "v:9")
def q_target_scale(spark, sf):
    """The second band stands in for the thermal one."""
    long = fx.cube(spark, sf).select(*_KEY, "b1", "b2").unpivot([*_KEY], ["b1", "b2"], "band", "v")
    thermal = F.when(F.col("band") == "b2", "lst").otherwise(F.col("band"))
    return long.withColumn("v", scalars.target_scale(thermal, F.col("v")))


@query("q_kelvin_to_celsius", f"q AS (SELECT {_KEYS}, b1 + 273 - 273.15::DOUBLE AS celsius FROM cube)", "celsius")
def q_kelvin_to_celsius(spark, sf):
    return fx.cube(spark, sf).select(*_KEY, scalars.kelvin_to_celsius(F.col("b1") + 273).alias("celsius"))


@query("q_pan_mask", f"q AS (SELECT {_KEYS}, b4 = 0 OR b4 IS NULL AS hidden FROM cube)")
def q_pan_mask(spark, sf):
    return fx.cube(spark, sf).select(*_KEY, scalars.missing(F.col("b4")).alias("hidden"))


@query("q_read_mask", f"q AS (SELECT {_KEYS}, (masked::INT > 0) OR b3 = 0 OR b4 = 0 AS masked FROM cube)")
def q_read_mask(spark, sf):
    stored = fx.cube(spark, sf).withColumn("stored", F.col("masked").cast("int"))
    return columns.read_mask(stored, "stored", ["b3", "b4"]).select(*_KEY, "masked")


@query("q_joint_mask", f"""g AS (SELECT {_KEYS}, 'a' AS grp, masked FROM cube UNION ALL SELECT {_KEYS}, 'b', b1 > 40 FROM cube),
    q AS (SELECT {_KEYS}, grp, bool_or(masked) OVER (PARTITION BY {_KEYS}) AS masked FROM g)""")
def q_joint_mask(spark, sf):
    c = fx.cube(spark, sf)
    groups = c.select(*_KEY, F.lit("a").alias("grp"), "masked").union(c.select(*_KEY, F.lit("b").alias("grp"), F.col("b1") > 40))
    return columns.joint_mask(groups)


@query("q_force_mask", f"d AS (SELECT site, sensor, doy FROM product_index WHERE n_px % 3 = 0), q AS (SELECT {_KEYS}, masked OR (site, sensor, doy) IN (SELECT (site, sensor, doy) FROM d) AS masked FROM cube)", views="product_index")
def q_force_mask(spark, sf):
    dates = fx.product_index(spark, sf).where("n_px % 3 = 0")
    return columns.force_mask(fx.cube(spark, sf), dates).select(*_KEY, "masked")


@query("q_append_tag", "q AS (SELECT vec_id, len(embedding) + 2 AS n, embedding[64]::DOUBLE AS last_value, 1.5::DOUBLE AS tag_a, -2::DOUBLE AS tag_b FROM embeddings)", "last_value")
def q_append_tag(spark, sf):
    e = fx.read(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return columns.append_tag(e, "v", [1.5, -2.0]).select("vec_id", F.size("v").cast("long").alias("n"), F.col("v")[63].alias("last_value"), F.col("v")[64].alias("tag_a"), F.col("v")[65].alias("tag_b"))


@query("q_sanitise_nan", f"q AS (SELECT {_KEYS}, CASE WHEN b1 > 45 THEN 0 ELSE b1 END AS b1, b2, masked OR b1 > 45 AS masked FROM cube)", "b1 b2")
def q_sanitise_nan(spark, sf):
    """Great values stand in for missing numbers."""
    c = fx.cube(spark, sf).withColumn("b1", F.when(F.col("b1") > 45, F.lit(float("nan"))).otherwise(F.col("b1")))
    return columns.sanitise_nan(c, ["b1", "b2"]).select(*_KEY, "b1", "b2", "masked")


@query("q_display_stretch", f"""s AS (SELECT {_KEYS}, masked, least(greatest(b2 / 100 / 1500, 0), 1) AS v FROM cube),
    q AS (SELECT {_KEYS}, CASE WHEN NOT masked OR v <> 0 THEN v ELSE 1 END AS red, CASE WHEN NOT masked THEN v ELSE 0 END AS green FROM s)""", "red:9 green:9")
def q_display_stretch(spark, sf):
    shown = lambda channel: scalars.display_stretch(F.col("b2") / 100, F.col("masked"), channel).alias(channel)
    return fx.cube(spark, sf).select(*_KEY, shown("red"), shown("green"))


@query("q_invert_mask", f"q AS (SELECT {_KEYS}, NOT masked AS masked FROM cube)")
def q_invert_mask(spark, sf):
    return columns.invert_mask(fx.cube(spark, sf)).select(*_KEY, "masked")


@query("q_mask_to_null", f"q AS (SELECT {_KEYS}, CASE WHEN NOT masked THEN b1 END AS b1, CASE WHEN NOT masked THEN b2 END AS b2 FROM cube)", "b1 b2")
def q_mask_to_null(spark, sf):
    return columns.mask_to_null(fx.cube(spark, sf), ["b1", "b2"]).select(*_KEY, "b1", "b2")


@query("q_label_results", "q AS (SELECT site, sensor, doy, CASE WHEN valid THEN 'clear' ELSE 'masked' END AS status, sensor || '_' || doy AS id, CASE WHEN n_px < 100 THEN n_px END AS score FROM product_index)", views="product_index")
def q_label_results(spark, sf):
    rows = fx.product_index(spark, sf).withColumns({"clear": F.col("valid"), "name": F.col("sensor"), "score": F.col("n_px")})
    return columns.label_results(rows, ["score"]).select(*SERIES, "doy", "status", "id", "score")


@query("q_keep_dates", f"q AS (SELECT {_KEYS} FROM cube WHERE (site, sensor, doy) IN (SELECT (site, sensor, doy) FROM product_index WHERE valid))", views="product_index")
def q_keep_dates(spark, sf):
    return filters.keep_dates(fx.cube(spark, sf), fx.product_index(spark, sf).where("valid").select(*SERIES, "doy")).select(*_KEY)


@query("q_trim", """d AS (SELECT site, sensor, doy FROM cube GROUP BY ALL HAVING NOT bool_and(masked)),
    s AS (SELECT site, sensor, count(DISTINCT doy) AS n_left FROM d GROUP BY ALL), q AS (SELECT c.site, c.sensor, coalesce(n_left, 0) AS n_left FROM (SELECT DISTINCT site, sensor FROM cube) c LEFT JOIN s USING (site, sensor))""")
def q_trim(spark, sf):
    """Dates that trimming leaves to each series; a series with none left is an error for the caller to see."""
    c = fx.cube(spark, sf)
    left = filters.drop_masked_dates(c).groupBy(*SERIES).agg(F.countDistinct("doy").alias("n_left"))
    return c.select(*SERIES).distinct().join(left, list(SERIES), "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))


@query("q_clip_to_aoi", """a AS (SELECT DISTINCT site, CASE WHEN site % 2 = 0 THEN 32631 ELSE 32630 END AS crs FROM tile_px),
    d AS (SELECT t.*, 32631 AS epsg, dense_rank() OVER (PARTITION BY t.site ORDER BY c) AS nx, dense_rank() OVER (PARTITION BY t.site ORDER BY r DESC) AS ny, crs FROM tile_px t JOIN a USING (site)),
    q AS (SELECT vec_id, site, r, c FROM d WHERE CASE WHEN epsg = crs THEN c BETWEEN 2 AND 5 AND r BETWEEN 1 AND 6 ELSE nx <= 3 AND ny <= 3 END)""", views="tile_px")
def q_clip_to_aoi(spark, sf):
    """Columns and rows of a tile stand in for coordinates; odd sites have another projection."""
    cells = fx.tile_px(spark, sf).select("vec_id", "site", "r", "c", F.col("c").alias("x"), F.col("r").alias("y"), F.lit(32631).alias("epsg"))
    box = {"xmin": F.lit(2), "xmax": F.lit(5), "ymin": F.lit(1), "ymax": F.lit(6)}
    aoi = cells.select(F.col("site").alias("name")).distinct().withColumns({"crs": F.when(F.col("name") % 2 == 0, 32631).otherwise(32630), **box})
    return filters.clip_to_aoi(cells, aoi, 3).select("vec_id", "site", "r", "c")


@query("q_cloud_ceiling", _DATED + ", q AS (SELECT site, sensor, doy FROM p WHERE (1 - clear_pixel_rate) * 100 <= 25 AND acquisition_date >= DATE '2022-06-01' AND acquisition_date < DATE '2024-01-01')", views="product_index")
def q_cloud_ceiling(spark, sf):
    catalogue = _dated(fx.product_index(spark, sf)).withColumn("cloud_cover", (1 - F.col("clear_pixel_rate")) * 100)
    return filters.cloud_ceiling(catalogue, 25.0, "2022-06-01", "2024-01-01").select(*SERIES, "doy")


@query("q_half_open_period", _DATED + ", q AS (SELECT site, sensor, doy FROM p WHERE acquisition_date >= DATE '2022-03-05' AND acquisition_date < DATE '2023-03-05')", views="product_index")
def q_half_open_period(spark, sf):
    return filters.period(_dated(fx.product_index(spark, sf)), "acquisition_date", "2022-03-05", "2023-03-05").select(*SERIES, "doy")


@query("q_eligible_patches", "e AS (SELECT vec_id FROM tile_px GROUP BY vec_id HAVING avg(CASE WHEN NOT masked THEN 1::DOUBLE ELSE 0::DOUBLE END) >= 0.6), q AS (SELECT vec_id, r, c FROM tile_px WHERE vec_id IN (SELECT vec_id FROM e) AND abs(v) <= 0.2)", views="tile_px")
def q_eligible_patches(spark, sf):
    return filters.eligible(fx.tile_px(spark, sf), ("vec_id",), 0.6, 0.2, F.col("v")).select("vec_id", "r", "c")


@query("q_contact_sheet", _DATED + ", n AS (SELECT *, row_number() OVER (PARTITION BY site, sensor ORDER BY acquisition_date) - 1 AS k FROM p WHERE valid), q AS (SELECT site, sensor, doy, CAST(k // 8 AS INT) AS sheet_row, CAST(k % 8 AS INT) AS sheet_col FROM n)", views="product_index")
def q_contact_sheet(spark, sf):
    return timeops.sheet_position(_dated(fx.product_index(spark, sf))).select(*SERIES, "doy", "sheet_row", "sheet_col")


@query("q_example_numbers", "q AS (SELECT vec_id, CAST(floor(vec_id / 7) AS INT) AS patch_idx, CAST(vec_id % 7 AS INT) AS slice_idx FROM embeddings)")
def q_example_numbers(spark, sf):
    patch, piece = timeops.number_examples(10, 7, F.col("vec_id"))
    return fx.read(spark, sf, "embeddings").select("vec_id", patch.alias("patch_idx"), piece.alias("slice_idx"))


@query("q_stack_sensors", f"q AS (SELECT site, sensor, doy, count(*) AS n, avg(b1) AS b1 FROM (SELECT site, px, 'lr' AS sensor, doy, b1 FROM cube WHERE sensor = 'lr' UNION ALL SELECT site, px, 'hr', doy, b1 FROM cube WHERE sensor = 'hr') GROUP BY ALL)", "b1")
def q_stack_sensors(spark, sf):
    c = fx.cube(spark, sf)
    side = lambda s: c.where(F.col("sensor") == s).drop("sensor")
    return sets.stack_sensors(side("lr"), side("hr")).groupBy(*SERIES, "doy").agg(F.count("*").alias("n"), F.avg("b1").alias("b1"))


@query("q_stack_experiments", "q AS (SELECT experiment, site, count(*) AS n, avg(b1) AS b1 FROM (SELECT 'all' AS experiment, site, b1 FROM cube UNION ALL SELECT 'clear', site, b1 FROM cube WHERE NOT masked) GROUP BY ALL)", "b1")
def q_stack_experiments(spark, sf):
    c = fx.cube(spark, sf)
    return sets.stack_experiments({"all": c, "clear": c.where("not masked")}).groupBy("experiment", "site").agg(F.count("*").alias("n"), F.avg("b1").alias("b1"))


@query("q_filled_calendar", """t AS (SELECT site, CAST(d AS INT) AS doy FROM (SELECT DISTINCT site FROM cube), range(0, 361, 30) r(d)), d AS (SELECT DISTINCT site, doy FROM cube UNION SELECT site, doy FROM t),
    g AS (SELECT k.*, d.doy FROM (SELECT DISTINCT site, px, sensor FROM cube) k JOIN d USING (site)),
    f AS (SELECT g.site, g.sensor, g.doy, coalesce(b1, 1) AS b1, coalesce(masked, true) AS masked FROM g LEFT JOIN cube USING (site, px, sensor, doy)),
    q AS (SELECT site, sensor, doy, count(*) AS n, count(*) FILTER (masked) AS n_masked, sum(b1) AS b1 FROM f GROUP BY ALL)""", "b1")
def q_filled_calendar(spark, sf):
    c = fx.cube(spark, sf)
    targets = c.select("site").distinct().crossJoin(timeops.regular_calendar(spark, 30))
    out = fusion.filled_calendar(c, targets, ["b1"])
    return out.groupBy(*SERIES, "doy").agg(F.count("*").alias("n"), F.count(F.when(F.col("masked"), 1)).alias("n_masked"), F.sum("b1").alias("b1"))


@query("q_site_checks", """a AS (SELECT DISTINCT s_suppkey % 12 AS site FROM supplier), i AS (SELECT DISTINCT site FROM product_index),
    q AS (SELECT site, 'no aoi' AS problem FROM i WHERE site NOT IN (SELECT site FROM a) UNION ALL SELECT site, 'no product' FROM a WHERE site NOT IN (SELECT site FROM i))""", views="product_index")
def q_site_checks(spark, sf):
    """Suppliers stand in for areas."""
    aoi = fx.read(spark, sf, "supplier").select((F.col("s_suppkey") % 12).alias("name")).distinct()
    return quality.site_violations(fx.product_index(spark, sf), aoi)


@query("q_thumbnail", """w AS (SELECT vec_id, CAST(floor(r / 2) AS INT) AS r, CAST(floor(c / 2) AS INT) AS c, v FROM tile_px), q AS (SELECT vec_id, r, c, avg(v) AS v FROM w GROUP BY ALL)""", "v:8", views="tile_px")
def q_thumbnail(spark, sf):
    """Half the size by bilinear resampling, which at this factor is the mean of four cells."""
    return tiles.resample(fx.tile_px(spark, sf), 8, 2, ("vec_id",), mode="bilinear")


@query("q_sharpen_bands", """m AS (SELECT site, doy, avg(b3) AS mean FROM cube WHERE sensor = 'hr' GROUP BY ALL),
    q AS (SELECT site, px, doy, mean AS b3, b1, b1 / 2 AS b2 FROM cube JOIN m USING (site, doy) WHERE sensor = 'hr')""", "b1 b2 b3:9")
def q_sharpen_bands(spark, sf):
    """A stand-in model: half the first fine band, and a site's mean of a coarse one."""
    hr = fx.cube(spark, sf).where("sensor = 'hr'").drop("sensor")
    coarse = hr.groupBy("site", "doy").agg(F.avg("b3").alias("b3")).join(hr.select("site", "px", "doy"), ["site", "doy"])
    model = lambda fine, low: fine.join(low, ["site", "px", "doy"]).withColumn("b2", F.col("b1") / 2)
    return fusion.sharpen_bands(hr, coarse.withColumn("b2", F.lit(0.0)), model, ["b1"], ["b2", "b3"], ["b3", "b1", "b2"], ("site", "px", "doy"))
