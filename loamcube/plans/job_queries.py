"""Queries of whole jobs on tiles and sites, and of the operators that only they use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamcube import fixtures as fx
from loamcube.functions import scalars
from loamcube.operators import filters, joins, tiles, timeops
from loamcube.plans import dataset, evaluation, fusion, quality, thermal
from loamcube.plans.column_queries import _DATED, _KEY, _KEYS, _dated
from loamcube.plans.registry import query
from loamcube.plans.tile_queries import _OP, _RING, KEY, MTF, MTF_RES, N, _axis_sql, _blur_sql, _kernel_sql, _resample_sql
from loamcube.schemas import PIXEL, SERIES, HidingParameters


def _tile(spark, sf) -> DataFrame:
    return fx.tile_px(spark, sf).select("vec_id", "site", "r", "c", "v", "masked")


def _dates(spark, sf) -> DataFrame:
    """Tiles as the dates of a site."""
    return _tile(spark, sf).select("site", F.col("vec_id").cast("int").alias("doy"), "r", "c", "v", "masked")


def _coarse(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return tiles.resample(df, N, 2.0, keys, mask="masked")


_COARSE = _axis_sql("x2", N, 2.0) + ", " + _resample_sql("cv", "tile_px", "x2") + ", d AS (SELECT cv.vec_id, cv.r, cv.c, cv.v, p.masked, p.site FROM cv JOIN tile_px p ON p.vec_id = cv.vec_id AND p.r = cv.r * 2 AND p.c = cv.c * 2)"


# tiles


@query("q_tile_shrink", _kernel_sql(3, 2.0, 0.1) + ", " + _blur_sql("b", "tile_px") + ", " + _axis_sql("x2", N, 2.0) + ", " + _resample_sql("q", "b", "x2"), "v:8", views="tile_px")
def q_tile_shrink(spark, sf):
    """Anti-aliased shrinking by a kernel of fixed half width."""
    return tiles.shrink(_tile(spark, sf), N, 2.0, KEY)


@query("q_read_thumbnail", f"""tw AS (SELECT CAST(o AS INT) AS o, CAST(i AS INT) AS i, 1 - abs((o + 0.5::DOUBLE) * 2 - 0.5 - i) / 2 AS w FROM range({N // 2}) a(o), range({N}) b(i) WHERE abs((o + 0.5::DOUBLE) * 2 - 0.5 - i) < 2),
    tn AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM tw), {_resample_sql("th", "tile_px", "tn")},
    q AS (SELECT th.vec_id, th.r, th.c, th.v, p.masked FROM th JOIN tile_px p ON p.vec_id = th.vec_id AND p.r = th.r * 2 + 1 AND p.c = th.c * 2 + 1)""", "v:8", views="tile_px")
def q_read_thumbnail(spark, sf):
    return tiles.thumbnail(_tile(spark, sf), N, 2.0, KEY, mask="masked").select("vec_id", "r", "c", "v", "masked")


def _spline_sql(name: str, offset: float) -> str:
    """Axis weights by the closed form of the inverse filter, whose taps fall by sqrt(3) - 2 a cell."""
    mirror = lambda x: f"CASE WHEN ({x} + {20 * N}) % {2 * N} < {N} THEN ({x} + {20 * N}) % {2 * N} ELSE {2 * N - 1} - ({x} + {20 * N}) % {2 * N} END"
    t = f"abs(o + {offset} - k)"
    return f"""cf AS (SELECT CAST(j AS INT) AS j, CAST({mirror("j + k")} AS INT) AS i, sum(sqrt(3) * pow(sqrt(3) - 2, abs(k))) AS w FROM range({N}) a(j), range(-40, 41) b(k) GROUP BY ALL),
    ev AS (SELECT CAST(o AS INT) AS o, CAST({mirror("k")} AS INT) AS j, sum(CASE WHEN {t} < 1 THEN (4 - 6 * {t} ** 2 + 3 * {t} ** 3) / 6 WHEN {t} < 2 THEN (2 - {t}) ** 3 / 6 ELSE 0 END) AS w FROM range({N}) a(o), range(-3, {N + 4}) b(k) GROUP BY ALL),
    {name} AS (SELECT ev.o, cf.i, sum(ev.w * cf.w) AS w FROM ev JOIN cf USING (j) GROUP BY ALL)"""


@query("q_spline_shift", _spline_sql("sp", 0.25) + ", " + _resample_sql("q", "tile_px", "sp"), "v:8", views="tile_px")
def q_spline_shift(spark, sf):
    """A quarter of a pixel along both axes."""
    return tiles.shift_spline(_tile(spark, sf), N, 0.25, 0.25, KEY)


# scores


def _grad(source: str, name: str, cols: dict[str, str], keep: str) -> str:
    one = lambda v, w: f"CASE WHEN lag({v}) OVER {w} IS NULL THEN lead({v}) OVER {w} - {v} WHEN lead({v}) OVER {w} IS NULL THEN {v} - lag({v}) OVER {w} ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / 2 END"
    sq = ", ".join(f"pow({one(v, 'wx')}, 2) + pow({one(v, 'wy')}, 2) AS {to}" for to, v in cols.items())
    return f"{name} AS (SELECT {keep}, {sq} FROM {source} WINDOW wx AS (PARTITION BY vec_id, r ORDER BY c), wy AS (PARTITION BY vec_id, c ORDER BY r))"


_PAIR = _OP + ", " + _blur_sql("b", "tile_px") + ", al AS (SELECT vec_id, r, c, b.v AS p, t.v AS x, t.masked FROM b JOIN tile_px t USING (vec_id, r, c)), ok AS (SELECT vec_id FROM al GROUP BY vec_id HAVING avg(masked::INT) <= 0.5)"


def _slope_sql(source: str) -> str:
    return f"""m AS (SELECT vec_id, count(*) AS n, avg(p) AS mp, avg(x) AS mr, sum(p * p) AS spp, sum(x * x) AS srr, sum(p * x) AS spr FROM {source} WHERE NOT masked AND vec_id IN (SELECT vec_id FROM ok) GROUP BY ALL),
    s AS (SELECT *, sqrt(spp / (n - 1) - mp * mp) AS dp, sqrt(srr / (n - 1) - mr * mr) AS dr FROM m),
    t AS (SELECT *, ((spr - n * mr * mp) / (dr * dp)) / ((srr - n * mr * mr) / (dr * dr) + 1e-3) * dp / dr AS slope FROM s),
    a AS (SELECT al.vec_id, al.r, al.c, al.masked, al.p, slope * x + mp - slope * mr AS a FROM {source} al JOIN t USING (vec_id))"""


_LOSS = "avg(CASE WHEN abs(p - a) < 0.1 THEN 0.5 * pow(p - a, 2) / 0.1 ELSE abs(p - a) - 0.05 END)"


def _fit_input(spark, sf) -> DataFrame:
    px = _tile(spark, sf)
    blur = tiles.convolve(px, N, tiles.psf_kernel(1.0, MTF_RES, MTF), KEY, "v", "p_v")
    return px.select("vec_id", "r", "c", "masked", F.col("v").alias("r_v")).join(blur, ["vec_id", "r", "c"])


@query("q_regression_fit_pre", _PAIR + ", " + _grad("al", "g", {"p": "p", "x": "x"}, "vec_id, r, c, masked") + ", " + _slope_sql("g") + f", q AS (SELECT vec_id, {_LOSS} AS fit_loss FROM a WHERE NOT masked GROUP BY vec_id)", "fit_loss:8", views="tile_px")
def q_regression_fit_pre(spark, sf):
    """Regression of squared gradients."""
    return evaluation.filtered_fit(_fit_input(spark, sf), "v", N, KEY, "PRE")


@query("q_regression_fit_post", _PAIR + ", " + _slope_sql("al") + ", " + _grad("a", "g", {"p": "p", "a": "a"}, "vec_id, masked") + f", f AS (SELECT vec_id, {_LOSS} AS fit_loss FROM g WHERE NOT masked GROUP BY vec_id), q AS (SELECT vec_id, CASE WHEN fit_loss <= 0.001 THEN fit_loss END AS fit_loss FROM f)", "fit_loss:8", views="tile_px")
def q_regression_fit_post(spark, sf):
    """Squared gradients of the prediction and of the adapted reference; great losses don't count."""
    return evaluation.filtered_fit(_fit_input(spark, sf), "v", N, KEY, "POST", security=0.001)


_TWO = "tv AS (SELECT vec_id, r, c, v FROM tile_px), tw AS (SELECT vec_id, r, c, v * v + 1 AS v FROM tile_px)"


@query("q_scores_coarse", ", ".join([_OP, _TWO, _blur_sql("bv", "tv"), _blur_sql("bw", "tw"), _COARSE, _resample_sql("pv", "bv", "x2"), _resample_sql("pw", "bw", "x2")]) + f""",
    al AS (SELECT d.vec_id, pv.v AS p, pw.v AS pw, d.v AS x, d.v * d.v + 1 AS xw FROM d JOIN pv USING (vec_id, r, c) JOIN pw USING (vec_id, r, c) WHERE NOT d.masked AND r BETWEEN 1 AND {N // 2 - 2} AND c BETWEEN 1 AND {N // 2 - 2}),
    lg AS (SELECT vec_id, 'v' AS band, p, x FROM al UNION ALL SELECT vec_id, 'w', pw, xw FROM al),
    q AS (SELECT vec_id, band, sqrt(avg(pow(p - x, 2))) AS value, 'rmse' AS metric FROM lg GROUP BY ALL UNION ALL SELECT vec_id, band, sqrt(sum(pow(p - x, 2)) / sum(x * x)), 'nrmse' FROM lg GROUP BY ALL
          UNION ALL SELECT vec_id, band, avg(abs(p - x)), 'mae' FROM lg GROUP BY ALL UNION ALL SELECT vec_id, 'all', avg(acos(least(1, (p * x + pw * xw) / (sqrt(p * p + pw * pw) * sqrt(x * x + xw * xw))))), 'sam' FROM al GROUP BY vec_id)""", "value", views="tile_px")
def q_scores_coarse(spark, sf):
    """A prediction on the fine grid against a coarse target, in two bands."""
    two = lambda px: px.withColumn("w", F.col("v") * F.col("v") + 1)
    px = _tile(spark, sf)
    return evaluation.scores_on_coarse_grid(two(px), two(_coarse(px, KEY)), N, 2, ["v", "w"], KEY, {b: (MTF_RES, MTF) for b in "vw"}, margin=1)


def _second_ring(source: str) -> str:
    """The profile of another table, under other names; frequencies are those of the first."""
    out = _RING[_RING.index("du AS") :].replace("tile_px", source)
    for name in ("du", "dw", "fp"):
        out = out.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ")
    return out


@query("q_spectra", ", ".join([_RING, _COARSE, _axis_sql("x5", N // 2, 0.5), _resample_sql("up", "d", "x5"), _second_ring("up")]) + """,
    pr AS (SELECT p.vec_id, p.freq_idx, 10 * log10(p.amp) AS lp, 10 * log10(r.amp) AS lr FROM fp p JOIN fp2 r ON r.vec_id = p.vec_id AND r.freq_idx = p.freq_idx WHERE p.freq_idx >= 1),
    n AS (SELECT *, lp - max(lp) FILTER (freq_idx = 1) OVER w AS dp, lr - max(lr) FILTER (freq_idx = 1) OVER w AS dr, count(*) OVER w AS n FROM pr WINDOW w AS (PARTITION BY vec_id)),
    q AS (SELECT vec_id, avg(dp - dr) AS frr FROM n WHERE freq_idx - 1 >= 1 AND freq_idx - 1 < n - 1 GROUP BY vec_id)""", "frr", views="tile_px")
def q_spectra(spark, sf):
    px = _tile(spark, sf)
    return evaluation.spectra(px, _coarse(px, KEY), N, 2, "v", KEY, margin=0)


@query("q_evaluation_job", "w AS (SELECT DISTINCT s_suppkey % 12 AS site FROM supplier), q AS (SELECT site FROM w WHERE site NOT IN (SELECT site FROM cube))")
def q_evaluation_job(spark, sf):
    """Sites wanted by suppliers of which the job has no scores."""
    wanted = fx.read(spark, sf, "supplier").select((F.col("s_suppkey") % 12).alias("site"))
    return evaluation.evaluate(fx.cube(spark, sf), ["b1"], HidingParameters("GAPS", gap=30), wanted)[2]


# fusion


@query("q_sen2like_tiles", ", ".join([_COARSE, _axis_sql("b5", N // 2, 0.5, "bilinear"), _resample_sql("ub", "d", "b5"), _kernel_sql(1, 1.0, 0.4)]) + """,
    up AS (SELECT ub.vec_id, ub.r, ub.c, ub.v, d.masked, d.site FROM ub JOIN d ON d.vec_id = ub.vec_id AND d.r = ub.r // 2 AND d.c = ub.c // 2),
    ds AS (SELECT vec_id, site, lag(vec_id) OVER (PARTITION BY site ORDER BY vec_id) AS d2 FROM (SELECT DISTINCT vec_id, site FROM tile_px)),
    ah AS (SELECT up.site, up.vec_id, up.r, up.c, (b.v - a.v) / (ds.d2 - ds.vec_id) * (up.vec_id - ds.d2) + b.v AS v, up.v AS lr, up.masked OR a.masked OR coalesce(b.masked, true) AS masked
           FROM up JOIN ds USING (vec_id) JOIN tile_px a ON a.vec_id = up.vec_id AND a.r = up.r AND a.c = up.c LEFT JOIN tile_px b ON b.vec_id = ds.d2 AND b.r = up.r AND b.c = up.c),
    bl AS (SELECT p.vec_id, ro AS r, co AS c, sum(v * w) AS v FROM ah p JOIN op ON p.r = op.r AND p.c = op.c GROUP BY ALL),
    q AS (SELECT ah.site, CAST(ah.vec_id AS INT) AS doy, ah.r, ah.c, ah.lr + (ah.v - bl.v) AS v, ah.masked FROM ah JOIN bl ON bl.vec_id = ah.vec_id AND bl.r = ah.r AND bl.c = ah.c)""", "v:8", views="tile_px")
def q_sen2like_tiles(spark, sf):
    hr = _dates(spark, sf)
    return fusion.sen2like(hr, _coarse(hr, ("site", "doy")), N, 2, "v")


@query("q_naive_enlarged", ", ".join([_COARSE, "k AS (SELECT site, r * 4 + c AS px, vec_id AS doy, v FROM d WHERE NOT masked)", "g AS (SELECT DISTINCT site, px FROM (SELECT site, r * 4 + c AS px, count(*) OVER (PARTITION BY site, r, c) AS n FROM d) WHERE n > 1), tg AS (SELECT DISTINCT site, vec_id + 1 AS doy FROM d), gt AS (SELECT g.site, g.px, tg.doy FROM g JOIN tg USING (site))"]) + """,
    gf AS (SELECT t.site, t.px, t.doy, CASE WHEN n.doy IS NULL THEN a.v WHEN a.doy IS NULL OR n.doy = t.doy THEN n.v ELSE a.v + (n.v - a.v) * (t.doy - a.doy) / (n.doy - a.doy)::DOUBLE END AS v
           FROM gt t ASOF LEFT JOIN k a ON t.site = a.site AND t.px = a.px AND t.doy > a.doy ASOF LEFT JOIN k n ON t.site = n.site AND t.px = n.px AND t.doy <= n.doy),
    """ + _axis_sql("x5", N // 2, 0.5) + ", q AS (SELECT site, CAST(doy AS INT) AS doy, CAST(x.o AS INT) AS r, CAST(y.o AS INT) AS c, sum(v * x.w * y.w) AS v FROM gf JOIN x5 x ON x.i = px // 4 JOIN x5 y ON y.i = px % 4 GROUP BY ALL)", "v:8", views="tile_px")
def q_naive_enlarged(spark, sf):
    """The day after each date."""
    low = _coarse(_dates(spark, sf), ("site", "doy"))
    targets = low.select("site", (F.col("doy") + 1).alias("doy")).distinct()
    return fusion.naive_on_fine_grid(low, N // 2, 2, "v", targets)


@query("q_pair_tiles", _kernel_sql(3, 2.0, 0.1) + ", " + _blur_sql("b", "tile_px") + ", " + _axis_sql("x2", N, 2.0) + ", " + _resample_sql("sh", "b", "x2") + """, ds AS (SELECT DISTINCT site, vec_id FROM tile_px),
    nb AS (SELECT site, vec_id, lag(vec_id) OVER w AS a, lead(vec_id) OVER w AS b FROM ds WINDOW w AS (PARTITION BY site ORDER BY vec_id)),
    nn AS (SELECT site, vec_id, CASE WHEN b IS NULL OR vec_id - a <= b - vec_id THEN a ELSE b END AS near FROM nb),
    q AS (SELECT site, CAST(vec_id AS INT) AS doy, CAST(near AS INT) AS nearest_doy, sum(v) AS v FROM nn JOIN sh USING (vec_id) WHERE near IS NOT NULL GROUP BY ALL)""", "v", views="tile_px")
def q_pair_tiles(spark, sf):
    px = _dates(spark, sf)
    near, low = fusion.pair_tiles(px, px, N, "v")
    return near.join(low, ["site", "doy"]).groupBy("site", "doy", "nearest_doy").agg(F.sum("v").alias("v"))


@query("q_thermal_series")
def q_thermal_series(spark, sf):
    """Even dates are coarse temperatures, odd ones fine features."""
    px = _dates(spark, sf)
    fine = px.where("doy % 2 = 1").withColumns({"f1": F.col("v") * F.col("v"), "f2": F.col("v")}).drop("v")
    low = _coarse(px.where("doy % 2 = 0"), ("site", "doy")).select("site", "doy", "r", "c", (F.col("v") * 40 + 290).alias("lst"), "masked")
    return thermal.sharpen_series(fine, low, 2, ["f1", "f2"], thermal.TreeParameters(depth=2, bins=8, least=3, window=2, reach=1))


# datasets and ingest


@query("q_patch_dataset", """xy AS (SELECT *, round(b1, 3) AS x, round(b3 * 100, 3) AS y FROM cube), a AS (SELECT site, min(x) - 0.00123::DOUBLE AS xmin, max(x) AS xmax, min(y) - 0.00123::DOUBLE AS ymin, max(y) AS ymax FROM xy GROUP BY site),
    n AS (SELECT *, greatest(floor((xmax - xmin) / 3), 1)::INT AS nx, greatest(floor((ymax - ymin) / 3), 1)::INT AS ny FROM a),
    g AS (SELECT site, CAST(ix * ny + iy AS INT) AS patch_idx, xmin + ix * ((xmax - xmin) / nx) AS x0, ymin + iy * ((ymax - ymin) / ny) AS y0 FROM n, range(100) x(ix), range(100) y(iy) WHERE ix < nx AND iy < ny),
    c AS (SELECT *, CAST(floor(doy / 365) AS INT) AS slice_idx, max(CAST(floor(doy / 365) AS INT)) OVER (PARTITION BY site) + 1 AS ns FROM xy),
    q AS (SELECT c.site, patch_idx, CAST(patch_idx * ns + slice_idx AS INT) AS example, count(*) AS n FROM c JOIN g ON g.site = c.site AND x >= x0 AND x < x0 + 3 AND y >= y0 AND y < y0 + 3 GROUP BY ALL)""")
def q_patch_dataset(spark, sf):
    """Two bands stand in for coordinates; no pixel lies on a corner, where both engines' averages would round apart."""
    c = fx.cube(spark, sf).withColumns({"x": F.round("b1", 3), "y": F.round(F.col("b3") * 100, 3)})
    box = c.groupBy(F.col("site").alias("name")).agg((F.min("x") - 0.00123).alias("xmin"), F.max("x").alias("xmax"), (F.min("y") - 0.00123).alias("ymin"), F.max("y").alias("ymax"))
    out = dataset.patch_dataset(timeops.time_slices(c, 365), box, 3.0)
    return out.groupBy("site", "patch_idx", "example").agg(F.count("*").alias("n"))


def _slide_sql(name: str, source: str, k: int, any_: bool) -> str:
    lo, hi = (-(k // 2), (k - 1) // 2) if any_ else (-((k - 1) // 2), k // 2)
    agg = "bool_or(m.m)" if any_ else f"bool_and(m.m) AND count(*) = {k * k}"
    return f"{name} AS (SELECT p.vec_id, p.r, p.c, {agg} AS m FROM {source} p JOIN {source} m ON m.vec_id = p.vec_id AND m.r BETWEEN p.r + {lo} AND p.r + {hi} AND m.c BETWEEN p.c + {lo} AND p.c + {hi} GROUP BY ALL)"


_CLEANED = ", ".join([_slide_sql("z", "z0", 2, True), "k0 AS (SELECT vec_id, r, c, z.m OR b.masked AS m FROM z JOIN tile_px b USING (vec_id, r, c))", _slide_sql("k1", "k0", 2, False), _slide_sql("k2", "k1", 2, True), _slide_sql("k3", "k2", 2, True), _slide_sql("k4", "k3", 2, False), _slide_sql("k5", "k4", 2, True)])


@query("q_ingest", f"""z0 AS (SELECT vec_id, r, c, abs(v) < 0.002 AS m FROM tile_px), {_CLEANED}, x AS (SELECT site, vec_id, r, c, k5.m OR v > 0.3 AS m FROM k5 JOIN tile_px USING (vec_id, r, c)),
    i AS (SELECT site, vec_id, avg(CASE WHEN m THEN 0::DOUBLE ELSE 1::DOUBLE END) AS clear_pixel_rate, strftime(DATE '2022-01-01' + vec_id::INT, '%Y%m%d') AS day FROM x GROUP BY ALL),
    q AS (SELECT site, 'hr_' || day AS product_id, clear_pixel_rate, clear_pixel_rate >= 0.25 AS valid, CASE WHEN clear_pixel_rate >= 0.25 THEN day || '/hr_bands_' || day END AS bands, CASE WHEN clear_pixel_rate >= 0.25 THEN day || '/hr_mask_' || day END AS mask FROM i)""", "clear_pixel_rate", views="tile_px")
def q_ingest(spark, sf):
    """Small values stand in for zeros, great ones for missing numbers; a tile is a date."""
    v = F.when(F.abs("v") < 0.002, F.lit(0.0)).when(F.col("v") > 0.3, F.lit(float("nan"))).otherwise(F.col("v"))
    px = _dated(_dates(spark, sf)).withColumns({"sensor": F.lit("hr"), "b1": v})
    index, _ = dataset.ingest(px, F.col("masked"), opening=2, dilation=2, zero_dilation=2)
    return index.select("site", "product_id", "clear_pixel_rate", "valid", "bands", "mask")


@query("q_stale_folders", _DATED + """, h AS (SELECT site, doy FROM p WHERE sensor = 'hr' AND valid), l AS (SELECT * FROM p WHERE sensor = 'lr'),
    q AS (SELECT DISTINCT l.site, strftime(acquisition_date, '%Y%m%d') AS folder FROM l LEFT JOIN h USING (site, doy) WHERE NOT l.valid OR h.doy IS NULL)""", views="product_index")
def q_stale_folders(spark, sf):
    i = _dated(fx.product_index(spark, sf))
    return joins.stale_folders(i.where("sensor = 'lr'"), i.where("sensor = 'hr' and valid"))


@query("q_target_values", f"q AS (SELECT {_KEYS}, b1 / 10000 AS b1, b2 / 10000 AS b2, b4 / 10 AS b8 FROM cube)", "b1:9 b2:9 b8:9")
def q_target_values(spark, sf):
    """The eighth of eight bands is thermal."""
    bands = [f"b{i}" for i in range(1, 9)]
    c = fx.cube(spark, sf).withColumns({b: F.col("b4") for b in bands[4:]})
    return c.withColumns(scalars.target_values(bands)).select(*_KEY, "b1", "b2", "b8")


@query("q_thermal_units", f"q AS (SELECT {_KEYS}, b2 / 1000 AS kelvin, b2 / 10 - 273.15::DOUBLE AS celsius FROM cube)", "kelvin:9 celsius")
def q_thermal_units(spark, sf):
    return fx.cube(spark, sf).select(*_KEY, scalars.raw_thermal(F.col("b2")).alias("kelvin"), scalars.stored_to_celsius(F.col("b2")).alias("celsius"))


@query("q_trimmed_away", "q AS (SELECT site, px, sensor FROM cube GROUP BY ALL HAVING bool_and(masked OR b1 > 1))")
def q_trimmed_away(spark, sf):
    """Pixels whose own series has no clear date; all but the least values are hidden."""
    return filters.trim(fx.cube(spark, sf).withColumn("masked", F.col("masked") | (F.col("b1") > 1)), PIXEL)[1]


@query("q_layer_checks", """f AS (SELECT site, sensor, doy, count(CASE WHEN b1 <= 45 THEN 1 END) AS bands, count(masked) AS mask FROM cube GROUP BY ALL), v AS (SELECT f.* FROM f JOIN product_index USING (site, sensor, doy) WHERE valid),
    q AS (SELECT site, sensor, doy, 'bands' AS layer, bands AS n_found FROM v WHERE bands <> 3 UNION ALL SELECT site, sensor, doy, 'mask', mask FROM v WHERE mask <> 3)""", views="product_index")
def q_layer_checks(spark, sf):
    px = fx.cube(spark, sf).withColumns({"bands": F.when(F.col("b1") <= 45, F.col("b1")), "mask": F.col("masked")})
    return quality.layer_violations(fx.product_index(spark, sf), px, ["bands", "mask"], 3)


@query("q_dataset_checks", """a AS (SELECT site, max(s_nationkey) AS crs FROM (SELECT s_suppkey % 12 AS site, s_nationkey FROM supplier) GROUP BY site), e AS (SELECT site, min(doy % 25) AS lo, max(doy % 25) AS hi FROM cube GROUP BY site),
    m AS (SELECT site, sensor, doy, min(n_px) AS x FROM product_index GROUP BY ALL),
    q AS (SELECT site, 'projection' AS problem FROM a JOIN e USING (site) WHERE lo <> crs OR hi <> crs UNION ALL SELECT site, 'no first patch' FROM a WHERE site NOT IN (SELECT site FROM cube WHERE px % 3 = 0)
          UNION ALL SELECT site, 'mask of some dates' FROM m GROUP BY site, sensor HAVING bool_or(x % 2 = 0) AND NOT bool_and(x % 2 = 0))""", views="product_index")
def q_dataset_checks(spark, sf):
    """Nations stand in for projections, pixel numbers for patches; products of an odd number of pixels have no mask."""
    aoi = fx.read(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 12).alias("name")).agg(F.max("s_nationkey").alias("crs"))
    c = fx.cube(spark, sf)
    cells = c.select("site", F.pmod("doy", F.lit(25)).alias("epsg"))
    dates = fx.product_index(spark, sf).withColumn("masked", F.when(F.col("n_px") % 2 == 0, True))
    out = quality.projection_violations(cells, aoi).union(quality.unread_sites(aoi, c.withColumn("patch_idx", F.col("px") % 3)))
    return out.union(quality.mask_violations(dates).select("site", "problem"))
