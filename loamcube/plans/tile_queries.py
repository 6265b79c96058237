"""Queries over 8 x 8 tiles and the tile pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamcube import fixtures as fx
from loamcube.operators import aggs, filters, joins, reshape, tiles
from loamcube.plans import fusion, thermal
from loamcube.plans.registry import query

N = 8
KEY = ("vec_id",)
MTF_RES, MTF = 2.0, 0.2


def _px(spark, sf) -> DataFrame:
    return fx.tile_px(spark, sf)


def _kernel_sql(half: int, mtf_res: float, mtf: float) -> str:
    sigma = f"(sqrt(-ln({mtf}) / 2) / (pi() * 0.5 / {mtf_res}))"
    return f"""kr AS (SELECT dr, dc, exp(-(dr * dr + dc * dc) / (2 * pow({sigma}, 2))) AS w FROM range(-{half}, {half + 1}) a(dr), range(-{half}, {half + 1}) b(dc)),
    kn AS (SELECT dr, dc, w / sum(w) OVER () AS w FROM kr),
    ax AS (SELECT o, d, CASE WHEN o + d < 0 THEN -(o + d) WHEN o + d > {N - 1} THEN {2 * (N - 1)} - (o + d) ELSE o + d END AS i FROM range({N}) a(o), range(-{half}, {half + 1}) b(d)),
    op AS (SELECT x.o AS ro, y.o AS co, x.i AS r, y.i AS c, sum(w) AS w FROM kn JOIN ax x ON x.d = dr JOIN ax y ON y.d = dc GROUP BY ALL)"""


def _blur_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT vec_id, CAST(ro AS INT) AS r, CAST(co AS INT) AS c, sum(v * w) AS v FROM {source} p JOIN op ON p.r = op.r AND p.c = op.c GROUP BY ALL)"


def _axis_sql(name: str, size: int, factor: float, mode: str = "bicubic") -> str:
    if mode == "bicubic":
        w = "CASE WHEN x <= 1 THEN 1.25 * x ** 3 - 2.25 * x ** 2 + 1 ELSE -0.75 * x ** 3 + 3.75 * x ** 2 - 6 * x + 3 END"
        reach = 2
    else:
        w, reach = "1 - x", 1
    return f"""{name} AS (SELECT o, least(greatest(b + k, 0), {size - 1})::INT AS i, sum({w}) AS w FROM (SELECT o, k, b, abs(s - b - k) AS x FROM (SELECT o, (o + 0.5::DOUBLE) * {factor} - 0.5 AS s, floor((o + 0.5::DOUBLE) * {factor} - 0.5)::INT AS b FROM range({int(size / factor)}) t(o)), range({1 - reach}, {reach + 1}) u(k)) GROUP BY ALL)"""


def _resample_sql(name: str, source: str, axis: str) -> str:
    return f"{name} AS (SELECT vec_id, CAST(x.o AS INT) AS r, CAST(y.o AS INT) AS c, sum(v * x.w * y.w) AS v FROM {source} p JOIN {axis} x ON x.i = p.r JOIN {axis} y ON y.i = p.c GROUP BY ALL)"


_OP = _kernel_sql(2, MTF_RES, MTF)


@query("q_tile_blur", _OP + ", " + _blur_sql("q", "tile_px"), "v:8", views="tile_px")
def q_tile_blur(spark, sf):
    return tiles.convolve(_px(spark, sf), N, tiles.psf_kernel(1.0, MTF_RES, MTF), KEY)


@query("q_tile_highpass", _OP + ", " + _blur_sql("b", "tile_px") + ", q AS (SELECT vec_id, r, c, p.v - b.v AS v FROM tile_px p JOIN b USING (vec_id, r, c))", "v:8", views="tile_px")
def q_tile_highpass(spark, sf):
    return tiles.high_pass(_px(spark, sf), N, tiles.psf_kernel(1.0, MTF_RES, MTF), KEY)


def _gradient_sql() -> str:
    one = lambda w: f"CASE WHEN lag(v) OVER {w} IS NULL THEN lead(v) OVER {w} - v WHEN lead(v) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"
    return f"g AS (SELECT vec_id, r, c, {one('x')} AS gx, {one('y')} AS gy FROM tile_px WINDOW x AS (PARTITION BY vec_id, r ORDER BY c), y AS (PARTITION BY vec_id, c ORDER BY r)), q AS (SELECT vec_id, r, c, gx * gx + gy * gy AS grad FROM g)"


@query("q_tile_gradient", _gradient_sql(), "grad:8", views="tile_px")
def q_tile_gradient(spark, sf):
    return tiles.gradient_magnitude(_px(spark, sf), KEY).select("vec_id", "r", "c", "grad")


@query("q_tile_down_bicubic", _axis_sql("x2", N, 2.0) + ", " + _resample_sql("d", "tile_px", "x2") + ", q AS (SELECT d.vec_id, d.r, d.c, d.v, p.masked FROM d JOIN tile_px p ON p.vec_id = d.vec_id AND p.r = d.r * 2 AND p.c = d.c * 2)", "v:8", views="tile_px")
def q_tile_down_bicubic(spark, sf):
    return tiles.resample(_px(spark, sf), N, 2.0, KEY, mask="masked").select("vec_id", "r", "c", "v", "masked")


@query("q_tile_down_mtf", _OP + ", " + _blur_sql("b", "tile_px") + ", " + _axis_sql("x2", N, 2.0) + ", " + _resample_sql("q", "b", "x2"), "v:8", views="tile_px")
def q_tile_down_mtf(spark, sf):
    return tiles.downsample_mtf(_px(spark, sf), N, 1.0, MTF_RES, MTF, 2.0, KEY)


@query("q_tile_up_bicubic", _axis_sql("x5", N, 0.5) + ", " + _resample_sql("q", "tile_px", "x5"), "v:8", views="tile_px")
def q_tile_up_bicubic(spark, sf):
    return tiles.resample(_px(spark, sf), N, 0.5, KEY)


@query("q_tile_up_bilinear", _axis_sql("x5", N, 0.5, "bilinear") + ", " + _resample_sql("q", "tile_px", "x5"), "v:8", views="tile_px")
def q_tile_up_bilinear(spark, sf):
    return tiles.resample(_px(spark, sf), N, 0.5, KEY, mode="bilinear")


@query("q_tile_crop", "q AS (SELECT vec_id, CAST(r - 2 AS INT) AS r, CAST(c - 2 AS INT) AS c, v FROM tile_px WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5)", "v:8", views="tile_px")
def q_tile_crop(spark, sf):
    return filters.crop(_px(spark, sf), N, 2).select("vec_id", "r", "c", "v")


@query("q_patchify_roundtrip", "q AS (SELECT vec_id, r, c, v FROM tile_px)", "v:8", views="tile_px")
def q_patchify_roundtrip(spark, sf):
    return reshape.unpatchify(reshape.patchify(_px(spark, sf), N, 3, 1, KEY), N, 3, 1, KEY)


def _slide_sql(name: str, source: str, k: int, any_: bool) -> str:
    lo, hi = -(k // 2), (k - 1) // 2
    if not any_:
        lo, hi = -hi, -lo
    agg = "bool_or(m.masked)" if any_ else f"bool_and(m.masked) AND count(*) = {k * k}"
    return f"{name} AS (SELECT p.vec_id, p.r, p.c, {agg} AS masked FROM {source} p JOIN {source} m ON m.vec_id = p.vec_id AND m.r BETWEEN p.r + {lo} AND p.r + {hi} AND m.c BETWEEN p.c + {lo} AND p.c + {hi} GROUP BY ALL)"


_NEG = "n0 AS (SELECT vec_id, r, c, v < 0.02 AS masked FROM tile_px)"


@query("q_mask_open_close_dilate", ", ".join([_NEG, _slide_sql("n1", "n0", 2, False), _slide_sql("n2", "n1", 2, True), _slide_sql("n3", "n2", 3, True), _slide_sql("n4", "n3", 3, False), _slide_sql("q", "n4", 3, True)]), views="tile_px")
def q_mask_open_close_dilate(spark, sf):
    px = _px(spark, sf).select("vec_id", "r", "c", (F.col("v") < 0.02).alias("masked"))
    return tiles.clean_mask(px, 2, 3, KEY)


@query("q_tile_clear_stats", "q AS (SELECT vec_id, count(*) FILTER (NOT masked) AS n, avg(v) FILTER (NOT masked AND r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6) AS v FROM tile_px GROUP BY ALL)", "v:8", views="tile_px")
def q_tile_clear_stats(spark, sf):
    px = filters.scored(_px(spark, sf), N, 1)
    return px.groupBy("vec_id").agg(F.count_if(~F.col("masked")).alias("n"), F.avg(F.when(F.col("scored"), F.col("v"))).alias("v"))


@query("q_tile_roundtrip", "q AS (SELECT vec_id, list(v ORDER BY idx)[10] AS tenth, count(*) AS n FROM tile_px GROUP BY ALL)", "tenth:8", views="tile_px")
def q_tile_roundtrip(spark, sf):
    back = reshape.pixels_to_tile(_px(spark, sf), KEY)
    return back.select("vec_id", F.col("data")[9].alias("tenth"), F.size("data").cast("long").alias("n"))


@query("q_cross_resolution", _axis_sql("x2", N, 2.0) + ", " + _resample_sql("d", "tile_px", "x2") + ", q AS (SELECT p.vec_id, p.r, p.c, p.v, d.v AS coarse_v FROM tile_px p JOIN d ON d.vec_id = p.vec_id AND d.r = p.r // 2 AND d.c = p.c // 2)", "v:8 coarse_v:8", views="tile_px")
def q_cross_resolution(spark, sf):
    px = _px(spark, sf)
    return joins.cross_resolution(px, tiles.resample(px, N, 2.0, KEY), 2, KEY, ["v"]).select("vec_id", "r", "c", "v", "coarse_v")


def _tiles(spark, sf) -> DataFrame:
    return fx.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("data"))


_RING = """f AS (SELECT CAST(k AS INT) AS k, CASE WHEN k < 8 THEN k ELSE k - 16 END / 8.0::DOUBLE AS f FROM range(16) t(k)),
    fr AS (SELECT u.k AS ku, w.k AS kw, CAST(j AS INT) AS freq_idx, (4 * j + 1) / 16.0::DOUBLE AS freq FROM f u, f w, range(4) t(j) WHERE sqrt(u.f * u.f + w.f * w.f) > 2 * j / 8.0::DOUBLE AND sqrt(u.f * u.f + w.f * w.f) < (2 * j + 1) / 8.0::DOUBLE),
    du AS (SELECT p.vec_id, p.c, u.k AS ku, sum(v * cos(2 * pi() * u.k * p.r / 16)) AS a, sum(-v * sin(2 * pi() * u.k * p.r / 16)) AS b FROM tile_px p, (SELECT DISTINCT ku AS k FROM fr) u GROUP BY ALL),
    dw AS (SELECT vec_id, fr.freq_idx, fr.freq, fr.ku, fr.kw, sum(a * cos(2 * pi() * kw * c / 16) + b * sin(2 * pi() * kw * c / 16)) AS re, sum(b * cos(2 * pi() * kw * c / 16) - a * sin(2 * pi() * kw * c / 16)) AS im FROM du JOIN fr USING (ku) GROUP BY ALL),
    fp AS (SELECT vec_id, freq_idx, freq, avg(sqrt(re * re + im * im)) AS amp FROM dw GROUP BY ALL)"""


@query("q_fft_profile", _RING + ", q AS (SELECT * FROM fp)", "amp:8", views="tile_px")
def q_fft_profile(spark, sf):
    return tiles.fft_profile(_tiles(spark, sf), "data", N, KEY)


@query("q_frr", _RING + """, pr AS (SELECT p.vec_id, p.freq_idx, 10 * log10(p.amp) AS lp, 10 * log10(r.amp) AS lr FROM fp p JOIN fp r ON r.vec_id = p.vec_id + 1 AND r.freq_idx = p.freq_idx WHERE p.freq_idx >= 1),
    n AS (SELECT *, lp - max(lp) FILTER (freq_idx = 1) OVER w AS dp, lr - max(lr) FILTER (freq_idx = 1) OVER w AS dr, count(*) OVER w AS n FROM pr WINDOW w AS (PARTITION BY vec_id)),
    q AS (SELECT vec_id, avg(dp - dr) AS frr FROM n WHERE freq_idx - 1 >= 1 AND freq_idx - 1 < n - 1 GROUP BY vec_id)""", "frr", views="tile_px")
def q_frr(spark, sf):
    prof = tiles.fft_profile(_tiles(spark, sf), "data", N, KEY)
    return tiles.frequency_restoration(prof, prof.withColumn("vec_id", F.col("vec_id") - 1), KEY)


@query("q_macro_profile", _RING + ", s AS (SELECT e.label AS site, freq_idx, avg(amp) AS v FROM fp JOIN embeddings e USING (vec_id) GROUP BY ALL), q AS (SELECT freq_idx, avg(v) AS amp FROM s GROUP BY ALL)", "amp:8", views="tile_px")
def q_macro_profile(spark, sf):
    prof = tiles.fft_profile(_tiles(spark, sf), "data", N, KEY)
    sites = fx.read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("site"))
    return aggs.macro_profile(prof.join(sites, "vec_id"), ("freq_idx",), "amp")


_OP_RES = _kernel_sql(2, 2.0, 0.4)


@query("q_residual_comp", _OP_RES + ", " + _axis_sql("x2", N, 2.0) + ", " + _resample_sql("d", "tile_px", "x2") + ", " + _axis_sql("x5", N // 2, 0.5) + ", " + _resample_sql("u", "d", "x5") + ", " + _blur_sql("b", "tile_px") + ", q AS (SELECT vec_id, r, c, p.v + u.v - b.v AS v FROM tile_px p JOIN u USING (vec_id, r, c) JOIN b USING (vec_id, r, c))", "v:8", views="tile_px")
def q_residual_comp(spark, sf):
    px = _px(spark, sf).select("vec_id", "r", "c", "v")
    return fusion.residual_compensation(px, tiles.resample(px, N, 2.0, KEY), N, 2, KEY)


@query("q_high_frequency", _kernel_sql(1, 1.0, 0.4) + ", " + _blur_sql("b", "tile_px") + ", q AS (SELECT vec_id, r, c, 2 * p.v - b.v AS v FROM tile_px p JOIN b USING (vec_id, r, c))", "v:8", views="tile_px")
def q_high_frequency(spark, sf):
    px = _px(spark, sf).select("vec_id", "r", "c", "v")
    return fusion.add_high_frequency(px, px, N, KEY)


@query("q_tiled_gain", "q AS (SELECT vec_id, r, c, 3 * v AS v FROM tile_px)", "v:8", views="tile_px")
def q_tiled_gain(spark, sf):
    """A user's function, patch by patch with a halo."""
    return fusion.tiled(_px(spark, sf), lambda t: 3 * t, N, 4, 1, KEY)


@query("q_thermal_tree")
def q_thermal_tree(spark, sf):
    """Windows of two coarse cells, with one around; trees of each tile."""
    px = _px(spark, sf).withColumns({"f1": F.col("v") * F.col("v"), "f2": F.col("v")}).select("vec_id", "r", "c", "masked", "f1", "f2")
    coarse = tiles.resample(_px(spark, sf), N, 2.0, KEY, mask="masked").select("vec_id", "r", "c", (F.col("v") * 40 + 290).alias("lst"), "masked")
    return thermal.sharpen(px, coarse, 2, ["f1", "f2"], KEY, thermal.TreeParameters(depth=2, bins=8, least=3, window=2, reach=1))
