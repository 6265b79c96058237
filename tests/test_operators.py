"""Small literal cases of the time-series operators."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcube.functions import scalars
from loamcube.operators import aggs, columns, filters, joins, reshape, sampling, sets, tiles, timeops
from loamcube.plans import dataset, evaluation, fusion, quality
from loamcube.plans.scenarios import STRATEGIES, draw_scenarios, make_scenario
from loamcube.schemas import PIXEL, HidingParameters
from loamcube.sources import tables
from loamcube.streaming.incremental import ingest_new

SERIES_SCHEMA = "site int, px int, sensor string, doy int, b1 double, masked boolean"


def series(spark, rows, sensor="hr"):
    return spark.createDataFrame([(1, 1, sensor, d, v if v is None else float(v), m) for d, v, m in rows], SERIES_SCHEMA)


def values(df, *cols, by="doy"):
    return [tuple(r[c] for c in cols) for r in df.orderBy(by).collect()]


def test_calendar_join_keeps_present_dates_and_masks_absent_ones(spark):
    s = series(spark, [(d, d * 10, d == 5) for d in (0, 2, 5, 6, 8)])
    out = joins.calendar_join(s, timeops.listed_calendar(spark, (1, 2, 3, 5)), ["b1"], -10)
    assert values(out, "doy", "b1", "masked") == [(1, -10, True), (2, 20, False), (3, -10, True), (5, 50, True)]


def test_coalesce_series(spark):
    doys = (0, 1, 2, 5, 6)
    a, b = series(spark, [(d, 10, i >= 2) for i, d in enumerate(doys)]), series(spark, [(d, 20, i >= 4) for i, d in enumerate(doys)])
    out = joins.coalesce_series(a, b, ["b1"], (*PIXEL, "doy"))
    assert values(out, "b1", "masked") == [(10, False), (10, False), (20, False), (20, False), (10, True)]


def test_combine_series(spark):
    a, b = series(spark, [(1, 10, False), (2, 10, True), (3, 4, False)]), series(spark, [(1, 20, False), (2, 8, False), (4, 7, True)])
    out = joins.combine_series(a, b, ["b1"], (*PIXEL, "doy"))
    assert values(out, "doy", "b1", "masked") == [(1, 15, False), (2, 8, False), (3, 4, False), (4, 0, True)]


def test_gap_filling_interpolates_extends_and_ignores_masked(spark):
    s = series(spark, [(0, 0, False), (4, 99, True), (10, 10, False)])
    t = spark.createDataFrame([(1, 1, "hr", d) for d in (-3, 0, 4, 10, 20)], "site int, px int, sensor string, doy int")
    assert values(timeops.linear_gapfilling(s, t, ["b1"]), "b1") == [(0,), (0,), (4,), (10,), (10,)]
    assert values(timeops.linear_gapfilling(s.where("masked"), t, ["b1"]), "b1") == [(None,)] * 5


def test_nearest_date_prefers_the_earlier_and_can_exclude_the_same_day(spark):
    d = lambda *x: spark.createDataFrame([(1, i) for i in x], "site int, doy int")
    assert values(joins.nearest_date(d(1, 5), d(3, 5, 9)), "nearest_doy", "distance") == [(1, 2), (5, 0), (5, 4)]
    assert values(joins.nearest_date(d(1, 5), d(5), allow_same_day=False), "nearest_doy") == [(1,)]
    assert values(joins.nearest_date(d(5), d(5), allow_same_day=False), "nearest_doy") == [(None,)]


def test_closest_distance_and_density(spark):
    d = lambda *x: spark.createDataFrame([(1, i) for i in x], "site int, doy int")
    near = joins.nearest_date(d(1, 2), d(0, 1))
    assert values(near, "distance") == [(1,), (0,)]
    assert values(near.select("doy", aggs.density(F.col("distance")).alias("x")), "x") == [(math.exp(-0.01),), (1.0,)]


def test_previous_two(spark):
    d = lambda *x: spark.createDataFrame([(1, i) for i in x], "site int, doy int")
    out = joins.previous_clear(d(2, 4, 9), d(1, 3, 4, 20), [])
    assert values(out, "first_doy", "second_doy") == [(None, None), (2, None), (4, 2), (9, 4)]


def test_padded_date_union(spark):
    mk = lambda sets_: spark.createDataFrame([(s, d) for s, ds in sets_.items() for d in ds], "site int, doy int")
    out = sets.padded_date_union(mk({1: range(4), 2: range(4)}), mk({1: range(2, 7), 2: range(3, 8)})).orderBy("site").collect()
    assert out[0].doy == [0, 1, 2, 3, 4, 5, 6, 0] and out[0].valid == [True] * 7 + [False]
    assert out[1].doy == list(range(8)) and all(out[1].valid)


def test_pad(spark):
    s = series(spark, [(d, d, False) for d in range(5)])
    assert len(sampling.pad(s, ["b1"], 10, PIXEL).first().doy) == 10
    assert sampling.pad(s, ["b1"], 4, PIXEL).first().doy is None


def test_crop_checks_its_margin(spark):
    px = spark.range(32 * 32).select(F.floor(F.col("id") / 32).cast("int").alias("r"), (F.col("id") % 32).cast("int").alias("c"))
    assert filters.crop(px, 32, 2).agg(F.max("r"), F.count("*")).first() == (27, 28 * 28)
    with pytest.raises(ValueError):
        filters.crop(px, 32, 16)


def test_rmse_of_a_constant_offset(spark):
    s = series(spark, [(d, d, d == 3) for d in range(5)])
    al = joins.align(s.withColumn("b1", F.col("b1") + 10), s, ["b1"])
    assert {r.v for r in aggs.per_band(al, ["b1"], ("site", "sensor", "doy"), aggs.rmse, "v").collect()} == {10.0}


def test_band_arithmetic(spark):
    df = spark.createDataFrame([([float(i) for i in range(16)], 0.2, 0.6, 7)], "a array<double>, red double, nir double, doy int")
    r = columns.split_bands(df, "a", 10).first()
    assert (len(r.a_a), len(r.a_b)) == (10, 6)
    assert columns.add_ndvi(df, "red", "nir").first().ndvi == pytest.approx(0.5, abs=1e-5)
    for mode, n in (("YIELD", 16), ("ADD", 16), ("CONCAT", 32)):
        assert len(df.select(scalars.with_calendar(F.col("a"), F.col("doy"), mode, 16).alias("x")).first().x) == n


def test_path_tail_and_export(spark):
    df = spark.createDataFrame([("/a/b/c.tif", 0.5), ("b/c.tif", float("nan")), (None, None)], "p string, v double")
    out = df.select(scalars.path_tail(F.col("p")).alias("p"), scalars.export_value(F.col("v"), 10000).alias("v")).collect()
    assert [tuple(r) for r in out] == [("b/c.tif", 5000), ("b/c.tif", -10000), (None, -10000)]


def test_every_strategy_gives_a_scenario_and_an_unknown_one_fails(spark):
    rows = [(1, 1, s, d, 1.0, False) for s, ds in (("lr", (0, 10, 40, 70)), ("hr", (0, 20, 40, 80))) for d in ds]
    obs = spark.createDataFrame(rows, SERIES_SCHEMA)
    for name in STRATEGIES:
        p = HidingParameters(name, start=20, reference_size=30, gap=15, dates=(1, 40), year=2022)
        roles = {r.role for r in make_scenario(obs, p).select("role").distinct().collect()}
        assert "target" in roles, name
    with pytest.raises(ValueError):
        make_scenario(obs, HidingParameters("NOPE"))
    drawn = draw_scenarios(obs.select("site").distinct()).first()
    assert 0.2 <= drawn.rate <= 0.7 and 65 <= drawn.start <= 300 and 30 <= drawn.gap <= 90


def test_sampling_does_not_depend_on_partitions(spark):
    d = spark.range(300).select((F.col("id") % 3).alias("site"), F.lit("lr").alias("sensor"), F.col("id").alias("doy"))
    got = [sorted(map(tuple, sampling.random_dates(d.repartition(n), 0.3, 7).collect())) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 90


def _tile(spark, a):
    rows = [(1, int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "k int, r int, c int, v double")


def _array(df, n, value="v"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.r, r.c] = r[value]
    return out


def test_convolution_against_numpy(spark):
    a = np.random.default_rng(0).random((7, 7))
    k = tiles.psf_kernel(1.0, 2.0, 0.3)
    padded = np.pad(a, 2, mode="reflect")
    want = np.array([[(padded[r : r + 5, c : c + 5] * k).sum() for c in range(7)] for r in range(7)])
    assert np.allclose(_array(tiles.convolve(_tile(spark, a), 7, k, ("k",)), 7), want)
    assert tiles.psf_kernel(1.0, 2.0, 1.0).max() == 1.0


def test_gradient_against_numpy(spark):
    a = np.random.default_rng(1).random((6, 6))
    gy, gx = np.gradient(a)
    assert np.allclose(_array(tiles.gradient_magnitude(_tile(spark, a), ("k",)), 6, "grad"), gx**2 + gy**2)


def test_morphology_of_a_speck_and_a_block(spark):
    a = np.zeros((9, 9))
    a[1, 1] = 1
    a[4:7, 4:7] = 1
    px = _tile(spark, a).withColumn("masked", F.col("v") > 0)
    got = _array(tiles.clean_mask(px, 2, 3, ("k",)).withColumn("m", F.col("masked").cast("int")), 9, "m")
    assert got[1, 1] == 0 and got[3:8, 3:8].all() and got.sum() == 25


def test_resampling_keeps_constants_and_tiling_keeps_values(spark):
    a = np.full((8, 8), 3.0)
    assert np.allclose(_array(tiles.resample(_tile(spark, a), 8, 2, ("k",)), 4), 3)
    assert np.allclose(_array(tiles.resample(_tile(spark, a), 8, 0.5, ("k",)), 16), 3)
    b = np.arange(49.0).reshape(7, 7)
    back = reshape.unpatchify(reshape.patchify(_tile(spark, b), 7, 3, 2, ("k",)), 7, 3, 2, ("k",))
    assert np.allclose(_array(back, 7), b)
    blurred = fusion.tiled(_tile(spark, b), lambda t: t * 2, 7, 3, 1, ("k",))
    assert np.allclose(_array(blurred, 7), 2 * b)
    assert np.allclose(_array(tiles.shift_nearest(_tile(spark, b), 7, 1, 0, ("k",), fill=-1), 7), np.vstack([b[1:], np.full((1, 7), -1)]))


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([[1.0, 2], [0.5, -1], [0, 3]]) + [4, -2] + rng.normal(size=(400, 2)) * 0.01
    rows = [(1, *map(float, a), *map(float, b), False) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, x3 double, y1 double, y2 double, masked boolean")
    got = {(r.target, r.source): r for r in aggs.ridge_multi(df, ["x1", "x2", "x3"], ["y1", "y2"], ("g",)).collect()}
    fit = np.linalg.lstsq(np.column_stack([x, np.ones(400)]), y, rcond=None)[0]
    for i, s in enumerate(("x1", "x2", "x3")):
        for j, t in enumerate(("y1", "y2")):
            assert got[t, s].coefficient == pytest.approx(fit[i, j], abs=1e-3)
            assert got[t, s].intercept == pytest.approx(fit[3, j], abs=1e-3)


def test_evaluation_invariants_hold(spark):
    rows = [(1, p, "hr", d, float(d + p), (d * p) % 7 == 3) for p in range(4) for d in range(0, 200, 5)]
    obs = spark.createDataFrame(rows, SERIES_SCHEMA)
    p = HidingParameters("GAPS", gap=20)
    given, _ = evaluation.scenario_parts(obs, p)
    record = evaluation.date_record(evaluation.gapfill_scenario(obs, ["b1"], p), given, ["b1"])
    assert record.count() == 40 and evaluation.invariant_violations(record).count() == 0
    # beyond the last clear date values stay as they were
    assert record.where("doy < 180").agg(F.max("rmse")).first()[0] < 1e-9
    assert quality.series_violations(obs.union(obs.limit(1)), ["b1"]).count() == 1


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "aoi").mkdir()
    (tmp_path / "aoi/a.json").write_text(json.dumps({"name": "s1", "aoi": [0, 1, 2, 3], "crs": "EPSG:1", "start_date": "2022-01-01", "end_date": "2022-12-31"}))
    assert tables.read_aoi(spark, str(tmp_path / "aoi")).first().ymax == 3
    d = tmp_path / "root/s1/lr"
    d.mkdir(parents=True)
    head = "product_id\tacquisition_date\tclear_pixel_rate\tdark_pixel_rate\tsnow_pixel_rate\tvalid\tbands\tmask\tsnow_mask\n"
    (d / "index.csv").write_text(head + "p1\t2022-01-05\t0.5\t0\t0\ttrue\t/x/y/z.tif\t/x/y/m.tif\t\np2\t2022-01-06\t0.1\t0\t0\tfalse\t\t\t\n")
    (d / "other.csv").write_text(head + "p1\t2022-01-05\t0.5\t0\t0\ttrue\t/x/y/z.tif\t/x/y/m.tif\t\n")
    index = tables.read_product_index(spark, str(tmp_path / "root"))
    assert index.count() == 3 and index.where("bands = 'y/z.tif'").count() == 2
    assert filters.valid_products(index).count() == 2 and joins.common_dates(index).count() == 2
    calls = []
    for _ in range(2):
        tables.cached(spark, str(tmp_path / "cache"), {"a": 1}, lambda: calls.append(1) or spark.range(3)).count()
    assert len(calls) == 1


def test_sinks_round_trip(spark, tmp_path):
    rows = [(s, px, "hr", d, px // 4, px % 4, float(px + d) / 10, px == 3) for s in (1, 2) for px in range(16) for d in (0, 10)]
    obs = spark.createDataFrame(rows, "site int, px int, sensor string, doy int, r int, c int, b1 double, masked boolean")
    path = lambda n: str(tmp_path / n)
    tables.write_observations(obs, path("obs"))
    part = tables.read_observations(spark, path("obs"), ["b1"], sites=[2], sensor="hr", rows=(1, 3), cols=(0, 2))
    assert part.count() == 8 and set(part.columns) == {"site", "sensor", "doy", "px", "r", "c", "masked", "b1"}
    tables.write_samples(obs, path("raw"), ["b1"], "2022-01-01", (0, 2), (0, 2), 10.0)
    raw = spark.read.parquet(path("raw"))
    assert raw.count() == 16 and dict(raw.dtypes)["b1"] == "smallint" and {str(r.acq_date) for r in raw.collect()} == {"2022-01-01", "2022-01-11"}
    pred = obs.withColumn("clear", F.col("doy") == 0).drop("masked")
    tables.write_predictions(pred, path("pred"), ["b1"], "2022-01-01", 10.0, reference=obs)
    got = spark.read.parquet(path("pred"))
    assert got.where("mode = 'clr'").count() == 32 and {(r.px, r.ref_b1) for r in got.where("site = 1 and doy = 10 and px < 5").collect()} == {(0, 10), (1, 11), (2, 12), (3, -10000), (4, 14)}
    tables.write_features(obs, path("features"), ["b1"])
    assert dict(spark.read.parquet(path("features")).dtypes)["b1"] == "float"
    metrics = obs.select("doy", F.col("b1").alias("value"))
    tables.write_metrics(metrics, path("metrics"))
    back = tables.read_metrics(spark, path("metrics"), "doy int, value double").collect()
    assert len(back) == 64 and [r.doy for r in back] == sorted(r.doy for r in back)
    index = spark.createDataFrame([("p", dt.date(2022, 1, 1), 0.5, "1", "hr")], "product_id string, acquisition_date date, clear_pixel_rate double, site string, sensor string")
    tables.write_product_index(index, path("index"))
    assert spark.read.csv(path("index"), sep="\t", header=True).first().product_id == "p"


def test_resampling_at_read(spark):
    px = spark.createDataFrame([(1, r, c, 100.0, r == 0) for r in range(8) for c in range(8)], "k int, r int, c int, v double, masked boolean")
    assert dataset.resample_at_read(px, 8, 10, 10, ("k",)) is px
    fine, coarse = dataset.resample_at_read(px, 8, 20, 10, ("k",)).collect(), dataset.resample_at_read(px, 8, 10, 20, ("k",)).collect()
    assert len(fine) == 256 and {r.v for r in fine} == {100} and sum(r.masked for r in fine) == 32
    assert len(coarse) == 16 and all(abs(r.v - 100) < 1e-9 for r in coarse) and sum(r.masked for r in coarse) == 4


def test_ingest_marks_cloudy_products(spark):
    rows = [("s", "hr", dt.date(2022, 1, d), r, c, 4 if d == 1 else 9, 0.5) for d in (1, 2) for r in range(6) for c in range(6)]
    px = spark.createDataFrame(rows, "site string, sensor string, acquisition_date date, r int, c int, scl int, b1 double")
    index, kept = dataset.ingest(px, scalars.scene_mask(F.col("scl")), opening=2, dilation=2, scene="scl")
    assert {(r.product_id, r.valid) for r in index.collect()} == {("hr_20220101", True), ("hr_20220102", False)}
    assert kept.select("acquisition_date").distinct().count() == 1


def test_streaming_ingest_skips_what_is_stored(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "product_id string, v int").write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("product_id string, v int").parquet(src)
        ingest_new(spark, stream, out, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("b", 9), ("c", 3)], "product_id string, v int").write.mode("append").parquet(src)
    ingest_new(spark, spark.readStream.schema("product_id string, v int").parquet(src), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_spline_weights_interpolate_and_reproduce_cubics():
    n = 40
    exact = tiles.spline_weights(n, 0.0)
    assert exact.keys() == {(i, i) for i in range(n)} and all(abs(w - 1) < 1e-12 for w in exact.values())
    for offset, step, n_out in ((0.3, 1.0, n), (-0.25, 0.5, 2 * n)):
        m = np.zeros((n_out, n))
        for (o, i), w in tiles.spline_weights(n, offset, step, n_out).items():
            m[o, i] = w
        x = np.arange(n_out) * step + offset
        inner = (x > 15) & (x < n - 16)
        cubic = lambda t: t**3 / 500 - t**2 / 10 + t
        # mirrored borders bend the curve there; what they add falls by 3.7 a cell
        assert inner.any() and np.abs(m @ cubic(np.arange(n)) - cubic(x))[inner].max() < 1e-5
        assert np.allclose(m.sum(axis=1), 1)


def test_thermal_band_and_patch_size():
    assert scalars.thermal_band([f"b{i}" for i in range(8)]) == "b7" and scalars.thermal_band(["t"]) == "t" and scalars.thermal_band(["a", "b"]) is None
    assert quality.patch_size(990, 10, 3) == 99
    for bad in ((995, 10, 3), (100, 10, 3)):
        with pytest.raises(ValueError):
            quality.patch_size(*bad)


def test_filtered_fit_refuses_unknown_modes(spark):
    px = spark.createDataFrame([(1, 0, 0, 1.0, 1.0, False)], "k int, r int, c int, p_v double, r_v double, masked boolean")
    with pytest.raises(ValueError):
        evaluation.filtered_fit(px, "v", 8, ("k",), "NEVER")


def test_filtered_fit_of_an_affine_prediction_is_near_zero(spark):
    rng = np.random.default_rng(5)
    rows = [(1, r, c, 0.0, float(v), False) for (r, c), v in np.ndenumerate(rng.normal(0, 1, (8, 8)))]
    px = spark.createDataFrame(rows, "k int, r int, c int, p_v double, r_v double, masked boolean").withColumn("p_v", 2 * F.col("r_v") + 1)
    for when in ("PRE", "POST"):
        for kernel in (tiles.psf_kernel(1.0, 2.0, 0.2), None):
            if kernel is not None or when == "POST":
                assert evaluation.filtered_fit(px, "v", 8, ("k",), when, kernel).first().fit_loss < 1e-3
    assert evaluation.filtered_fit(px.withColumn("p_v", -F.col("c") * F.col("r_v")), "v", 8, ("k",), "PRE", tiles.psf_kernel(1.0, 2.0, 0.2), security=1e-9).first().fit_loss is None


def test_evaluation_job_scores_all_sites_and_names_those_without(spark):
    rows = [(s, 1, "hr", d, float(d), False) for s in (1, 2) for d in range(0, 100, 10)]
    obs = spark.createDataFrame(rows, SERIES_SCHEMA)
    wanted = spark.createDataFrame([(1,), (2,), (9,)], "site int")
    by_date, table, skipped = evaluation.evaluate(obs, ["b1"], HidingParameters("GAPS", gap=30), wanted)
    assert {r.site for r in by_date.collect()} == {1, 2} and [r.site for r in skipped.collect()] == [9]
    assert all(r["mean"] < 1e-9 for r in table.where("metric = 'rmse'").collect())


def test_ingest_hides_what_is_near_zeros_and_what_is_missing(spark):
    rows = [("s", "hr", dt.date(2022, 1, 1), r, c, {(0, 0): 0.0, (7, 7): float("nan")}.get((r, c), 0.5)) for r in range(8) for c in range(8)]
    px = spark.createDataFrame(rows, "site string, sensor string, acquisition_date date, r int, c int, b1 double")
    index, kept = dataset.ingest(px, F.lit(False), opening=1, dilation=1, zero_dilation=3)
    assert {(r.r, r.c) for r in kept.where("masked").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1), (7, 7)}
    assert (index.first().bands, index.first().mask) == ("20220101/hr_bands_20220101", "20220101/hr_mask_20220101")


def test_trim_names_series_of_which_nothing_is_left(spark):
    obs = series(spark, [(1, 1, True), (2, 2, False)]).union(series(spark, [(1, 1, True)], "lr"))
    kept, gone = filters.trim(obs)
    assert [r.doy for r in kept.collect()] == [2] and [r.sensor for r in gone.collect()] == ["lr"]


def test_no_frame_of_dates_ends_behind(spark):
    obs = spark.createDataFrame([(1, 1, s, d, float(d), d % 5 == 0) for s in ("hr", "lr") for d in range(0, 60, 3)], "site int, px int, sensor string, doy int, b1 double, masked boolean")
    for strict in (False, True):
        out = joins.bracket(obs.where("not masked"), obs, ["b1"], strict_after=strict)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        clear = [d for d in range(0, 60, 3) if d % 5]
        want = {d: (max((x for x in clear if x < d), default=None), min((x for x in clear if x > d or (x == d and not strict)), default=None)) for d in range(0, 60, 3)}
        got = out.where("sensor = 'hr'").collect()
        assert {r.doy: (r.prev_doy, r.next_doy) for r in got} == want
        assert all(r.next_b1 == r.next_doy for r in got)
    assert "unboundedfollowing" not in fusion.stair(obs, "b1")._jdf.queryExecution().toString().lower()


def test_gap_filling_reads_each_observation_once(spark, tmp_path):
    rows = [(s, p, n, d, float(d % 11 + p), (d + p) % 4 == 0) for s in range(2) for p in range(3) for n in ("lr", "hr") for d in range(0, 200, 7)]
    rows += [(0, 9, "lr", 40, 1.0, False), (0, 9, "lr", 130, None, False), (1, 9, "hr", 95, 2.0, None), (None, 1, "lr", 95, 2.0, False), (1, 1, "lr", None, 2.0, False)]
    spark.createDataFrame(rows, "site int, px int, sensor string, doy int, b1 double, masked boolean").write.parquet(str(tmp_path / "obs"))
    obs = spark.read.parquet(str(tmp_path / "obs"))
    for p in (HidingParameters("GAPS", gap=30), HidingParameters("ALL"), HidingParameters("NOHR"), HidingParameters("NOLR"), HidingParameters("FORECAST", start=90), HidingParameters("BACKCAST", start=90)):
        got = evaluation.gapfill_scenario(obs, ["b1"], p)
        assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        given, target = evaluation.scenario_parts(obs, p)
        want = joins.clear_masked_split(joins.align(timeops.linear_gapfilling(given, target.select(*PIXEL, "doy"), ["b1"]), target, ["b1"]), given)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        own, other = evaluation.date_record(got, None, ["b1"]), evaluation.date_record(want, given, ["b1"])
        assert sorted(map(repr, own.collect())) == sorted(map(repr, other.collect()))
