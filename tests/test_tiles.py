"""Tile operators against arrays: strips, running morphology, their plans."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamcube.functions import scalars
from loamcube.operators import tiles
from loamcube.plans import dataset

PX = "k int, r int, c int, v double"


def frame(spark, v, k=1):
    """Pixel rows of an array, made from columns so that large ones are quick."""
    n, m = v.shape
    flat = spark.createDataFrame([(k, v.ravel().tolist())], "k int, d array<double>")
    return flat.select("k", F.posexplode("d").alias("i", "v")).select("k", F.floor(F.col("i") / m).cast("int").alias("r"), (F.col("i") % m).alias("c"), "v")


def array(df, shape, value="v"):
    out = np.full(shape, np.nan)
    pdf = df.toPandas()
    out[pdf.r, pdf.c] = pdf[value].astype(float)
    return out


def convolved(v, kernel):
    half = len(kernel) // 2
    padded = np.pad(v, half, mode="reflect")
    return sum(kernel[i, j] * padded[i : i + v.shape[0], j : j + v.shape[1]] for i in range(len(kernel)) for j in range(len(kernel)))


@pytest.mark.parametrize("cells", [1, 60, 1 << 17])
def test_convolution_across_strips(spark, monkeypatch, cells):
    monkeypatch.setattr(tiles, "STRIP_CELLS", cells)
    v = np.random.default_rng(1).normal(size=(23, 23))
    for kernel in (tiles.psf_kernel(1.0, 3.0, 0.2), np.random.default_rng(2).normal(size=(5, 5))):
        assert array(tiles.convolve(frame(spark, v), 23, kernel, ("k",)), v.shape) == pytest.approx(convolved(v, kernel), abs=1e-12)
        assert array(tiles.high_pass(frame(spark, v), 23, kernel, ("k",)), v.shape) == pytest.approx(v - convolved(v, kernel), abs=1e-12)


def test_large_raster_is_shuffled_as_strips(spark):
    v = np.random.default_rng(3).normal(size=(990, 990))
    kernel = tiles.psf_kernel(1.0, 9.0, 0.1)
    out = tiles.convolve(frame(spark, v), 990, kernel, ("k",))
    # one shuffle, before which a task has packed its pixels into strips
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("partial_collect_list") > plan.index("Exchange hashpartitioning")
    assert array(out, v.shape) == pytest.approx(convolved(v, kernel), abs=1e-10)
    strips = tiles.strips_of([tiles.convolution_weights(990, kernel[:, 9])], 990)
    assert sum(bottom - top for top, bottom, _, _ in strips) == 990
    assert all(high - low <= 2 * (bottom - top) + 18 for top, bottom, low, high in strips)


def test_null_missing_and_odd_pixels(spark):
    rows = [(1, r, c, 1.0) for r in range(6) for c in range(6) if (r, c) != (0, 0)] + [(2, r, c, None) for r in range(6) for c in range(6)] + [(3, 0, 0, 2.0)]
    rows = [(k, r, c, math.nan if (k, r, c) == (1, 5, 5) else v) for k, r, c, v in rows]
    half = {(o, i): 0.5 for o in range(3) for i in (2 * o, 2 * o + 1)}
    out = {(r["k"], r["r"], r["c"]): r["v"] for r in tiles.weighted(spark.createDataFrame(rows, PX), 6, [(half, half)], ("k",)).collect()}
    assert out[1, 0, 0] == 0.75 and out[1, 1, 1] == 1.0 and math.isnan(out[1, 2, 2])
    assert all(out[2, r, c] is None for r in range(3) for c in range(3))
    assert {k for k in out if k[0] == 3} == {(3, 0, 0)} and out[3, 0, 0] == 0.5
    assert tiles.weighted(spark.createDataFrame([], PX), 6, [(half, half)], ("k",)).collect() == []


def moved(mask, k, any_, low, high):
    n, m = mask.shape
    out = np.zeros_like(mask)
    for r in range(n):
        for c in range(m):
            part = mask[max(r + low, 0) : r + high + 1, max(c + low, 0) : c + high + 1] if r + high >= 0 and c + high >= 0 else mask[:0, :0]
            out[r, c] = part.any() if any_ else part.size == k * k and part.all()
    return out


def dilated(mask, k):
    return moved(mask, k, True, -(k // 2), (k - 1) // 2) if k > 1 else mask


def eroded(mask, k):
    return moved(mask, k, False, -((k - 1) // 2), k // 2) if k > 1 else mask


@pytest.mark.parametrize(("opening", "dilation"), [(2, 3), (3, 2), (1, 5), (4, 1), (5, 50), (1, 1)])
def test_masks_by_running_passes(spark, opening, dilation):
    g = np.random.default_rng(opening * 100 + dilation)
    masks = {k: g.random((17, 17)) < share for k, share in enumerate((0.0, 0.05, 0.3, 0.9, 1.0))}
    df = spark.createDataFrame([(k, r, c, bool(m[r, c])) for k, m in masks.items() for r, c in np.ndindex(m.shape)], "k int, r int, c int, masked boolean")
    got = {(r["k"], r["r"], r["c"]): r["masked"] for r in tiles.clean_mask(df, opening, dilation, ("k",)).collect()}
    for k, m in masks.items():
        want = dilated(eroded(dilated(dilated(eroded(m, opening), opening), dilation), dilation), dilation)
        assert all(got[k, r, c] == want[r, c] for r, c in np.ndindex(m.shape))


def test_erosion_stops_at_missing_pixels(spark):
    df = spark.createDataFrame([(1, 0, c, True) for c in (0, 1, 2, 4, 5, 6, 7)], "k int, r int, c int, masked boolean")
    out = tiles._nearest(df, ("k",), "c", "masked", 3, False)
    assert sorted(r["c"] for r in out.where("masked").collect()) == [1, 5, 6]


def test_mask_frames_never_look_behind(spark):
    df = spark.createDataFrame([(1, 0, 0, True)], "k int, r int, c int, masked boolean")
    plan = tiles.clean_mask(df, 5, 50, ("k",))._jdf.queryExecution().executedPlan().toString()
    # frames grow by the row itself; five operations share axes, so six partitionings do
    assert "unboundedfollowing" not in plan and "RangeFrame" not in plan
    assert plan.count("Exchange hashpartitioning") <= 6


def test_resampled_shorts_hold_what_they_can(spark):
    v = np.full((4, 4), 32760.0)
    v[0, 0], v[3, 3] = math.nan, -40000.0
    v[1, 2] = 20000.0
    px = frame(spark, v).withColumn("masked", F.lit(False))
    out = dataset.resample_at_read(px, 4, 2.0, 1.0, ("k",), "v").collect()
    assert len(out) == 64
    assert all(-32768 <= r["v"] <= 32767 for r in out)
    assert {r["v"] for r in out if r["r"] < 2 and r["c"] < 2} == {scalars.NO_DATA}


def test_rows_of_a_function_leave_after_few_tiles():
    """The worker's part is called by itself: one batch of many tiles comes back in many."""
    kept = {}

    class Tiles:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            kept["run"] = run

    tiles.dense(Tiles(), lambda t: None if t[0, 0] == 3 else {"i": [0, 1], "v": t.sum(axis=1)}, "data", 2, ("k",), "k long, i int, v double")
    n = 2 * tiles.TILE_BATCH + 5
    out = list(kept["run"]([pd.DataFrame({"k": range(n), "data": [np.full(4, float(k)) for k in range(n)]})]))
    assert [len(p) for p in out] == [2 * tiles.TILE_BATCH - 2, 2 * tiles.TILE_BATCH, 10]
    rows = [r for p in out for r in p.itertuples(index=False, name=None)]
    assert rows == [(k, i, 2.0 * k) for k in range(n) if k != 3 for i in (0, 1)]
