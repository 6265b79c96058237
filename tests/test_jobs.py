"""Jobs and stores: window scans, caches, restarts of the stream, run ledgers, tiles of two grids, selection."""

import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcube.operators import aggs, joins
from loamcube.plans import evaluation, fusion
from loamcube.sources import colocated, tables
from loamcube.streaming.incremental import ingest_new

# window scans


def test_a_window_reads_few_rows(spark, tmp_path):
    n = 512
    px = spark.range(n * n).select((F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    obs = px.select(F.lit(1).alias("site"), F.lit("hr").alias("sensor"), F.lit(0).alias("doy"), "r", "c", F.rand(1).alias("b1"), F.lit(False).alias("masked")).orderBy(F.rand(2))
    path = str(tmp_path / "obs")
    tables.write_observations(obs, path, group_bytes=1 << 17, page_rows=1000)
    part = tables.read_observations(spark, path, ["b1"], [1], "hr", rows=(200, 251), cols=(100, 151))
    assert part.count() == 51 * 51
    part.write.format("noop").mode("overwrite").save()
    read = scanned(spark, part)
    assert 51 * 51 <= read < 0.05 * n * n


def scanned(spark, df):
    """Rows that the scan gave, from its metrics."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    leaves, plan = [], execution.executedPlan()
    todo = [plan]
    while todo:
        p = todo.pop()
        if "Scan" in p.nodeName():
            leaves.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
    return sum(p.metrics().apply("numOutputRows").value() for p in leaves)


def test_z_order_keeps_neighbours_together(spark):
    rows = spark.range(64).select((F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"))
    got = {(x["r"], x["c"]): x["z"] for x in rows.withColumn("z", tables.z_order(F.col("r"), F.col("c"))).collect()}
    assert sorted(got.values()) == list(range(64))
    assert all(z == sum(((c >> i & 1) << 2 * i) | ((r >> i & 1) << 2 * i + 1) for i in range(3)) for (r, c), z in got.items())


# caches


def test_cache_follows_its_inputs(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []

    def result():
        compute = lambda: calls.append(1) or spark.read.parquet(source).agg(F.sum("id").alias("s"))
        return tables.cached(spark, root, {"a": 1}, compute, [source]).first()["s"]

    spark.range(3).write.parquet(source)
    assert [result(), result(), len(calls)] == [3, 3, 1]
    spark.range(10, 11).write.mode("append").parquet(source)
    assert [result(), len(calls)] == [13, 2]
    spark.range(4).write.mode("overwrite").parquet(source)
    assert [result(), len(calls)] == [6, 3]


def test_the_second_of_two_writers_keeps_the_firsts_result(spark, tmp_path):
    root = str(tmp_path / "cache")

    def slow():
        tables.cached(spark, root, {"a": 1}, lambda: spark.range(5)).count()
        return spark.range(7)

    assert tables.cached(spark, root, {"a": 1}, slow).count() == 5
    (only,) = os.listdir(root)
    assert not any(os.path.isdir(f"{root}/{only}/{f}") for f in os.listdir(f"{root}/{only}"))


# streams


def arrive(spark, source, rows):
    spark.createDataFrame(rows, "product_id string, v int").coalesce(1).write.mode("append").parquet(source)


def stored(spark, tmp_path):
    return sorted((r["product_id"] or "", r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def ingest(spark, tmp_path):
    stream = spark.readStream.schema("product_id string, v int").parquet(str(tmp_path / "in"))
    ingest_new(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    return [name for name, _ in stored(spark, tmp_path)]


def test_a_batch_that_runs_again_writes_nothing_twice(spark, tmp_path):
    spark.createDataFrame([("a", 0)], "product_id string, v int").write.parquet(str(tmp_path / "out"))
    arrive(spark, str(tmp_path / "in"), [("a", 1), ("b", 2)])
    assert ingest(spark, tmp_path) == ["a", "b"]
    arrive(spark, str(tmp_path / "in"), [("b", 3), ("c", 4), ("c", 5), (None, 6)])
    assert ingest(spark, tmp_path) == ["", "a", "b", "c"]
    before = stored(spark, tmp_path)
    # the stream fell over between a batch's write and its commit
    last = max(int(f) for f in os.listdir(tmp_path / "ck/commits") if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "ck/commits" / name).unlink(missing_ok=True)
    ingest(spark, tmp_path)
    assert stored(spark, tmp_path) == before


def test_the_first_batch_may_run_again(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [("a", 1), ("b", 2)])
    ingest(spark, tmp_path)
    shutil.rmtree(tmp_path / "ck/commits")
    assert ingest(spark, tmp_path) == ["a", "b"]


def test_later_batches_read_nothing_of_the_target(spark, tmp_path):
    arrive(spark, str(tmp_path / "in"), [(f"p{i}", i) for i in range(50)])
    assert len(ingest(spark, tmp_path)) == 50
    stored = [f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]
    for f in stored:
        os.rename(tmp_path / "out" / f, tmp_path / f"kept-{f}")
        (tmp_path / "out" / f).write_bytes(b"not parquet")
    arrive(spark, str(tmp_path / "in"), [("p1", 0), ("new", 1)])
    with pytest.raises(Exception, match="parquet|Parquet"):
        ingest(spark, tmp_path)
    for f in stored:
        (tmp_path / "out" / f).unlink()
    assert [r["product_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["new"]


# run ledger


def test_a_bad_site_is_entered_and_the_rest_written(spark, tmp_path):
    out, ledger, ran = str(tmp_path / "scores"), str(tmp_path / "ledger"), []

    def job(sites, poison=(3,)):
        ran.append(list(sites))
        return spark.createDataFrame([(s, float(s)) for s in sites], "site int, v double").withColumn("v", F.when(F.col("site").isin(list(poison)), F.raise_error(F.lit("no image"))).otherwise(F.col("v")))

    states = {r["site"]: (r["state"], r["attempts"], r["error"]) for r in evaluation.run_by_sites(spark, list(range(6)), job, out, ledger, group=4).collect()}
    assert {s for s, (state, *_) in states.items() if state == "done"} == {"0", "1", "2", "4", "5"}
    assert states["3"][:2] == ("failed", 2) and "no image" in states["3"][2]
    assert sorted((r["site"], r["v"]) for r in spark.read.parquet(out).collect()) == [(s, float(s)) for s in (0, 1, 2, 4, 5)]
    ran.clear()
    # the failed site may be tried once more, done ones aren't
    evaluation.run_by_sites(spark, [*range(6), 7], lambda s: job(s, ()), out, ledger, group=4, attempts=3)
    assert ran == [[3, 7]] and spark.read.parquet(out).count() == 7
    ran.clear()
    again = evaluation.run_by_sites(spark, [*range(6), 7], job, out, ledger)
    assert ran == [] and {r["state"] for r in again.collect()} == {"done"}


# two grids


def test_tiles_of_two_grids_with_their_halos(spark):
    g = np.random.default_rng(5)
    size, factor, patch, margin = 50, 3, 18, 6
    hr, lr = g.normal(size=(2, size, size)), g.normal(size=(1, 17, 17))
    hr_df = spark.createDataFrame([(1, d, r, c, float(hr[d, r, c]), False) for d, r, c in np.ndindex(hr.shape)], "site int, doy int, r int, c int, b1 double, masked boolean")
    lr_df = spark.createDataFrame([(1, 9, r, c, float(lr[0, r, c]), (r + c) % 5 == 0) for _, r, c in np.ndindex(lr.shape)], "site int, doy int, r int, c int, t double, masked boolean")

    def fn(a, b):
        # reads the whole halo: mean of the 13 x 13 around, and of the 5 x 5 coarse ones
        fine = windows(a.values[:, 0].mean(0), 6)
        coarse = np.kron(windows(np.where(b.masked[0], np.nan, b.values[0, 0]), 2), np.ones((factor, factor)))
        return fusion.Cube(b.doy, (fine + coarse)[None, None], np.isnan(fine)[None])

    out = fusion.tiled_pair(hr_df, lr_df, fn, size, factor, patch, margin, ("site",), ["b1"], ["t"], ["p"]).collect()
    want = windows(hr.mean(0), 6) + np.kron(windows(np.where(np.add.outer(np.arange(17), np.arange(17)) % 5 == 0, np.nan, lr[0]), 2), np.ones((3, 3)))[:size, :size]
    assert len(out) == size * size and {r["doy"] for r in out} == {9} and not any(r["masked"] for r in out)
    assert all(r["p"] == pytest.approx(want[r["r"], r["c"]], abs=1e-12) for r in out)


def windows(v, half):
    """Mean of what is known around each place."""
    out = np.full(v.shape, np.nan)
    for r, c in np.ndindex(v.shape):
        part = v[max(r - half, 0) : r + half + 1, max(c - half, 0) : c + half + 1]
        out[r, c] = np.nanmean(part) if np.isfinite(part).any() else np.nan
    return out


def test_tiles_that_one_sensor_lacks(spark):
    hr = spark.createDataFrame([(1, 0, r, c, 1.0, False) for r in range(4) for c in range(4)], "site int, doy int, r int, c int, b1 double, masked boolean")
    lr = spark.createDataFrame([], "site int, doy int, r int, c int, t double, masked boolean")
    out = fusion.tiled_pair(hr, lr, lambda a, b: fusion.Cube(a.doy, a.values + len(b.doy), a.masked), 4, 2, 2, 2, ("site",), ["b1"], ["t"], ["p"]).collect()
    assert len(out) == 16 and {r["p"] for r in out} == {1.0}
    with pytest.raises(ValueError, match="whole coarse"):
        fusion.tiled_pair(hr, lr, None, 4, 2, 3, 2, ("site",), ["b1"], ["t"], ["p"])


# selection and states


@pytest.mark.parametrize(("bins", "rounds"), [(1024, 2), (3, 1), (2, 5), (7, 0)])
def test_quantiles_by_selection_are_exact(spark, bins, rounds):
    g = random.Random(3)
    groups = {0: [5.0], 1: [1.0, 2.0], 2: [3.0] * 40, 3: [g.gauss(0, 1) for _ in range(333)], 4: [float(int(g.expovariate(0.3))) for _ in range(500)] + [1e12], 5: [-1e-9, 0.0, 1e-9] * 9}
    rows = [(k, v, False) for k, vs in groups.items() for v in vs] + [(0, 9.0, True), (3, float("nan"), False), (3, None, False), (9, None, False)]
    got = aggs.quantiles(spark.createDataFrame(rows, "k int, b double, masked boolean"), "b", ("k",), bins=bins, rounds=rounds).collect()
    assert {r["k"] for r in got} == set(groups)
    for r in got:
        assert (r["q05"], r["q95"]) == pytest.approx(tuple(np.quantile(groups[r["k"]], [0.05, 0.95])), rel=1e-12, abs=1e-15)


def test_states_of_batches_in_any_order_make_the_table(spark):
    g = random.Random(4)
    rows = [("rmse", g.choice(["b1", "b2"]), g.random() < 0.5, None if g.random() < 0.1 else 1e6 + g.gauss(0, 1)) for _ in range(400)]
    of = lambda part: aggs.result_states(spark.createDataFrame(part, "metric string, band string, clear boolean, value double"))
    want = {tuple(r)[:3]: tuple(r)[3:] for r in aggs.result_table(spark.createDataFrame(rows, "metric string, band string, clear boolean, value double")).collect()}
    for cuts in ((0, 1, 7, 400), (0, 200, 201, 400)):
        states = None
        for a, b in sorted(zip(cuts, cuts[1:], strict=False), key=lambda _: g.random()):
            states = of(rows[a:b]) if states is None else aggs.combined_states(states.unionByName(of(rows[a:b])))
        got = {tuple(r)[:3]: tuple(r)[3:] for r in aggs.table_of_states(states).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in got)


# joins of stored tables


def test_stored_tables_meet_without_a_shuffle(spark, tmp_path):
    rows = [(s, px, "hr", d, px + d / 10, px == 3) for s in (1, 2) for px in range(20) for d in (0, 5)]
    obs = spark.createDataFrame(rows, "site int, px int, sensor string, doy int, b1 double, masked boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (colocated.write_colocated(df, n, str(tmp_path / n), buckets=4) for df, n in ((obs, "stored_ref"), (obs.drop("masked").withColumn("b1", F.col("b1") + 1), "stored_pred")))
        met = joins.align(b, a, ["b1"])
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, met.collect())) == sorted(map(tuple, joins.align(obs.withColumn("b1", F.col("b1") + 1), obs, ["b1"]).collect()))

        cell = ("site", "_r", "_c")
        fine = spark.createDataFrame([(1, r, c, float(r * c)) for r in range(6) for c in range(6)], "site int, r int, c int, v double")
        coarse = spark.createDataFrame([(1, r, c, float(r + c)) for r in range(3) for c in range(3)], "site int, r int, c int, v double")
        f = colocated.write_colocated(colocated.with_cell(fine, 2), "stored_fine", str(tmp_path / "fine"), cell, 4)
        g = colocated.write_colocated(coarse.withColumns({"_r": F.col("r"), "_c": F.col("c")}), "stored_coarse", str(tmp_path / "coarse"), cell, 4)
        met = joins.cross_resolution(f, g.select("site", F.col("_r").alias("r"), F.col("_c").alias("c"), "v"), 2, ("site",), ["v"])
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        want = joins.cross_resolution(fine, coarse, 2, ("site",), ["v"])
        assert sorted(map(tuple, met.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in ("stored_ref", "stored_pred", "stored_fine", "stored_coarse"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")


@pytest.mark.parametrize("name", sorted(fusion.METHODS))
def test_registered_methods_predict_and_score(spark, name):
    rows = [(1, px, sensor, d, 1.0 + px + d / 10, 2.0, 3.0, 4.0, False) for px in range(3) for sensor, every in (("hr", 5), ("lr", 3)) for d in range(0, 121, every)]
    obs = spark.createDataFrame(rows, "site int, px int, sensor string, doy int, b1 double, b2 double, b3 double, b4 double, masked boolean")
    out = evaluation.evaluate_method(name, obs, ["b1"]).where("band = 'b1' and metric = 'rmse'").collect()
    # the series are straight lines, which every method meets where both sides are known
    assert out and min(r["value"] for r in out) == pytest.approx(0, abs=1e-9)
