"""Queries over the cube: joins, gap filling, strategies, scores, dataset, columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamcube import fixtures as fx
from loamcube.functions import scalars
from loamcube.operators import aggs, columns, filters, joins, reshape, sampling, sets, timeops
from loamcube.plans import dataset, evaluation, fusion, quality
from loamcube.plans.registry import gapfill_sql, query
from loamcube.plans.scenarios import draw_scenarios, make_scenario
from loamcube.schemas import PIXEL, SERIES, HidingParameters, Standardization

B = fx.BANDS
GAP, HORIZON = 30, 2600
GAPS = HidingParameters("GAPS", gap=GAP, horizon=HORIZON)
_HIDDEN = f"(doy > {GAP} AND ((doy - {GAP}) % {2 * GAP} + {2 * GAP}) % {2 * GAP} > 0 AND ((doy - {GAP}) % {2 * GAP} + {2 * GAP}) % {2 * GAP} < {GAP} AND doy - ((doy - {GAP}) % {2 * GAP} + {2 * GAP}) % {2 * GAP} < {HORIZON})"
_CLEAR_INPUT = f"k AS (SELECT * FROM cube WHERE NOT {_HIDDEN} AND NOT masked)"
_GAP_PRED = _CLEAR_INPUT + ",\n" + gapfill_sql("g", "k", "cube", "b1") + f""",
    al AS (SELECT c.site, c.px, c.sensor, c.doy, NOT {_HIDDEN.replace('doy', 'c.doy')} AS clear, g.b1 AS p, c.b1 AS r, c.masked FROM cube c JOIN g USING (site, px, sensor, doy)),
    sc AS (SELECT * FROM al WHERE NOT masked AND p IS NOT NULL)"""


def gap_aligned(spark: SparkSession, sf: str, bands: tuple[str, ...] = ("b1",)) -> DataFrame:
    """Gap-filled prediction of the cube beside its values."""
    keep = fx.cube(spark, sf).select(*PIXEL, "doy", *bands, "masked")
    return evaluation.gapfill_scenario(keep, list(bands), GAPS)


@query("q_minimum_slice", _GAP_PRED + ", q AS (SELECT site, sensor, doy, 'b1' AS band, sqrt(avg((p - r) * (p - r))) AS rmse FROM sc WHERE NOT clear GROUP BY site, sensor, doy)", "rmse")
def q_minimum_slice(spark, sf):
    """Hide every second gap, fill the hidden dates, score them."""
    return aggs.per_band(gap_aligned(spark, sf).where("not clear"), ["b1"], (*SERIES, "doy"), aggs.rmse, "rmse")


_CLEAR = "k AS (SELECT * FROM cube WHERE NOT masked)"


@query("q_gapfill_linear", _CLEAR + ",\n" + gapfill_sql("g", "k", "cube", "b1") + ", q AS (SELECT * FROM g)", "b1")
def q_gapfill_linear(spark, sf):
    c = fx.cube(spark, sf)
    return timeops.linear_gapfilling(c, c.select(*PIXEL, "doy"), ["b1"])


@query("q_gapfill_calendar_10d", _CLEAR + ", t AS (SELECT site, px, sensor, CAST(d AS INT) AS doy FROM (SELECT DISTINCT site, px, sensor FROM cube), range(0, 361, 10) r(d)),\n" + gapfill_sql("g", "k", "t", "b1") + ", q AS (SELECT * FROM g)", "b1")
def q_gapfill_calendar_10d(spark, sf):
    c = fx.cube(spark, sf)
    grid = joins.query_grid(c.select(*PIXEL).distinct(), timeops.regular_calendar(spark))
    return timeops.linear_gapfilling(c, grid, ["b1"])


@query("q_calendar_join", "t AS (SELECT site, px, sensor, CAST(d AS INT) AS doy FROM (SELECT DISTINCT site, px, sensor FROM cube), range(0, 361, 10) r(d)), q AS (SELECT site, px, sensor, doy, coalesce(b1, -10) AS b1, coalesce(masked, true) AS masked FROM t LEFT JOIN cube USING (site, px, sensor, doy))", "b1")
def q_calendar_join(spark, sf):
    return joins.calendar_join(fx.cube(spark, sf), timeops.regular_calendar(spark), ["b1"], -10.0).select(*PIXEL, "doy", "b1", "masked")


@query("q_calendar_join_union", "t AS (SELECT * FROM (SELECT DISTINCT site, px, sensor FROM cube) JOIN (SELECT DISTINCT site, sensor, doy FROM cube) USING (site, sensor)), f AS (SELECT site, px, sensor, doy, coalesce(b1, 0) AS b1, coalesce(masked, true) AS masked FROM t LEFT JOIN cube USING (site, px, sensor, doy)), q AS (SELECT site, sensor, doy, count(*) AS n, count(*) FILTER (masked) AS n_masked, sum(b1) AS b1 FROM f GROUP BY ALL)", "b1")
def q_calendar_join_union(spark, sf):
    out = joins.calendar_join(fx.cube(spark, sf), None, ["b1"])
    return out.groupBy(*SERIES, "doy").agg(F.count("*").alias("n"), F.count_if("masked").alias("n_masked"), F.sum("b1").alias("b1"))


@query("q_bracket", _CLEAR + """, q AS (SELECT t.site, t.px, t.sensor, t.doy, a.doy AS prev_doy, a.b1 AS prev_b1, n.doy AS next_doy, n.b1 AS next_b1 FROM cube t
    ASOF LEFT JOIN k a ON t.site = a.site AND t.px = a.px AND t.sensor = a.sensor AND t.doy > a.doy ASOF LEFT JOIN k n ON t.site = n.site AND t.px = n.px AND t.sensor = n.sensor AND t.doy <= n.doy)""", "prev_b1 next_b1")
def q_bracket(spark, sf):
    c = fx.cube(spark, sf)
    return joins.bracket(c.where("not masked"), c, ["b1"])


def _nearest_sql(same_day: bool) -> str:
    return f"""s AS (SELECT site, doy FROM cube WHERE sensor = 'hr' GROUP BY site, doy HAVING avg(masked::INT) <= 0.5),
    t AS (SELECT DISTINCT site, doy FROM cube WHERE sensor = 'lr'),
    j AS (SELECT t.site, t.doy, s.doy AS nearest_doy, abs(s.doy - t.doy) AS distance, row_number() OVER (PARTITION BY t.site, t.doy ORDER BY abs(s.doy - t.doy), s.doy) AS n
          FROM t LEFT JOIN s ON s.site = t.site {'' if same_day else 'AND s.doy <> t.doy'}),
    q AS (SELECT site, doy, nearest_doy, distance FROM j WHERE n = 1)"""


@query("q_nearest_clear_date", _nearest_sql(True))
def q_nearest_clear_date(spark, sf):
    c = fx.cube(spark, sf)
    return joins.nearest_date(joins.clear_dates(c.where("sensor = 'hr'"), 0.5), c.where("sensor = 'lr'").select("site", "doy").distinct())


@query("q_nearest_other_day", _nearest_sql(False))
def q_nearest_other_day(spark, sf):
    c = fx.cube(spark, sf)
    return joins.nearest_date(joins.clear_dates(c.where("sensor = 'hr'"), 0.5), c.where("sensor = 'lr'").select("site", "doy").distinct(), allow_same_day=False)


_NEAR_PIXEL = """j AS (SELECT t.site, t.px, t.sensor, t.doy, s.doy AS near_doy, s.b1 AS near_b1, row_number() OVER (PARTITION BY t.site, t.px, t.sensor, t.doy ORDER BY abs(s.doy - t.doy), s.doy) AS n
    FROM cube t JOIN cube s ON t.site = s.site AND t.px = s.px AND t.sensor = s.sensor AND abs(s.doy - t.doy) < 20 WHERE t.masked AND NOT s.masked)"""


@query("q_nearest_clear_pixel", _NEAR_PIXEL + ", q AS (SELECT * EXCLUDE (n) FROM j WHERE n = 1)", "near_b1")
def q_nearest_clear_pixel(spark, sf):
    c = fx.cube(spark, sf)
    return joins.nearest_clear(c, c.where("masked"), ["b1"])


@query("q_prev_two_clear", """s AS (SELECT site, doy FROM cube WHERE sensor = 'hr' GROUP BY site, doy HAVING avg(masked::INT) <= 0.5), t AS (SELECT DISTINCT site, doy FROM cube WHERE sensor = 'lr'),
    l AS (SELECT t.site, t.doy, list(s.doy ORDER BY s.doy DESC) FILTER (s.doy IS NOT NULL) AS d FROM t LEFT JOIN s ON s.site = t.site AND s.doy <= t.doy GROUP BY ALL), q AS (SELECT site, doy, d[1] AS first_doy, d[2] AS second_doy FROM l)""")
def q_prev_two_clear(spark, sf):
    c = fx.cube(spark, sf)
    return joins.previous_clear(joins.clear_dates(c.where("sensor = 'hr'"), 0.5), c.where("sensor = 'lr'").select("site", "doy").distinct(), [])


@query("q_conjunction_pairs", "q AS (SELECT site, px, doy, l.b1 AS lr_b1, l.b2 AS lr_b2, l.masked AS lr_masked, h.b1 AS hr_b1, h.b2 AS hr_b2, h.masked AS hr_masked FROM (SELECT * FROM cube WHERE sensor = 'lr') l JOIN (SELECT * FROM cube WHERE sensor = 'hr') h USING (site, px, doy))", "lr_b1 lr_b2 hr_b1 hr_b2")
def q_conjunction_pairs(spark, sf):
    return joins.conjunction_pairs(fx.cube(spark, sf), ["b1", "b2"])


def _conj_sql(sensor: str, other: str, has: str) -> str:
    return f"q AS (SELECT site, px, sensor, doy, b1, masked FROM cube c WHERE sensor = '{sensor}' AND {has} EXISTS (SELECT 1 FROM cube o WHERE o.site = c.site AND o.doy = c.doy AND o.sensor = '{other}'))"


@query("q_conjunction_lr", _conj_sql("lr", "hr", ""), "b1")
def q_conjunction_lr(spark, sf):
    return joins.conjunctions(fx.cube(spark, sf), "lr").select(*PIXEL, "doy", "b1", "masked")


@query("q_conjunction_hr", _conj_sql("hr", "lr", ""), "b1")
def q_conjunction_hr(spark, sf):
    return joins.conjunctions(fx.cube(spark, sf), "hr").select(*PIXEL, "doy", "b1", "masked")


@query("q_non_conjunction_hr", _conj_sql("hr", "lr", "NOT"), "b1")
def q_non_conjunction_hr(spark, sf):
    return joins.non_conjunctions(fx.cube(spark, sf), "hr").select(*PIXEL, "doy", "b1", "masked")


def _two(c: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    side = lambda s: c.where(F.col("sensor") == s).select("site", "px", "doy", *bands, "masked")
    return side("lr"), side("hr")


_LR_HR = "l AS (SELECT * FROM cube WHERE sensor = 'lr'), h AS (SELECT * FROM cube WHERE sensor = 'hr')"


@query("q_coalesce_series", _LR_HR + ", q AS (SELECT site, px, doy, CASE WHEN l.masked AND NOT h.masked THEN h.b1 ELSE l.b1 END AS b1, l.masked AND h.masked AS masked FROM l JOIN h USING (site, px, doy))", "b1")
def q_coalesce_series(spark, sf):
    lr, hr = _two(fx.cube(spark, sf), ["b1"])
    return joins.coalesce_series(lr, hr, ["b1"], ("site", "px", "doy"))


@query("q_combine_series", _LR_HR + """, q AS (SELECT site, px, doy, CASE WHEN NOT l.masked AND NOT h.masked THEN (l.b1 + h.b1) / 2 WHEN NOT l.masked THEN l.b1 WHEN NOT h.masked THEN h.b1 ELSE 0 END AS b1,
    coalesce(l.masked, true) AND coalesce(h.masked, true) AS masked FROM l FULL JOIN h USING (site, px, doy))""", "b1")
def q_combine_series(spark, sf):
    lr, hr = _two(fx.cube(spark, sf), ["b1"])
    return joins.combine_series(lr, hr, ["b1"], ("site", "px", "doy"))


@query("q_band_concat", _LR_HR + ", q AS (SELECT site, px, doy, l.b1, h.b2, l.masked OR h.masked AS masked FROM l JOIN h USING (site, px, doy))", "b1 b2")
def q_band_concat(spark, sf):
    lr, hr = _two(fx.cube(spark, sf), ["b1", "b2"])
    return joins.concat_bands(lr, hr, ["b1"], ["b2"], ("site", "px", "doy"))


@query("q_clear_masked_split", f"q AS (SELECT DISTINCT site, sensor, doy, NOT {_HIDDEN} AS clear FROM cube)")
def q_clear_masked_split(spark, sf):
    c = fx.cube(spark, sf)
    given, target = evaluation.scenario_parts(c, GAPS)
    return joins.clear_masked_split(target.select(*SERIES, "doy").distinct(), given)


# strategies: how many rows and masked ones each date has in each role

_COUNT = "q AS (SELECT site, sensor, role, doy, count(*) AS n, count(*) FILTER (masked) AS n_masked FROM sc GROUP BY ALL)"
_EX = lambda o: f"EXISTS (SELECT 1 FROM cube o WHERE o.site = c.site AND o.doy = c.doy AND o.sensor = '{o}')"
_LR_C, _HR_C, _HR_N = f"sensor = 'lr' AND {_EX('hr')}", f"sensor = 'hr' AND {_EX('lr')}", f"sensor = 'hr' AND NOT {_EX('lr')}"


def _scenario_sql(given: str | None, target: str | None, extra: str = "") -> str:
    parts = [f"SELECT site, sensor, doy, masked, '{role}' AS role FROM cube c WHERE {cond}" for role, cond in (("input", given), ("target", target)) if cond]
    return "sc AS (" + " UNION ALL ".join([*parts, *([extra] if extra else [])]) + "), " + _COUNT


def _count(df: DataFrame) -> DataFrame:
    return df.groupBy(*SERIES, "role", "doy").agg(F.count("*").alias("n"), F.count_if("masked").alias("n_masked"))


def _register(name: str, p: HidingParameters, sql: str | None, origin: str | None = None) -> None:
    def run(spark, sf):
        return _count(make_scenario(fx.cube(spark, sf), p, origin))

    query(name, sql)(run)


START = 900
_GRID = "SELECT g.site, 'hr' AS sensor, CAST(d AS INT) AS doy, true AS masked, 'target' AS role FROM (SELECT DISTINCT site, px FROM cube WHERE sensor = 'hr') g, {dates}"
_RANK = "SELECT *, row_number() OVER (PARTITION BY site, sensor ORDER BY md5('{seed}:' || site || ':' || sensor || ':' || doy)) AS r, count(*) OVER (PARTITION BY site, sensor) AS n FROM (SELECT DISTINCT site, sensor, doy FROM cube)"
_RANDOM = "hid AS (SELECT site, sensor, doy FROM (" + _RANK.format(seed=0) + ") WHERE r <= ceil(n * 0.5)), "
_NOT_HID = "NOT EXISTS (SELECT 1 FROM hid WHERE hid.site = c.site AND hid.sensor = c.sensor AND hid.doy = c.doy)"
_register("q_scn_all", HidingParameters("ALL"), _scenario_sql("true", "true"))
_register("q_scn_gaps", GAPS, _scenario_sql(f"NOT {_HIDDEN}", "true"))
_register("q_scn_nohr", HidingParameters("NOHR"), _scenario_sql("sensor = 'lr'", "true"))
_register("q_scn_nolr", HidingParameters("NOLR"), _scenario_sql("sensor = 'hr'", "true"))
_register("q_scn_forecast", HidingParameters("FORECAST", start=START), _scenario_sql(f"doy <= {START}", "true"))
_register("q_scn_backcast", HidingParameters("BACKCAST", start=START), _scenario_sql(f"doy >= {START}", "true"))
_register("q_scn_deepharmo", HidingParameters("DEEPHARMO"), _scenario_sql(f"sensor = 'lr' OR {_HR_N}", "true"))
_register("q_scn_conj_lr_u_hr", HidingParameters("CONJLRuHR2HR"), _scenario_sql(f"({_LR_C}) OR ({_HR_N})", _HR_C))
_register("q_scn_conj_lr", HidingParameters("CONJLR2HR"), _scenario_sql(_LR_C, _HR_C))
_register("q_scn_lr_u_hr_noconj", HidingParameters("LRuHRNOCONJ2HR"), _scenario_sql(f"sensor = 'lr' OR ({_HR_N})", _HR_C))
_register("q_scn_hr_noconj", HidingParameters("HRNOCONJ2HR"), _scenario_sql(_HR_N, _HR_C))
_register("q_scn_allhr", HidingParameters("ALLHR2ALLHR"), _scenario_sql("sensor = 'hr'", "sensor = 'hr'"))
_register("q_scn_all2conj", HidingParameters("ALL2CONJHR"), _scenario_sql("true", _HR_C))
_register("q_scn_l3a", HidingParameters("L3A", year=1996), _scenario_sql("true", None, _GRID.format(dates="(SELECT unnest([date_diff('day', DATE '1995-01-01', make_date(1996, m::INT, 1)), date_diff('day', DATE '1995-01-01', make_date(1996, m::INT, 15))]) AS d FROM range(1, 13) r(m)) x")), "1995-01-01")
_register("q_scn_l3a_10d", HidingParameters("L3A_10D"), _scenario_sql("true", None, _GRID.format(dates="range(0, 361, 10) r(d)")))
_CUSTOM = (7, 100, 364, 365, 700, 2100)
_register("q_scn_custom", HidingParameters("CUSTOM", dates=_CUSTOM), _scenario_sql("true", None, f"SELECT g.site, g.sensor, CAST(d AS INT) AS doy, coalesce(cube.masked, true) AS masked, 'target' AS role FROM (SELECT DISTINCT site, px, sensor FROM cube) g CROSS JOIN unnest({list(_CUSTOM)}) t(d) LEFT JOIN cube ON cube.site = g.site AND cube.px = g.px AND cube.sensor = g.sensor AND cube.doy = t.d"))
_register("q_scn_random", HidingParameters("RANDOM", rate=0.5), _RANDOM + _scenario_sql(_NOT_HID, "true"))
_register("q_scn_random_all_doys", HidingParameters("RANDOM_ALL_DOYS", rate=0.5), _RANDOM + _scenario_sql(_NOT_HID, None, "SELECT g.site, g.sensor, d.doy, coalesce(cube.masked, true) AS masked, 'target' AS role FROM (SELECT DISTINCT site, px, sensor FROM cube) g JOIN (SELECT DISTINCT site, doy FROM cube) d ON d.site = g.site LEFT JOIN cube ON cube.site = g.site AND cube.px = g.px AND cube.sensor = g.sensor AND cube.doy = d.doy"))
_CTX = f"""d AS (SELECT *, row_number() OVER (PARTITION BY site, sensor ORDER BY doy) AS i FROM (SELECT DISTINCT site, sensor, doy FROM cube)),
    e AS (SELECT site, sensor, coalesce(max(i) FILTER (doy <= {START}), 1) AS f, coalesce(min(i) FILTER (doy >= {START + 200}), max(i)) AS l FROM d GROUP BY ALL),
    r AS (SELECT site, sensor, doy, i BETWEEN f - 2 AND f OR i BETWEEN l AND l + 2 AS given, i BETWEEN f - 2 AND l + 2 AS scored FROM d JOIN e USING (site, sensor)),
    p AS (SELECT r.*, g.px FROM r JOIN (SELECT DISTINCT site, px, sensor FROM cube) g USING (site, sensor) WHERE scored),
    pm AS (SELECT p.*, coalesce(cube.masked, true) AS masked FROM p LEFT JOIN cube USING (site, px, sensor, doy)),
    sc AS (SELECT site, sensor, doy, masked, 'input' AS role FROM pm WHERE given UNION ALL SELECT site, sensor, doy, masked, 'target' AS role FROM pm), """
_register("q_scn_context", HidingParameters("CONTEXT", start=START, reference_size=200, n_context=3), _CTX + _COUNT)

_U = lambda w: f"(('0x' || substr(md5('0:{w}:' || site), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("q_scn_draw", f"""q AS (SELECT site, (['RANDOM','RANDOM','RANDOM','RANDOM','RANDOM','RANDOM','RANDOM','RANDOM','GAPS','GAPS','GAPS','GAPS','NOHR','NOLR','FORECAST','BACKCAST'])[CAST(floor({_U("strategy")} * 16) AS INT) + 1] AS strategy,
    0.2 + 0.5 * {_U("rate")} AS rate, CAST(floor(65 + 236 * {_U("start")}) AS INT) AS start, CAST(floor(30 + 61 * {_U("gap")}) AS INT) AS gap FROM (SELECT DISTINCT site FROM cube))""", "rate")
def q_scn_draw(spark, sf):
    return draw_scenarios(fx.cube(spark, sf).select("site").distinct())


# scores


@query("q_clear_rate", "q AS (SELECT site, sensor, doy, count(*) AS n_px, avg(CASE WHEN masked THEN 0::DOUBLE ELSE 1::DOUBLE END) AS clear_pixel_rate FROM cube GROUP BY ALL)", "clear_pixel_rate")
def q_clear_rate(spark, sf):
    return aggs.clear_rate(fx.cube(spark, sf))


def _score(name: str, fn, expr: str) -> None:
    def run(spark, sf):
        return aggs.per_band(gap_aligned(spark, sf), ["b1"], (*SERIES, "doy", "clear"), fn, "value")

    query(name, _GAP_PRED + f", q AS (SELECT site, sensor, doy, clear, 'b1' AS band, {expr} AS value FROM sc GROUP BY ALL)", "value")(run)


_score("q_rmse", aggs.rmse, "sqrt(avg((p - r) * (p - r)))")
_score("q_nrmse", aggs.nrmse, "sqrt(sum((p - r) * (p - r)) / nullif(sum(r * r), 0))")
_score("q_smooth_l1", aggs.smooth_l1_score, "avg(CASE WHEN abs(p - r) < 0.1 THEN 0.5 * (p - r) * (p - r) / 0.1 ELSE abs(p - r) - 0.05 END)")


@query("q_mae_mape", _GAP_PRED + ", q AS (SELECT site, sensor, doy, 'b1' AS band, avg(abs(p - r)) AS mae, avg(abs(p - r) / greatest(abs(r), 1.17e-6)) AS mape FROM sc GROUP BY ALL)", "mae mape")
def q_mae_mape(spark, sf):
    a, keys = gap_aligned(spark, sf), (*SERIES, "doy")
    return aggs.per_band(a, ["b1"], keys, lambda p, r: F.struct(aggs.mae(p, r).alias("mae"), aggs.mape(p, r).alias("mape")), "s").select(*keys, "band", "s.mae", "s.mape")


@query("q_sam", _CLEAR_INPUT + ",\n" + gapfill_sql("g1", "k", "cube", "b3") + ",\n" + gapfill_sql("g2", "k", "cube", "b4") + """,
    x AS (SELECT c.site, c.sensor, c.doy, g1.b3 * c.b3 + g2.b4 * c.b4 AS d, g1.b3 * g1.b3 + g2.b4 * g2.b4 AS pp, c.b3 * c.b3 + c.b4 * c.b4 AS rr FROM cube c JOIN g1 USING (site, px, sensor, doy) JOIN g2 USING (site, px, sensor, doy) WHERE NOT c.masked),
    q AS (SELECT site, sensor, doy, avg(acos(least(1.0, d / nullif(sqrt(pp) * sqrt(rr), 0)))) AS sam FROM x GROUP BY ALL)""", "sam")
def q_sam(spark, sf):
    return aggs.spectral_angle(gap_aligned(spark, sf, ("b3", "b4")), ["b3", "b4"], (*SERIES, "doy"))


@query("q_pooled_std", """u AS (UNPIVOT (SELECT sensor, site, b1, b2, b3, b4 FROM cube WHERE NOT masked) ON b1, b2, b3, b4 INTO NAME band VALUE v),
    b AS (SELECT sensor, band, site, count(v) AS n, sum(v) AS s, var_samp(v) AS var FROM u GROUP BY ALL),
    q AS (SELECT sensor, band, sum(s) / sum(n) AS mean, sqrt(sum((n - 1) * coalesce(var, 0)) / nullif(sum(n) - count(*), 0)) AS std FROM b GROUP BY ALL)""", "mean std")
def q_pooled_std(spark, sf):
    return aggs.pooled_stats(fx.cube(spark, sf), B, ("site",), ("sensor",))


@query("q_masked_mean_std", "q AS (SELECT site, sensor, doy, sum(b1) / count(b1) AS mean, sqrt(greatest(sum(b1 * b1) / nullif(count(b1) - 1, 0) - (sum(b1) / count(b1)) ** 2, 0)) AS std FROM cube WHERE NOT masked GROUP BY ALL)", "mean std")
def q_masked_mean_std(spark, sf):
    return aggs.masked_mean_std(fx.cube(spark, sf), "b1", (*SERIES, "doy"))


_PAIRS = [(a, b) for i, a in enumerate(B) for b in B[i:]]


@query("q_covariance", "q AS (" + " UNION ALL ".join(f"SELECT site, sensor, '{a}' AS band_a, '{b}' AS band_b, covar_samp({a}, {b}) AS cov FROM cube WHERE NOT masked GROUP BY ALL" for a, b in _PAIRS) + ")", "cov")
def q_covariance(spark, sf):
    return aggs.covariance(fx.cube(spark, sf).where("not masked"), B, SERIES)


@query("q_cross_product", "q AS (" + " UNION ALL ".join(f"SELECT site, sensor, '{a}' AS band_a, '{b}' AS band_b, sum(b4 * b4 * {a} * {b}) AS product FROM cube WHERE NOT masked GROUP BY ALL" for a, b in (("b1", "b1"), ("b1", "b3"), ("b3", "b3"))) + ")", "product")
def q_cross_product(spark, sf):
    return aggs.cross_product(fx.cube(spark, sf).where("not masked"), ["b1", "b3"], SERIES, F.col("b4"))


@query("q_ridge_1d", _GAP_PRED + """, m AS (SELECT site, sensor, count(*) AS n, avg(p) AS mp, avg(r) AS mr, sum(p) AS sp, sum(r) AS sr, sum(p * p) AS spp, sum(r * r) AS srr, sum(p * r) AS spr FROM sc GROUP BY ALL),
    s AS (SELECT *, sqrt(spp / (n - 1) - mp * mp) AS dp, sqrt(srr / (n - 1) - mr * mr) AS dr FROM m),
    t AS (SELECT *, ((spr - n * mr * mp) / (dr * dp)) / ((srr - n * mr * mr) / (dr * dr) + 1e-3) * dp / dr AS slope FROM s),
    q AS (SELECT site, sensor, n, slope, mp - slope * mr AS intercept FROM t)""", "slope intercept")
def q_ridge_1d(spark, sf):
    return aggs.ridge_closed(gap_aligned(spark, sf).where("p_b1 is not null"), "b1", SERIES)


@query("q_ridge_multi")
def q_ridge_multi(spark, sf):
    a = gap_aligned(spark, sf, ("b1", "b3", "b4")).where("p_b1 is not null")
    return aggs.ridge_multi(a, ["r_b1", "r_b3", "r_b4"], ["p_b1", "p_b3"], SERIES)


@query("q_triplet", _CLEAR_INPUT + ",\n" + gapfill_sql("g", "k", "cube", "b1") + ",\n" + _NEAR_PIXEL + """, x AS (SELECT j.site, j.sensor, abs(g.b1 - j.near_b1 + 1e-6) AS dp, least(abs(g.b1 - c.b1 + 1e-6), abs(j.near_b1 - c.b1 + 1e-6)) AS dn
    FROM j JOIN g USING (site, px, sensor, doy) JOIN cube c USING (site, px, sensor, doy) WHERE j.n = 1 AND c.masked), q AS (SELECT site, sensor, avg(greatest(0, dp - dn + 0.1)) AS triplet FROM x GROUP BY ALL)""", "triplet")
def q_triplet(spark, sf):
    c = fx.cube(spark, sf)
    given, target = evaluation.scenario_parts(c, GAPS)
    pred = timeops.linear_gapfilling(given, target.select(*PIXEL, "doy"), ["b1"]).where("b1 is not null")
    return aggs.triplet_score(pred, target, "b1")


@query("q_decorrelation", "q AS (SELECT CASE WHEN count(*) >= 1000 THEN (" + " + ".join(f"abs(covar_samp({a}, {b}) - {1 if a == b else 0})" for a in ("b1", "b3", "b4") for b in ("b1", "b3", "b4")) + ") / 9 END AS decorrelation FROM cube WHERE NOT masked)", "decorrelation")
def q_decorrelation(spark, sf):
    return aggs.decorrelation(fx.cube(spark, sf), ["b1", "b3", "b4"])


_CLOSEST = """s AS (SELECT DISTINCT site, sensor, doy FROM cube), t AS (SELECT site, sensor, CAST(d AS INT) AS doy FROM (SELECT DISTINCT site, sensor FROM cube), range(365) r(d)),
    n AS (SELECT t.site, t.sensor, t.doy, min(abs(s.doy - t.doy)) AS distance FROM t JOIN s USING (site, sensor) GROUP BY ALL)"""


def _closest(spark, sf):
    c = fx.cube(spark, sf)
    grid = joins.query_grid(c.select(*SERIES).distinct(), timeops.regular_calendar(spark, 1, 0, 364))
    return joins.nearest_date(c.select(*SERIES, "doy").distinct(), grid, SERIES)


@query("q_closest_date", _CLOSEST + ", q AS (SELECT * FROM n)")
def q_closest_date(spark, sf):
    return _closest(spark, sf).select(*SERIES, "doy", "distance")


@query("q_density", _CLOSEST + ", q AS (SELECT site, sensor, doy, exp(-1 * pow(distance / 10.0, 2)) AS density FROM n)", "density")
def q_density(spark, sf):
    return _closest(spark, sf).select(*SERIES, "doy", aggs.density(F.col("distance")).alias("density"))


@query("q_quantiles", "q AS (SELECT site, sensor, doy, quantile_cont(b1, 0.05) AS q05, quantile_cont(b1, 0.95) AS q95 FROM cube WHERE NOT masked GROUP BY ALL)", "q05 q95")
def q_quantiles(spark, sf):
    return aggs.quantiles(fx.cube(spark, sf), "b1", (*SERIES, "doy"))


# metric tables: RMSE of gap filling for each band

_METRICS = _CLEAR_INPUT + ",\n" + ",\n".join(gapfill_sql(f"g{b}", "k", "cube", b) for b in B) + f""",
    w AS (SELECT c.site, c.sensor, c.doy, NOT {_HIDDEN.replace('doy', 'c.doy')} AS clear, """ + ", ".join(f"sqrt(avg((g{b}.{b} - c.{b}) ** 2)) AS {b}" for b in B) + """
    FROM cube c """ + " ".join(f"JOIN g{b} USING (site, px, sensor, doy)" for b in B) + """ WHERE NOT c.masked AND gb1.b1 IS NOT NULL GROUP BY ALL),
    m AS (SELECT site, sensor, doy, clear, 'rmse' AS metric, band, value FROM (UNPIVOT w ON b1, b2, b3, b4 INTO NAME band VALUE value))"""


def metrics(spark, sf) -> DataFrame:
    a = gap_aligned(spark, sf, tuple(B)).where("p_b1 is not null")
    return aggs.per_band(a, B, (*SERIES, "doy", "clear"), aggs.rmse, "value").withColumn("metric", F.lit("rmse"))


_WIDE = ["rmse_b1", "rmse_b2", "rmse_b3", "rmse_b4"]


@query("q_metric_wide", _METRICS + ", q AS (SELECT site, sensor, doy, clear, b1 AS rmse_b1, b2 AS rmse_b2, b3 AS rmse_b3, b4 AS rmse_b4 FROM w)", "rmse_b1:10 rmse_b2:6 rmse_b3:11 rmse_b4:11")
def q_metric_wide(spark, sf):
    return reshape.widen(metrics(spark, sf), (*SERIES, "doy", "clear"), _WIDE)


@query("q_band_groups", _METRICS + ", q AS (SELECT site, sensor, doy, clear, (b1 + b2) / 2 AS rmse_10m, (b3 + b4) / 2 AS rmse_20m FROM w)", "rmse_10m rmse_20m:11")
def q_band_groups(spark, sf):
    wide = reshape.widen(metrics(spark, sf), (*SERIES, "doy", "clear"), _WIDE)
    return aggs.band_group_means(wide, {"rmse_10m": _WIDE[:2], "rmse_20m": _WIDE[2:]}).select(*SERIES, "doy", "clear", "rmse_10m", "rmse_20m")


@query("q_result_table", _METRICS + ", q AS (SELECT metric, band, clear, avg(value) AS mean, stddev_samp(value) AS std FROM m GROUP BY ALL)", "mean std")
def q_result_table(spark, sf):
    wide = reshape.widen(metrics(spark, sf), (*SERIES, "doy", "clear"), _WIDE)
    return aggs.result_table(reshape.lengthen(wide, (*SERIES, "doy", "clear"), _WIDE))


@query("q_run_summary", _METRICS + ", q AS (SELECT sensor, band, clear, avg(value) AS mean, count(*) AS n FROM m GROUP BY ALL)", "mean")
def q_run_summary(spark, sf):
    return metrics(spark, sf).groupBy("sensor", "band", "clear").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("q_metric_rollup", _METRICS + """, p AS (SELECT sensor, CASE WHEN band IN ('b1', 'b2') THEN 10 ELSE 20 END AS res, band, avg(value) AS v FROM m GROUP BY ALL),
    q AS (SELECT sensor, res, avg(v) AS mean FROM p GROUP BY GROUPING SETS ((sensor, res), (sensor)))""", "mean")
def q_metric_rollup(spark, sf):
    return aggs.rollup_scores(metrics(spark, sf).withColumn("res", F.when(F.col("band").isin("b1", "b2"), 10).otherwise(20)))


@query("q_role_weights", "d AS (SELECT site, sensor, count(DISTINCT doy) AS n_dates FROM cube GROUP BY ALL), q AS (SELECT site, sensor, n_dates, n_dates / sum(n_dates) OVER (PARTITION BY site) AS weight FROM d)", "weight")
def q_role_weights(spark, sf):
    return aggs.role_weights(fx.cube(spark, sf).select(*SERIES, "doy").distinct())


_FIT = """e AS (SELECT site, sensor FROM al GROUP BY ALL HAVING avg(masked::INT) <= 0.5), sc2 AS (SELECT * FROM sc WHERE (site, sensor) IN (SELECT (site, sensor) FROM e)),
    m AS (SELECT site, sensor, count(*) AS n, avg(p) AS mp, avg(r) AS mr, sum(p * p) AS spp, sum(r * r) AS srr, sum(p * r) AS spr FROM sc2 GROUP BY ALL),
    s AS (SELECT *, sqrt(spp / (n - 1) - mp * mp) AS dp, sqrt(srr / (n - 1) - mr * mr) AS dr FROM m),
    t AS (SELECT *, ((spr - n * mr * mp) / (dr * dp)) / ((srr - n * mr * mr) / (dr * dr) + 1e-3) * dp / dr AS slope FROM s),
    f AS (SELECT site, sensor, p - (slope * r + mp - slope * mr) AS d FROM sc2 JOIN t USING (site, sensor)),
    fit AS (SELECT site, sensor, avg(CASE WHEN abs(d) < 0.1 THEN 0.5 * d * d / 0.1 ELSE abs(d) - 0.05 END) AS fit_loss FROM f GROUP BY ALL)"""
_TRIPLET = _NEAR_PIXEL + """, x AS (SELECT j.site, j.sensor, abs(g.b1 - j.near_b1 + 1e-6) AS dp, least(abs(g.b1 - c.b1 + 1e-6), abs(j.near_b1 - c.b1 + 1e-6)) AS dn
    FROM j JOIN g USING (site, px, sensor, doy) JOIN cube c USING (site, px, sensor, doy) WHERE j.n = 1 AND c.masked), tr AS (SELECT site, sensor, avg(greatest(0, dp - dn + 0.1)) AS triplet FROM x GROUP BY ALL)"""


@query("q_composite_score", _GAP_PRED + ", " + _TRIPLET + ", " + _FIT + """, l AS (SELECT site, sensor, clear, avg(CASE WHEN abs(p - r) < 0.1 THEN 0.5 * (p - r) * (p - r) / 0.1 ELSE abs(p - r) - 0.05 END) AS loss FROM sc GROUP BY ALL),
    d AS (SELECT site, sensor, count(DISTINCT doy) AS n FROM cube GROUP BY ALL), wt AS (SELECT site, sensor, n / sum(n) OVER (PARTITION BY site) AS weight FROM d),
    q AS (SELECT site, sum(CASE WHEN clear THEN weight * loss ELSE weight * 0.5 * (loss + coalesce(triplet, 0)) + coalesce(fit_loss, 0) END) AS score
          FROM l JOIN wt USING (site, sensor) LEFT JOIN tr USING (site, sensor) LEFT JOIN fit USING (site, sensor) GROUP BY site)""", "score")
def q_composite_score(spark, sf):
    """Reconstruction of all dates; cloud leak and regression fit count with the hidden ones."""
    c = fx.cube(spark, sf)
    aligned = gap_aligned(spark, sf)
    loss = aggs.per_band(aligned, ["b1"], (*SERIES, "clear"), aggs.smooth_l1_score, "reconstruction")
    parts = loss.join(aggs.role_weights(c.select(*SERIES, "doy").distinct()), list(SERIES))
    parts = parts.join(q_triplet(spark, sf), list(SERIES), "left").join(q_regression_fit(spark, sf).withColumnRenamed("fit_loss", "fit"), list(SERIES), "left")
    hidden = lambda c: F.when(~F.col("clear"), F.col(c))
    return evaluation.composite_score(parts.withColumns({"triplet": hidden("triplet"), "fit": hidden("fit")}))


@query("q_ensemble_mean", _CLEAR + ",\n" + gapfill_sql("g", "k", "cube", "b1") + """, a AS (SELECT site, px, sensor, doy, b1 FROM g UNION ALL SELECT site, px, sensor, doy, b1 FROM cube),
    q AS (SELECT site, px, sensor, doy, avg(b1) AS b1, count(*) AS n_members FROM a GROUP BY ALL)""", "b1")
def q_ensemble_mean(spark, sf):
    c = fx.cube(spark, sf)
    return aggs.ensemble_mean([timeops.linear_gapfilling(c, c.select(*PIXEL, "doy"), ["b1"]), c], ["b1"], (*PIXEL, "doy"))


@query("q_regression_fit", _GAP_PRED + """, e AS (SELECT site, sensor FROM al GROUP BY ALL HAVING avg(masked::INT) <= 0.5), sc2 AS (SELECT * FROM sc WHERE (site, sensor) IN (SELECT (site, sensor) FROM e)),
    m AS (SELECT site, sensor, count(*) AS n, avg(p) AS mp, avg(r) AS mr, sum(p * p) AS spp, sum(r * r) AS srr, sum(p * r) AS spr FROM sc2 GROUP BY ALL),
    s AS (SELECT *, sqrt(spp / (n - 1) - mp * mp) AS dp, sqrt(srr / (n - 1) - mr * mr) AS dr FROM m),
    t AS (SELECT *, ((spr - n * mr * mp) / (dr * dp)) / ((srr - n * mr * mr) / (dr * dr) + 1e-3) * dp / dr AS slope FROM s),
    f AS (SELECT site, sensor, p - (slope * r + mp - slope * mr) AS d FROM sc2 JOIN t USING (site, sensor)),
    q AS (SELECT site, sensor, avg(CASE WHEN abs(d) < 0.1 THEN 0.5 * d * d / 0.1 ELSE abs(d) - 0.05 END) AS fit_loss FROM f GROUP BY ALL)""", "fit_loss")
def q_regression_fit(spark, sf):
    return aggs.regression_fit(gap_aligned(spark, sf).where("p_b1 is not null"), "b1", SERIES)


@query("q_date_record", _CLEAR_INPUT + ",\n" + gapfill_sql("g", "k", "cube", "b1") + f""", al AS (SELECT c.site, c.sensor, c.doy, NOT {_HIDDEN.replace('doy', 'c.doy')} AS clear, g.b1 AS p, c.b1 AS r, c.masked FROM cube c JOIN g USING (site, px, sensor, doy)),
    i AS (SELECT DISTINCT site, sensor, doy FROM cube WHERE NOT {_HIDDEN}),
    a AS (SELECT site, sensor, doy, clear, avg(CASE WHEN masked THEN 0::DOUBLE ELSE 1::DOUBLE END) AS clear_pixel_rate, avg(CASE WHEN p IS NOT NULL THEN 1::DOUBLE ELSE 0::DOUBLE END) AS predicted_pixel_rate, sqrt(avg((p - r) * (p - r)) FILTER (NOT masked AND p IS NOT NULL)) AS rmse FROM al GROUP BY ALL),
    n AS (SELECT a.site, a.sensor, a.doy, min(abs(i.doy - a.doy)) AS distance FROM a JOIN i USING (site, sensor) GROUP BY ALL),
    q AS (SELECT site, sensor, doy, clear, clear_pixel_rate, predicted_pixel_rate, distance, exp(-1 * pow(distance / 10.0, 2)) AS density, rmse FROM a JOIN n USING (site, sensor, doy))""", "clear_pixel_rate:10 predicted_pixel_rate:10 density rmse:9")
def q_date_record(spark, sf):
    c = fx.cube(spark, sf).select(*PIXEL, "doy", "b1", "masked")
    return evaluation.date_record(evaluation.gapfill_scenario(c, ["b1"], GAPS), None, ["b1"])


# dataset


@query("q_valid_products", "q AS (SELECT site, sensor, doy, n_px, clear_pixel_rate FROM product_index WHERE valid)", "clear_pixel_rate", views="product_index")
def q_valid_products(spark, sf):
    i = fx.product_index(spark, sf).withColumn("acquisition_date", F.col("doy"))
    return filters.min_clear_rate(filters.valid_products(i)).select(*SERIES, "doy", "n_px", "clear_pixel_rate")


@query("q_common_dates", "f AS (SELECT DISTINCT site, sensor, doy, px % 2 AS file FROM cube), n AS (SELECT site, sensor, count(DISTINCT file) AS k FROM f GROUP BY ALL), q AS (SELECT site, sensor, doy FROM f JOIN n USING (site, sensor) GROUP BY site, sensor, doy, k HAVING count(DISTINCT file) = k)")
def q_common_dates(spark, sf):
    c = fx.cube(spark, sf).select(*SERIES, F.col("doy").alias("acquisition_date"), (F.col("px") % 2).alias("index_file")).distinct()
    return joins.common_dates(c).select(*SERIES, F.col("acquisition_date").alias("doy")).distinct()


@query("q_time_slices", "s AS (SELECT site, CAST(floor(doy / 100) AS INT) AS slice_idx, count(DISTINCT CASE WHEN sensor = 'lr' THEN doy END) AS n_lr, count(DISTINCT CASE WHEN sensor = 'hr' THEN doy END) AS n_hr FROM cube GROUP BY ALL), q AS (SELECT * FROM s WHERE n_lr > 5 AND n_hr > 5)")
def q_time_slices(spark, sf):
    return timeops.dense_slices(timeops.time_slices(fx.cube(spark, sf), 100), 5)


@query("q_never_observed", "q AS (SELECT site, px, sensor, bool_and(masked) AS never_observed FROM cube GROUP BY ALL)")
def q_never_observed(spark, sf):
    return aggs.never_observed(fx.cube(spark, sf))


@query("q_patches", """a AS (SELECT site, min(b1) AS xmin, max(b1) AS xmax, min(b3) * 100 AS ymin, max(b3) * 100 AS ymax FROM cube GROUP BY site),
    n AS (SELECT *, greatest(floor((xmax - xmin) / 3), 1)::INT AS nx, greatest(floor((ymax - ymin) / 3), 1)::INT AS ny FROM a),
    g AS (SELECT n.*, ix, iy FROM n, range(100) x(ix), range(100) y(iy) WHERE ix < nx AND iy < ny),
    q AS (SELECT site, CAST(ix * ny + iy AS INT) AS patch_idx, xmin + ix * ((xmax - xmin) / nx) AS x0, ymin + iy * ((ymax - ymin) / ny) AS y0, xmin + ix * ((xmax - xmin) / nx) + 3 AS x1, ymin + iy * ((ymax - ymin) / ny) + 3 AS y1 FROM g)""", "x0 y0 x1 y1")
def q_patches(spark, sf):
    box = fx.cube(spark, sf).groupBy(F.col("site").alias("name")).agg(F.min("b1").alias("xmin"), F.max("b1").alias("xmax"), (F.min("b3") * 100).alias("ymin"), (F.max("b3") * 100).alias("ymax"))
    return timeops.patches(spark, box, 3.0)


@query("q_time_range", "q AS (SELECT site, min(doy) AS first, max(doy) AS last, count(DISTINCT doy) AS n_dates FROM cube GROUP BY site)")
def q_time_range(spark, sf):
    return dataset.time_range(fx.cube(spark, sf), "doy")


@query("q_split_fixed", "v AS (SELECT DISTINCT px FROM cube WHERE b1 > 45), q AS (SELECT site, px, sensor, CASE WHEN px IN (SELECT px FROM v) THEN 'validation' ELSE 'training' END AS split, count(*) AS n FROM cube GROUP BY ALL)")
def q_split_fixed(spark, sf):
    c = fx.cube(spark, sf)
    return sampling.fixed_split(c, c.where("b1 > 45"), "px").groupBy(*PIXEL, "split").agg(F.count("*").alias("n"))


@query("q_split_sites", "q AS (SELECT site, CASE WHEN site < 6 THEN 'training' ELSE 'testing' END AS split, count(*) AS n FROM cube WHERE site < 9 GROUP BY ALL)")
def q_split_sites(spark, sf):
    return sampling.site_split(fx.cube(spark, sf), list(range(6)), [6, 7, 8]).groupBy("site", "split").agg(F.count("*").alias("n"))


@query("q_split_random", f"q AS (SELECT site, px, CASE WHEN u < 0.7 THEN 'training' WHEN u < 0.7 + 0.2 THEN 'validation' ELSE 'rest' END AS split FROM (SELECT DISTINCT site, px, ('0x' || substr(md5('5:' || site || ':' || px), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM cube))")
def q_split_random(spark, sf):
    return sampling.random_split(fx.cube(spark, sf).select("site", "px").distinct(), {"training": 0.7, "validation": 0.2}, ("site", "px"), 5)


@query("q_date_cap", "r AS (" + _RANK.format(seed=1) + "), a AS (SELECT *, count(*) OVER (PARTITION BY site) AS everything FROM r), q AS (SELECT site, sensor, doy FROM a WHERE everything <= 200 OR r <= floor(n * 200 / everything))")
def q_date_cap(spark, sf):
    return sampling.cap_dates(fx.cube(spark, sf).select(*SERIES, "doy").distinct(), 200, 1)


@query("q_pad", """s AS (SELECT site, px, sensor, count(*)::INT AS n, list(doy ORDER BY doy) AS d, list(masked ORDER BY doy) AS m FROM cube GROUP BY ALL),
    q AS (SELECT site, px, sensor, n, CASE WHEN n <= 150 THEN array_to_string(list_concat(d, list_transform(range(greatest(150 - n, 0)), lambda x: 0)), ',') END AS doys, CASE WHEN n <= 150 THEN len(list_filter(m, lambda x: x)) + greatest(150 - n, 0) END AS n_masked FROM s)""")
def q_pad(spark, sf):
    out = sampling.pad(fx.cube(spark, sf), ["b1"], 150, PIXEL)
    return out.select(*PIXEL, "n", F.when(F.col("doy").isNotNull(), F.array_join(F.transform("doy", lambda x: x.cast("string")), ",")).alias("doys"), F.when(F.col("masked").isNotNull(), F.size(F.filter("masked", lambda x: x))).cast("long").alias("n_masked"))


@query("q_strip_masked", "g AS (SELECT site, sensor, doy FROM cube GROUP BY ALL HAVING NOT bool_and(masked)), q AS (SELECT site, sensor, doy, count(*) AS n FROM cube SEMI JOIN g USING (site, sensor, doy) GROUP BY ALL)")
def q_strip_masked(spark, sf):
    return filters.drop_masked_dates(fx.cube(spark, sf)).groupBy(*SERIES, "doy").agg(F.count("*").alias("n"))


@query("q_index_clean", "q AS (SELECT l.site, l.sensor, l.doy, l.n_px, h.clear_pixel_rate, h.valid FROM product_index l JOIN product_index h ON l.site = h.site AND l.doy = h.doy WHERE l.sensor = 'lr' AND h.sensor = 'hr')", "clear_pixel_rate", views="product_index")
def q_index_clean(spark, sf):
    i = fx.product_index(spark, sf)
    return joins.reconcile_index(i.where("sensor = 'lr'"), i.where("sensor = 'hr'")).select(*SERIES, "doy", "n_px", "clear_pixel_rate", "valid")


@query("q_skip_existing", "q AS (SELECT site, sensor, doy, n_px FROM product_index a WHERE NOT EXISTS (SELECT 1 FROM product_index b WHERE b.valid AND a.site = b.site AND a.sensor = b.sensor AND a.doy = b.doy))", views="product_index")
def q_skip_existing(spark, sf):
    i = fx.product_index(spark, sf)
    return joins.skip_existing(i, i.where("valid"), (*SERIES, "doy")).select(*SERIES, "doy", "n_px")


@query("q_quality_checks", "m AS (SELECT max(n_px) AS e FROM product_index), q AS (SELECT site, sensor, doy, n_px AS n_found FROM product_index, m WHERE valid AND n_px <> e)", views="product_index")
def q_quality_checks(spark, sf):
    i = fx.product_index(spark, sf)
    expected = i.agg(F.max("n_px")).first()[0] or 0
    return quality.product_violations(i, fx.cube(spark, sf), expected)


# columns

_STATS = Standardization({"b1": 25.0, "b3": 0.05}, {"b1": 12.0, "b3": 0.03}, scale=2.0, clip=(-0.2, 20.0))


@query("q_standardize", "q AS (SELECT site, px, sensor, doy, (least(greatest(b1 / 2, -0.2), 20) - 25) / 12 AS b1, (least(greatest(b3 / 2, -0.2), 20) - 0.05) / 0.03 AS b3 FROM cube)", "b1 b3")
def q_standardize(spark, sf):
    return columns.standardize(fx.cube(spark, sf), _STATS).select(*PIXEL, "doy", "b1", "b3")


@query("q_unstandardize", "q AS (SELECT site, px, sensor, doy, (b1 * 12 + 25) * 2 AS b1, (b3 * 0.03 + 0.05) * 2 AS b3 FROM cube)", "b1 b3")
def q_unstandardize(spark, sf):
    return columns.unstandardize(fx.cube(spark, sf), _STATS).select(*PIXEL, "doy", "b1", "b3")


@query("q_ndvi", "q AS (SELECT site, px, sensor, doy, (b4 - b3) / (b3 + b4 + 1e-6) AS ndvi FROM cube)", "ndvi")
def q_ndvi(spark, sf):
    return columns.add_ndvi(fx.cube(spark, sf), "b3", "b4").select(*PIXEL, "doy", "ndvi")


@query("q_minmax_ref", "r AS (SELECT *, min(b1) OVER w AS lo, max(b1) OVER w AS hi FROM cube WINDOW w AS (PARTITION BY site, sensor, doy)), q AS (SELECT site, px, sensor, doy, (b3 - lo) / nullif(hi - lo, 0) AS b3_scaled, (b1 - lo) / nullif(hi - lo, 0) AS b1_scaled FROM r)", "b1_scaled:10 b3_scaled:10")
def q_minmax_ref(spark, sf):
    return columns.minmax_by_reference(fx.cube(spark, sf), "b3", "b1", (*SERIES, "doy")).select(*PIXEL, "doy", "b3_scaled", "b1_scaled")


@query("q_bitmask", """x AS (SELECT (l_partkey & 31) <> 0 OR ((l_orderkey >> 1) & 1 = 1 AND (l_orderkey >> 6) & 1 = 1 AND (l_orderkey >> 7) & 1 = 1) OR (l_suppkey & 2175) <> 0 OR l_discount = 0 OR isnan(l_discount) AS m, (l_partkey >> 5) & 1 AS snow FROM lineitem),
    q AS (SELECT m AS masked, CAST(snow AS INT) AS snow, count(*) AS n FROM x GROUP BY ALL)""")
def q_bitmask(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    mask = scalars.quality_mask(F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey"), [F.col("l_discount")])
    return li.groupBy(mask.alias("masked"), scalars.bit(F.col("l_partkey"), scalars.QA_SNOW_BIT).cast("int").alias("snow")).agg(F.count("*").alias("n"))


@query("q_scl_mask", "x AS (SELECT l_partkey % 12 AS scl, l_linenumber % 3 AS data, l_suppkey % 200 AS clp FROM lineitem), q AS (SELECT scl, scl IN (0, 1, 2, 3, 7, 8, 9, 10) OR data = 0 OR clp > 150 AS masked, count(*) AS n FROM x GROUP BY ALL)")
def q_scl_mask(spark, sf):
    li = fx.read(spark, sf, "lineitem").select((F.col("l_partkey") % 12).alias("scl"), (F.col("l_linenumber") % 3).alias("data"), (F.col("l_suppkey") % 200).alias("clp"))
    return li.groupBy("scl", scalars.scene_mask(F.col("scl"), F.col("data"), None, F.col("clp")).alias("masked")).agg(F.count("*").alias("n"))


@query("q_posenc", "d AS (SELECT DISTINCT site, sensor, doy FROM cube), q AS (SELECT site, sensor, doy, CAST(k AS INT) AS k, CASE WHEN k % 2 = 0 THEN sin(doy / pow(10000.0, 2 * floor(k / 2) / 8)) ELSE cos(doy / pow(10000.0, 2 * floor(k / 2) / 8)) END AS value FROM d, range(8) r(k))", "value")
def q_posenc(spark, sf):
    d = fx.cube(spark, sf).select(*SERIES, "doy").distinct()
    return d.select(*SERIES, "doy", F.posexplode(scalars.calendar_features(F.col("doy"), 8)).alias("k", "value"))


@query("q_impute", "q AS (SELECT site, px, sensor, doy, CASE WHEN masked THEN 25 ELSE b1 END AS b1, CASE WHEN masked THEN -1 ELSE b3 END AS b3, false AS masked FROM cube)", "b1 b3")
def q_impute(spark, sf):
    return columns.impute(fx.cube(spark, sf), {"b1": 25.0, "b3": -1.0}, strip=True).select(*PIXEL, "doy", "b1", "b3", "masked")


def _sides(spark, sf):
    c = fx.obs(spark, sf)
    return c.where("sensor = 'lr'").select("site", "px", "doy"), c.where("sensor = 'hr'").select("site", "px", "doy")


_SETS = "l AS (SELECT DISTINCT site, px, doy FROM obs WHERE sensor = 'lr'), h AS (SELECT DISTINCT site, px, doy FROM obs WHERE sensor = 'hr'), q AS (SELECT * FROM l {op} SELECT * FROM h)"


@query("q_doy_union", _SETS.format(op="UNION"), views="obs")
def q_doy_union(spark, sf):
    return sets.date_union(*_sides(spark, sf), ("site", "px"))


@query("q_doy_common", _SETS.format(op="INTERSECT"), views="obs")
def q_doy_common(spark, sf):
    return sets.common_dates(*_sides(spark, sf), ("site", "px"))


@query("q_doy_uncommon", _SETS.format(op="EXCEPT").replace("FROM l ", "FROM h ").replace("EXCEPT SELECT * FROM h", "EXCEPT SELECT * FROM l"), views="obs")
def q_doy_uncommon(spark, sf):
    return sets.uncommon_dates(*_sides(spark, sf), ("site", "px"))


@query("q_timeline", f"""r AS (SELECT site, doy, sensor || '_target' AS role FROM cube UNION SELECT site, doy, sensor || '_input' FROM cube WHERE NOT {_HIDDEN}),
    q AS (SELECT site, doy, bool_or(role = 'lr_input') AS lr_input, bool_or(role = 'lr_target') AS lr_target, bool_or(role = 'hr_input') AS hr_input, bool_or(role = 'hr_target') AS hr_target FROM r GROUP BY ALL)""")
def q_timeline(spark, sf):
    s = make_scenario(fx.cube(spark, sf), GAPS)
    part = lambda sensor, role: s.where((F.col("sensor") == sensor) & (F.col("role") == role))
    return reshape.timeline({f"{a}_{b}": part(a, b) for a in ("lr", "hr") for b in ("input", "target")})


# pipelines

_TWO_DATES = "e AS (SELECT site, px, sensor FROM cube GROUP BY ALL HAVING count(DISTINCT doy) > 1), t AS (SELECT e.*, d.doy FROM e JOIN (SELECT DISTINCT site, doy FROM cube) d USING (site))"


@query("q_naive", _CLEAR + ", " + _TWO_DATES + ",\n" + gapfill_sql("g", "k", "t", "b1") + ", q AS (SELECT site, sensor, doy, count(b1) AS n, avg(b1) AS b1 FROM g GROUP BY ALL)", "b1")
def q_naive(spark, sf):
    return fusion.naive(fx.cube(spark, sf), ["b1"]).groupBy(*SERIES, "doy").agg(F.count("b1").alias("n"), F.avg("b1").alias("b1"))


_PIXEL_DATES = "OVER (PARTITION BY site, px ORDER BY doy ROWS BETWEEN"
_BEFORE, _BEHIND = f"{_PIXEL_DATES} UNBOUNDED PRECEDING AND 1 PRECEDING)", f"{_PIXEL_DATES} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def _stair_fill(side: str, far: str, near: str) -> str:
    """HR - LR at a neighbouring conjunction, filled without the row's own date."""
    n, f = f"CASE WHEN {side}.{near}1.d = doy THEN {side}.{near}2 ELSE {side}.{near}1 END", f"{side}.{far}1"
    return f"""CASE WHEN {side}.ok THEN {side}.v WHEN ({n}).d IS NULL THEN {f}.v WHEN {f}.d IS NULL THEN ({n}).v
        ELSE ({n}).v + ({f}.v - ({n}).v) * ({side}.d - ({n}).d) / ({f}.d - ({n}).d)::DOUBLE END - {side}.lr"""


_STAIR = f"""l AS (SELECT site, px, doy, b1, masked FROM cube WHERE sensor = 'lr'), h AS (SELECT site, px, doy, b1 AS v, NOT masked AS ok FROM cube WHERE sensor = 'hr'),
    x0 AS (SELECT h.*, l.b1 AS lr, l.masked AS lm FROM h LEFT JOIN l USING (site, px, doy)),
    x1 AS (SELECT *, last_value(CASE WHEN ok THEN {{'d': doy, 'v': v}} END IGNORE NULLS) {_BEFORE} AS p1, first_value(CASE WHEN ok THEN {{'d': doy, 'v': v}} END IGNORE NULLS) {_BEHIND} AS n1 FROM x0),
    x2 AS (SELECT *, last_value(CASE WHEN ok THEN {{'d': p1.d, 'v': p1.v}} END IGNORE NULLS) {_BEFORE} AS p2, first_value(CASE WHEN ok THEN {{'d': n1.d, 'v': n1.v}} END IGNORE NULLS) {_BEHIND} AS n2 FROM x1),
    x3 AS (SELECT *, CASE WHEN NOT lm THEN {{'d': doy, 'v': v, 'ok': ok, 'lr': lr, 'p1': p1, 'p2': p2, 'n1': n1, 'n2': n2}} END AS u FROM x2),
    x4 AS (SELECT *, last_value(u IGNORE NULLS) {_BEFORE} AS a, first_value(u IGNORE NULLS) {_BEHIND} AS b FROM x3),
    x5 AS (SELECT *, {_stair_fill("a", "p", "n")} AS da, {_stair_fill("b", "n", "p")} AS db FROM x4 WHERE lm IS NOT NULL),
    x6 AS (SELECT *, CASE WHEN db IS NULL THEN da WHEN da IS NULL THEN db ELSE da + (db - da) * (doy - a.d) / (b.d - a.d)::DOUBLE END AS diff FROM x5)"""


@query("q_stair", _STAIR + ", q AS (SELECT site, px, doy, CASE WHEN diff IS NOT NULL THEN lr + diff ELSE 0 END AS pred, lm OR diff IS NULL AS masked FROM x6)", "pred")
def q_stair(spark, sf):
    return fusion.stair(fx.cube(spark, sf), "b1")


@query("q_sen2like", """s AS (SELECT site, doy FROM cube WHERE sensor = 'hr' GROUP BY site, doy HAVING avg(masked::INT) <= 0.9), t AS (SELECT DISTINCT site, doy FROM cube WHERE sensor = 'lr'),
    w AS (SELECT t.site, t.doy, list(s.doy ORDER BY s.doy DESC) FILTER (s.doy IS NOT NULL) AS d FROM t LEFT JOIN s ON s.site = t.site AND s.doy <= t.doy GROUP BY ALL),
    l AS (SELECT cube.*, d[1] AS d1, d[2] AS d2 FROM cube JOIN w USING (site, doy) WHERE sensor = 'lr'), h AS (SELECT * FROM cube WHERE sensor = 'hr'),
    q AS (SELECT l.site, l.px, l.doy, (b.b1 - a.b1) / (d2 - d1) * (l.doy - d2) + b.b1 AS hr_pred, l.b1 AS lr, l.masked OR coalesce(a.masked, true) OR coalesce(b.masked, true) AS masked
          FROM l LEFT JOIN h a ON a.site = l.site AND a.px = l.px AND a.doy = d1 LEFT JOIN h b ON b.site = l.site AND b.px = l.px AND b.doy = d2)""", "hr_pred lr")
def q_sen2like(spark, sf):
    return fusion.extrapolate_previous(fx.cube(spark, sf), "b1", 0.9)


@query("q_pair_inputs", _nearest_sql(False).replace("<= 0.5", "<= 1").replace("q AS", "nn AS") + ", q AS (SELECT l.site, l.px, l.doy, nn.nearest_doy, nn.distance, l.b1 AS lr_b1, h.b1 AS hr_b1 FROM cube l JOIN nn ON nn.site = l.site AND nn.doy = l.doy JOIN cube h ON h.site = l.site AND h.px = l.px AND h.doy = nn.nearest_doy AND h.sensor = 'hr' WHERE l.sensor = 'lr')", "lr_b1 hr_b1")
def q_pair_inputs(spark, sf):
    return fusion.pair_inputs(fx.cube(spark, sf), ["b1"])
