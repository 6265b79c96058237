"""Thermal sharpening against arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcube.operators import aggs
from loamcube.plans import thermal
from loamcube.plans.thermal import TreeParameters

FINE, COARSE = "site int, doy int, r int, c int, f1 double, f2 double, masked boolean", "site int, doy int, r int, c int, lst double, masked boolean"
KEYS = ("site", "doy")
P = TreeParameters(depth=2, bins=8, least=4, window=4, reach=1)


def brute_tree(x, y, p):
    """{node: split}, {node: leaf} of samples ``x`` (n, features) and ``y``."""
    nodes, splits, leaves = {1: np.arange(len(y))}, {}, {}
    for level in range(p.depth):
        for node in [n for n in nodes if n >= 2**level]:
            own, best = nodes[node], None
            v = y[own] - y[own].mean()
            for f in range(x.shape[1]):
                low, high = x[own, f].min(), x[own, f].max()
                if high == low:
                    continue
                step = (high - low) / p.bins
                bins = np.minimum(np.floor((x[own, f] - low) / step), p.bins - 1)
                for b in range(1, p.bins):
                    left = bins < b
                    if b not in bins or left.sum() < p.least or (~left).sum() < p.least:
                        continue
                    gain = round(v[left].sum() ** 2 / left.sum() + v[~left].sum() ** 2 / (~left).sum() - v.sum() ** 2 / len(v), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, low + b * step)
            if best:
                _, f, t = best
                splits[node] = (f, t)
                del nodes[node]
                for child, part in ((2 * node, own[x[own, f] < t]), (2 * node + 1, own[~(x[own, f] < t)])):
                    if len(part):
                        nodes[child] = part
    for node, own in nodes.items():
        n, k = len(own), x.shape[1]
        leaf = [y[own].mean(), y[own].min(), y[own].max(), None, None]
        if n > k:
            both = np.c_[x[own], y[own]]
            mean, prod = both.mean(0), both.T @ both
            std = np.sqrt(np.maximum(np.diag(prod) / (n - 1) - mean**2, 0))
            if (std > 0).all():
                z = (prod - n * np.outer(mean, mean)) / np.outer(std, std)
                beta = np.linalg.solve(z[:k, :k] + p.ridge * np.eye(k), z[:k, k]) * std[k] / std[:k]
                leaf[3:] = [mean[k] - mean[:k] @ beta, beta]
        leaves[node] = leaf
    return splits, leaves


def brute_predict(tree, x, p):
    if tree is None or not np.isfinite(x).all():
        return math.nan
    node = 1
    while node in tree[0]:
        f, t = tree[0][node]
        node = 2 * node + (0 if x[f] < t else 1)
    mean, low, high, offset, slopes = tree[1][node]
    if offset is None:
        return mean
    room = p.extrapolation * (high - low)
    return max(min(offset + slopes @ x, high + room), low - room)


def brute(fine, hidden, lst, dark, factor, p, residual=True):
    """``fine`` (rows, columns, features) and ``lst`` with their masks; temperatures and mask of one pair."""
    n = lst.shape[0]
    x, spread = np.full((n, n, fine.shape[2]), np.nan), np.full((n, n), np.nan)
    for r in range(n):
        for c in range(n):
            at = np.s_[r * factor : (r + 1) * factor, c * factor : (c + 1) * factor]
            v = fine[at][~hidden[at] & np.isfinite(fine[at]).all(-1)]
            if len(v) and not dark[r, c] and np.isfinite(lst[r, c]):
                x[r, c] = v.mean(0)
                spread[r, c] = np.mean([s / abs(m) if m else 0.0 for s, m in zip(v.std(0), v.mean(0), strict=True)])
    learnt = np.isfinite(spread)
    if p.homogeneous < 1 and learnt.any():
        learnt &= spread <= np.quantile(spread[learnt], p.homogeneous)

    def tree(rows, cols):
        part = np.zeros_like(learnt)
        part[rows, cols] = learnt[rows, cols]
        return brute_tree(x[part], lst[part], p) if part.any() else None

    whole, out = tree(np.s_[:], np.s_[:]), np.full((2, *fine.shape[:2]), np.nan)
    for wr in range(0, n, p.window or n):
        for wc in range(0, n, p.window or n):
            near = lambda w: np.s_[max(w - p.reach, 0) : w + p.window + p.reach]
            own = tree(near(wr), near(wc)) if p.window else None
            for r in range(wr * factor, min(wr + (p.window or n), n) * factor):
                for c in range(wc * factor, min(wc + (p.window or n), n) * factor):
                    out[:, r, c] = brute_predict(own, fine[r, c], p), brute_predict(whole, fine[r, c], p)
    result = np.full(fine.shape[:2], np.nan)
    mask = hidden.copy()
    for r in range(n):
        for c in range(n):
            at = np.s_[r * factor : (r + 1) * factor, c * factor : (c + 1) * factor]
            clear = ~hidden[at]

            def left(v, r=r, c=c, clear=clear):
                known = clear & np.isfinite(v)
                return lst[r, c] ** p.power - np.mean(v[known] ** p.power) if known.any() and np.isfinite(lst[r, c]) else math.nan

            own, all_ = out[0][at], out[1][at]
            a, b = left(own), left(all_)
            share = 0.5 if not math.isfinite(a) or a * a + b * b == 0 else b * b / (a * a + b * b)
            t = np.where(np.isnan(own), all_, np.where(np.isnan(all_), own, share * own + (1 - share) * all_))
            rest = left(t)
            if residual and math.isfinite(rest):
                t = np.maximum(t**p.power + rest, 0) ** (1 / p.power)
            result[at] = t
            mask[at] |= dark[r, c] | np.isnan(t)
    return result, mask


def pair(seed, relation, n=10, factor=3):
    g = np.random.default_rng(seed)
    size = n * factor
    fine = g.uniform(0.05, 0.5, (size, size, 2)) + np.linspace(0, 0.5, size)[:, None, None]
    hidden = g.random((size, size)) < 0.1
    hidden[:factor, :factor] = True
    fine[7, 7, 0] = np.nan
    x = fine.reshape(n, factor, n, factor, 2).mean((1, 3))
    x = np.where(np.isnan(x), 0.3, x)
    lst = 290 + relation(x[..., 0], x[..., 1]) + g.normal(0, 0.05, (n, n))
    return fine, hidden, lst, g.random((n, n)) < 0.08


def rows(doy, fine, hidden, lst, dark):
    f = [(1, doy, r, c, *(None if np.isnan(v) else float(v) for v in fine[r, c]), bool(hidden[r, c])) for r, c in np.ndindex(hidden.shape)]
    return f, [(1, doy, r, c, float(lst[r, c]), bool(dark[r, c])) for r, c in np.ndindex(dark.shape)]


PAIRS = {1: pair(1, lambda a, b: 20 * a - 5 * b), 2: pair(2, lambda a, b: np.where(b > 0.5, -30 * a, 8.0))}


def sharpened(spark, pairs, p, residual=True):
    fine, coarse = ([row for doy, pair in pairs.items() for row in rows(doy, *pair)[i]] for i in (0, 1))
    out = thermal.sharpen(spark.createDataFrame(fine, FINE), spark.createDataFrame(coarse, COARSE), 3, ["f1", "f2"], KEYS, p, residual)
    return {(r["doy"], r["r"], r["c"]): (r["lst"], r["masked"]) for r in out.collect()}


@pytest.mark.parametrize(("p", "residual"), [(P, True), (P, False), (TreeParameters(depth=1, bins=4, least=3, window=0, homogeneous=1.0, power=1.0), True)])
def test_trees_of_two_dates_by_brute_force(spark, p, residual):
    got = sharpened(spark, PAIRS, p, residual)
    for doy, found in PAIRS.items():
        lst, mask = brute(*found, 3, p, residual)
        for r, c in np.ndindex(lst.shape):
            value, masked = got[doy, r, c]
            assert masked == mask[r, c]
            assert value is None if np.isnan(lst[r, c]) else value == pytest.approx(lst[r, c], rel=1e-9)


def test_a_date_does_not_depend_on_others(spark):
    both, alone = sharpened(spark, PAIRS, P), sharpened(spark, {2: PAIRS[2]}, P)
    assert {k: v for k, v in both.items() if k[0] == 2} == {k: (pytest.approx(v, rel=1e-12), m) if v is not None else (v, m) for k, (v, m) in alone.items()}


def test_sharpening_recovers_a_relation_that_changes_across_the_image(spark):
    fine, hidden, _, dark = pair(3, lambda a, b: a, n=12)
    fine = np.where(np.isnan(fine), 0.3, fine)
    left = np.arange(36)[None, :] < 18
    truth = 290 + np.where(left, 20 * fine[..., 0], -20 * fine[..., 0])
    lst = truth.reshape(12, 3, 12, 3).mean((1, 3))
    p = TreeParameters(depth=1, bins=8, least=6, window=6, reach=0, homogeneous=1.0)
    got = sharpened(spark, {1: (fine, np.zeros_like(hidden), lst, np.zeros_like(dark))}, p)
    flat = np.repeat(np.repeat(lst, 3, 0), 3, 1)
    error = lambda v: np.sqrt(np.mean((v - truth) ** 2))
    assert error(np.array([[got[1, r, c][0] for c in range(36)] for r in range(36)])) < 0.3 * error(flat)


def test_pairs_without_any_clear_cell_give_masked_rows(spark):
    fine, hidden, lst, dark = PAIRS[1]
    got = sharpened(spark, {1: (fine, np.ones_like(hidden), lst, dark), 2: PAIRS[2]}, P)
    assert all(v is None and m for (doy, _, _), (v, m) in got.items() if doy == 1)
    assert any(not m for (doy, _, _), (_, m) in got.items() if doy == 2)
    assert sharpened(spark, {1: (fine, np.ones_like(hidden), lst, dark)}, P).keys() == {(1, r, c) for r, c in np.ndindex(hidden.shape)}


def test_deep_trees_cost_a_look_up_for_each_level(spark):
    depth = 12
    p = thermal.TreeParameters(depth=depth)
    # a feature below 0.5 goes to the even child all the way down
    splits = {2**d: (0, 0.5) for d in range(depth)}
    leaves = {2**depth: (1.0, 0.0, 9.0, 2.0, [4.0]), 3: (5.0, 0.0, 9.0, None, None)}
    kinds = "x array<double>, splits map<int,struct<f:int,t:double>>, leaves map<int,struct<mean:double,low:double,high:double,offset:double,slopes:array<double>>>"
    df = spark.createDataFrame([([0.25], splits, leaves), ([0.75], splits, leaves), ([None], splits, leaves), ([0.25], None, None)], kinds)
    out = thermal.predict(df, F.col("splits"), F.col("leaves"), F.col("x"), p, "lst")
    assert out.columns == [*df.columns, "lst"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("try_element_at") <= depth + 1
    assert [r.lst for r in out.collect()] == [3.0, 5.0, None, None]


def test_regressions_of_many_groups_at_once(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(b), float(2 * a - b + g)) for g in range(300) for a, b in rng.normal(size=(12, 2))]
    rows += [(-1, float(i), 0.0, float(i)) for i in range(12)] + [(-2, float("nan"), float(i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double").withColumn("masked", F.lit(False))
    got = {}
    for r in aggs.ridge_multi(df, ["a", "b"], ["y"], ("g",), 1e-9, 1).collect():
        got[r.g, r.source] = r.coefficient, r.intercept
    assert {g for g, _ in got} == set(range(300))
    assert all(abs(c - (2 if s == "a" else -1)) < 1e-6 and abs(i - g) < 1e-6 for (g, s), (c, i) in got.items())
