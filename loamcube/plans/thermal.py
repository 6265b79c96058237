"""Thermal sharpening by model trees, one for each window of each pair of images.

A pair is a coarse temperature image and the finer reflectances nearest to it in time. Fine pixels are averaged over
coarse cells, a tree learns temperature from the averages, each leaf holds a linear regression, and the tree is
applied to the fine pixels. There is a tree for every window of coarse cells (with cells of its neighbours around) and one
for the whole pair. All trees of all pairs grow together, a level in each round: histograms keyed by tree, node, feature and bin
give every node's best split, so no tree and no node is gathered; leaf regressions come from grouped sums of products. A
finished tree is one small row, joined to the pixels of its window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.operators import aggs, joins
from loamcube.sources.scratch import stored

#: Window number of the tree of a whole pair.
WHOLE = -1
TREE = ("_wr", "_wc")
_SPLITS = "map<int,struct<f:int,t:double>>"
_LEAF = "struct<mean:double,low:double,high:double,offset:double,slopes:array<double>>"


@dataclass(frozen=True)
class TreeParameters:
    """How trees grow, and over what.

    ``depth`` levels of splits at one of ``bins`` equal steps between a node's extremes, with ``least`` cells to each side. A leaf of
    more cells than features has a ridge regression of weight ``ridge``; predictions go beyond the leaf's extremes by
    ``extrapolation`` of their range at most. ``window`` is in coarse cells, 0 for whole pairs alone; its tree learns from cells
    ``reach`` around it too. Only the share ``homogeneous`` of a pair's cells that vary least inside is learnt from.
    Residuals are compared in the ``power`` of the temperature that radiance follows.
    """

    depth: int = 4
    bins: int = 32
    least: int = 10
    extrapolation: float = 0.25
    ridge: float = 1e-3
    window: int = 15
    reach: int = 3
    homogeneous: float = 0.8
    power: float = 4.0


def _cell(factor: int) -> dict[str, Column]:
    return {x: F.floor(F.col(x) / factor).cast("int") for x in ("r", "c")}


def training_cells(fine: DataFrame, coarse: DataFrame, factor: int, features: list[str], keys: tuple[str, ...], p: TreeParameters) -> DataFrame:
    """Clear coarse cells (keys, r, c, features, lst) that vary little inside, from clear fine pixels without missing features."""
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features])
    spread = reduce(lambda a, b: a + b, [F.coalesce(F.stddev_pop(f) / F.nullif(F.abs(F.avg(f)), F.lit(0.0)), F.lit(0.0)) for f in features]) / len(features)
    means = fine.where(~F.col("masked") & whole).withColumns(_cell(factor)).groupBy(*keys, "r", "c").agg(*[F.avg(f).alias(f) for f in features], spread.alias("_spread"))
    seen = coarse.where(~F.col("masked") & F.col("lst").isNotNull() & ~F.isnan("lst")).select(*keys, "r", "c", "lst")
    cells = means.join(seen, [*keys, "r", "c"])
    if p.homogeneous >= 1:
        return cells.drop("_spread")
    # a pair's cells are those of one image
    most = cells.groupBy(*keys).agg(F.percentile("_spread", p.homogeneous).alias("_most"))
    return cells.join(most, list(keys)).where(F.col("_spread") <= F.col("_most")).drop("_spread", "_most")


def in_windows(cells: DataFrame, p: TreeParameters) -> DataFrame:
    """Every cell in the tree of its pair and in those of the windows that reach it (``_wr``, ``_wc``)."""
    whole = cells.withColumns({w: F.lit(WHOLE) for w in TREE})
    if not p.window:
        return whole

    def near(x: str) -> Column:
        first = F.greatest(F.floor((F.col(x) - p.reach) / p.window), F.lit(0)).cast("int")
        return F.explode(F.sequence(first, F.floor((F.col(x) + p.reach) / p.window).cast("int")))

    return cells.withColumn("_wr", near("r")).withColumn("_wc", near("c")).unionByName(whole)


def _with_node(df: DataFrame, splits: Column, x: Column, depth: int, name: str = "_node") -> DataFrame:
    """``df`` with the node that ``x`` comes to; a node without a split keeps it, a missing value goes to the upper child.

    Every level is a column: in one expression each level would be computed again wherever the next one names it, so that the work
    would be a power of the depth.
    """
    node, split = F.col(name), F.col("_split")
    below = F.coalesce(F.get(x, split["f"]) < split["t"], F.lit(False))
    df = df.withColumn(name, F.lit(1))
    for _ in range(depth):
        df = df.withColumn("_split", F.try_element_at(splits, node))
        df = df.withColumn(name, F.when(split.isNull(), node).otherwise(2 * node + F.when(below, 0).otherwise(1)))
    return df.drop("_split")


def _splits(samples: DataFrame, tree: list[str], features: list[str], level: int, p: TreeParameters) -> DataFrame:
    """Best split of every node of a level: tree, ``_node``, ``f``, ``t``.

    The best one leaves the smallest sum of squares, equal ones (to nine digits) the first feature and the lowest threshold.
    """
    node = W.partitionBy(*tree, "_node")
    own = samples.where(F.col("_node") >= 2**level)
    # temperatures against the node's first guess, so that squares stay small
    own = own.withColumns({"_y": F.col("lst") - F.avg("lst").over(node), **{f"_low_{i}": F.min(f).over(node) for i, f in enumerate(features)}, **{f"_high_{i}": F.max(f).over(node) for i, f in enumerate(features)}})
    step = lambda i: (F.col(f"_high_{i}") - F.col(f"_low_{i}")) / p.bins
    cell = lambda i, f: F.least(F.floor((F.col(f) - F.col(f"_low_{i}")) / F.nullif(step(i), F.lit(0.0))).cast("int"), F.lit(p.bins - 1))
    # the value from which a bin's pixels lie above
    bins = F.array(*[F.struct(F.lit(i).alias("f"), cell(i, f).alias("bin"), F.col(f"_low_{i}").alias("low"), step(i).alias("step")) for i, f in enumerate(features)])
    hist = own.select(*tree, "_node", "_y", F.explode(bins).alias("b")).where("b.bin is not null")
    hist = hist.groupBy(*tree, "_node", "b.f", "b.bin", "b.low", "b.step").agg(F.count("*").alias("n"), F.sum("_y").alias("s"))
    line = W.partitionBy(*tree, "_node", "f")
    upto = line.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumns({"nl": F.sum("n").over(upto), "sl": F.sum("s").over(upto), "na": F.sum("n").over(line), "sa": F.sum("s").over(line)})
    nr, sr = F.col("na") - F.col("nl"), F.col("sa") - F.col("sl")
    gain = F.round(F.col("sl") * F.col("sl") / F.col("nl") + sr * sr / nr - F.col("sa") * F.col("sa") / F.col("na"), 9)
    found = hist.where((F.col("nl") >= p.least) & (nr >= p.least)).withColumn("gain", gain).where("gain > 0")
    best = F.max_by(F.struct("f", (F.col("low") + F.col("bin") * F.col("step")).alias("t")), F.struct("gain", -F.col("f"), -F.col("bin")))
    return found.groupBy(*tree, "_node").agg(best.alias("b")).select(*tree, "_node", "b.f", "b.t")


def grow(samples: DataFrame, features: list[str], tree: list[str], p: TreeParameters) -> DataFrame:
    """Trees (``tree`` columns, ``splits`` and ``leaves`` by node number) from samples with ``features`` and ``lst``.

    A node's children are ``2 n`` and ``2 n + 1``. Each round reads the samples once, sends them down the trees so far, and adds a
    level.
    """
    samples = stored(samples.select(*tree, *features, "lst"), "thermal-samples")
    x = F.array(*[F.col(f).cast("double") for f in features])
    found = None

    def routed(depth: int) -> DataFrame:
        if found is None:
            return samples.withColumn("_node", F.lit(1))
        so_far = found.groupBy(*tree).agg(F.map_from_entries(F.collect_list(F.struct("_node", F.struct("f", "t")))).alias("splits"))
        # a tree that has no split yet has no map, in which nothing is found either
        return _with_node(samples.join(so_far, tree, "left").withColumn("_x", x), F.col("splits"), F.col("_x"), depth).drop("splits", "_x")

    for level in range(p.depth):
        new = _splits(routed(level), tree, features, level, p)
        found = stored(new if found is None else found.unionByName(new), "thermal-splits")

    leaves = routed(p.depth).withColumn("masked", F.lit(False))
    means = leaves.groupBy(*tree, "_node").agg(F.avg("lst").alias("mean"), F.min("lst").alias("low"), F.max("lst").alias("high"))
    lines = aggs.ridge_multi(leaves, features, ["lst"], (*tree, "_node"), p.ridge, 1)
    place = F.array_position(F.lit(features), F.col("source"))
    lines = lines.groupBy(*tree, "_node").agg(F.first("intercept").alias("offset"), F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "coefficient"))), lambda s: s["coefficient"]).alias("slopes"))
    # at most two to the depth leaves and as many splits a tree
    leaf = F.struct("_node", F.struct("mean", "low", "high", "offset", "slopes"))
    leaves = means.join(lines, [*tree, "_node"], "left").groupBy(*tree).agg(F.map_from_entries(F.collect_list(leaf)).alias("leaves"))
    inner = found.groupBy(*tree).agg(F.map_from_entries(F.collect_list(F.struct("_node", F.struct("f", "t")))).alias("splits"))
    out = leaves.join(inner, tree, "left").withColumn("splits", F.coalesce("splits", F.expr(f"cast(map() as {_SPLITS})")))
    return out.select(*tree, "splits", F.col("leaves").cast(f"map<int,{_LEAF}>").alias("leaves"))


def predict(df: DataFrame, splits: Column, leaves: Column, x: Column, p: TreeParameters, name: str) -> DataFrame:
    """``df`` with the temperature ``name`` of features ``x``: the leaf's regression, kept near what the leaf has seen; its mean where it has none."""
    leaf = F.col("_leaf")
    line = leaf["offset"] + F.aggregate(F.zip_with(leaf["slopes"], x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    room = p.extrapolation * (leaf["high"] - leaf["low"])
    # nothing is predicted from a missing feature
    complete = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    bounded = F.greatest(F.least(line, leaf["high"] + room), leaf["low"] - room)
    df = _with_node(df, splits, x, p.depth).withColumn("_leaf", F.try_element_at(leaves, F.col("_node")))
    return df.withColumn(name, F.when(complete, F.when(leaf["offset"].isNull(), leaf["mean"]).otherwise(bounded))).drop("_node", "_leaf")


def sharpen(fine: DataFrame, coarse: DataFrame, factor: int, features: list[str], keys: tuple[str, ...], p: TreeParameters | None = None, residual: bool = True) -> DataFrame:
    """Temperature (``lst``) on the fine grid; keys, r, c, lst, masked.

    ``fine`` has keys, r, c, features, masked; ``coarse`` keys, r, c, lst, masked; rows of both are of distinct places. A window's and
    its pair's predictions are weighed in each coarse cell by the inverse squares of their residuals there. With ``residual`` what is
    left of the cell's residual is added. Masked where either image is or nothing is predicted. Nothing of one pair enters
    another's result.
    """
    p = p or TreeParameters()
    tree = [*keys, *TREE]
    trees = grow(in_windows(training_cells(fine, coarse, factor, features, keys, p), p), features, tree, p)
    trees = stored(trees, "thermal-trees")
    window = {w: F.floor(F.col(x) / max(p.window, 1)).cast("int") if p.window else F.lit(WHOLE) for w, x in zip(TREE, ("_r", "_c"), strict=True)}

    whole = trees.where(F.col("_wr") == WHOLE).select(*keys, F.col("splits").alias("_whole_splits"), F.col("leaves").alias("_whole_leaves"))
    local = trees.where(F.col("_wr") != WHOLE).select(*tree, F.col("splits").alias("_own_splits"), F.col("leaves").alias("_own_leaves"))
    cells = coarse.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("lst").alias("_seen"), F.col("masked").alias("_hidden")).withColumns(window)
    # a window's cells and trees are one row, which meets its pixels
    packed = cells.groupBy(*tree).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("_r", "_c"), F.struct("_seen", "_hidden")))).alias("_cells"))
    packed = packed.join(whole, list(keys), "left").join(local, tree, "left")

    px = fine.select(*keys, "r", "c", "masked", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    px = px.withColumns({"_r": _cell(factor)["r"], "_c": _cell(factor)["c"]}).withColumns(window).join(packed, tree, "left")
    px = px.withColumn("_cell", F.try_element_at("_cells", F.struct("_r", "_c")))
    for side in ("_own", "_whole"):
        px = predict(px, F.col(f"{side}_splits"), F.col(f"{side}_leaves"), F.col("_x"), p, side)
    px = px.select(*tree, "r", "c", "_r", "_c", F.coalesce("masked", F.lit(True)).alias("masked"), "_own", "_whole", "_cell._seen", F.coalesce("_cell._hidden", F.lit(True)).alias("_hidden"))

    # pixels of a cell are in the window's partition already
    of_cell = W.partitionBy(*tree, "_r", "_c")
    power = lambda c: F.pow(c, F.lit(p.power))
    left = lambda c: power("_seen") - F.avg(F.when(~F.col("masked"), power(c))).over(of_cell)
    px = px.withColumns({"_left_own": left("_own"), "_left_whole": left("_whole")})
    own, both = F.col("_left_own"), F.col("_left_own") * F.col("_left_own") + F.col("_left_whole") * F.col("_left_whole")
    share = F.when(own.isNull(), 0.5).when(both > 0, F.col("_left_whole") * F.col("_left_whole") / both).otherwise(0.5)
    lst = F.when(F.col("_own").isNull(), F.col("_whole")).when(F.col("_whole").isNull(), F.col("_own")).otherwise(share * F.col("_own") + (1 - share) * F.col("_whole"))
    px = px.withColumn("lst", lst)
    if residual:
        px = px.withColumn("_left", left("lst"))
        mended = F.greatest(power("lst") + F.coalesce("_left", F.lit(0.0)), F.lit(0.0))
        px = px.withColumn("lst", F.when(F.col("lst").isNotNull(), F.pow(mended, F.lit(1 / p.power))))
    return px.select(*keys, "r", "c", "lst", (F.col("masked") | F.col("_hidden") | F.col("lst").isNull()).alias("masked"))


def sharpen_series(hr: DataFrame, lr: DataFrame, factor: int, features: list[str], p: TreeParameters | None = None, residual: bool = True) -> DataFrame:
    """Thermal sharpening of each LR date by the nearest HR date of its site; tiles have site, doy, r, c."""
    near = joins.nearest_date(hr.select("site", "doy").distinct(), lr.select("site", "doy").distinct()).where("nearest_doy is not null")
    fine = hr.withColumnRenamed("doy", "nearest_doy").join(near.select("site", "doy", "nearest_doy"), ["site", "nearest_doy"])
    return sharpen(fine.drop("nearest_doy"), lr, factor, features, ("site", "doy"), p, residual)
