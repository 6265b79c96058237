"""Neighbourhood operators on square tiles in pixel rows (keys, ``r``, ``c``, a value).

Linear ones are weights, one table for each axis, and go through ``weighted``: pixels are packed into strips of rows with the halo
rows that the weights reach, before they are shuffled, and each strip is computed as an array. Morphology
looks for the nearest pixel of the other kind to each side, in one running pass whatever the reach. A user's own
function of tiles goes through ``dense``, block by block as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def psf_kernel(res: float, mtf_res: float, mtf: float, half: int | None = None) -> np.ndarray:
    """Normalised Gaussian whose transfer at half the sampling frequency of ``mtf_res`` is ``mtf``."""
    mtf = min(max(mtf, 0.0), 1.0)
    half = math.ceil(mtf_res / res) if half is None else half
    k = np.zeros((2 * half + 1, 2 * half + 1))
    if mtf == 1.0:
        k[half, half] = 1.0
        return k
    sigma = math.sqrt(-math.log(max(mtf, 1e-12)) / 2) / (math.pi * 0.5 / mtf_res)
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    k = np.exp(-(res * res) * (x * x + y * y) / (2 * sigma * sigma))
    return k / k.sum()


def reflect(i: int, size: int) -> int:
    while not 0 <= i < size:
        i = -i if i < 0 else 2 * (size - 1) - i
    return i


def separated(kernel: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of column and row kernels whose products add up to ``kernel``; a Gaussian is one pair."""
    u, s, v = np.linalg.svd(kernel)
    return [(u[:, i] * s[i], v[i]) for i in range(len(s)) if s[i] > 1e-12 * s[0]]


def convolution_weights(size: int, kernel: np.ndarray) -> dict[tuple[int, int], float]:
    """(out, in) to weight of convolving one axis, borders reflected."""
    half = len(kernel) // 2
    out: dict[tuple[int, int], float] = {}
    for o in range(size):
        for d in range(-half, half + 1):
            key = (o, reflect(o + d, size))
            out[key] = out.get(key, 0.0) + float(kernel[half + d])
    return {k: w for k, w in out.items() if w != 0}


def cubic(x: float, a: float = -0.75) -> float:
    x = abs(x)
    if x <= 1:
        return (a + 2) * x**3 - (a + 3) * x**2 + 1
    return a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0.0


def linear(x: float) -> float:
    return max(0.0, 1 - abs(x))


def axis_weights(size: int, factor: float, mode: str = "bicubic") -> dict[tuple[int, int], float]:
    """(out, in) to weight of resampling one axis by ``1 / factor``: pixel centres, borders clamped."""
    f, reach = (cubic, 2) if mode == "bicubic" else (linear, 1)
    out: dict[tuple[int, int], float] = {}
    for o in range(int(size / factor)):
        x = (o + 0.5) * factor - 0.5
        base = math.floor(x)
        for i in range(base - reach + 1, base + reach + 1):
            key = (o, min(max(i, 0), size - 1))
            out[key] = out.get(key, 0.0) + f(x - i)
    return out


Weights = dict[tuple[int, int], float]
#: Cells of a strip's array, so that a batch of strips stays small.
STRIP_CELLS = 1 << 17
#: Strips that a worker holds at a time.
STRIP_BATCH = 32
#: Tiles of which a worker holds a function's rows at a time.
TILE_BATCH = 256


def _axis_table(spark: SparkSession, weights: Weights, names: tuple[str, str, str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(o, i, w) for (o, i), w in weights.items()], f"{names[0]} int, {names[1]} int, {names[2]} double"))


def identity(size: int) -> Weights:
    return {(i, i): 1.0 for i in range(size)}


def strips_of(down: list[Weights], size: int) -> list[tuple[int, int, int, int]]:
    """(first, last row of the result, first, last row read) of each strip of whole rows, last ones exclusive.

    A strip's height follows what its weights reach, so that the halo adds at most as many rows as it has.
    """
    reads: dict[int, list[int]] = {}
    for weights in down:
        for o, i in weights:
            reads.setdefault(o, []).append(i)
    rows = sorted(reads)
    reach = max((max(v) - min(v) + 1 for v in reads.values()), default=1)
    step = max(reach, STRIP_CELLS // max(size, 1) // 2, 1)
    out = []
    for first in range(0, len(rows), step):
        own = rows[first : first + step]
        out.append((own[0], own[-1] + 1, min(min(reads[o]) for o in own), max(max(reads[o]) for o in own) + 1))
    return out


def _matrix(weights: Weights, outs: tuple[int, int], ins: tuple[int, int]) -> np.ndarray:
    out = np.zeros((outs[1] - outs[0], ins[1] - ins[0]))
    for (o, i), w in weights.items():
        if outs[0] <= o < outs[1]:
            out[o - outs[0], i - ins[0]] = w
    return out


def weighted(px: DataFrame, size: int, operators: list[tuple[Weights, Weights]], keys: tuple[str, ...], value: str = "v", to: str = "v") -> DataFrame:
    """Sum over ``operators`` of weights along rows times weights along columns; ``r``, ``c`` and the new value.

    One shuffle: rows are packed into strips before it (a strip with its halo is one array for each task that holds some of
    it), and a strip of bounded size is one small product of matrices. Missing and null pixels count
    nothing; a result without any pixel under its weights is left out, one with nulls alone is null, one with a NaN or an infinity NaN.
    """
    spans = strips_of([down for down, _ in operators], size)
    if not spans:
        return px.select(*keys, "r", "c", F.col(value).cast("double").alias(to)).where("false")
    wide = (0, max(o for _, along in operators for o, _ in along) + 1)
    place = [(i, t) for t, (_, _, low, high) in enumerate(spans) for i in range(low, high)]
    table = F.broadcast(px.sparkSession.createDataFrame(place, "r int, _strip int"))
    cells = px.select(*keys, F.col("r").cast("int").alias("r"), F.struct((F.col("r") * size + F.col("c")).cast("int").alias("idx"), F.col(value).cast("double").alias("v")).alias("_px"))
    cells = cells.join(table, "r").groupBy(*keys, "_strip").agg(F.collect_list("_px").alias("_px"))
    types = [px.schema[k].dataType for k in keys]
    schema = ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in zip(keys, types, strict=True)), f"r int, c int, `{to}` double"])

    def strip(number: int, pixels: pa.StructArray, made: dict) -> list[np.ndarray]:
        """r, c, value of a strip's results, and which of them are null."""
        top, bottom, low, high = spans[number]
        if "along" not in made:
            made["along"] = [_matrix(along, wide, (0, size)).T for _, along in operators]
        if number not in made:
            made[number] = [_matrix(down, (top, bottom), (low, high)) for down, _ in operators]
        pairs = list(zip(made[number], made["along"], strict=True))
        at = pixels.field("idx").to_numpy() - low * size
        known = pixels.field("v").is_valid().to_numpy(zero_copy_only=False)
        v = pixels.field("v").fill_null(0.0).to_numpy()
        finite = np.isfinite(v)
        x = np.zeros((high - low, size))
        x.ravel()[at] = np.where(finite, v, 0.0)
        out = sum(down @ x @ along for down, along in pairs)

        def touched(cells: np.ndarray) -> np.ndarray:
            m = np.zeros(x.shape)
            m.ravel()[cells] = 1.0
            return sum((down != 0) @ m @ (along != 0) for down, along in pairs) > 0

        shown = touched(at)
        null = np.zeros(out.shape, bool) if known.all() else ~touched(at[known])
        if not finite.all():
            out[touched(at[~finite])] = np.nan
        r, c = np.nonzero(shown)
        return [(r + top).astype(np.int32), c.astype(np.int32), out[r, c], null[r, c]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        n = len(keys)
        for whole in batches:
            for first in range(0, whole.num_rows, STRIP_BATCH):
                batch = whole.slice(first, STRIP_BATCH)
                numbers, pixels = batch.column(n).to_pylist(), batch.column(n + 1)
                parts = [strip(number, pixels[i].values, made) for i, number in enumerate(numbers)]
                index = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
                r, c, v, null = (np.concatenate(column) for column in zip(*parts, strict=True))
                own = [batch.column(k).take(index) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(r), pa.array(c), pa.array(v, mask=null)], [*keys, "r", "c", to])

    return cells.mapInArrow(run, schema)


def convolve(px: DataFrame, size: int, kernel: np.ndarray, keys: tuple[str, ...], value: str = "v", to: str = "v") -> DataFrame:
    """Convolution of each tile, borders reflected; rows come back with ``r``, ``c`` and the new value alone."""
    return weighted(px, size, _convolution(size, kernel), keys, value, to)


def _convolution(size: int, kernel: np.ndarray, sign: float = 1.0) -> list[tuple[Weights, Weights]]:
    return [(convolution_weights(size, sign * down), convolution_weights(size, along)) for down, along in separated(kernel)]


def high_pass(px: DataFrame, size: int, kernel: np.ndarray, keys: tuple[str, ...], value: str = "v", to: str = "v") -> DataFrame:
    """What the kernel's blur leaves: the tile itself and the blur taken away are one operator."""
    return weighted(px, size, [(identity(size), identity(size)), *_convolution(size, kernel, -1.0)], keys, value, to)


def gradient_magnitude(px: DataFrame, keys: tuple[str, ...], value: str = "v", to: str = "grad") -> DataFrame:
    """Squared gradient: central differences, one-sided at the borders."""

    def axis(along: str, across: str):
        w = W.partitionBy(*keys, across).orderBy(along)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)

    return px.withColumns({"_gx": axis("c", "r"), "_gy": axis("r", "c")}).withColumn(to, F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).drop("_gx", "_gy")


def resample(px: DataFrame, size: int, factor: float, keys: tuple[str, ...], value: str = "v", mode: str = "bicubic", mask: str | None = None) -> DataFrame:
    """Resample by ``1 / factor`` (under 1 enlarges); the mask by the nearest cell. Factor 1 changes nothing."""
    if factor == 1:
        return px
    spark = px.sparkSession
    weights = axis_weights(size, factor, mode)
    out = _by_axes(px, size, weights, weights, keys, value)
    if mask is None:
        return out
    near = {(o, min(int(o * factor), size - 1)): 1.0 for o in range(int(size / factor))}
    m = px.select(*keys, "r", "c", mask).join(_axis_table(spark, near, ("ro", "r", "_w")).drop("_w"), "r").join(_axis_table(spark, near, ("co", "c", "_w")).drop("_w"), "c")
    return out.join(m.select(*keys, F.col("ro").alias("r"), F.col("co").alias("c"), mask), [*keys, "r", "c"])


def downsample_mtf(px: DataFrame, size: int, res: float, mtf_res: float, mtf: float, factor: float, keys: tuple[str, ...], value: str = "v", half: int | None = None) -> DataFrame:
    """Blur by the sensor's transfer function, its kernel of fixed half width if ``half`` is given, then resample."""
    return resample(convolve(px, size, psf_kernel(res, mtf_res, mtf, half), keys, value, value), size, factor, keys, value)


def shrink(px: DataFrame, size: int, factor: float, keys: tuple[str, ...], value: str = "v", mtf: float = 0.1, half: int = 3) -> DataFrame:
    """Anti-aliased shrinking by ``factor``: the kernel follows the factor, its half width is fixed."""
    return downsample_mtf(px, size, 1.0, factor, mtf, factor, keys, value, half)


def thumbnail_weights(size: int, factor: float) -> dict[tuple[int, int], float]:
    """(out, in) to weight of shrinking one axis by a triangle as wide as two cells of the result; inside the tile they add up to 1."""
    out: dict[tuple[int, int], float] = {}
    for o in range(int(size / factor)):
        x = (o + 0.5) * factor - 0.5
        taps = {i: linear((x - i) / factor) for i in range(max(math.ceil(x - factor), 0), min(math.floor(x + factor), size - 1) + 1)}
        out.update({(o, i): w / sum(taps.values()) for i, w in taps.items() if w > 0})
    return out


def thumbnail(px: DataFrame, size: int, factor: float, keys: tuple[str, ...], value: str = "v", mask: str | None = None) -> DataFrame:
    """Shrunk at read by ``factor``: values by a widened triangle, the mask by the cell at the middle."""
    weights = thumbnail_weights(size, factor)
    out = _by_axes(px, size, weights, weights, keys, value)
    if mask is None:
        return out
    near = {(o, min(int((o + 0.5) * factor), size - 1)): 1.0 for o in range(int(size / factor))}
    m = _by_axes(px.withColumn("_m", F.col(mask).cast("double")), size, near, near, keys, "_m")
    return out.join(m.select(*keys, "r", "c", (F.col("_m") > 0).alias(mask)), [*keys, "r", "c"])


def _by_axes(px: DataFrame, size: int, down: Weights, along: Weights, keys: tuple[str, ...], value: str) -> DataFrame:
    """Weighted sums over rows by ``down``, over columns by ``along``."""
    return weighted(px, size, [(down, along)], keys, value, value)


def spline_weights(size: int, offset: float, step: float = 1.0, n_out: int | None = None) -> dict[tuple[int, int], float]:
    """(out, in) to weight of the cubic spline through an axis, read at ``out * step + offset``.

    The axis is mirrored about the edges of its end cells. The spline's coefficients solve a banded system; their
    weights fall by a factor of 3.7 a cell, so those under 1e-12 are left out.
    """
    basis = lambda t: (4 - 6 * t * t + 3 * t**3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0

    def mirrored(i: int) -> int:
        i %= 2 * size
        return i if i < size else 2 * size - 1 - i

    def taps(at: list[float]) -> np.ndarray:
        out = np.zeros((len(at), size))
        for o, x in enumerate(at):
            for i in range(math.floor(x) - 1, math.floor(x) + 3):
                out[o, mirrored(i)] += basis(abs(x - i))
        return out

    own = taps([float(i) for i in range(size)])
    wanted = taps([o * step + offset for o in range(size if n_out is None else n_out)])
    weights = np.linalg.solve(own.T, wanted.T).T
    return {(int(o), int(i)): float(weights[o, i]) for o, i in zip(*np.nonzero(np.abs(weights) > 1e-12), strict=True)}


def shift_spline(px: DataFrame, size: int, dr: float, dc: float, keys: tuple[str, ...], value: str = "v", step: float = 1.0, n_out: int | None = None) -> DataFrame:
    """Tile moved by a part of a pixel along a cubic spline; ``step`` and ``n_out`` put it on another grid."""
    return _by_axes(px, size, spline_weights(size, dr, step, n_out), spline_weights(size, dc, step, n_out), keys, value)


def _runs(keys: tuple[str, ...], along: str) -> tuple:
    """Running windows to both sides of a line: each row adds itself, whatever the reach (a frame that ends behind would be read again)."""
    across = "c" if along == "r" else "r"
    line = W.partitionBy(*keys, across)
    return line.orderBy(F.asc(along)), line.orderBy(F.desc(along))


def _nearest(px: DataFrame, keys: tuple[str, ...], along: str, flag: str, k: int, any_: bool) -> DataFrame:
    """``flag`` where any, or else all, of the ``k`` places around a pixel of its line are flagged; outside counts as clear.

    Any: the nearest flagged place to one side is near enough. All: the nearest clear place to both sides, or the
    place without a pixel, is too far.
    """
    low, high = -(k // 2), (k - 1) // 2
    if not any_:
        low, high = -high, -low
    ahead, back = _runs(keys, along)
    pos, running = F.col(along), lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    if any_:
        met = F.when(F.col(flag), pos)
        px = px.withColumns({"_before": F.last(met, True).over(running(ahead)), "_behind": F.last(met, True).over(running(back))})
        near = (F.col("_before") >= pos + low) | (F.col("_behind") <= pos + high)
        return px.withColumn(flag, F.coalesce(near, F.lit(False))).drop("_before", "_behind")

    def clear(w, step: int) -> Column:
        gap = F.coalesce(F.lag(along).over(w) != pos - step, F.lit(True))
        return F.when(~F.col(flag), pos).when(gap, pos - step)

    px = px.withColumns({"_b": clear(ahead, 1), "_e": clear(back, -1)})
    px = px.withColumns({"_before": F.last("_b", True).over(running(ahead)), "_behind": F.last("_e", True).over(running(back))})
    far = F.col(flag) & (F.col("_before") < pos + low) & (F.col("_behind") > pos + high)
    return px.withColumn(flag, far).drop("_b", "_e", "_before", "_behind")


def _both_axes(px: DataFrame, keys: tuple[str, ...], flag: str, k: int, any_: bool, order: str = "rc") -> DataFrame:
    for along in order:
        px = _nearest(px, keys, along, flag, k, any_)
    return px


def dilate(px: DataFrame, k: int, keys: tuple[str, ...], flag: str = "masked") -> DataFrame:
    """Flagged where any pixel of the ``k`` x ``k`` around is; the work doesn't follow ``k``."""
    return px if k <= 1 else _both_axes(px, keys, flag, k, True)


def erode(px: DataFrame, k: int, keys: tuple[str, ...], flag: str = "masked") -> DataFrame:
    """Flagged where all pixels of the ``k`` x ``k`` around are; what lies outside isn't."""
    return px if k <= 1 else _both_axes(px, keys, flag, k, False)


def clean_mask(px: DataFrame, opening: int, dilation: int, keys: tuple[str, ...], flag: str = "masked") -> DataFrame:
    """Opening by ``opening``, then closing and dilation by ``dilation``.

    The axes of an operation may come in any order, so each begins with the one that the one before ended with: lines of the
    same axis stay where they are.
    """
    out, order = px, "rc"
    for k, any_ in ((opening, False), (opening, True), (dilation, True), (dilation, False), (dilation, True)):
        if k > 1:
            out, order = _both_axes(out, keys, flag, k, any_, order), order[::-1]
    return out


def shift_nearest(px: DataFrame, size: int, dr: float, dc: float, keys: tuple[str, ...], value: str = "v", fill: float = 0.0) -> DataFrame:
    """Tile moved by a part of a pixel, nearest neighbour; what comes from outside is ``fill``."""
    near = lambda d: {(o, i): 1.0 for o in range(size) if 0 <= (i := math.floor(o + d + 0.5)) < size}
    spark = px.sparkSession
    moved = px.select(*keys, "r", "c", value).join(_axis_table(spark, near(dr), ("ro", "r", "_w")).drop("_w"), "r").join(_axis_table(spark, near(dc), ("co", "c", "_w")).drop("_w"), "c")
    moved = moved.select(*keys, F.col("ro").alias("r"), F.col("co").alias("c"), F.col(value).alias("_moved"))
    return px.select(*keys, "r", "c").join(moved, [*keys, "r", "c"], "left").select(*keys, "r", "c", F.coalesce("_moved", F.lit(float(fill))).alias(value))


def dense(tiles: DataFrame, fn: Callable[[np.ndarray], dict[str, list] | None], array_col: str, width: int, keys: tuple[str, ...], schema: str) -> DataFrame:
    """``fn`` on each tile as a square array; its columns of rows come back with the keys.

    ``schema`` declares keys and columns. Tiles are rows, so Spark deals them out and none is gathered; rows leave the worker
    after every ``TILE_BATCH`` tiles.
    """

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), TILE_BATCH):
                pdf = whole.iloc[first : first + TILE_BATCH]
                got = [fn(np.asarray(tile, float).reshape(-1, width)) for tile in pdf[array_col]]
                shown = [i for i, columns in enumerate(got) if columns is not None]
                if shown:
                    values = {name: np.concatenate([np.asarray(got[i][name]) for i in shown]) for name in got[shown[0]]}
                    own = pdf[list(keys)].iloc[np.repeat(shown, [len(next(iter(got[i].values()))) for i in shown])]
                    yield own.reset_index(drop=True).assign(**values)

    return tiles.select(*keys, array_col).mapInPandas(run, schema)


def fft_rings(tile: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean amplitudes of a zero-padded spectrum in rings between pairs of half-axis frequencies."""
    axis = np.fft.fftshift(np.fft.fftfreq(s, d=tile.shape[-1] / s))
    half = axis[s // 2 :]
    radius = np.hypot(*np.meshgrid(axis, axis, indexing="ij"))
    amplitude = np.abs(np.fft.fftshift(np.fft.fft2(tile, s=(s, s))))
    low, high = half[:-1:2], half[1::2]
    n = min(len(low), len(high))
    rings = [(radius > a) & (radius < b) for a, b in zip(low[:n], high[:n], strict=True)]
    return (low[:n] + high[:n]) / 2, np.array([amplitude[m].mean() if m.any() else np.nan for m in rings])


def fft_profile(tiles: DataFrame, array_col: str, width: int, keys: tuple[str, ...], s: int | None = None) -> DataFrame:
    """``freq_idx``, ``freq``, ``amp`` of each tile; rings that hold no frequency are left out."""

    def fn(tile: np.ndarray):
        freq, amp = fft_rings(tile, s or 2 * width)
        met = np.flatnonzero(~np.isnan(amp))
        return {"freq_idx": met, "freq": freq[met], "amp": amp[met]}

    types = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)
    return dense(tiles, fn, array_col, width, keys, f"{types}, freq_idx int, freq double, amp double")


def frequency_restoration(pred: DataFrame, ref: DataFrame, keys: tuple[str, ...], start: int = 1, low: float = 0.0, high: float = 1.0, own_first_bin: bool = True) -> DataFrame:
    """Mean difference in dB of two profiles (keys, ``freq_idx``, ``amp``), each against its first kept bin.

    The first kept bin is 0 for both and is left out. ``own_first_bin=False`` sets the reference against the
    prediction's first bin instead.
    """
    w = W.partitionBy(*keys)
    db = lambda c: 10 * F.log10(c)
    at_first = lambda c: F.max(F.when(F.col("freq_idx") == start, db(c))).over(w)
    both = pred.select(*keys, "freq_idx", F.col("amp").alias("p")).join(ref.select(*keys, "freq_idx", F.col("amp").alias("q")), [*keys, "freq_idx"]).where(F.col("freq_idx") >= start)
    both = both.withColumns({"lp": db("p") - at_first("p"), "lq": db("q") - (at_first("q") if own_first_bin else at_first("p")), "n": F.count("*").over(w), "k": F.col("freq_idx") - start})
    first = F.greatest(F.floor(F.lit(low) * F.col("n")), F.lit(1))
    return both.where((F.col("k") >= first) & (F.col("k") < F.floor(F.lit(high) * (F.col("n") - 1)))).groupBy(*keys).agg(F.avg(F.col("lp") - F.col("lq")).alias("frr"))
