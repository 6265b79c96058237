"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are rotated at random and projected on a few of the rotated axes; the cells of a grid over the
projection, shifted at random, are numbered along a Hilbert curve. Spark range-partitions and sorts the
vectors by that number, once for each of ``curves`` such orderings. Near vectors tend to stand near each
other in some ordering: a query's candidates are those within a window of places around it, in any of them,
and they are reranked by the exact cosine of the original vectors.

A window is ``WINDOW_FACTOR * n ** WINDOW_POWER`` places to each side. In 64 independent dimensions the
nearest of n vectors is hardly nearer than the next ones, and no index can do with a fixed window there;
for vectors with structure a smaller one is enough. Orderings are cut into blocks, each query visits the
blocks that its window touches, and only its best few leave a block: rows grow with queries, not with pairs.

Equal vectors are searched as one, with their smallest ids, so that no common vector fills a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._shared import materialize

CURVES = 16
AXES = 8
BITS = 4
WINDOW_FACTOR = 0.22
WINDOW_POWER = 0.8
LEAST_WINDOW = 64
MOST_BLOCK = 8192


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``cells`` (unsigned, ``bits`` bits an axis).

    Axes are turned to the curve's transposed form by undoing its reflections and swaps from the top bit down,
    then Gray-decoded; the number interleaves the bits.
    """
    x = cells.astype(np.uint64)
    n, axes = x.shape
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(axes):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= low
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        turn[(x[:, axes - 1] & q) != 0] ^= q - one
    x ^= turn[:, None]
    out = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << one) | ((x[:, i] >> np.uint64(level)) & one)
    return out


def _curve_plan(dim: int, curves: int, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift) of each curve; curves share out the axes of a rotation before the next is drawn."""
    rng = np.random.default_rng(seed)
    axes = min(axes, dim)
    plan: list[tuple[np.ndarray, np.ndarray]] = []
    while len(plan) < curves:
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for first in range(0, dim - axes + 1, axes):
            plan.append((turn[:, first : first + axes], rng.random(axes)))
    return plan[:curves]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


@F.arrow_udf(T.BinaryType())
def _pack(vectors: pa.Array) -> pa.Array:
    """Arrays of doubles as bytes; null where a vector has no direction."""
    out = []
    for v in vectors:
        x = None
        if v.is_valid and v.values is not None and v.values.null_count == 0 and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False)
            most = np.abs(x).max()
            if most > 0 and np.isfinite(most):
                # a power of two leaves the cosine as it is; squares can't leave the range of doubles then
                x = x.tobytes() if 1e-100 < most < 1e100 else np.ldexp(x, -int(np.frexp(most)[1])).tobytes()
            else:
                x = None
        out.append(x)
    return pa.array(out, pa.binary())


def _numbers(dim: int, curves: int, axes: int, bits: int, seed: int):
    """(rep, vec) to (curve, number, rep)."""
    plan = _curve_plan(dim, curves, axes, seed)
    top = 2**bits - 1

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for c, (turn, shift) in enumerate(plan):
                y = x @ turn * (np.sqrt(dim) / 2.2)
                cells = np.clip((y + 1) / 2 * top + shift, 0, top).astype(np.uint64)
                number = hilbert_numbers(cells, bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(number), batch.column(0)], ["curve", "number", "rep"])

    return scan


def _rerank(keep: int):
    """Points and queries of one block to the best ``keep`` points of each query."""
    kind = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        asks = np.asarray(rows.column("query").is_valid())
        # within a block by id, so that equal scores go to the smaller
        reps = rows.column("rep").to_numpy()
        vec = _vectors(rows.column("vec").combine_chunks())
        order = np.argsort(reps, kind="stable")
        order = order[~asks[order]]
        if not len(order) or not asks.any():
            return kind.empty_table()
        points, reps = vec[order], reps[order]
        norms = np.sqrt((points * points).sum(axis=1))
        queries, ids = vec[asks], rows.column("query").to_numpy()[asks]
        out = []
        for first in range(0, len(ids), 256):
            q = queries[first : first + 256]
            score = (q @ points.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * norms)
            k = min(keep, len(reps))
            if k < len(reps):
                floor = np.partition(score, len(reps) - k, axis=1)[:, len(reps) - k]
            for i in range(len(q)):
                best = np.arange(len(reps)) if k == len(reps) else np.flatnonzero(score[i] >= floor[i])
                best = best[np.argsort(-score[i, best], kind="stable")][:k]
                out += [(int(ids[first + i]), int(reps[b]), float(score[i, b])) for b in best]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, curves: int = CURVES, axes: int = AXES, bits: int = BITS, factor: float = WINDOW_FACTOR, power: float = WINDOW_POWER, seed: int = 3
) -> DataFrame:
    """The ``k`` nearest found of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (cosine).

    ``queries`` has the ids to ask for (null: all); they are rows of ``vectors``, and never their own
    neighbours. Nearest first, ties to the smaller id. Vectors that are null, zero, of another length than most,
    or hold null or non-finite components take no part, nor do null ids; an id that stands on several rows is taken once,
    by its first vector in byte order. Components of any finite size count. Equal vectors are ranked by id. Other columns, of
    whatever name, are left out. An empty table, or one without usable vectors, gives no rows.
    """
    packed = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _pack(F.col(vector_col).cast("array<double>")).alias("vec")).where("vec is not null")
    packed = packed.groupBy("id").agg(F.min("vec").alias("vec"))
    usual = packed.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = usual.n // 8
    packed = materialize(packed.where(F.octet_length("vec") == usual.n), "vectors")
    # the k + 1 smallest ids of each distinct vector; Spark cuts each task's rows to so many before the shuffle
    ranked = packed.withColumn("nth", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("nth") <= k + 1)
    members = materialize(ranked.withColumn("rep", F.min("id").over(W.partitionBy("vec"))), "members")
    reps = members.where("nth = 1").select("rep", "vec")
    n = reps.count()
    window = max(LEAST_WINDOW, int(np.ceil(factor * n**power)))
    block = min(window, MOST_BLOCK)
    reach = -(-window // block)

    numbers = reps.mapInArrow(_numbers(dim, curves, axes, bits, seed), "curve int, number long, rep long")
    parts = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = numbers.repartitionByRange(parts, "curve", "number", "rep").sortWithinPartitions("curve", "number", "rep")
    ordered = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "curves")
    ordered = ordered.select("rep", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("own"))
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each range partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = ordered.join(before, "part").withColumn("place", F.col("before") + F.col("own"))
    # every curve orders all n
    place = place.select("rep", F.expr(f"cast(place div {n} as int)").alias("curve"), F.expr(f"(place % {n}) div {block}").alias("block"))

    asked = packed if queries is None else packed.join(queries.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    # a query stands where its vector's representative does
    asked = asked.join(reps, "vec").select(F.col("id").alias("query"), "rep", "vec")
    points = place.join(reps, "rep").select("curve", "block", F.lit(None).cast("long").alias("query"), "rep", "vec")
    around = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach))
    visits = place.join(asked, "rep").select("curve", around.alias("block"), "query", "rep", "vec").where("block >= 0")
    found = points.union(visits).groupBy("curve", "block").applyInArrow(_rerank(k + 1), "query long, rep long, score double")

    best = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    pairs = best.join(members.select("rep", F.col("id").alias("vec_id")), "rep").where("vec_id <> query")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
