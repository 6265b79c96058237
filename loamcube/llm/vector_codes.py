"""Vector codes from small codebooks, one for each part of a vector, whose nearest entry is found by Orchard's search.

Components are whole numbers, so distances, means and errors are exact and don't depend on how rows are dealt out.
Every entry of a codebook has a list of all entries sorted by their distance to it. A search starts at some entry, walks its
list, and jumps to the list of an entry that is nearer to the vector as soon as it meets one; entries that it has seen are
marked and not measured again. It stops where the list gets beyond twice the distance to the current entry: by
the triangle inequality no entry behind that is nearer. Squared distances are compared, so that is four times.

Only codebooks (entries times dimensions), the seeds and sums of that size pass the driver. Tasks give their sums in limbs of
32 bits; Spark adds these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._shared import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are searched together.
BLOCK = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis; exact for integers and Python's own numbers alike."""
    return ((a - b) ** 2).sum(axis=-1)


class Codebook:
    """Entries of one part and, for each, all entries by distance: ``order`` (ties to the lower index) and ``gaps`` (squared)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = squared(entries[:, None, :], entries[None, :, :])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, ties to the lower one; squared distance) of each row, by Orchard's search."""
        n, k = len(vectors), len(self.entries)
        here, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = squared(vectors, self.entries[0])
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        active = np.arange(n)
        while len(active):
            # a search ends with its list, or beyond twice the distance to the entry it is at
            active = active[at[active] < k]
            c, j = here[active], at[active]
            within = (self.gaps[c, j] <= 4 * best[active]).astype(bool)
            active, c, j = active[within], c[within], j[within]
            x = self.order[c, j]
            at[active] += 1
            new = ~marked[active, x]
            rows, x = active[new], x[new]
            marked[rows, x] = True
            d = squared(vectors[rows], self.entries[x])
            nearer = ((d < best[rows]) | ((d == best[rows]) & (x < here[rows]))).astype(bool)
            rows = rows[nearer]
            here[rows], best[rows], at[rows] = x[nearer], d[nearer], 0
        return here, best


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x): 64-bit, or Python's numbers where a squared distance could pass 64 bits."""
    values = values.astype(np.float64)
    if values.size == 0 or np.abs(values).max() * SCALE * (16.0 * values.shape[-1]) ** 0.5 < 2**31:
        return np.floor(values * SCALE).astype(np.int64)
    out = np.empty(values.shape, object)
    for i, x in np.ndenumerate(values):
        top, bottom = float(x).as_integer_ratio()
        out[i] = top * SCALE // bottom
    return out


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _books(codebooks: list) -> list[Codebook]:
    def array(entries: list) -> np.ndarray:
        small = max(abs(v) for e in entries for v in e) * (16 * len(entries[0]) * len(codebooks)) ** 0.5 < 2**31
        return np.array(entries, np.int64 if small else object)

    return [Codebook(array(entries)) for entries in codebooks]


def _assign(values: np.ndarray, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its number, the components, the indexes and the squared distances."""
    width = values.shape[1] // len(books)
    for p, book in enumerate(books):
        part = values[:, p * width : (p + 1) * width]
        yield p, part, *book.nearest(part)


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, signed digit) of a number in base 2**32, zeros left out."""
    sign, x, place = (-1, -x, 0) if x < 0 else (1, x, 0)
    while x:
        if x & 0xFFFFFFFF:
            yield place, sign * (x & 0xFFFFFFFF)
        x, place = x >> 32, place + 1


def _update(kept: DataFrame, vec_col: str, codebooks: list) -> list:
    """The codebooks after one round: each entry the floored mean of the parts nearest to it, or as it was if there are none."""
    dim = sum(len(part[0]) for part in codebooks)

    def sums(batches):
        books = _books(codebooks)
        counts = np.zeros((len(books), len(books[0].entries)), np.int64)
        totals = np.zeros((*counts.shape, dim // len(books)), object)
        for batch in batches:
            vectors = batch.column(0)
            for first in range(0, len(vectors), BLOCK):
                for p, part, index, _ in _assign(whole(_rows(vectors.slice(first, BLOCK), dim)), books):
                    counts[p] += np.bincount(index, minlength=counts.shape[1])
                    block = np.zeros(totals.shape[1:], part.dtype)
                    np.add.at(block, index, part)
                    totals[p] += block
        out = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts), strict=True)]
        out += [(p, e, i, place, digit) for (p, e, i), v in np.ndenumerate(totals) for place, digit in limbs(int(v))]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in out], pa.int64()) for i in range(5)], ["part", "entry", "pos", "place", "value"])

    found = kept.select(vec_col).mapInArrow(sums, "part long, entry long, pos long, place long, value long")
    found = found.groupBy("part", "entry", "pos", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    totals: dict[tuple[int, int, int], int] = {}
    for r in found:
        key = (r["part"], r["entry"], r["pos"])
        totals[key] = totals.get(key, 0) + (int(r["value"]) << 32 * r["place"])
    return [[[totals.get((p, e, i), 0) // n for i in range(len(entry))] if (n := totals.get((p, e, -1), 0)) else entry for e, entry in enumerate(part)] for p, part in enumerate(codebooks)]


def _usable(vec: Column, parts: int) -> Column:
    finite = F.forall(vec, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(vec) > 0) & (F.size(vec) % parts == 0), F.lit(False))


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """Codebooks ``[part][entry][component]`` of whole numbers; empty if no vector can be used.

    Each part's codebook starts as that part of the vectors of the smallest ids (rows of equal id by their vectors, null ids last)
    and is moved ``rounds`` times. The dimension is that of the smallest id's vector; see ``encode`` for what takes no part.
    """
    kept = vectors.where(_usable(F.col(vec_col), parts))
    order = [F.col(id_col).asc_nulls_last(), F.col(vec_col)]
    first = kept.orderBy(*order).select(F.size(vec_col).alias("dim")).first()
    if first is None:
        return []
    kept = kept.where(F.size(vec_col) == first["dim"])
    seeds = [r[0] for r in kept.orderBy(*order).select(vec_col).limit(entries).collect()]
    width = first["dim"] // parts
    seeds = [[int(v) for v in row] for row in whole(np.array(seeds, np.float64))]
    codebooks = [[row[p * width : (p + 1) * width] for row in seeds] for p in range(parts)]
    for _ in range(rounds):
        codebooks = _update(kept, vec_col, codebooks)
    return codebooks


def codebooks_sha256(codebooks: list) -> str:
    return hashlib.sha256(",".join(str(v) for part in codebooks for entry in part for v in entry).encode()).hexdigest()


def encode(vectors: DataFrame, codebooks: list, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector takes part, with ``vq_code`` (hex digits, two a part or as many as entries need) and ``vq_error``.

    Rows go whose vector is null, holds a null or a component that isn't finite, is empty, or is of another length than
    the codebooks' (lengths that the parts don't divide are). An error beyond 64 bits is null. Repeated rows
    get equal codes; an empty table gives an empty one. Columns of these names are replaced, all others stay.
    """
    source = vectors.drop("vq_code", "vq_error")
    out = T.StructType([*source.schema.fields, T.StructField("vq_code", T.StringType()), T.StructField("vq_error", T.LongType())])
    if not codebooks:
        return source.sparkSession.createDataFrame([], out)
    parts, dim = len(codebooks), sum(len(part[0]) for part in codebooks)
    digits = max(2, len(f"{len(codebooks[0]) - 1:x}"))
    at = source.columns.index(vec_col)

    def run(batches):
        books = _books(codebooks)
        names = np.array([f"{i:0{digits}x}" for i in range(len(codebooks[0]))], object)
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                block = batch.slice(first, BLOCK)
                codes, errors = np.full(block.num_rows, "", object), np.zeros(block.num_rows, object)
                for _, _, index, d in _assign(whole(_rows(block.column(at), dim)), books):
                    codes += names[index]
                    errors += d
                errors = [int(e) if e < 2**63 else None for e in errors]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*block.schema.names, "vq_code", "vq_error"])

    kept = source.where(_usable(F.col(vec_col), parts) & (F.size(vec_col) == dim))
    return kept.mapInArrow(run, out)


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``vq_label_error``: the errors of all rows of the same label (nulls together) added up; null beyond 64 bits.

    ``coded`` is read twice, so store it first. Sums are taken before they are dealt out and stored before the join, so that Spark
    can split the rows of a label that very many have.
    """
    coded = coded.drop("vq_label_error")
    total = coded.groupBy(F.col(label_col).alias("vq_label")).agg(F.expr("try_cast(sum(cast(vq_error as decimal(38,0))) as bigint)").alias("vq_label_error"))
    total = materialize(total, "label-errors")
    return coded.join(total, coded[label_col].eqNullSafe(total["vq_label"]), "left").drop("vq_label")


def oracle_sql() -> str:
    """The same digest over ``embeddings`` for DuckDB: every entry measured."""
    sql = f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM e),
    p AS MATERIALIZED (SELECT vec_id, CAST(part AS INT) AS part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x FROM v, range({PARTS}) t(part)),
    s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
    b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN s USING (vec_id))"""
    for n in range(ROUNDS + 1):
        sql += f""",
    a{n} AS MATERIALIZED (SELECT vec_id, part, (min([d, entry]))[2] AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM p JOIN b{n} b USING (part)) GROUP BY ALL)"""
        if n < ROUNDS:
            sql += f""",
    m{n} AS (SELECT part, entry, pos, sum(y) AS total, count(*) AS n FROM (SELECT a.part, a.entry, unnest(range(1, len(p.x) + 1)) AS pos, unnest(p.x) AS y FROM a{n} a JOIN p USING (vec_id, part)) GROUP BY ALL),
    c{n} AS (SELECT part, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM m{n} GROUP BY ALL),
    b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(c.x, b.x) AS x FROM b{n} b LEFT JOIN c{n} c USING (part, entry))"""
    return sql + f""",
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
    r AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"""
