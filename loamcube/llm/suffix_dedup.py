"""Suffix-array dedup: remove every byte that lies in a long string which also starts somewhere else.

The suffix array is never needed whole: only which suffixes share their first ``length`` bytes with
another. As in prefix doubling, positions get a rank, the class of the bytes at some offsets from them,
Spark brings equal ranks together, positions with a rank of their own leave, and the others are ranked
again over more bytes, until they are unique or past the threshold.

Plain doubling sorts every byte position of the corpus in every round, some 40 times the input. Here
positions are ranked in *runs*. In the text, every ``window`` consecutive positions have one position of
least hash (of the 16 bytes there), their *anchor*; equal strings of ``length`` bytes have their anchors at
equal places. The strings that start ``back`` bytes before an anchor, for ``back`` from x to y, all contain
the ``length - (y - x)`` bytes from x before the anchor on: the run's *core*. So each round gives every run
two ranks:

* the class of its core. Unique: no string of the run repeats, and the run leaves;
* the class of its *whole*, from the first string's start to the last one's end. Shared: all strings of the
  run repeat.

Where a core is shared and wholes differ (at the ends of repeated passages), one run of each class is cut
into narrower ones (``_widths``: 137 starts, 18, 1), whose cores are longer (64 bytes, 183, 200), and is
ranked again. A run of one start has core and whole of ``length`` bytes.

Ranks are hashes of content, so a rank over more bytes needs no lookup of another position's rank. Those of
wholes have 128 bits and name what is removed; those of cores have 64, and two that collide are merely
ranked once more. Groups of one rank are only ever counted, with partial sums before the shuffle, and looked
up by joins of which Spark can split a crowded side: none is brought to one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import binary_of, joined, slices, sliding_argmin, window_hashes
from loamcube.llm._shared import materialize

LENGTH = 200
WINDOW = 137
#: A run is cut into so many parts, at most, from one round to the next.
PARTS = 8
_GRAM = 16
#: Bytes that are scanned at once; a longer text is scanned in pieces, each with the bytes that follow.
_SLICE = 1 << 18
_RUN = "rid binary, lo long, more int, back int, many boolean, times int, reach long, rank1 long, rank2 binary"
_ROWS = pa.schema([("rid", pa.binary()), ("lo", pa.int64()), ("more", pa.int32()), ("back", pa.int32()), ("many", pa.bool_()), ("times", pa.int32()), ("reach", pa.int64()), ("rank1", pa.int64()), ("rank2", pa.binary())])


def _widths(window: int) -> list[int]:
    """Starts in a run, round by round, down to one."""
    out = [window]
    while out[-1] > 1:
        out.append(-(-out[-1] // PARTS) if out[-1] > 2 * PARTS + PARTS // 2 else 1)
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first position, bytes, offsets) with bounded bytes for each scan."""
    if len(offsets) == 2 and len(data) > _SLICE + length:
        for at in range(0, len(data) - length + 1, _SLICE):
            part = data[at : at + _SLICE + length - 1]
            yield at, part, np.array([0, len(part)])
    else:
        yield 0, data, offsets


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor of each run; a run ends with its anchor's windows or its document."""
    starts = max(0, len(data) - length + 1)
    head = sliding_argmin(window_hashes(data, (_GRAM,))[_GRAM], window)[:starts] if starts else np.empty(0, np.int64)
    # a start is good if its string ends inside its document
    edges = offsets[1:-1]
    good = np.ones(len(head) + 1, bool)
    for a, b in zip(np.maximum(edges - length + 1, 0).tolist(), edges.tolist(), strict=True):
        good[a:b] = False
    good[-1] = False
    new = np.ones(len(head), bool)
    np.not_equal(head[1:], head[:-1], out=new[1:])
    new[1:] |= ~good[:-2]
    new[edges[edges < len(head)]] = True
    lo = np.flatnonzero(new & good[:-1])
    if not len(lo):
        return lo, lo, lo
    # a run stops before the next run or the first bad start
    bad = np.flatnonzero(~good)
    hi = np.minimum(np.append(lo[1:], len(head)), bad[np.searchsorted(bad, lo)]) - 1
    return lo, hi, head[lo]


def _anchors(length: int, window: int):
    """Batches of (rid, text) to the runs of each text, ranked.

    Neighbouring runs of one whole, as periodic text has, are one row with its ``times``; the row's starts
    reach from ``lo`` to ``reach``.
    """
    core = length + 1 - window
    whole_of, core_of = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(binary_of(batch.column(1)), _SLICE):
                for at, data, offsets in _pieces(*joined(part), length):
                    lo, hi, head = _runs(data, offsets, length, window)
                    if not len(lo):
                        continue
                    raw = data.tobytes()
                    wholes = b"".join([whole_of(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
                    cores = np.array([core_of(raw[a : a + core]) for a in head.tolist()], np.uint64)
                    doc = np.searchsorted(offsets, lo, side="right") - 1
                    pair = np.frombuffer(wholes, np.uint64).reshape(-1, 2)
                    new = np.append(True, (pair[1:] != pair[:-1]).any(axis=1) | (lo[1:] != hi[:-1] + 1) | (doc[1:] != doc[:-1]))
                    keep = np.flatnonzero(new)
                    last = np.append(keep[1:], len(lo)) - 1
                    start = offsets[doc[keep]] - at
                    columns = [
                        batch.column(0).cast(pa.binary()).take(pa.array(first + doc[keep])),
                        pa.array(lo[keep] - start),
                        pa.array((hi - lo)[keep], pa.int32()),
                        pa.array((head - lo)[keep], pa.int32()),
                        pa.array(np.zeros(len(keep), bool)),
                        pa.array(last - keep + 1, pa.int32()),
                        pa.array(hi[last] - start),
                        pa.array(cores[keep].view(np.int64)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(lo), [None, pa.py_buffer(wholes)]).take(pa.array(keep)).cast(pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)

    return scan


def _contexts(length: int):
    """Batches of (rid, packed text, asked runs) to one row for each run, with its bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("rid", "lo", "more", "back", "many", "bytes")}
            for rid, z, runs in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = unpack(z.as_py())
                for run in runs.as_py():
                    for k in ("lo", "more", "back", "many"):
                        rows[k].append(run[k])
                    rows["rid"].append(rid.as_py())
                    rows["bytes"].append(data[run["lo"] : run["lo"] + run["more"] + length])
            yield pa.RecordBatch.from_pydict(rows, pa.schema([*(_ROWS.field(k) for k in ("rid", "lo", "more", "back", "many")), pa.field("bytes", pa.binary())]))

    return scan


def _narrower(length: int, width: int):
    """Rows (rid, lo, more, back, many, bytes) to the ranked runs of ``width`` starts that each is cut into.

    ``base`` is the start of the run that was cut. Cuts stand at multiples of ``width`` before the anchor.
    """
    whole_of, core_of = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ROWS.append(pa.field("base", pa.int64()))
        for batch in batches:
            out: list[tuple] = []
            for rid, lo, more, back, many, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for cell in range((back - more) // width, back // width + 1):
                    x, y = cell * width, (cell + 1) * width - 1
                    # starts of the run at x to y before the anchor, and what all strings at x to y contain
                    a, b = max(0, back - y), min(more, back - x)
                    ends = max(0, back - x), back - y + length
                    rank = core_of(data[ends[0] : ends[1]], cell)
                    out.append((rid, lo + a, b - a, back - a, many, 1, lo + b, rank - (1 << 64) if rank >> 63 else rank, whole_of(data[a : b + length]), lo))
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return scan


@F.arrow_udf(T.BinaryType())
def _pack(text: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press(x.as_py()) for x in binary_of(text)], pa.binary())


def _removal(length: int, want_text: bool):
    """(packed text, two lists of runs of starts) to what is removed and what is kept."""
    out = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    @F.arrow_udf(T.StructType().add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "string"))
    def cut(packed: pa.Array, sure: pa.Array, found: pa.Array) -> pa.Array:
        unpack, rows = zstandard.ZstdDecompressor().decompress, []
        for z, *lists in zip(packed, sure, found, strict=True):
            lo = hi = np.empty(0, np.int64)
            for run in lists:
                if run.is_valid and len(run):
                    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in run.values.flatten())
                    lo, hi = np.append(lo, a), np.append(hi, b + length)
            kept, removed, spans = remove_spans(unpack(z.as_py()), lo, hi)
            rows.append({"n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "ignore") if want_text else None})
        return pa.array(rows, out)

    return cut


def remove_spans(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """Cut the union of ``[lo, hi)`` out of ``data``: what is kept, bytes removed, maximal runs removed."""
    if not len(lo):
        return data, 0, 0
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    lo, hi = lo[new], hi[np.append(new[1:], len(hi)) - 1]
    edges = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(data)]]).reshape(-1, 2)
    return b"".join(data[a:b] for a, b in edges.tolist()), int((hi - lo).sum()), len(lo)


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by 128 bits; rows equal in both columns share it, and share their result."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat_ws("\u0000", *parts).cast("binary")))


def _round(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """One round of ranking: the runs whose starts all repeat (``rid``, ``lo``, ``reach``), and one run of each
    whole that shares its core with other wholes, to be cut and ranked again.
    """
    some = F.xxhash64("rank2")
    cores = rows.groupBy("rank1").agg(F.sum("times").alias("n"), F.min(some).alias("low"), F.max(some).alias("high"))
    # stored, so that the joins have plain shuffles on both sides, of which Spark splits a crowded one
    cores = materialize(cores.where("n > 1").select("rank1", (F.col("low") != F.col("high")).alias("mixed")), f"{tag}-cores")
    alive = materialize(rows.join(cores, "rank1"), f"{tag}-alive")
    mixed = alive.where("mixed")
    own = [F.first(c).alias(c) for c in ("rid", "lo", "more", "back", *(c for c in rows.columns if c == "base"))]
    wholes = mixed.groupBy("rank1", "rank2").agg((F.max("many") | (F.sum("times") > 1)).alias("many"), *own)
    wholes = materialize(wholes, f"{tag}-wholes")
    out = ("rid", "lo", "reach")
    sure = alive.where("not mixed and not many").select(*out)
    twice = wholes.where("many").select("rank1", "rank2")
    return sure.union(mixed.where("not many").join(twice, ["rank1", "rank2"], "left_semi").select(*out)), wholes.drop("rank1", "rank2")


def repeated_runs(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``rid``, ``packed`` text and two lists of runs of repeated starts for each row of ``texts`` that has any.

    ``texts`` has ``rid`` (binary, a row's name) and ``text``.
    """
    long = texts.where(F.octet_length("text") >= length)
    rows = materialize(long.mapInArrow(_anchors(length, window), _RUN), "runs")
    sure, asked = _round(rows, "first")
    # the texts of all runs that repeat or are to be cut are packed and brought to them once
    no_run, run = F.lit(None).cast("struct<lo:bigint,reach:bigint>"), F.struct("lo", "reach")
    ask = F.struct("lo", "more", "back", "many")
    each = sure.select("rid", run.alias("run"), F.lit(None).cast("struct<lo:bigint,more:int,back:int,many:boolean>").alias("ask")).union(asked.select("rid", no_run.alias("run"), ask.alias("ask")))
    each = each.groupBy("rid").agg(F.collect_set("run").alias("sure"), F.collect_set("ask").alias("ask"))
    work = materialize(long.select("rid", _pack("text").alias("packed")).join(each, "rid").dropDuplicates(["rid"]), "repeats")
    held = materialize(work.where(F.size("ask") > 0).select("rid", "packed", "ask").mapInArrow(_contexts(length), "rid binary, lo long, more int, back int, many boolean, bytes binary"), "asked")
    found = None
    for width in _widths(window)[1:]:
        rows = materialize(held.mapInArrow(_narrower(length, width), f"{_RUN}, base long"), "runs")
        more, asked = _round(rows, f"width{width}")
        found = more if found is None else found.union(more)
        if width > 1:
            base = held.select("rid", F.col("lo").alias("base"), "bytes")
            own = F.expr(f"substring(bytes, int(lo - base) + 1, more + {length})")
            held = materialize(asked.join(base, ["rid", "base"]).select("rid", "lo", "more", "back", "many", own.alias("bytes")), "asked")
    found = found.groupBy("rid").agg(F.collect_set(F.struct("lo", "reach")).alias("found"))
    return work.join(found, "rid", "left").select("rid", "packed", "sure", "found").where("size(sure) > 0 or found is not null")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW, want_text: bool = True) -> DataFrame:
    """``docs`` with ``sd_n_bytes``, ``sd_n_removed``, ``sd_n_spans``, ``sd_kept_sha256`` and ``sd_text``.

    A byte goes if a string of ``length`` bytes over it also starts at any other place of any row, the
    same row included (overlaps count). ``sd_text`` is the text without those bytes (what is left of a
    character that was cut apart goes with it), or null unless ``want_text``. A null text is empty, a text
    under ``length`` bytes neither loses nor causes anything, very long texts are scanned in slices, equal rows are
    each other's copies, an empty table gives an empty one; all columns of ``docs`` are kept (those named
    ``sd_*`` are replaced).
    """
    if not 1 < window < length - _GRAM:
        raise ValueError(f"window must lie between 1 and length - {_GRAM}")
    keyed = docs.withColumn("sd_rid", row_key(id_col, text_col))
    runs = repeated_runs(keyed.select(F.col("sd_rid").alias("rid"), F.col(text_col).alias("text")), length, window)
    cut = runs.select(F.col("rid").alias("sd_rid"), _removal(length, want_text)("packed", "sure", "found").alias("sd"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = keyed.withColumns({"sd_n_bytes": F.octet_length(text).cast("long"), "sd_kept_sha256": F.sha2(text.cast("binary"), 256)})
    if not want_text:
        # the texts need not travel
        keyed = keyed.drop(text_col)
    out = keyed.join(cut, "sd_rid", "left")
    out = out.withColumns(
        {
            "sd_n_removed": F.coalesce("sd.n_removed", F.lit(0)).cast("long"),
            "sd_n_spans": F.coalesce("sd.n_spans", F.lit(0)).cast("long"),
            "sd_kept_sha256": F.coalesce("sd.kept_sha256", "sd_kept_sha256"),
            "sd_text": F.coalesce("sd.kept", text) if want_text else F.lit(None).cast("string"),
        }
    )
    return out.drop("sd", "sd_rid")


def oracle_sql(length: int = LENGTH) -> str:
    """The report of ``documents`` for DuckDB: every string of ``length`` bytes is counted by its 128-bit hash."""
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    s AS (SELECT k, unnest(range(octet_length(b) - {length - 1})) AS i, b FROM d WHERE octet_length(b) >= {length}),
    g AS MATERIALIZED (SELECT k, i, md5_number(b[i + 1 : i + {length}]) AS h FROM s),
    r AS (SELECT k, i FROM g JOIN (SELECT h FROM g GROUP BY h HAVING count(*) > 1) USING (h)),
    o AS (SELECT k, i, coalesce(i > lag(i) OVER (PARTITION BY k ORDER BY i) + {length}, true)::INT AS opens FROM r),
    n AS (SELECT k, i, sum(opens) OVER (PARTITION BY k ORDER BY i) AS run FROM o),
    c AS (SELECT k, run, min(i) AS a, max(i) + {length} AS z FROM n GROUP BY ALL),
    e AS (SELECT k, count(*) AS n_spans, sum(z - a) AS n_removed FROM c GROUP BY k),
    p AS (SELECT k, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS f, a AS t FROM c UNION ALL SELECT k, max(z), NULL FROM c GROUP BY k),
    x AS (SELECT p.k, string_agg(hex(b[f + 1 : coalesce(t, octet_length(b))]), '' ORDER BY f) AS kept FROM p JOIN d USING (k) GROUP BY p.k)
    SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
           sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN e USING (k) LEFT JOIN x USING (k)"""
