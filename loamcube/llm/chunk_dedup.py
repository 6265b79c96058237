"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash shifts left by one bit for each byte and adds the byte's code, so its bit ``k`` depends on the last
``k + 1`` bytes only. A chunk ends where some bits of the hash are zero (and it isn't too short), or where it
would get too long: boundaries follow the content, and an insertion moves them only nearby. Chunks are
deduplicated by digest: the first in order of (id, place) stays, later ones go, if they lie in a stretch of
repeated chunks that is long enough not to be a turn of phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import BYTE_CODE, binary_of, joined, slices
from loamcube.llm.suffix_dedup import remove_spans

_SLICE = 1 << 20


@dataclass(frozen=True)
class Chunking:
    """Least and greatest chunk in bytes, boundary bits (a boundary every 2**bits bytes), and the shortest stretch."""

    least: int = 24
    most: int = 128
    bits: int = 5
    stretch: int = 72


#: 16-bit code of each byte value.
GEAR = (BYTE_CODE >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """16-bit gear hash behind each byte, by doubling (fewer bytes count at the start)."""
    h = GEAR[data]
    for size in (1, 2, 4, 8):
        out = h.copy()
        out[size:] += h[:-size] << np.uint16(size)
        h = out
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, how: Chunking) -> np.ndarray:
    """Ends of the chunks of every document in ``data``; each non-empty document's end is one."""
    mask = np.uint16(((1 << how.bits) - 1) << (16 - how.bits))
    marks = np.flatnonzero((gear_hashes(data) & mask) == 0) + 1
    ends: list[int] = []
    first = np.searchsorted(marks, offsets[:-1] + how.least)
    marks_list = marks.tolist()
    n = len(marks_list)
    for at, stop, m in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), strict=True):
        while at < stop:
            low, high = at + how.least, min(at + how.most, stop)
            while m < n and marks_list[m] < low:
                m += 1
            at = marks_list[m] if m < n and marks_list[m] <= high else high
            ends.append(at)
    return np.array(ends, np.int64)


def _chunks(how: Chunking):
    """(rid, id, text) to one row for each chunk: rid, id, place, size, digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, texts = batch.column(0).to_numpy(zero_copy_only=False), binary_of(batch.column(2))
            ids = batch.column(1)
            for first, part in slices(texts, _SLICE):
                data, offsets = joined(part)
                if not len(data):
                    continue
                ends = chunk_ends(data, offsets, how)
                starts = np.concatenate([[0], ends[:-1]])
                doc = np.searchsorted(offsets, starts, side="right") - 1
                whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
                digests = np.array([digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[first + doc]), ids.take(pa.array(first + doc)), pa.array(starts - offsets[doc]), pa.array((ends - starts).astype(np.int32)), pa.array(digests.view(np.int64))],
                    ["rid", "id", "place", "size", "digest"],
                )

    return scan


@F.arrow_udf(T.BinaryType())
def _pack(text: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press(x) for x in binary_of(text).to_pylist()], pa.binary())


def stretches(places: np.ndarray, sizes: np.ndarray, later: np.ndarray, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bytes in repeated stretches of at least ``least`` bytes, and the chunks in them that aren't the first of their kind."""
    order = np.argsort(places)
    places, sizes, later = places[order], sizes[order], later[order]
    new = np.append(True, places[1:] != places[:-1] + sizes[:-1])
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights=sizes)
    long = total[run] >= least
    go = long & later
    return int(total[total >= least].sum()), places[go], places[go] + sizes[go]


def _removal(least: int, want_text: bool):
    kind = pa.struct([("n_repeated", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    @F.arrow_udf(T.StructType().add("n_repeated", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "string"))
    def cut(packed: pa.Array, chunks: pa.Array) -> pa.Array:
        unpack, rows = zstandard.ZstdDecompressor().decompress, []
        for z, c in zip(packed, chunks, strict=True):
            places, sizes, later = (x.to_numpy(zero_copy_only=False) for x in c.values.flatten())
            repeated, lo, hi = stretches(places, sizes.astype(np.int64), later.astype(bool), least)
            kept, removed, spans = remove_spans(unpack(z.as_py()), lo, hi)
            rows.append({"n_repeated": repeated, "n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode("utf-8", "ignore") if want_text else None})
        return pa.array(rows, kind)

    return cut


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking(), want_text: bool = True) -> DataFrame:  # noqa: B008
    """``docs`` with ``cd_n_bytes``, ``cd_n_repeated``, ``cd_n_removed``, ``cd_n_spans``, ``cd_kept_sha256``, ``cd_text``.

    ``cd_n_repeated`` counts bytes in stretches of at least ``how.stretch`` bytes of chunks that stand in more than
    one place, ``cd_n_removed`` those of them that aren't the first in order of id (null last) and place.
    Null and empty texts have no chunks; rows equal in id and text are one row for all purposes (each keeps
    what one of them would); an empty table gives an empty one. Columns named ``cd_*`` are replaced, all
    others stay; ``cd_text`` is null unless ``want_text``.
    """
    keyed = docs.withColumn("cd_rid", F.xxhash64(F.col(id_col), F.col(text_col)))
    texts = keyed.where(F.octet_length(text_col) > 0).select(F.col("cd_rid").alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).alias("text"))
    chunks = texts.mapInArrow(_chunks(how), "rid long, id long, place long, size int, digest long")
    mine = F.struct("id", "rid", "place")
    kinds = chunks.groupBy("digest", "size").agg(F.min(mine).alias("first"), F.max(mine).alias("last")).where("first <> last").select("digest", "size", "first")
    again = chunks.join(kinds, ["digest", "size"])
    item = F.struct("place", "size", (mine != F.col("first")).alias("later"))
    lists = again.groupBy("rid").agg(F.collect_set(item).alias("chunks")).where(F.aggregate("chunks", F.lit(0), lambda n, c: n + c["size"]) >= how.stretch)
    packed = texts.select("rid", _pack("text").alias("packed"))
    cut = packed.join(lists, "rid").dropDuplicates(["rid"]).select(F.col("rid").alias("cd_rid"), _removal(how.stretch, want_text)("packed", "chunks").alias("cd"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = keyed.withColumns({"cd_n_bytes": F.octet_length(text).cast("long"), "cd_kept_sha256": F.sha2(text.cast("binary"), 256)})
    keyed = keyed if want_text else keyed.drop(text_col)
    out = keyed.join(cut, "cd_rid", "left")
    zero = {f"cd_{c}": F.coalesce(f"cd.{c}", F.lit(0)).cast("long") for c in ("n_repeated", "n_removed", "n_spans")}
    out = out.withColumns({**zero, "cd_kept_sha256": F.coalesce("cd.kept_sha256", "cd_kept_sha256"), "cd_text": F.coalesce("cd.kept", text) if want_text else F.lit(None).cast("string")})
    return out.drop("cd", "cd_rid")
