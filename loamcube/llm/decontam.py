"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training text.

The n-grams of the benchmark are counted first. Up to ``most_windows`` of them are broadcast at once, each
with its items. Of a larger benchmark the distinct n-grams are dealt by hash into parts of that size, each
scanned in its turn; an n-gram then only carries the name of the set of items that hold it (however many do),
findings are merged per document, and Spark joins the items to the names that were found. The scan keeps no
table of document n-grams: each document's words become numbers of the benchmark's vocabulary, runs of known
words are hashed, and a hash that hits is verified word by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import binary_of
from loamcube.llm._shared import materialize

WINDOW = 10
#: N-grams broadcast at once: some 100 MB in each Python worker.
MOST_WINDOWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bytes to bytes: A-Z to a-z, any other ASCII but a-z and 0-9 to a space, the rest (parts of other letters) as it is.
_TABLE = bytes((b | 0x20) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item`` and each of its windows as an array of words; a shorter item that has words is one window."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    items = bench.select(F.col(id_col).alias("item"), words.alias("words")).where("item is not null and size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window - 1), F.lit(1)))
    return items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("gram")).distinct()


class GramSet:
    """Windows by length, as sorted hashes of word numbers, with the items that hold each."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.vocabulary: dict[bytes, int] = {}
        items: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, gram in rows:
            numbers = tuple(self.vocabulary.setdefault(w.encode(), len(self.vocabulary)) for w in gram)
            items[len(gram)][numbers].add(item)
        self.items = {n: dict(x) for n, x in items.items()}
        rng = np.random.default_rng(5)
        self.factors = {n: rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1) for n in self.items}
        self.hashes = {n: np.unique((np.array(list(x), dtype=np.uint64) * self.factors[n]).sum(axis=1)) for n, x in self.items.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Hit flags of the words, and the items found."""
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        hit, found = np.zeros(len(words), bool), set()
        known = np.concatenate([[0], np.cumsum(numbers >= 0)])
        for n, hashes in self.hashes.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n) if len(words) >= n else np.empty(0, np.int64)
            if not len(at):
                continue
            value = np.zeros(len(at), np.uint64)
            for k, f in enumerate(self.factors[n]):
                value += numbers[at + k].astype(np.uint64) * f
            place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            for i in at[hashes[place] == value].tolist():
                holders = self.items[n].get(tuple(numbers[i : i + n].tolist()))
                if holders:
                    hit[i : i + n] = True
                    found |= holders
        return hit, found


def _scanner(shared):
    """Text to (words, hit word runs as from/to, items)."""
    run = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("items", pa.list_(pa.string()))])
    runs_type = T.ArrayType(T.StructType().add("a", "long").add("b", "long"))

    @F.arrow_udf(T.StructType().add("n_words", "long").add("runs", runs_type).add("items", T.ArrayType(T.StringType())))
    def scan(text: pa.Array) -> pa.Array:
        grams: GramSet = shared.value
        rows = []
        for x in binary_of(text):
            words = words_of(x.as_py())
            hit, items = grams.scan(words)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2).tolist() if items else []
            rows.append({"n_words": len(words), "runs": [{"a": a, "b": b} for a, b in edge], "items": sorted(items)})
        return pa.array(rows, kind)

    return scan


def item_sets(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``name``, ``gram``) and (``name``, ``item``): n-grams that the same items hold share a name.

    A name is the number of items and two sums of their hashes, so no set is ever gathered.
    """

    def total(*seed) -> Column:
        return F.sum(F.xxhash64(*seed, "item").cast("decimal(38,0)"))

    name = F.md5(F.concat_ws(":", F.count("*"), total(), total(F.lit(1))).cast("binary"))
    named = materialize(grams.groupBy("gram").agg(name.alias("name")), "item-sets")
    return named, grams.join(named.groupBy("name").agg(F.min("gram").alias("gram")), "gram").select("name", "item")


def _count_union(runs: list[dict]) -> Iterator[int]:
    end = -1
    for r in sorted(runs, key=lambda r: r["a"]):
        yield max(0, r["b"] - max(r["a"], end))
        end = max(end, r["b"])


_REPORT = T.StructType().add("n_hit", "long").add("n_items", "long").add("items_sha256", "string")


@F.arrow_udf(_REPORT)
def _report(runs: pa.Array, items: pa.Array) -> pa.Array:
    rows = [(sum(_count_union(r)) if r else 0, sorted(set(i or []))) for r, i in zip(runs.to_pylist(), items.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays(
        [pa.array([n for n, _ in rows], pa.int64()), pa.array([len(i) for _, i in rows], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, i in rows])], ["n_hit", "n_items", "items_sha256"]
    )


def scan_documents(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``dc_n_words``, ``dc_n_hit``, ``dc_n_items``, ``dc_items_sha256``, ``dc_contaminated``, ``dc_runs``.

    Words are runs of a-z (A-Z lower-cased), 0-9 and non-ASCII characters. A document word is hit if it
    lies in an occurrence of a window of the benchmark; ``dc_runs`` has the hit runs of words (first, one
    past the last). Null and empty texts have no words; very long ones are scanned whole, by one task each. Every
    row of ``docs`` comes out once, repeated rows with equal reports; items of null id are left out, equal items
    count once; an empty benchmark hits nothing; columns named ``dc_*`` are replaced and all others stay.
    """
    spark = docs.sparkSession
    grams = materialize(benchmark_windows(bench, item_col, bench_text_col, window).select(F.col("item").cast("string"), "gram"), "grams")

    def scanned(rows: DataFrame, own: DataFrame) -> DataFrame:
        # bounded: about most_windows rows of (holder, gram)
        shared = spark.sparkContext.broadcast(GramSet([tuple(r) for r in own.collect()]))
        return rows.withColumn("dc", _scanner(shared)(F.col(text_col)))

    if grams.count() <= most_windows:
        out = scanned(docs, grams.select("item", "gram"))
    else:
        named, holders = item_sets(grams)
        parts = -(-named.count() // most_windows)
        keyed = docs.withColumn("dc_row", F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)))
        part = F.pmod(F.xxhash64("gram"), F.lit(parts))
        pieces = [scanned(keyed, named.where(part == p).select("name", "gram")).select("dc_row", "dc.*") for p in range(parts)]
        merged = reduce(DataFrame.union, pieces).groupBy("dc_row").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_set("runs")).alias("runs"), F.flatten(F.collect_set("items")).alias("names")
        )
        merged = materialize(merged, "findings")
        items = merged.select("dc_row", F.explode("names").alias("name")).join(holders, "name").groupBy("dc_row").agg(F.collect_set("item").alias("items"))
        merged = merged.join(items, "dc_row", "left").select("dc_row", F.struct("n_words", "runs", "items").alias("dc"))
        out = keyed.join(merged, "dc_row").drop("dc_row")
    out = out if keep_text else out.drop(text_col)
    out = out.withColumn("dc_report", _report("dc.runs", "dc.items"))
    return out.withColumns(
        {
            "dc_n_words": F.col("dc.n_words"),
            "dc_n_hit": F.col("dc_report.n_hit"),
            "dc_n_items": F.col("dc_report.n_items"),
            "dc_items_sha256": F.col("dc_report.items_sha256"),
            "dc_contaminated": F.col("dc_report.n_hit") > 0,
            "dc_runs": F.col("dc.runs"),
        }
    ).drop("dc", "dc_report")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    names = docs.columns
    return scan_documents(docs, bench, text_col, **options).where(~F.col("dc_contaminated")).select(*names)


def oracle_sql(window: int = WINDOW) -> str:
    """The report of ``documents`` against ``benchmark`` for DuckDB."""
    words = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    g AS (SELECT DISTINCT item, w[i + 1 : i + {window}] AS gram FROM b, unnest(range(greatest(len(w) - {window - 1}, 1))) u(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT len(gram) AS n FROM g),
    d AS (SELECT doc_id, coalesce({words}, CAST([] AS VARCHAR[])) AS w FROM documents),
    h AS (SELECT doc_id, i, n, w[i + 1 : i + n] AS gram FROM d, sizes, unnest(range(greatest(len(w) - n + 1, 0))) u(i)),
    m AS (SELECT h.doc_id, h.i, h.n, g.item FROM h JOIN g ON h.gram = g.gram),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) u(k) GROUP BY doc_id),
    it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
