"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is a row of bytes. If two fingerprints differ in at most ``max_bits`` bits, at most so many
of their bytes differ, so they share at least ``n_bytes - max_bits`` bytes *at the same positions*: the
guaranteed minimum of matches. The inverted index lists fingerprints under what they hold at some
positions; pairs that meet there are tallied over all positions, kept if they reach the minimum, and
verified bit by bit.

One byte alone is a poor key: each of its 256 lists holds a 256th of the corpus. Lists are therefore keyed
by the bytes of several positions at once, with enough sets of positions that a pair with the minimum of
matches meets at least once: eight bytes in four neighbouring pairs, of which two differing bytes spoil two
at most, give six sets of four bytes (``CONTRACT``).

A list isn't expanded into pairs. Its first fingerprint is compared with all; the others need comparing with
all only if they aren't linked to it, and only links of a spanning forest leave the task. A list of more than
``CROWD`` fingerprints isn't brought to one task either. At two bits, its fingerprints are grouped by the
points one bit away from them (and themselves): two that share a point differ in at most two bits, and two
that differ in at most two bits share one, so the groups' stars are exactly the links. At more bits, such a
list is dealt into blocks, and every two of them are brought to one task.

Bits only estimate how much two texts share. A scheme with a ``similarity`` groups texts by their fingerprints
like any other, and then checks each group exactly: texts link by the Jaccard similarity of their shingle sets
(``verified_links``). Pairs at the similarity that differ in more bits, or share no list of bytes, are looked for in lists
keyed by a few of the sets' minima under random hashes, and pass the same check.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamcube.llm._bytes import binary_of
from loamcube.llm._shared import connected_components, discard, kept, let_go, materialize, passing


#: Fingerprints of one list that a task takes at once.
CROWD = 4096
#: Shingles that vote at once.
_VOTES = 1 << 15
#: Sets of positions that are searched before the groups so far are drawn together.
FIRST_SETS = 16


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints, and when fingerprints link.

    ``words`` in a shingle; one XXH64 ``seed`` for each 8 bytes of fingerprint; ``position_sets`` key the
    lists; a pair needs ``min_matches`` equal bytes and at most ``max_bits`` differing bits. With a
    ``similarity`` (numerator, denominator) such groups are checked: texts link at this Jaccard similarity of their shingle sets.
    """

    words: int
    seeds: tuple[int, ...]
    position_sets: tuple[tuple[int, ...], ...]
    min_matches: int
    max_bits: int
    similarity: tuple[int, int] | None = None


def paired_positions(n_bytes: int, max_bits: int) -> tuple[tuple[int, ...], ...]:
    """Sets of positions of which one at least is untouched when ``max_bits`` bytes differ."""
    pairs = [(i, i + 1) for i in range(0, n_bytes, 2)]
    return tuple(sum(c, ()) for c in combinations(pairs, len(pairs) - max_bits))


def drawn_positions(n_bytes: int, size: int, count: int, seed: int = 11) -> tuple[tuple[int, ...], ...]:
    """``count`` sets of ``size`` positions, drawn once."""
    rng = np.random.default_rng(seed)
    return tuple(tuple(int(p) for p in rng.choice(n_bytes, size, replace=False)) for _ in range(count))


#: 64 bits over 3-word shingles; fingerprints link at two differing bits. Finds every link.
CONTRACT = Scheme(3, (42,), paired_positions(8, 2), 6, 2)
#: Near copies by 5-word shingles: 256 bits name a text, shingle sets of similarity 0.8 link. Lists of three bytes
#: meet 74 % of the pairs at just that similarity; minima find the rest.
NEAR = Scheme(5, (42, 43, 44, 45), drawn_positions(32, 3, 128), 3, 46, (4, 5))
#: ``BANDS`` lists of ``ROWS`` minima each. Two sets share a minimum with the probability of their similarity, so
#: a pair at 0.8 meets in no list with a probability of (1 - 0.8^5)^32 = 3e-6. Of the 160 minima it shares 128,
#: give or take 5; a pair that shares fewer than ``SHARED`` (probability 1e-7) isn't read in full.
BANDS, ROWS, SHARED = 32, 5, 100
_FACTORS, _TERMS = np.random.default_rng(12).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTORS = _FACTORS * np.uint64(2) + np.uint64(1)


def fingerprint_of(text: bytes, scheme: Scheme = CONTRACT) -> bytes:
    """Words between ASCII white space, A-Z lower-cased; every shingle votes as often as it occurs."""
    words = text.lower().split()
    k = scheme.words
    if not words:
        return bytes(8 * len(scheme.seeds))
    n = max(len(words) - k + 1, 1)
    totals = np.zeros((len(scheme.seeds), 64), np.int64)
    digest = xxhash.xxh64_digest
    # a very long text's shingles aren't all held at once
    for at in range(0, n, _VOTES):
        part = words[at : at + _VOTES + k - 1]
        shingles = [b" ".join(x) for x in zip(*(part[i:] for i in range(k)), strict=False)] if len(part) > k else [b" ".join(part)]
        for total, seed in zip(totals, scheme.seeds, strict=True):
            votes = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, 8)
            total += np.unpackbits(votes, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * totals > n, axis=1).tobytes()


def fingerprint(text: Column | str, scheme: Scheme = CONTRACT) -> Column:
    """Fingerprint as binary, most significant byte first. Null and wordless texts: zero."""

    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_py(), scheme) for x in binary_of(column)], pa.binary())

    return run(text)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles of ``k`` words that ``fingerprint_of`` lets vote; none if wordless."""
    words = text.lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(total)


def minima(shingles: np.ndarray) -> bytes:
    """16 bits of each of the set's minima."""
    if not len(shingles):
        return bytes(2 * BANDS * ROWS)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * _FACTORS + _TERMS).min(axis=0))
    return (_mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def _sketch(text: Column | str, k: int) -> Column:
    """Name of the shingle set, its size and its minima."""
    kind = T.StructType([T.StructField("cid", T.LongType()), T.StructField("size", T.LongType()), T.StructField("minima", T.BinaryType())])

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        names, sizes, least = [], [], []
        for x in binary_of(column):
            found = shingle_set(x.as_py(), k)
            # a name is never below zero
            names.append(xxhash.xxh64_intdigest(found.tobytes()) >> 1)
            sizes.append(len(found))
            least.append(minima(found))
        return pa.StructArray.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(least, pa.binary())], ["cid", "size", "minima"])

    return run(text)


def _shingles(text: Column | str, k: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(column: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x.as_py(), k).view(np.int64) for x in binary_of(column)], pa.list_(pa.int64()))

    return run(text)


@F.arrow_udf(T.IntegerType())
def _n_shared(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).sum(axis=1), pa.int32())


def verified_links(classes: DataFrame, texts: DataFrame, scheme: Scheme = NEAR, crowd: int = CROWD) -> DataFrame:
    """Links ``a``, ``b`` that connect each group of shingle sets at ``scheme.similarity``.

    ``classes`` holds each set once (``cid``, ``size``, ``fp``, ``minima``, ``row``), ``texts`` its text by ``row``. Sets whose
    fingerprints ``fingerprint_links`` puts in one group are a list, those of equal minima another. Every
    list's set that meets most others is compared with all of the list. Sets of lists that are then in several groups are compared again
    where they share one of their rarest shingles, and only with sets of other groups (``_prefix_pairs``).
    There, a list of more than ``crowd`` sets is dealt into blocks, and every block is compared with the whole list.
    """
    over, under = scheme.similarity
    worded = classes.where("size > 0")
    with passing(classes.sparkSession):
        alike = connected_components(fingerprint_links(worded.select(F.col("cid").alias("fid"), "fp"), scheme))
        alike = kept(alike.select(F.col("node").alias("cid"), F.xxhash64(F.lit("bits"), F.col("component")).alias("key")), "alike")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("minima", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    postings = worded.select("cid", "size", F.explode(bands).alias("key")).union(worded.join(alike, "cid").select("cid", "size", "key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counted = met = materialize(postings.join(shared, "key"), "met")
    # the set that meets most others is likely the one that the others of a list are copies of
    meets = met.groupBy("cid").agg(F.sum("n").alias("meets"))
    first = met.select("key", "cid").join(meets, "cid").groupBy("key").agg(F.max(F.struct("meets", "cid")).alias("first"))
    met = materialize(met.drop("n").join(materialize(first.select("key", F.col("first.cid").alias("first")), "firsts"), "key"), "met")
    discard(counted)
    wanted = classes.join(met.select("cid").distinct(), "cid", "left_semi").select("cid", "row")
    sets = materialize(texts.join(wanted, "row").dropDuplicates(["cid"]).select("cid", _shingles("text", scheme.words).alias("shingles")), "sets")
    of_a, of_b = (classes.select(F.col("cid").alias(c), F.col("size").alias(f"size_{c}"), F.col("minima").alias(f"minima_{c}")) for c in "ab")
    set_a, set_b = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(of_a, "a").join(of_b, "b")
        near = near.where(F.least("size_a", "size_b") * under >= F.greatest("size_a", "size_b") * over)
        near = materialize(near.where(_n_shared("minima_a", "minima_b") >= SHARED).select("a", "b", "size_a", "size_b"), "candidates")
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        return near.join(set_b, "b").join(set_a, "a").where(both * (over + under) >= (F.col("size_a") + F.col("size_b")) * over).select("a", "b")

    stars = materialize(verified(met.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))), "stars")
    let_go(classes.sparkSession)
    with passing(classes.sparkSession):
        found = kept(connected_components(stars), "groups")
    parted = met.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid"))
    # lists of one group have nothing left to find
    mixed = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    open_sets = parted.join(mixed, "key").select("cid", "part", "size").distinct()
    return verified(_prefix_pairs(open_sets.join(sets, "cid"), scheme, crowd)).union(stars)


def _prefix_pairs(sets: DataFrame, scheme: Scheme, crowd: int) -> DataFrame:
    """Pairs ``a``, ``b`` of sets (``cid``, ``part``, ``size``, ``shingles``) of different parts that may be similar enough.

    Two sets of s and t shingles at similarity n / m share at least n (s + t) / (n + m) of them, hence n s / m. With the
    shingles of every set in one order for all, the first that they share stands so far ahead in both that enough are
    left behind it. Rare shingles come first, so texts of one template that differ in places of their own rarely meet.
    """
    over, under = scheme.similarity
    tokens = sets.select("cid", F.explode("shingles").alias("token"))
    # stored, so that Spark splits the join of a crowded shingle
    common = materialize(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "common")
    ranked = tokens.join(common, "token", "left").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("ranked"))
    ahead = F.expr(f"slice(ranked, 1, size(ranked) - cast(ceil(size(ranked) * {over} / {under}) as int) + 1)")
    ranked = ranked.select("cid", F.posexplode(ahead).alias("at", "item")).where("item.n > 1").select("cid", F.col("item.token").alias("token"), "at")
    posts = materialize(ranked.join(sets.select("cid", "part", "size"), "cid"), "prefixes")
    own = F.min(F.struct("cid", "part")).alias("own")
    lists = posts.groupBy("token").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"), own).where("low < high")
    lists = materialize(lists.select("token", F.ceil(F.col("n") / crowd).cast("int").alias("blocks"), F.col("own.part").alias("own")), "prefix-lists")
    posts = posts.join(lists, "token")
    # what is in the first set's part needs comparing with the others only
    left = posts.where("part <> own").select("token", F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), F.col("cid").alias("x"), F.col("part").alias("part_x"), F.col("size").alias("s"), F.col("at").alias("i"))
    right = posts.select("token", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cid").alias("y"), F.col("part").alias("part_y"), F.col("size").alias("t"), F.col("at").alias("j"))
    enough = F.least(F.col("s") - F.col("i"), F.col("t") - F.col("j")) * (over + under) >= (F.col("s") + F.col("t")) * over
    apart = (F.col("part_x") != F.col("part_y")) & ((F.col("part_y") == F.col("own")) | (F.col("x") < F.col("y")))
    return left.join(right, ["token", "block"]).where(enough & apart).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _postings(scheme: Scheme):
    """(fid, fp) to one row for each set of positions: list key, fid."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
            for n, positions in enumerate(scheme.position_sets):
                key = np.full(batch.num_rows, n, np.int64)
                for p in positions:
                    key = (key << 8) | fps[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).cast(pa.int64())], ["key", "fid"])

    return scan


def links_in_list(parts: np.ndarray, fps: np.ndarray, scheme: Scheme) -> list[tuple[int, int]]:
    """Links that connect what is linked among the fingerprints of one list.

    ``parts`` names the group that each is known to be in; links go between groups, as a spanning forest.
    """

    def linked(one: int, many: np.ndarray) -> np.ndarray:
        differ = fps[many] ^ fps[one]
        tally = np.count_nonzero(differ == 0, axis=1)
        many, differ = many[tally >= scheme.min_matches], differ[tally >= scheme.min_matches]
        return many[np.bitwise_count(differ).sum(axis=1) <= scheme.max_bits]

    root = {int(p): int(p) for p in parts}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    out: list[tuple[int, int]] = []

    def join(i: int, found: np.ndarray) -> None:
        for p in np.unique(parts[found]).tolist():
            x, y = find(int(parts[i])), find(p)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(parts[i]), p))

    everyone = np.arange(len(parts))
    others = everyone[parts != parts[0]]
    near = linked(0, others)
    join(0, near)
    apart = np.setdiff1d(others, near)
    is_apart = np.isin(everyone, apart)
    for i in apart:
        join(int(i), linked(int(i), everyone[((everyone > i) | ~is_apart) & (parts != parts[i])]))
    return out


def _list_links(scheme: Scheme):
    """Rows (key, block, part, fp) sorted by key and block to links."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def links(rows: pa.Table) -> pa.RecordBatch:
            keys, blocks, parts = (rows.column(i).to_numpy() for i in range(3))
            fps = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(len(keys), -1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]), [True]]))
            out: list[tuple[int, int]] = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b - a > 1:
                    order = np.argsort(parts[a:b], kind="stable")
                    out += links_in_list(parts[a:b][order], fps[a:b][order], scheme)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            keys, blocks = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            # the last list may go on in the next batch
            cut = int(np.argmax((keys == keys[-1]) & (blocks == blocks[-1]))) if len(keys) else 0
            left = rows.slice(cut)
            if cut:
                yield links(rows.slice(0, cut))
        if left is not None and left.num_rows:
            yield links(left)

    return scan


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fid, fp) to one row for the fingerprint and for each way to flip one of its bits."""
    for batch in batches:
        if batch.num_rows:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary())], ["fid", "point"])
            for bit in range(8 * fps.shape[1]):
                flipped = fps.copy()
                flipped[:, bit // 8] ^= np.uint8(1 << bit % 8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flipped], pa.binary())], ["fid", "point"])


def fingerprint_links(fps: DataFrame, scheme: Scheme = CONTRACT, crowd: int = CROWD) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (``fid`` long, ``fp`` binary) that connect each group.

    With many sets of positions, the first few connect most of each group; the others then only look for
    links between the groups found.
    """
    fps = fps.select("fid", "fp", F.col("fid").alias("part"))
    few, more = scheme.position_sets[:FIRST_SETS], scheme.position_sets[FIRST_SETS:]
    links = _links(fps, replace(scheme, position_sets=few), crowd)
    if not more:
        return links
    with passing(fps.sparkSession):
        found = kept(connected_components(links), "groups")
    joined = fps.drop("part").join(found.withColumnRenamed("node", "fid"), "fid", "left")
    fps = materialize(joined.select("fid", "fp", F.coalesce("component", "fid").alias("part")), "grouped")
    between = _links(fps, replace(scheme, position_sets=more), crowd)
    return between.union(found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))


def _links(fps: DataFrame, scheme: Scheme, crowd: int) -> DataFrame:
    """Links between parts of ``fps`` (``fid``, ``fp``, ``part``)."""
    # fingerprints are few bytes and postings many times as many: tasks are dealt for the postings
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = fps.select("fid", "fp").repartition(tasks, "fid").mapInArrow(_postings(scheme), "key long, fid long")
    shared = postings.groupBy("key").agg(F.count("*").alias("n"), F.min("fid").alias("first")).where("n > 1")
    met = postings.join(shared, "key")
    small = met.where(F.col("n") <= crowd).select("key", F.lit(0).cast("long").alias("block"), "fid")
    crowded = met.where(F.col("n") > crowd)
    if scheme.max_bits == 2:
        points = crowded.select("fid").distinct().join(fps, "fid").select("fid", "fp").mapInArrow(_points, "fid long, point binary")
        centre = points.groupBy("point").agg(F.min("fid").alias("a"), F.max("fid").alias("z")).where("a < z").select("point", "a")
        stars = points.join(centre, "point").where("fid <> a").select("a", F.col("fid").alias("b"))
    else:
        # every two blocks meet in one task, named by both
        blocks = F.ceil(F.col("n") / crowd).cast("int")
        own = F.pmod(F.xxhash64("fid"), blocks).cast("int")
        dealt = crowded.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pair = F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")
        small, stars = small.union(dealt.select("key", pair.alias("block"), "fid")), None
    rows = small.join(fps, "fid").select("key", "block", "part", "fp").repartition("key", "block").sortWithinPartitions("key", "block")
    links = rows.mapInArrow(_list_links(scheme), "a long, b long")
    return (links if stars is None else links.union(stars)).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme, crowd: int) -> DataFrame:
    """``id``, ``row`` (hash of id and text), ``least`` and, for a scheme of bits alone, ``fp`` of each row.

    ``least`` is the first row of its group: whether it has no id, its id, its hash. Classes are named by their
    content, never by an id, which several texts may share.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col)).alias("row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    if scheme.similarity:
        named = docs.select(F.col(id_col).alias("id"), row, fingerprint(text_col, scheme).alias("fp"), _sketch(text_col, scheme.words).alias("sketch"))
        named = materialize(named.select("id", "row", "fp", "sketch.*"), "sketches")
        # texts of one set may repeat shingles unlike each other: one of their fingerprints stands for all
        classes = named.groupBy(F.col("cid").alias("name")).agg(first, F.min("row").alias("row"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("minima").alias("minima"))
        classes = materialize(classes, "classes")
        sets = classes.select(F.col("name").alias("cid"), "row", "size", "fp", "minima")
        links = verified_links(sets, docs.select(row, F.col(text_col).alias("text")), scheme, crowd)
        return _named_by_groups(named.withColumnRenamed("cid", "name").drop("fp", "size", "minima"), classes, links)
    # eight bytes are their own name
    name = F.conv(F.hex("fp"), 16, -10).cast("long") if len(scheme.seeds) == 1 else F.xxhash64("fp")
    named = docs.select(F.col(id_col).alias("id"), row, fingerprint(text_col, scheme).alias("fp"))
    named = materialize(named.withColumn("name", name), "fingerprints")
    classes = materialize(named.groupBy("name").agg(first, F.first("fp").alias("fp")), "classes")
    return _named_by_groups(named, classes, fingerprint_links(classes.select(F.col("name").alias("fid"), "fp"), scheme, crowd))


def _named_by_groups(named: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` with the ``least`` of its class's group; a class without links is a group."""
    parts = materialize(connected_components(links), "parts").withColumnRenamed("node", "name")
    own = classes.select("name", "least")
    # stored, so that Spark can split the join of a crowded group
    leasts = materialize(parts.join(own, "name").groupBy("component").agg(F.min("least").alias("of_group")), "groups")
    grouped = own.join(parts.join(leasts, "component").select("name", "of_group"), "name", "left")
    grouped = materialize(grouped.select("name", F.coalesce("of_group", "least").alias("least")), "grouped")
    return named.join(grouped, "name").drop("name")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = CONTRACT, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: its id, ``fingerprint`` (lower-case hex) and ``component_id``.

    ``component_id`` is the smallest id that links reach, itself included. Rows of equal fingerprint are one
    class, so copies cost one fingerprint. A null text has no words and links like any other; rows of null
    id take part, and their component is the smallest id among the others of their group, or null if there
    is none; repeated ids give repeated rows; the shingles of very long texts vote in slices, all of them; an empty table
    gives an empty one. Other columns, of whatever name, are left out.
    """
    found = _grouped(docs, id_col, text_col, scheme, crowd)
    if scheme.similarity:
        part = found.select("row", "least").distinct()
        named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), fingerprint(text_col, scheme).alias("fp"))
        found = named.join(part, "row")
    return found.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("least.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = NEAR, crowd: int = CROWD) -> DataFrame:
    """``docs`` without near copies: of each group the row of smallest id stays (null last, then by a hash of the row).

    Groups come from fingerprints, their bytes' lists and the count of equal ones; with a similarity they are checked on whole sets.

    Equal rows (same id, same text) count as one row: both stay or both go. Texts that resemble nothing stay,
    whatever other rows share their id. Null, empty and wordless texts are one group. Very long texts are compared whole.
    All columns are kept, but one named ``sh_row``.
    """
    with passing(docs.sparkSession):
        found = _grouped(docs, id_col, text_col, scheme, crowd)
        gone = kept(found.where(F.col("row") != F.col("least.row")).select(F.col("row").alias("sh_row")).distinct(), "near-copies")
    return docs.withColumn("sh_row", F.xxhash64(F.col(id_col), F.col(text_col))).join(gone, "sh_row", "left_anti").drop("sh_row")
