"""Collocations from an FM-index per shard over word ids.

Texts are cut into pieces and words, and packed into shards of whole pieces. A shard's ``PhraseIndex`` holds the Burrows-Wheeler
transforms of its ids and of their reverse, sorted as deep as the longest phrase. A phrase is an interval of rows in
each of the two; one step puts a word to the left or to the right of every phrase at once and moves both intervals. The
width of an interval is the count; counts of shards are added up in Spark.

Only phrases whose parts are frequent everywhere can be, so there are three rounds: words; pairs of frequent words; then, in
texts cut wherever a pair isn't frequent, triples (a pair and a word to its right) and fours (a triple and a word to its
left). Words and pairs that are frequent go back to the shards that hold them, by joins; nothing that grows with the
corpus is broadcast. A phrase is named by the numbers of its parts, not by a hash, so counts are exact. A shard has a
phrase once in what it sends, so no phrase has more rows than there are shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.llm._bytes import binary_of
from loamcube.llm._shared import discard, drop, let_go, materialize, materialize_by

#: Words of the longest phrase, occurrences of a frequent one, per cent of a phrase's occurrences that a longer one takes over.
LONGEST, LEAST, TAKEN_OVER, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
#: Words of a shard; its last piece may take it beyond.
SHARD_WORDS = 1 << 21
#: Bytes of a text that are cut into words together.
BLOCK = 1 << 22
_BUCKETS = 1024
#: No byte of UTF-8, so it can stand between pieces.
_BREAK = b"\xff"
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, ``_BREAK`` between pieces, a block at a time."""
    first = 0
    while first < len(text):
        last = min(first + BLOCK, len(text))
        if last < len(text):
            # words aren't cut; one longer than a block makes the block longer
            cut = max(text.rfind(b" ", first, last), text.rfind(b"\n", first, last))
            if cut <= first:
                found = [i for i in (text.find(b" ", last), text.find(b"\n", last)) if i >= 0]
                cut = min(found, default=len(text) - 1)
            last = cut + 1
        yield text[first:last].translate(_LETTERS).replace(_BREAK, b" \xff ").split()
        first = last


class PhraseIndex:
    """Bidirectional FM-index of ``text``: ids from 1, 0 where a phrase can't go on. Phrases of up to ``depth`` words are exact.

    Phrases are arrays ``low``, ``size`` (rows of the forward index, sorted by what follows) and ``back`` (first row of the backward
    index, sorted by what goes before, read from right to left).
    """

    def __init__(self, text: np.ndarray, depth: int, n_words: int):
        self.n_words = n_words
        self.forward, self.counts = self._transform(text, depth)
        self._reverse = text[::-1], depth
        self._backward: np.ndarray | None = None

    def _transform(self, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(id before each sorted suffix, number of ids that are smaller than each)."""
        n = len(text)
        rank = text.astype(np.int64)
        width = 1
        # ranks of double width from pairs of ranks; a suffix ends in zeros
        while width < depth:
            pair = rank * (int(rank.max(initial=0)) + 1)
            pair[: max(n - width, 0)] += rank[width:]
            rank = np.searchsorted(np.unique(pair), pair) if 2 * width < depth else pair
            width *= 2
        order = np.argsort(rank, kind="stable")
        counts = np.zeros(self.n_words + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=self.n_words + 1), out=counts[1:])
        return text[order - 1] if n else text, counts

    @property
    def backward(self) -> np.ndarray:
        if self._backward is None:
            self._backward = self._transform(*self._reverse)[0]
        return self._backward

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(id, low, size, back) of every word in the text."""
        ids = np.flatnonzero(np.diff(self.counts)[1:]) + 1
        return ids, self.counts[ids], self.counts[ids + 1] - self.counts[ids], self.counts[ids]

    def _step(self, transform: np.ndarray, low: np.ndarray, size: np.ndarray, other: np.ndarray):
        """(parent, id, low, size, other) of every phrase with one more id, given the transform of the side it is put to."""
        total, span = int(size.sum()), self.n_words + 1
        # arrays as long as the text are reused: a worker holds few of them
        key = np.repeat(np.arange(len(low)), size)
        key *= span
        rows = np.repeat((low - np.cumsum(size) + size).astype(np.int32), size)
        rows += np.arange(total, dtype=np.int32)
        key += transform[rows]
        del rows
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, total])
        parent, ids = np.divmod(key[starts], span)
        # ids smaller than this one stand before it in the other index too
        other = other[parent] + starts - (np.cumsum(size) - size)[parent]
        kept = ids > 0
        parent, ids, sizes, other = parent[kept], ids[kept], sizes[kept], other[kept]
        # rank of an id in the transform before an interval: its place among the rows of that id
        where = transform.astype(np.int64)
        where *= len(transform) + 1
        where += np.arange(len(transform))
        where.sort()
        before = np.searchsorted(where, ids * (len(transform) + 1) + low[parent]) - self.counts[ids]
        return parent, ids, self.counts[ids] + before, sizes, other

    def left(self, low: np.ndarray, size: np.ndarray, back: np.ndarray):
        """Every phrase with a word put before it: (parent, id, low, size, back)."""
        return self._step(self.forward, low, size, back)

    def right(self, low: np.ndarray, size: np.ndarray, back: np.ndarray):
        """Every phrase with a word put behind it: (parent, id, low, size, back)."""
        parent, ids, new_back, sizes, new_low = self._step(self.backward, back, size, low)
        return parent, ids, new_low, sizes, new_back


class _Ids(dict):
    """Ids of words in the order in which they are met; names are (language, word)."""

    def __init__(self, lang: bytes, names: list[tuple[bytes, bytes]]):
        super().__init__({_BREAK: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = len(self.names)
        return self[word]


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """Shards of a task's rows (language, text): ids of the words in order, and the distinct words with languages and counts."""
    place, number = TaskContext.get().partitionId(), 0
    known: dict[bytes, _Ids] = {}
    names: list[tuple[bytes, bytes]] = []
    runs: list[np.ndarray] = []
    total = 0

    def take(lang: bytes, words: list[bytes]) -> None:
        nonlocal total
        if lang not in known:
            known[lang] = _Ids(lang, names)
        runs.append(np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words)))
        total += len(words)

    def shard() -> pa.RecordBatch:
        nonlocal number, known, names, runs, total
        ids = np.concatenate(runs)
        column = lambda values, kind: pa.array([values], pa.list_(kind))
        counts = np.bincount(ids, minlength=len(names) + 1)[1:]
        langs, words = column([n.decode() for n, _ in names], pa.string()), column([w.decode() for _, w in names], pa.string())
        out = [pa.array([(place << 32) + number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), langs, words, column(counts, pa.int64())]
        number, known, names, runs, total = number + 1, {}, [], [], 0
        return pa.RecordBatch.from_arrays(out, ["shard", "ids", "langs", "words", "counts"])

    for batch in batches:
        for lang, text in zip(binary_of(batch.column(0)).to_pylist(), binary_of(batch.column(1)), strict=True):
            for words in pieces(text.as_py()):
                if total + len(words) >= shard_words and _BREAK in words:
                    # the shard ends behind the last whole piece
                    cut = len(words) - words[::-1].index(_BREAK)
                    take(lang, words[:cut])
                    yield shard()
                    words = words[cut:]
                take(lang, words)
            take(lang, [_BREAK])
            if total >= shard_words:
                yield shard()
    if total:
        yield shard()


def _frequent_text(shard: pa.Table, local: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a shard, new ones of its frequent words, else 0; numbers of the new ids, in order)."""
    ids = np.frombuffer(shard.column("ids")[0].as_py(), np.int32)
    order = np.argsort(x)
    renamed = np.zeros(int(max(ids.max(initial=0), local.max(initial=0))) + 1, np.int32)
    renamed[local[order]] = np.arange(1, len(x) + 1)
    return np.r_[renamed[ids], np.int32(0)], x[order]


def _sliced(columns: dict[str, np.ndarray], rows: int = 1 << 16) -> pa.Table:
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})
    return pa.Table.from_batches(table.to_batches(max_chunksize=rows), table.schema)


def _pairs(shard: pa.Table, known: pa.Table) -> pa.Table:
    """Pairs of frequent words in a shard, by the words' numbers, with their counts."""
    if not known.num_rows:
        return _sliced({c: np.empty(0, np.int64) for c in ("x", "y", "shard", "n")})
    text, numbers = _frequent_text(shard, known.column("local").to_numpy(), known.column("x").to_numpy())
    text = text[(text > 0) | np.r_[True, text[:-1] > 0]]
    index = PhraseIndex(text, 2, len(numbers))
    ids, *interval = index.words()
    parent, before, _, size, _ = index.left(*interval)
    return _sliced({"x": numbers[before - 1], "y": numbers[ids[parent] - 1], "shard": np.full(len(size), shard.column("shard")[0].as_py()), "n": size})


def _longer(shard: pa.Table, found: pa.Table) -> pa.Table:
    """Triples and fours of a shard whose pairs are all frequent, by the words' numbers (0 behind a triple), with their counts."""
    if not found.num_rows:
        return _sliced({c: np.empty(0, np.int64) for c in "abcdn"})
    words = shard.column("known").combine_chunks()[0].values
    text, numbers = _frequent_text(shard, words.field("local").to_numpy(), words.field("x").to_numpy())
    one, two = (np.searchsorted(numbers, found.column(c).to_numpy()) + 1 for c in ("x", "y"))
    pairs = np.sort(one * (len(numbers) + 1) + two)
    key = text[:-1].astype(np.int64) * (len(numbers) + 1) + text[1:]
    joined = np.zeros(len(text), bool)
    joined[:-1] = (pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key) & (text[:-1] > 0) & (text[1:] > 0)
    del key
    # words of frequent pairs stay; a break follows where the next word doesn't belong to one
    kept = joined | np.r_[False, joined[:-1]]
    room = kept * (1 + ~joined)
    cut = np.zeros(int(room.sum()), np.int32)
    cut[(np.cumsum(room) - room)[kept]] = text[kept]

    index = PhraseIndex(cut, LONGEST, len(numbers))
    ids, *interval = index.words()
    parent, first, *interval = index.left(*interval)
    two = np.stack([first, ids[parent]], axis=1)
    parent, last, *interval = index.right(*interval)
    three, n_three = np.c_[two[parent], last], interval[1]
    parent, first, _, n_four, _ = index.left(*interval)
    four = np.c_[first, three[parent]]
    named = np.r_[0, numbers]
    out = np.r_[np.c_[named[three], np.zeros(len(three), np.int64), n_three], np.c_[named[four], n_four]]
    return _sliced({c: out[:, i] for i, c in enumerate("abcdn")})


def _known(vocabulary: DataFrame, rows: int, least: int) -> DataFrame:
    """Rows of ``vocabulary`` of words that occur ``least`` times in all, with that number ``f`` and a number ``x`` of the word.

    One shuffle, into so many buckets of words that none has many more than a million rows: within a bucket words are counted and
    numbered in order, so numbers are small and need no global order.
    """
    buckets = max(_BUCKETS, rows // 1_000_000)
    out = vocabulary.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    place = F.dense_rank().over(W.partitionBy("bucket").orderBy("lang", "word")).cast("long")
    out = out.withColumns({"f": F.sum("n").over(W.partitionBy("bucket", "lang", "word")), "x": (place - 1) * buckets + F.col("bucket") + 1})
    return out.where(F.col("f") >= least).drop("bucket", "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a / (l + r)): products are decimals of 38 digits, the quotient is whole."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", big(a) * F.lit(SCALE).cast("decimal(10,0)"), big(left) + big(right))


def _cuts(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``score``, ``l`` and ``r`` of the cut of the lowest score, of equal ones the first."""
    options = [F.struct(_score(F.col("f"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, (left, right) in enumerate(cuts)]
    return rows.withColumn("best", F.array_min(F.array(*options)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, taken_over: int = TAKEN_OVER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is two to four words of one piece that occur ``least`` times or more; a, l and r are how often it and the two parts of its
    cut occur, n is how many words the language has. Phrases go that stand inside a longer one which has ``taken_over`` per cent
    of their occurrences or more. A null text is empty, a null language ``und``. Whole texts are read; a piece, however long, is in one
    shard. Repeated rows count as often as they occur; an empty table gives an empty one. Other columns aren't read.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = texts.mapInArrow(lambda batches: _shards(batches, shard_words), "shard long, ids binary, langs array<string>, words array<string>, counts array<long>")
    # in buckets: what is frequent goes to the shards, and no shard is moved
    shards = materialize_by(shards, "shard", "phrase_shards")
    vocabulary = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("pos", "w")).select("shard", (F.col("pos") + 1).cast("long").alias("local"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    rows = shards.agg(F.sum(F.size("words"))).first()[0] or 0
    frequent = materialize(_known(vocabulary, rows, least), "phrase-frequent")
    words = materialize(frequent.select(F.col("x").alias("number"), "lang", "word", "f").distinct(), "phrase-words")
    known = materialize_by(frequent.select("shard", "local", "x").repartition("shard"), "shard", "phrase_known")
    discard(frequent)
    totals = materialize(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    let_go(docs.sparkSession)

    ids = shards.select("shard", "ids")
    found = ids.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lambda s, k: _pairs(s, k), "x long, y long, shard long, n long")
    # a shard has a pair once, so a pair has no more rows than there are shards
    found = found.withColumn("f", F.sum("n").over(W.partitionBy("x", "y"))).where(F.col("f") >= least).select("shard", "x", "y", "f")
    found = materialize(found, "phrase-pairs")
    pairs = materialize(found.select("x", "y", "f").distinct(), "phrase-pair-counts")
    let_go(docs.sparkSession)
    with_words = ids.join(known.groupBy("shard").agg(F.collect_list(F.struct("local", "x")).alias("known")), "shard")
    longer = with_words.groupBy("shard").cogroup(found.select("shard", "x", "y").groupBy("shard")).applyInArrow(lambda s, k: _longer(s, k), "a long, b long, c long, d long, n long")
    longer = longer.groupBy("a", "b", "c", "d").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    longer = materialize(longer, "phrase-longer")
    drop(shards)
    drop(known)
    discard(found)
    let_go(docs.sparkSession)

    word = lambda n: words.select(F.col("number").alias(n), F.col("word").alias(f"word_{n}"), F.col("f").alias(f"f_{n}"), "lang")
    two = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "f").join(word("a"), "a").join(word("b").drop("lang"), "b")
    two = materialize(two.select("a", "b", "lang", "f", "f_a", "f_b", "word_b", F.concat_ws(" ", "word_a", "word_b").alias("phrase")), "phrase-two")
    head = two.select("a", "b", "lang", F.col("f").alias("f_ab"), "f_a", "phrase")
    tail = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc"), F.col("f_b").alias("f_c"), F.col("word_b").alias("word_c"))
    three = longer.where("d = 0").drop("d").join(head, ["a", "b"]).join(tail, ["b", "c"])
    three = materialize(three.select("a", "b", "c", "lang", "f", "f_a", "f_ab", "f_bc", "f_c", "word_c", F.concat_ws(" ", "phrase", "word_c").alias("phrase")), "phrase-three")
    head = three.select("a", "b", "c", "lang", F.col("f").alias("f_abc"), "f_ab", "f_a", "phrase")
    tail = three.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("f").alias("f_bcd"), F.col("f_bc").alias("f_cd"), F.col("f_c").alias("f_d"), F.col("word_c").alias("word_d"))
    four = longer.where("d > 0").join(head, ["a", "b", "c"]).join(tail, ["b", "c", "d"]).withColumn("phrase", F.concat_ws(" ", "phrase", "word_d"))

    def inside(shorter: DataFrame, longer: DataFrame, names: str) -> DataFrame:
        """``shorter`` without what a phrase longer by a word takes over; one longer by two occurs no more often than one between."""
        of = lambda cut: longer.select(*(F.col(old).alias(new) for old, new in zip(cut, names, strict=True)), F.col("f").alias("f_longer"))
        most = of("abcd"[: len(names)]).unionByName(of("abcd"[1 : len(names) + 1])).groupBy(*names).agg(F.max("f_longer").alias("f_longer"))
        big = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
        return shorter.join(most, list(names), "left").where(F.col("f_longer").isNull() | (big("f_longer", 100) < big("f", taken_over)))

    parts = [_cuts(inside(two, longer.where("d = 0"), "ab"), [("f_a", "f_b")]), _cuts(inside(three, longer.where("d > 0"), "abc"), [("f_a", "f_bc"), ("f_ab", "f_c")]), _cuts(four, [("f_a", "f_bcd"), ("f_ab", "f_cd"), ("f_abc", "f_d")])]
    parts = [p.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score") for p in parts]
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # the first of a language are among the first of each of its parts
    out = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best_first))).where(F.col("rank") <= top).drop("part")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best_first)).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same digest over ``documents`` for DuckDB: every phrase counted."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang)"""
    for k in range(1, LONGEST + 1):
        grams = f"list_transform(range(1, len(w) - {k - 2}), lambda i: w[i : i + {k - 1}])"
        sql += f""",
    g{k} AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest({grams}) AS g FROM w WHERE len(w) >= {k}) GROUP BY ALL HAVING count(*) >= {LEAST})"""
    sql += """,
    g AS MATERIALIZED (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4),
    c AS MATERIALIZED (SELECT * FROM g WHERE len(g) > 1),"""
    sql += f"""
    t AS MATERIALIZED (SELECT lang, g, f, k, g[1 : k] AS head, g[k + 1 : len(g)] AS tail FROM c, range(1, {LONGEST}) t(k) WHERE k < len(g)),
    s AS (SELECT t.lang, t.g, t.f AS a, k, x.f AS l, y.f AS r, CAST((t.f::HUGEINT * {SCALE}) // (x.f + y.f) AS BIGINT) AS score
        FROM t JOIN g x ON x.lang = t.lang AND x.g = head JOIN g y ON y.lang = t.lang AND y.g = tail),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    i AS (SELECT lang, unnest([g[1 : len(g) - 1], g[2 : len(g)]]) AS g, f FROM c WHERE len(g) > 2),
    m AS (SELECT lang, g, max(f) AS f FROM i GROUP BY ALL),
    d AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE m.f IS NULL OR 100 * m.f < {TAKEN_OVER} * a),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d QUALIFY rank <= {TOP})
    SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang"""
    return sql
