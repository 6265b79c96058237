"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a schedule of slots. Slot ``n`` sits at the golden-ratio point ``frac(n * phi)`` of the unit
interval, on which every source owns a stretch as long as its share of slots; the points of such a sequence
fall into every stretch as evenly as points can, at every prefix of the schedule. A slot's rank among the
slots of its source says which of the source's blocks it takes: the source's documents, shuffled by a hash,
form one long text that is cut into blocks of equal words; rank ``r`` takes block ``r`` and starts over
behind the last one.

Everything is counted in words. The number of slots is a parameter (``SLOTS``), so the schedule's cost does
not depend on the corpus; the length of a block does. A source has blocks of its own length, and is cut into
``LEAST_BLOCKS`` at least, so that a small one beside huge ones meets its target too. Positions in a source's shuffled text are running
sums, taken in two steps (over hash ranges, then inside each), so that no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.llm._shared import materialize

#: Slots of the schedule; a block has at least ``LEAST_BLOCK`` words, so a small corpus has fewer slots.
SLOTS = 1 << 20
LEAST_BLOCK = 16
#: Blocks of a source, if its words suffice for so many of ``LEAST_BLOCK``.
LEAST_BLOCKS = 64
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = "mix-1"
#: 2**32 / golden ratio; the point of slot n is (n * GOLDEN mod 2**32) / 2**32.
GOLDEN = 2654435769
_CELLS = 1024
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn. All targets sum to all sizes; one stops
    at ``most_repeats`` times its source's size, and what it leaves is shared by weight among the others.
    The window has one row for each source, not for each document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumns({"turn": turn, "weight": weight.cast("long"), "most": (F.col("source_size") * most_repeats).cast("long")})
    # in order of the level at which they fill up, the first that doesn't fill sets the level of the rest
    order = W.orderBy(F.col("most").cast("double") / F.col("weight"), "turn")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumns(
        {
            "left": (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double"),
            "weights_left": (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
        }
    )
    level = F.col("left") / F.col("weights_left")
    per = per.withColumn("full", F.col("most").cast("double") / F.col("weight") <= level)
    first = W.partitionBy()
    per = per.withColumns({"l": F.max(F.when(~F.col("full"), F.struct(-F.col("most").cast("double") / F.col("weight"), -F.col("turn"), F.col("left"), F.col("weights_left")))).over(first)})
    rest = F.col("l.left") * F.col("weight") / F.col("l.weights_left")
    return per.select("source", "source_size", "weight", "turn", F.when(F.col("full") | F.col("l").isNull(), F.col("most").cast("double")).otherwise(F.least(rest, F.col("most").cast("double"))).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, slots: int = SLOTS, least_block: int = LEAST_BLOCK
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``size``, ``source``, ``source_size``, ``target``, ``taken``, ``row_key``.

    ``size`` counts words between ASCII white space (null: 0); ``target`` is the source's, in words; ``taken``
    counts the row's words in the mix, repeats included, never over ``most_repeats`` times its size. Null is a source
    of its own. Rows are shuffled by a hash of id and text, so reruns agree whatever the partitioning;
    equal rows share ``row_key`` and may differ in ``taken`` alone. A very long text is counted whole and lies in many
    blocks. Other columns of ``docs``, of whatever name, are left out. An empty table, or one without words, takes nothing.
    """
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), text_hash.alias("text_hash"))
    order = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    # texts are read once; what follows takes a few numbers of each row
    rows = materialize(rows.withColumn("place", order), "mix")
    targets = source_targets(rows, weights, most_repeats)

    # the one number that the driver needs: words in all
    total = rows.agg(F.sum("size")).first()[0] or 0
    block = max(least_block, -(-total // slots), 1)
    fewest = F.least(F.ceil(F.col("source_size") / F.lit(least_block)), F.lit(LEAST_BLOCKS))
    plan = targets.withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / F.lit(block)), fewest)).where("n_blocks > 0")
    plan = plan.withColumn("block", F.ceil(F.col("source_size") / F.col("n_blocks")))
    plan = plan.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")))
    # blocks to take, so that their expected words are the target
    plan = plan.withColumn("share", F.col("target") * F.col("n_blocks") / F.col("source_size"))
    plan = plan.withColumns({"upto": F.sum("share").over(W.orderBy("turn")), "all": F.sum("share").over(W.partitionBy())})
    ends = plan.withColumns({"a": (F.col("upto") - F.col("share")) / F.col("all") * _CELLS, "b": F.col("upto") / F.col("all") * _CELLS})
    # a source lies in the cells of the unit interval that it touches; a slot looks in its own cell
    cells = ends.withColumn("cell", F.explode(F.sequence(F.floor("a"), F.least(F.floor("b"), F.lit(_CELLS)))))
    n_slots = (plan.agg(F.ceil(F.max("upto"))).first()[0] or 0) if total else 0
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32)) * _CELLS
    schedule = spark.range(int(n_slots)).withColumn("x", point).withColumn("cell", F.floor("x"))
    slot = schedule.join(cells, "cell").where("x >= a and x < b")
    rank = F.row_number().over(W.partitionBy("turn").orderBy("id")) - 1
    slot = slot.withColumn("rank", rank).where(F.col("rank") < F.col("n_blocks") * most_repeats)
    takes = slot.groupBy("turn", (F.col("rank") % F.col("n_blocks")).alias("at")).agg(F.count("*").alias("times"))

    # running sums in two steps: over ranges of the shuffling hash, then inside a range
    rows = rows.withColumn("reach", F.substring("place", 1, 3))
    ahead = rows.groupBy("source", "reach").agg(F.sum("size").alias("words"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("reach").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = plan.select("source", "turn", "block", "n_blocks")
    inside = W.partitionBy("source", "reach").orderBy("place", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    ahead = ahead.select(F.col("source").alias("s"), F.col("reach").alias("r"), "ahead")
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(ahead, placed.source.eqNullSafe(ahead.s) & (placed.reach == ahead.r)).withColumn("offset", F.col("offset") + F.col("ahead")).drop("s", "r", "ahead")
    known = known.withColumnRenamed("source", "s")
    blocks = placed.where("size > 0").join(known, placed.source.eqNullSafe(known.s))
    blocks = blocks.withColumn("at", F.explode(F.sequence(F.expr("offset div block"), F.expr("(offset + size - 1) div block"))))
    words = F.least(F.col("offset") + F.col("size"), (F.col("at") + 1) * F.col("block")) - F.greatest(F.col("offset"), F.col("at") * F.col("block"))
    taken = blocks.join(takes, ["turn", "at"]).groupBy("source", "offset").agg(F.sum(words * F.col("times")).alias("taken"))
    taken = taken.select(F.col("source").alias("s"), F.col("offset").alias("o"), "taken")
    out = placed.join(taken, placed.source.eqNullSafe(taken.s) & (placed["offset"] == taken.o) & (placed["size"] > 0), "left")
    goal = targets.select(F.col("source").alias("t"), "source_size", "target")
    out = out.join(goal, out.source.eqNullSafe(goal.t))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.xxhash64("id", "text_hash").alias("row_key"))


def oracle_sql(slots: int = SLOTS, least_block: int = LEAST_BLOCK) -> str:
    """The mix of ``documents`` for DuckDB."""
    most = MOST_REPEATS
    fill = "most::DOUBLE / weight"
    before = f"OVER (ORDER BY {fill}, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
             md5('{SEED}:' || doc_id) AS place FROM documents),
    per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    tw AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM per),
    w AS (SELECT *, ({list(WEIGHTS)})[(turn % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight, source_size * {most} AS most FROM tw),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) {before}, 0))::DOUBLE AS lft,
                 (sum(weight) OVER () - coalesce(sum(weight) {before}, 0))::DOUBLE AS wl FROM w),
    f AS (SELECT *, {fill} <= lft / wl AS filled FROM l),
    one AS (SELECT lft AS l0, wl AS w0 FROM f WHERE NOT filled ORDER BY {fill}, turn LIMIT 1),
    goal AS (SELECT source, source_size, turn, CASE WHEN filled OR l0 IS NULL THEN most::DOUBLE ELSE least(l0 * weight / w0, most::DOUBLE) END AS target
             FROM f LEFT JOIN one ON true),
    b AS (SELECT greatest({least_block}, (sum(size) + {slots} - 1) // {slots}, 1)::BIGINT AS block FROM d),
    p1 AS (SELECT goal.*, greatest(ceil(source_size / block::DOUBLE), least(ceil(source_size / {least_block}::DOUBLE), {LEAST_BLOCKS}))::BIGINT AS nb FROM goal, b WHERE source_size > 0),
    p2 AS (SELECT * REPLACE (ceil(source_size / ceil(source_size / nb::DOUBLE))::BIGINT AS nb), ceil(source_size / nb::DOUBLE)::BIGINT AS block FROM p1),
    p3 AS (SELECT *, target * nb / source_size AS share FROM p2),
    p4 AS (SELECT *, sum(share) OVER (ORDER BY turn) AS upto, sum(share) OVER () AS everything FROM p3),
    ends AS (SELECT *, (upto - share) / everything * {_CELLS} AS a, upto / everything * {_CELLS} AS b FROM p4),
    s AS (SELECT n, (n * {GOLDEN} % {1 << 32})::DOUBLE / {1 << 32}::DOUBLE * {_CELLS} AS x FROM range((SELECT ceil(max(upto))::BIGINT FROM p4)) t(n)),
    r AS (SELECT turn, nb, row_number() OVER (PARTITION BY turn ORDER BY n) - 1 AS rnk FROM s JOIN ends ON x >= a AND x < b),
    takes AS (SELECT turn, rnk % nb AS blk, count(*) AS times FROM r WHERE rnk < nb * {most} GROUP BY ALL),
    o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d),
    x AS (SELECT doc_id, off, size, turn, block, unnest(range(off // block, (off + size - 1) // block + 1)) AS blk
          FROM o JOIN p2 ON o.source IS NOT DISTINCT FROM p2.source WHERE size > 0),
    t AS (SELECT doc_id, sum((least(off + size, (blk + 1) * block) - greatest(off, blk * block)) * times)::BIGINT AS taken FROM x JOIN takes USING (turn, blk) GROUP BY doc_id)
    SELECT d.doc_id, d.size, goal.source_size, goal.target, coalesce(t.taken, 0)::BIGINT AS taken
    FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source LEFT JOIN t ON t.doc_id = d.doc_id"""
