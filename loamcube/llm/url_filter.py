"""URL rules by sorted sweeps.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. With the labels of a host
turned round and ended by a point (``net.example.www.``), a rule's host and what lies below it are an interval of the sorted
keys, and so are the paths that start with its path. Intervals of prefixes are nested or apart, so a sweep over
sorted keys keeps a stack: the rules that are open at a key are those of the stack of the last rule that began before
it, without those that have ended since.

The sweep is dealt out by ranges of keys. Each range gives the stack of the last rule that begins in it; a running last
value over these (one row a range) is the stack that the next range starts with. Keys are distinct before they are swept, so
a host or url that many pages share is one key. Two sweeps follow each other: hosts against hosts of rules, then the
paths, below each host of a rule that is open there, against the paths of its rules.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamcube.llm._shared import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict of the rules that the query applies.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict of a url that no rule fits.
DEFAULT = "allow"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end. Else empty."""
    behind = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))).otherwise(F.lit(""))
    behind = F.coalesce(behind, F.lit(""))
    host = F.regexp_extract(behind, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(behind, F.length(host) + 1, F.length(behind)), "^[^?#]*", 0)
    return lowered(host), path


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a point: a host is a prefix of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def nested(prefixes: DataFrame) -> DataFrame:
    """``key`` and its ``stack``: the prefixes that ``key`` lies in, itself last. ``prefixes`` has distinct ``key``."""
    heads = prefixes.select("key", F.explode(F.expr("transform(sequence(1, greatest(length(key), 1)), n -> left(key, n))")).alias("head"))
    met = heads.join(prefixes.select(F.col("key").alias("head")), "head", "left_semi")
    return met.groupBy("key").agg(F.array_sort(F.collect_set("head")).alias("stack"))


def open_prefixes(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``key`` and ``stack``: for each of the distinct ``points`` that lies in any prefix those that it lies in, longest last.

    One sweep over the sorted keys of both. The ranges are written before they are swept, so that a task that is run
    again finds the same ones.
    """
    starts = nested(prefixes).withColumn("point", F.lit(False))
    events = points.select("key", F.lit(None).cast("array<string>").alias("stack"), F.lit(True).alias("point")).unionByName(starts)
    ranged = materialize(events.repartitionByRange("key").withColumn("span", F.spark_partition_id()), "url-sweep")
    last = ranged.groupBy("span").agg(F.max(F.when(~F.col("point"), F.struct("key", "stack"))).alias("last"))
    before = W.partitionBy(F.lit(0)).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("span", F.last("last.stack", True).over(before).alias("carried"))
    so_far = W.partitionBy("span").orderBy("key", "point").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = ranged.withColumn("top", F.last("stack", True).over(so_far)).where("point").join(carried, "span")
    still = F.filter(F.coalesce("top", "carried"), lambda p: F.startswith(F.col("key"), p))
    return swept.select("key", still.alias("stack")).where(F.size("stack") > 0)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``uf_host``, ``uf_path``, ``uf_rule`` (host and path of the longest rule that fits, else null), ``uf_verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``; both tables may be of any size. A rule's host is lower-cased; rules with
    a null don't count, of rules of the same host and path the greatest verdict holds (``block`` before ``allow``). The longest
    rule has most characters in host and path together, of equal ones most in the host. A url that is null or
    has no ``://`` has an empty host and path, which a rule with both empty fits, and else none. Equal urls get equal results,
    whole urls are read, empty tables give empty ones or the default. Columns named ``uf_*`` are replaced, all others stay.
    """
    out = pages.drop("uf_host", "uf_path", "uf_rule", "uf_verdict")
    host, path = url_parts(F.col(url_col))
    out = out.withColumns({"uf_host": host, "uf_path": path})

    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy(lowered(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("below", host_key(F.col("host")))
    rules = rules.withColumn("key", F.concat("below", F.lit("/"), "path"))

    hosts = out.select(host_key(F.col("uf_host")).alias("key")).distinct()
    at_host = open_prefixes(hosts, rules.select(F.col("below").alias("key")).distinct())
    urls = out.select("uf_host", "uf_path").distinct().withColumn("key", host_key(F.col("uf_host")))
    below = urls.join(at_host, "key").select("uf_host", "uf_path", F.explode("stack").alias("below"))
    # written: it gives the keys of the second sweep and then meets what that finds
    below = materialize(below.select("uf_host", "uf_path", F.concat("below", F.lit("/"), "uf_path").alias("key")), "url-below")

    at_path = open_prefixes(below.select("key").distinct(), rules.select("key").distinct())
    fits = at_path.select("key", F.try_element_at("stack", F.lit(-1)).alias("rule_key"))
    fits = fits.join(rules.withColumnRenamed("key", "rule_key"), "rule_key")
    fits = below.join(fits.select("key", "host", "path", "verdict"), "key")
    length = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = fits.groupBy("uf_host", "uf_path").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), length).alias("best"))
    # written, so that Spark can split the join at a url that very many pages share
    best = materialize(best.select("uf_host", "uf_path", F.col("best.rule").alias("uf_rule"), F.col("best.verdict").alias("uf_verdict")), "url-verdicts")
    return out.join(best, ["uf_host", "uf_path"], "left").select(*out.columns, "uf_rule", F.coalesce("uf_verdict", F.lit(default)).alias("uf_verdict"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """A few rules as a table."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), rule, strict=True)]) for rule in rules])
    return spark.range(1).select(F.inline(rows))


def oracle_sql() -> str:
    """The same digest over ``pages`` for DuckDB."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    behind = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""WITH r AS (SELECT * FROM (VALUES {rules}) t(rh, rp, v)),
    b AS (SELECT page_id, url, coalesce({behind}, '') AS b FROM pages),
    h AS (SELECT *, regexp_extract(b, '^[^/?#]*') AS h FROM b),
    u AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(b, length(h) + 1), '^[^?#]*') AS path FROM h),
    d AS (SELECT DISTINCT host, path FROM u),
    f AS (SELECT host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
        FROM d JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT page_id, u.host, u.path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN f ON u.host = f.host AND u.path = f.path AND n = 1"""
