"""Views over the driver's tables that stand in for observations; the SQL of each for DuckDB beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ["b1", "b2", "b3", "b4"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four bands, two sensors, 7-day dates over 2,500 days."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.to_date(F.lit("1995-01-01")))
    keys = [(F.col("l_suppkey") % 10).alias("site"), F.floor(F.col("l_suppkey") / 10).cast("int").alias("px"), F.when(F.col("l_linestatus") == "O", "hr").otherwise("lr").alias("sensor"), (F.floor(days / 7) * 7).cast("int").alias("doy")]
    values = {"b1": "l_quantity", "b2": "l_extendedprice", "b3": "l_discount", "b4": "l_tax"}
    return read(spark, sf_dir, "lineitem").groupBy(*keys).agg(*[F.avg(c).alias(b) for b, c in values.items()], F.bool_or(F.col("l_returnflag") == "R").alias("masked"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band, daily dates over 30 days."""
    e = read(spark, sf_dir, "events").withColumn("doy", F.datediff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01"))))
    m = e.groupBy("user_id", "doy").agg(F.bool_or(F.col("event_type") == "error").alias("m"))
    keys = [(F.col("user_id") % 10).alias("site"), F.floor(F.col("user_id") / 10).cast("int").alias("px"), F.when(F.col("event_type").isin("click", "view"), "hr").otherwise("lr").alias("sensor"), F.col("doy").cast("int").alias("doy")]
    return e.where("event_type <> 'error'").join(m, ["user_id", "doy"]).groupBy(*keys).agg(F.avg("value").alias("value"), F.bool_or("m").alias("masked"))


def tile_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles as pixel rows."""
    t = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("site"), F.posexplode("embedding").alias("idx", "v"))
    return t.withColumns({"r": F.floor(F.col("idx") / 8).cast("int"), "c": F.col("idx") % 8, "masked": F.col("v") < -0.25, "v": F.col("v").cast("double")})


def product_index(spark: SparkSession, sf_dir: str, least: float = 0.25) -> DataFrame:
    rate = F.avg(F.when(F.col("masked"), 0.0).otherwise(1.0))
    return cube(spark, sf_dir).groupBy("site", "sensor", "doy").agg(F.count("*").alias("n_px"), rate.alias("clear_pixel_rate"), (rate >= least).alias("valid"))


CUBE_SQL = """cube AS (SELECT l_suppkey % 10 AS site, CAST(floor(l_suppkey / 10) AS INT) AS px, CASE WHEN l_linestatus = 'O' THEN 'hr' ELSE 'lr' END AS sensor,
    CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7) * 7 AS INT) AS doy, avg(l_quantity) AS b1, avg(l_extendedprice) AS b2,
    avg(l_discount) AS b3, avg(l_tax) AS b4, bool_or(l_returnflag = 'R') AS masked FROM lineitem GROUP BY 1, 2, 3, 4)"""
OBS_SQL = """e AS (SELECT user_id, event_type, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS doy FROM events),
    em AS (SELECT user_id, doy, bool_or(event_type = 'error') AS m FROM e GROUP BY user_id, doy),
    obs AS (SELECT e.user_id % 10 AS site, CAST(floor(e.user_id / 10) AS INT) AS px, CASE WHEN event_type IN ('click', 'view') THEN 'hr' ELSE 'lr' END AS sensor,
    CAST(e.doy AS INT) AS doy, avg(value) AS value, bool_or(m) AS masked FROM e JOIN em ON e.user_id = em.user_id AND e.doy = em.doy WHERE event_type <> 'error' GROUP BY 1, 2, 3, 4)"""
TILE_SQL = """tile_px AS (SELECT vec_id, label AS site, CAST(i AS INT) AS idx, CAST(floor(i / 8) AS INT) AS r, CAST(i % 8 AS INT) AS c,
    CAST(embedding[i + 1] AS DOUBLE) AS v, embedding[i + 1] < -0.25 AS masked FROM embeddings, range(64) t(i))"""
INDEX_SQL = """product_index AS (SELECT site, sensor, doy, count(*) AS n_px, avg(CASE WHEN masked THEN 0::DOUBLE ELSE 1::DOUBLE END) AS clear_pixel_rate,
    avg(CASE WHEN masked THEN 0::DOUBLE ELSE 1::DOUBLE END) >= 0.25 AS valid FROM cube GROUP BY site, sensor, doy)"""
