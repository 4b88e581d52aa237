"""The supplied tables as point clouds, tracks and frames, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PTS = """pts AS (SELECT o_orderkey AS loc_id, o_totalprice / 500.0 AS x,
  date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) / 2.4 AS y, o_orderstatus AS color FROM orders)"""
TRACKS = """tp AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  value AS x, CAST(event_id AS DOUBLE) / 100.0 AS y, ts, event_id AS loc_id FROM events)"""
FRAMES = "fr AS (SELECT event_id AS loc_id, date_diff('hour', TIMESTAMP '2020-01-01', date_trunc('hour', ts)) AS frame, value AS x, user_id FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("loc_id"), (F.col("o_totalprice") / 500.0).alias("x"),
        (F.datediff("o_orderdate", F.lit("1995-01-01")) / 2.4).alias("y"), F.col("o_orderstatus").alias("color"),
    )


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), F.row_number().over(w).alias("seq"), F.col("value").alias("x"),
        (F.col("event_id").cast("double") / 100.0).alias("y"), "ts", F.col("event_id").alias("loc_id"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor((F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.lit("2020-01-01").cast("timestamp"))) / 3600)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("loc_id"), hour.alias("frame"), F.col("value").alias("x"), "user_id")


def two_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts(spark, sf_dir).where(F.col("color").isin("F", "O"))
