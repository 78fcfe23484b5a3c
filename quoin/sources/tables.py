"""The driver's tables seen as points, assignments and primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.geometry import Vec


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """pid, x, y, z, nx, ny, nz, gid: the first three dimensions as place, the next three, at unit length, as normal, the label as patch."""
    e = read(spark, folder, "embeddings")
    at = [F.col("embedding")[i].cast("double") for i in range(6)]
    n = Vec(*at[3:]).unit()
    return e.select(F.col("vec_id").alias("pid"), *[c.alias(k) for k, c in zip(("x", "y", "z", "nx", "ny", "nz"), (*at[:3], *n), strict=True)], F.col("label").cast("long").alias("gid"))


def points_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """gid, x, y, z by supplier."""
    li = read(spark, folder, "lineitem")
    return li.select(F.col("l_suppkey").alias("gid"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 105000).alias("y"), (F.col("l_discount") * 10).alias("z"))


def points_events(spark: SparkSession, folder: str) -> DataFrame:
    """pid, x, y, z, gid of events: time, value and user."""
    e = read(spark, folder, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    return e.select(F.col("event_id").alias("pid"), (seconds / 2592000).alias("x"), (F.col("value") / 500).alias("y"), (F.col("user_id") / 150).alias("z"), F.col("user_id").alias("gid"))


def assignments_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(pid, gid) of orders and customers."""
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("gid"))
