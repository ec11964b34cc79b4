"""Panels (one row per symbol and time) derived from the source tables, and their dimensions. A symbol is a supplier, so panels grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, grain: str = "week") -> DataFrame:
    """Bars per supplier: symbol, date, open, high, low, close, volume, amount.

    Aggregation before anything else: the panel that later windows sort is smaller than the
    trades by the trades per bar.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.date_trunc(grain, "l_shipdate").cast("date").alias("date"),
        price.alias("price"),
        "l_quantity",
        "l_extendedprice",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", price.alias("p")).alias("at"),
    )
    return trades.groupBy("symbol", "date").agg(
        F.min("at")["p"].alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max("at")["p"].alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol to its nation and to its region: many to many, without repeats."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    placed = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.select(F.col("s_suppkey").alias("symbol"), F.explode(F.array("n_name", "r_name")).alias("member")).distinct()


def float_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = F.floor(F.abs("s_acctbal")) + 1000
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), shares.alias("float_shares"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per symbol and quarter, announced 30 days after the quarter's end."""
    quarter = F.date_trunc("quarter", "o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_suppkey").alias("symbol"), quarter.alias("quarter"))
        .agg(F.sum("l_extendedprice").alias("revenue"))
        .withColumn("announced", F.date_add(F.add_months("quarter", 3), 29))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol, ts, value, kind."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), "ts", "value", F.col("event_type").alias("kind"))
