"""Market, order and transaction tables read out of the general tables at hand.

Rows get ``row_seq``, their order within a sample, when they are read; it is the only order that later
operators know. Seconds fall towards the prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAST_DAY = "2001-11-04"
DAYS = 2498


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    of_user = Window.partitionBy("user_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("sample_id"),
        F.row_number().over(of_user.orderBy("ts", "event_id")).alias("row_seq"),
        ((F.max(at).over(of_user) - at) / 1e6 / 43200).alias("seconds"),
        (1 + F.col("value") / 1000).alias("price"),
        F.round(F.col("value") * 100).alias("volume"),
        F.when(F.col("event_type").isin("click", "view"), 0).otherwise(1).alias("side"),
    )


def _lines(spark: SparkSession, sf_dir: str, span: int) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    age = F.datediff(F.lit(LAST_DAY).cast("date"), F.col("l_shipdate").cast("date"))
    return lines.withColumns({"sample_id": F.col("l_suppkey"), "row_seq": F.row_number().over(order), "seconds": age * float(span) / DAYS})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("l_linenumber") == 7, 1.6).otherwise(1 + (F.col("l_discount") - F.col("l_tax")) / 10)
    return _lines(spark, sf_dir, 60).select(
        "sample_id", "row_seq", "seconds", price.alias("price"), (F.col("l_quantity") * 400).alias("volume"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("side"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("order_action"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    no_ask, no_bid = n == 7, n == 1
    side = lambda gone, value: F.when(gone, 0.0).otherwise(value)
    return _lines(spark, sf_dir, 600).select(
        "sample_id", "row_seq", "seconds",
        F.when(flag != "N", 1 + (F.col("l_discount") - 0.05) / 10).alias("transaction_avgprice"),
        F.when(flag == "A", F.col("l_quantity") * 10).when(flag == "R", F.col("l_quantity") * -10).otherwise(0.0).alias("transaction_volume"),
        F.when(flag == "A", n).when(flag == "R", -n).otherwise(0).cast("double").alias("transaction_count"),
        side(no_ask, 1 + F.col("l_tax") / 10).alias("ask_price_1"), side(no_ask, F.col("l_quantity") * 100).alias("ask_volume_1"),
        side(no_bid, 1 - F.col("l_discount") / 10).alias("bid_price_1"), side(no_bid, (51 - F.col("l_quantity")) * 100).alias("bid_volume_1"),
        side(no_ask, 1.001 + F.col("l_tax") / 10).alias("ask_price_2"), side(no_ask, F.col("l_quantity") * 120).alias("ask_volume_2"),
        side(no_bid, 0.999 - F.col("l_discount") / 10).alias("bid_price_2"), side(no_bid, (51 - F.col("l_quantity")) * 120).alias("bid_volume_2"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each order: its month counted from 1995, a target and two predictions."""
    o = _read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("sample_id"), ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).alias("month"),
        ((F.col("o_totalprice") - 250000) / 1e6).alias("target"),
        ((F.col("o_totalprice") % 1000 - 480) / 1000).alias("a"), ((F.col("o_custkey") % 97 - 45) / 100).alias("b"),
    )
