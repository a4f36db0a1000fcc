"""States of book levels and trades, checks of order, and runs of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import sample


def book_level_state(price: Column, volume: Column) -> Column:
    """valid, missing or inconsistent. A price without volume, or the reverse, is inconsistent."""
    return F.when((price > 0) & (volume > 0), "valid").when((price == 0) & (volume == 0), "missing").otherwise("inconsistent")


def trade_state(price: Column, volume: Column, count: Column) -> Column:
    """positive, none, correction or inconsistent; signs of volume and count must agree, and a price stands by them."""
    return (
        F.when((price > 0) & (volume > 0) & (count > 0), "positive")
        .when(price.isNull() & (volume == 0) & (count == 0), "none")
        .when((price > 0) & (volume < 0) & (count < 0), "correction")
        .otherwise("inconsistent")
    )


def strictly(state: Column) -> Column:
    """The state, or an error where it is inconsistent."""
    return F.when(state == "inconsistent", F.raise_error(F.lit("inconsistent row"))).otherwise(state)


def sample_spans(rows: DataFrame) -> DataFrame:
    """(sample_id, start, length, end) of samples that follow one another by ``row_seq`` over the whole table."""
    return rows.groupBy("sample_id").agg(F.min("row_seq").alias("start"), F.count("*").alias("length"), (F.max("row_seq") + 1).alias("end")).where(F.col("end") - F.col("start") == F.col("length"))


def broken_spans(rows: DataFrame) -> DataFrame:
    """Samples whose rows do not follow one another; none in sorted input."""
    return rows.groupBy("sample_id").agg(F.min("row_seq").alias("lo"), F.max("row_seq").alias("hi"), F.count("*").alias("n")).where("hi - lo + 1 != n").select("sample_id")


def sequence_order(rows: DataFrame) -> DataFrame:
    """How often seconds tie or rise within samples; one row. Order is right if they never rise."""
    steps = rows.select("seconds", F.lag("seconds").over(sample()).alias("prev"))
    out = steps.agg(F.count_if(F.col("prev") == F.col("seconds")).alias("time_ties"), F.count_if(F.col("seconds") > F.col("prev")).alias("time_increases"))
    return out.withColumn("ok", F.col("time_increases") == 0)
