"""Looking into tables, and dealing out their samples: pages, descriptions, splits, shuffles and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """``limit`` rows behind the first ``offset`` in an order."""
    if offset < 0 or limit < 1:
        raise ValueError("a page starts at 0 or later and has a row at least")
    return rows.orderBy(*order).offset(offset).limit(limit)


def describe(rows: DataFrame) -> DataFrame:
    """(name, type, filled, low, high, mean) of every column; the last three of numbers alone. One pass."""
    def facts(name: str, kind: str) -> Column:
        number = kind in _NUMBERS
        x = F.col(name).cast("double") if number else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.count(name).alias("filled"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"))

    made = rows.agg(*(facts(n, t).alias(f"c{k}") for k, (n, t) in enumerate(rows.dtypes)))
    return made.select(F.explode(F.array(*made.columns)).alias("x")).select("x.*")


def one_sample(rows: DataFrame, sample_id: int) -> DataFrame:
    """The rows of a sample in their order."""
    return rows.where(F.col("sample_id") == sample_id).orderBy("row_seq")


def draw(key: Column, seed: int) -> Column:
    """32 random bits of a key and a seed, as text in base 16 of fixed length."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8)


def split(rows: DataFrame, seed: int, share: float = 0.8, key: str = "sample_id") -> DataFrame:
    """``part``: train for about this share of the samples, valid for the others; the same at every run."""
    edge = f"{min((1 << 32) - 1, int(share * (1 << 32))):08x}"
    return rows.withColumn("part", F.when(draw(F.col(key), seed) < edge, "train").otherwise("valid"))


def shuffled(rows: DataFrame, seed: int, batch: int, shard: str = "shard", key: str = "sample_id") -> DataFrame:
    """``place`` and ``batch`` of each row in a random order within its shard, the same at every run."""
    order = Window.partitionBy(shard).orderBy(draw(F.col(key), seed), key)
    place = F.row_number().over(order) - 1
    return rows.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch).cast("long"))
