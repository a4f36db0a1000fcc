"""Months: rolling folds, recent months, target scaling and weights, clipping by quantiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

EPS = 1.1920929e-07  # of 32-bit floats


@dataclass(frozen=True)
class MonthFold:
    """Inclusive ranges of months; training ends before validation begins."""

    name: str
    train_start: int
    train_end: int
    valid_start: int
    valid_end: int

    def __post_init__(self) -> None:
        if not self.train_start <= self.train_end < self.valid_start <= self.valid_end:
            raise ValueError(f"fold {self.name}: ranges overlap or are out of order")


FOLDS = (MonthFold("f1", 0, 46, 47, 54), MonthFold("f2", 0, 54, 55, 62), MonthFold("f3", 0, 62, 63, 66), MonthFold("f4", 0, 66, 67, 70))


def in_folds(rows: DataFrame, folds: tuple[MonthFold, ...] = FOLDS) -> DataFrame:
    """Rows once for each fold that uses them, with ``part`` train or valid. Folds are a handful of ranges, kept as an
    array in the plan, so that no join is needed."""
    if len({f.name for f in folds}) < len(folds):
        raise ValueError("fold names must differ")

    def part(f: MonthFold) -> Column:
        m = F.col("month")
        p = F.when(m.between(f.train_start, f.train_end), "train").when(m.between(f.valid_start, f.valid_end), "valid")
        return F.struct(F.lit(f.name).alias("fold"), p.alias("part"))

    return rows.withColumn("f", F.explode(F.filter(F.array(*map(part, folds)), lambda x: x["part"].isNotNull()))).select(*rows.columns, "f.fold", "f.part")


def require_parts(rows: DataFrame, folds: tuple[MonthFold, ...] = FOLDS) -> DataFrame:
    """The rows of ``in_folds``; an error if a fold has no training or no validation row."""
    have = {(r["fold"], r["part"]) for r in rows.select("fold", "part").distinct().collect()}  # two for each fold
    if lacking := [(f.name, p) for f in folds for p in ("train", "valid") if (f.name, p) not in have]:
        raise ValueError(f"empty parts: {lacking}")
    return rows


def recent_months(train: DataFrame, n: int) -> DataFrame:
    """The last n months of each fold's training rows."""
    if n < 1:
        raise ValueError("at least one month must stay")
    latest = F.max("month").over(Window.partitionBy("fold"))
    return train.withColumn("latest", latest).where(F.col("month") >= F.col("latest") - n + 1).drop("latest")


def normalized(rows: DataFrame, method: str = "monthly_zscore") -> DataFrame:
    """``scaled``: the target over the standard deviation of its month, less its mean for z-scores. A flat month has scale 1."""
    if method not in ("none", "monthly_std", "monthly_zscore"):
        raise ValueError(f"unsupported target normalization: {method}")
    if method == "none":
        return rows.withColumn("scaled", F.col("target"))
    month = Window.partitionBy("month")
    scale = F.stddev_pop("target").over(month)
    mean = F.avg("target").over(month) if method == "monthly_zscore" else F.lit(0.0)
    return rows.withColumn("scaled", (F.col("target") - mean) / F.when(scale > EPS, scale).otherwise(1.0))


def recency_weights(rows: DataFrame, half_life: float | None) -> DataFrame:
    """``weight`` halves every half_life months and has mean 1."""
    if half_life is None:
        return rows.withColumn("weight", F.lit(1.0))
    months = rows.groupBy("month").agg(F.count("*").alias("n"))
    raw = F.pow(F.lit(0.5), (F.max("month").over(Window.partitionBy()) - F.col("month")) / half_life)
    months = months.withColumn("raw", raw)
    every = Window.partitionBy()
    months = months.select("month", (F.col("raw") / (F.sum(F.col("raw") * F.col("n")).over(every) / F.sum("n").over(every))).alias("weight"))
    return rows.join(F.broadcast(months), "month")  # one row for each calendar month


def clip_bounds(rows: DataFrame, features: list[str], quantiles: tuple[float, float], by: str = "fold") -> DataFrame:
    """(fold, feature, low, high, missing_rate) by exact quantiles of the finite training values."""
    long = rows.select(by, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in features))).alias("s")).select(by, "s.feature", "s.x")
    q = F.percentile("x", F.array(*map(F.lit, quantiles)))
    return long.groupBy(by, "feature").agg(q.alias("q"), F.avg(F.col("x").isNull().cast("double")).alias("missing_rate")).select(by, "feature", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "missing_rate")


def clipped(rows: DataFrame, bounds: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """Features within their fold's bounds; missing values and features without bounds stay."""
    held = bounds.where(F.col("low").isNotNull() & F.col("high").isNotNull()).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("low", "high").alias("b")))).alias("bounds"))
    out = rows.join(F.broadcast(held), by, "left")  # a row for each fold

    def one(n: str) -> Column:
        b = F.try_element_at("bounds", F.lit(n))
        return F.when(b.isNull(), F.col(n)).otherwise(S.clip(F.col(n).cast("double"), b["low"], b["high"])).alias(n)

    return out.select(*(one(c) if c in features else c for c in rows.columns))


def clip_target(rows: DataFrame, quantiles: tuple[float, float]) -> DataFrame:
    bounds = rows.agg(F.percentile("target", F.array(*map(F.lit, quantiles))).alias("q"))
    return rows.join(F.broadcast(bounds)).withColumn("target", S.clip(F.col("target"), F.col("q")[0], F.col("q")[1])).drop("q")  # one row of two numbers


def saved_bounds(bounds: DataFrame) -> list[dict]:
    """Bounds as plain rows, a few numbers for each feature, to be kept beside a model."""
    return [r.asDict() for r in bounds.orderBy(*bounds.columns[:2]).collect()]


def loaded_bounds(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows, "fold string, feature string, low double, high double, missing_rate double")
