"""Algebra of runs: tables (sample_id, month, target, fold, prediction) of out-of-fold predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KEYS = ("sample_id", "month", "target", "fold")


def weights_of(weights: list[float] | None, n: int, counts: list[int] | None = None) -> list[float]:
    """Positive weights that sum to 1; by default the number of seeds, or alike."""
    weights = list(map(float, weights or counts or [1] * n))
    if len(weights) != n or any(not w > 0 or w == float("inf") for w in weights):
        raise ValueError("weights must be positive, one for each run")
    return [w / sum(weights) for w in weights]


def _numbered(runs: list[DataFrame]) -> DataFrame:
    """All rows of up to 60 runs, each with a bit of its own in ``run``."""
    return reduce(DataFrame.unionByName, (r.select(*KEYS, F.col("prediction").cast("double").alias("prediction"), F.lit(1 << k).cast("long").alias("run")) for k, r in enumerate(runs)))


def _once_each(n: int) -> Column:
    """Of grouped rows: every run has its row, and no run has two. n bits that add up to 2**n - 1 are all different."""
    return (F.count("*") == n) & (F.sum("run") == (1 << n) - 1)


def contract_violations(runs: list[DataFrame]) -> DataFrame:
    """(sample_id, month, target, fold, n) of the keys that not every run has exactly once."""
    rows = _numbered(runs).groupBy(*KEYS).agg(F.count("*").alias("n"), _once_each(len(runs)).alias("sound"))
    return rows.where(~F.col("sound")).drop("sound")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both runs have the same keys, each once."""
    return contract_violations([a, b]).isEmpty()


def seed_mean(predictions: DataFrame) -> DataFrame:
    """The mean over seeds of (seed, sample_id, prediction)."""
    return predictions.groupBy("sample_id").agg(F.avg("prediction").alias("prediction"))


def unit_norm(run: DataFrame, column: str = "prediction") -> DataFrame:
    """The vector over its length; an error if that is 0."""
    length = run.agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("length"))
    out = run.join(F.broadcast(length))  # one number
    return out.withColumn(column, F.when(F.col("length") > 0, F.col(column) / F.col("length")).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("double"))).drop("length")


def _combined(runs: list[DataFrame], weights: list[float]) -> DataFrame:
    """The weighted sum by key; an error where a run lacks a key or has it twice."""
    w = F.element_at(F.array(*map(F.lit, weights)), F.bit_count(F.col("run") - 1).cast("int") + 1)
    total = F.sum(F.col("prediction") * w)
    checked = F.when(_once_each(len(runs)), total).otherwise(F.raise_error(F.lit("runs differ in their samples, months, targets or folds")).cast("double"))
    return _numbered(runs).groupBy(*KEYS).agg(checked.alias("prediction"))


def ensemble(runs: list[DataFrame], weights: list[float] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """Weighted mean of runs of one contract, by default by their numbers of seeds: one union and one aggregation,
    which also checks that every run has every key once."""
    return _combined(runs, weights_of(weights, len(runs), seeds))


def blend(runs: list[DataFrame], weights: list[float] | None = None, normalize: bool = True) -> DataFrame:
    """Weighted sum of runs of one contract, each brought to length 1 first."""
    weights = weights_of(weights, len(runs))
    return _combined([unit_norm(r.select(*KEYS, F.col("prediction").cast("double").alias("prediction"))) for r in runs] if normalize else runs, weights)


def blend_found(tabular: DataFrame, deep: DataFrame, steps: int = 100) -> tuple[DataFrame, dict]:
    """The run of the best blend of two, and its weight and score: both brought to length 1, over the samples of the deep run."""
    both = aligned(tabular, deep)
    best = best_weight(weight_search(both, steps)).first()
    if best is None or best["weight"] is None:
        raise ValueError("no blend has a score")
    length = F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("la"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("lb")
    rows = both.join(F.broadcast(both.agg(*length)))  # two numbers
    w = best["weight"]
    return rows.select(*KEYS, ((1 - w) * F.col("a") / F.col("la") + w * F.col("b") / F.col("lb")).alias("prediction")), best.asDict()


def aligned(tabular: DataFrame, deep: DataFrame) -> DataFrame:
    """Rows of both by sample, where the deep run may cover a part; an error if they disagree or a sample is unknown."""
    d = deep.select("sample_id", *(F.col(c).alias(f"{c}_d") for c in ("month", "target", "fold", "prediction")))
    both = d.join(tabular, "sample_id", "left")
    agree = F.col("prediction").isNotNull() & reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_d")) for c in ("month", "target", "fold")))
    checked = F.when(agree, F.col("prediction")).otherwise(F.raise_error(F.lit("runs disagree")).cast("double"))
    return both.select(*KEYS, checked.alias("a"), F.col("prediction_d").alias("b"))


def weight_search(rows: DataFrame, steps: int = 100, a: str = "a", b: str = "b", target: str = "target") -> DataFrame:
    """(weight, score) of blends (1 - weight) a / |a| + weight b / |b| over a grid. The score follows from six sums,
    so that the data are read once."""
    t, x, y = (F.col(c).cast("double") for c in (target, a, b))
    s = rows.agg(F.sum(t * t).alias("tt"), F.sum(x * x).alias("aa"), F.sum(y * y).alias("bb"), F.sum(t * x).alias("ta"), F.sum(t * y).alias("tb"), F.sum(x * y).alias("ab"))
    s = s.withColumn("weight", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k / float(steps))))
    w, v = F.col("weight"), 1 - F.col("weight")
    ta, tb, ab = F.col("ta") / F.sqrt("aa"), F.col("tb") / F.sqrt("bb"), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    norm = F.sqrt(v * v + w * w + 2 * v * w * ab)
    return s.select("weight", F.when(norm > 0, (v * ta + w * tb) / (norm * F.sqrt("tt"))).alias("score"))


def best_weight(search: DataFrame) -> DataFrame:
    """The first weight of the best score."""
    return search.where("score is not null").agg(F.min(F.struct((-F.col("score")).alias("s"), "weight")).alias("b")).select(F.col("b.weight").alias("weight"), (-F.col("b.s")).alias("score"))


def signed_power(run: DataFrame, power: float, center: bool = False) -> DataFrame:
    """sign(x) (|x| / std) ** power, of predictions less their mean if centred; the standard deviation is taken afterwards."""
    if not power > 0:
        raise ValueError("the power must be positive")
    s = run.agg(F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("scale"))
    out = run.join(F.broadcast(s))  # two numbers
    x = F.col("prediction") - F.col("mean") if center else F.col("prediction")
    y = F.when(F.col("scale") > 0, S.signed_power(x, F.col("scale"), power)).otherwise(F.raise_error(F.lit("predictions do not vary")).cast("double"))
    return out.withColumn("prediction", y).drop("mean", "scale")


def submission(template: DataFrame, predictions: DataFrame) -> DataFrame:
    """The template's samples with their predictions; an error where one is missing or not finite."""
    if template.columns != ["sample_id", "prediction"]:
        raise ValueError("the template must have the columns sample_id and prediction")
    out = template.select("sample_id").join(predictions.select("sample_id", F.col("prediction").cast("double").alias("prediction")), "sample_id", "left")
    return out.withColumn("prediction", F.coalesce(S.finite(F.col("prediction")), F.raise_error(F.lit("a prediction is missing or not finite")).cast("double")))
