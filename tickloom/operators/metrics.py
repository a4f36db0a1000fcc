"""Cosine similarity of targets and predictions, over all rows and by month; single-signal baselines; the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import cosine

BASELINES = {"volume_imbalance_10s": "transaction__w10__volume_imbalance", "microprice_last": "market__w5__microprice_bps__last", "mid_momentum_60s": "market__w60__mid_bps__delta"}


def cosine_scores(rows: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """(month, n, score): a row for each month and one, with month NULL, for all. A zero vector has no score."""
    t, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    return rows.groupingSets([[], ["month"]], "month").agg(F.count("*").alias("n"), cosine(t, p).alias("score"))


def cosine_report(rows: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """One row: global score, mean and deviation of the months, the worst month (the earliest of several)."""
    s = cosine_scores(rows, target, prediction)
    month = F.when(F.col("month").isNotNull(), F.col("score"))
    worst = F.min(F.when(F.col("month").isNotNull() & F.col("score").isNotNull(), F.struct("score", "month")))
    out = s.agg(F.max(F.when(F.col("month").isNull(), F.col("score"))).alias("global_score"), F.avg(month).alias("monthly_mean"), F.stddev_pop(month).alias("monthly_std"), worst.alias("w"))
    return out.select("global_score", "monthly_mean", "monthly_std", F.col("w.month").alias("worst_month"), F.col("w.score").alias("worst_score"))


def required(report: DataFrame) -> DataFrame:
    """The report, or an error where the score is undefined."""
    return report.withColumn("global_score", F.when(F.col("global_score").isNull(), F.raise_error(F.lit("cosine score is undefined for a zero-norm vector")).cast("double")).otherwise(F.col("global_score")))


def baseline_report(rows: DataFrame, signals: dict[str, str]) -> DataFrame:
    """(baseline, global_score): every signal that the rows have, in one pass; missing values count as 0."""
    have = {k: v for k, v in signals.items() if v in rows.columns}
    if not have:
        return rows.sparkSession.createDataFrame([], "baseline string, global_score double")
    t = F.col("target").cast("double")
    scores = rows.agg(*(cosine(t, F.coalesce(F.col(v).cast("double"), F.lit(0.0))).alias(k) for k, v in have.items()))
    return scores.select(F.explode(F.array(*(F.struct(F.lit(k).alias("baseline"), F.col(k).alias("global_score")) for k in have))).alias("s")).select("s.*")


def baseline_gate(folds: DataFrame) -> DataFrame:
    """One row from (fold, begin, name, score), where the name is ``model`` or a baseline's and ``begin`` the first month
    of the fold's validation, which orders the folds. The model passes if its mean over folds is above that of the best
    baseline, and in each of the last two folds it is above every baseline. Without a model or a baseline that has a
    score in every fold, the gate is undecided: NULL means, not passed."""
    n = folds.agg(F.count_distinct("fold").alias("n_folds"))
    means = folds.groupBy("name").agg(F.avg("score").alias("mean"), F.count("score").alias("k"))
    means = means.join(F.broadcast(n)).where("k = n_folds")  # a row for each name
    model = means.where("name = 'model'").agg(F.max("mean").alias("model_fold_mean"))
    best = means.where("name != 'model'").agg(F.min(F.struct((-F.col("mean")).alias("m"), "name")).alias("b")).select(F.col("b.name").alias("best_baseline"), (-F.col("b.m")).alias("best_baseline_fold_mean"))
    by_fold = folds.groupBy("fold").agg(F.min("begin").alias("begin"), F.max(F.when(F.col("name") == "model", F.col("score"))).alias("model"), F.max(F.when(F.col("name") != "model", F.col("score"))).alias("signal"))
    late = by_fold.orderBy(F.col("begin").desc(), F.col("fold").desc()).limit(2).agg(F.coalesce(F.every(F.col("model") > F.col("signal")), F.lit(False)).alias("late_folds_passed"))
    out = model.join(F.broadcast(best)).join(F.broadcast(late))  # single rows
    out = out.withColumn("mean_passed", F.coalesce(F.col("model_fold_mean") > F.col("best_baseline_fold_mean"), F.lit(False)))
    return out.withColumn("passed", F.col("mean_passed") & F.col("late_folds_passed"))
