"""Rolling out-of-fold training, full fits and test predictions, for any regressor of a small protocol.

A regressor is fitted on (sample_id, features, target, weight) and gives a model with its best number of
rounds, judged by cosine on validation rows. The one here is linear: a path of ridge penalties, each half of
the one before, whose place counts as the number of rounds. All that its fits need of the data are sums of
products, which executors add up; the driver solves systems of as many unknowns as there are features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds as M
from .browse import draw

#: Sums of products that the driver adds up at the end.
LAST_SUMS = 16


class Model(Protocol):
    best: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """(sample_id, prediction)"""

    def importance(self) -> list[tuple[str, float]]:
        """Features by falling importance."""


class Regressor(Protocol):
    def fit(self, train: DataFrame, features: list[str], seed: int, valid: DataFrame | None = None, rounds: int | None = None) -> Model:
        """On rows with target and weight: as many rounds as are best on valid, or the given number."""


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)]) if batch.num_rows else np.zeros((0, n))


def _summed(rows: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of part(batch): added up in tasks, then by groups of tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = sum((part(b) for b in batches), np.zeros(shape))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % LAST_SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "data"])

    def together(table: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py()).reshape(shape) for x in table.column("data")), np.zeros(shape))
        return pa.table({"data": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(partial, "g int, data binary").groupBy("g").applyInArrow(together, "data binary")
    return sum((np.frombuffer(r["data"]).reshape(shape) for r in sums.toLocalIterator()), np.zeros(shape))


def moments(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and standard deviations of the finite values; 0 and 1 where there is nothing to scale."""
    d = len(features)

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, d + 1)
        x, w = x[:, :d], x[:, d:]
        there = np.isfinite(x)
        x = np.where(there, x, 0.0)
        return np.vstack([(w * there).sum(0), (w * x).sum(0), (w * x * x).sum(0)])

    n, s, q = _summed(rows.select(*features, "weight"), part, (3, d))
    mean = np.divide(s, n, out=np.zeros(d), where=n > 0)
    variance = np.divide(q, n, out=np.zeros(d), where=n > 0) - mean**2
    return mean, np.where(variance > 1e-12 * np.maximum(1, mean**2), np.sqrt(np.maximum(variance, 0)), 1.0)


def products(rows: DataFrame, features: list[str], mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weighted sums of products of 1, the scaled features and the target; missing values count as the mean."""
    d = len(features)

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, d + 2)
        z = (x[:, :d] - mean) / scale
        z = np.column_stack([np.ones(len(x)), np.where(np.isfinite(z), z, 0.0), x[:, d]])
        return z.T @ (z * x[:, d + 1 :])

    return _summed(rows.select(*features, "target", "weight"), part, (d + 2, d + 2))


@dataclass
class LinearModel:
    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # intercept first
    best: int

    def predict(self, rows: DataFrame) -> DataFrame:
        names, mean, scale, w = self.features, self.mean, self.scale, self.weights

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = (_matrix(b, len(names)) - mean) / scale
                yield pa.RecordBatch.from_arrays([b.column(len(names)), pa.array(w[0] + np.where(np.isfinite(z), z, 0.0) @ w[1:])], ["sample_id", "prediction"])

        return rows.select(*names, F.col("sample_id").cast("long").alias("sample_id")).mapInArrow(scored, "sample_id long, prediction double")

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, np.abs(self.weights[1:]).tolist(), strict=True), key=lambda x: (-x[1], x[0]))


@dataclass
class RidgePath:
    """Penalties first, first / 2, ... times the sum of weights; seeds differ in the share of rows they see."""

    first: float = 1.0
    steps: int = 20
    patience: int = 4
    share: float = 0.8

    def fit(self, train: DataFrame, features: list[str], seed: int, valid: DataFrame | None = None, rounds: int | None = None) -> LinearModel:
        rows = train.where(draw(F.col("sample_id"), seed) < f"{int(self.share * 0xFFFFFFFF):08x}")
        mean, scale = moments(rows, features)
        p = products(rows, features, mean, scale)
        q = None if valid is None else products(valid.withColumn("weight", F.lit(1.0)), features, mean, scale)
        best, score, weights = 0, -np.inf, None
        for k in range(self.steps if rounds is None else rounds + 1):
            penalty = np.diag([0.0] + [self.first * 0.5**k * p[0, 0]] * len(features))
            b = np.linalg.lstsq(p[:-1, :-1] + penalty, p[:-1, -1], rcond=None)[0]
            norm = 0.0 if q is None else float(b @ q[:-1, :-1] @ b)
            s = float(b @ q[:-1, -1]) / np.sqrt(norm * q[-1, -1]) if norm > 0 and q[-1, -1] > 0 else float(k) if q is None else -np.inf
            if weights is None or s > score:
                best, score, weights = k, s, b
            elif k - best >= self.patience:
                break
        return LinearModel(features, mean, scale, weights, best)


@dataclass
class Plan:
    """What a run is made of; refuses what no step knows."""

    seeds: tuple[int, ...] = (17, 29, 97)
    folds: tuple[M.MonthFold, ...] = M.FOLDS
    normalization: str = "none"
    half_life: float | None = None
    recent: int | None = None
    feature_clip: tuple[float, float] | None = (0.001, 0.999)
    target_clip: tuple[float, float] | None = None
    regressor: Regressor = field(default_factory=RidgePath)

    def __post_init__(self) -> None:
        if not self.seeds or len(set(self.seeds)) < len(self.seeds):
            raise ValueError("seeds must differ, and there must be one")
        if self.normalization not in ("none", "monthly_std", "monthly_zscore"):
            raise ValueError(f"unsupported target normalization: {self.normalization}")
        for low, high in filter(None, (self.feature_clip, self.target_clip)):
            if not 0 <= low < high <= 1:
                raise ValueError("quantiles must lie between 0 and 1, the lower first")

    @classmethod
    def of(cls, said: dict) -> Plan:
        """From named values; an unknown name is an error."""
        if unknown := sorted(set(said) - set(cls.__dataclass_fields__)):
            raise ValueError(f"no such settings: {unknown}")
        return cls(**said)


def prepared(rows: DataFrame, plan: Plan) -> DataFrame:
    """Training rows with the target that is learnt, and weights."""
    if plan.target_clip:
        rows = M.clip_target(rows, plan.target_clip)
    return M.recency_weights(M.normalized(rows, plan.normalization).drop("target").withColumnRenamed("scaled", "target"), plan.half_life)


def median_rounds(best: list[int]) -> int:
    """The median of the best numbers of rounds, its fraction dropped."""
    return int(median(best))


def rolling(rows: DataFrame, features: list[str], plan: Plan) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions (sample_id, month, target, prediction, fold), mean over seeds, and what was found: the best
    rounds by fold and seed, their median, and the clip bounds of each fold."""
    dealt = M.require_parts(M.in_folds(rows, plan.folds), plan.folds)
    parts, found = [], {"best": {}, "bounds": []}
    for fold in plan.folds:
        own = dealt.where(F.col("fold") == fold.name)
        train, valid = own.where("part = 'train'"), own.where("part = 'valid'")
        if plan.recent:
            train = M.recent_months(train, plan.recent)
        if plan.feature_clip:
            bounds = M.saved_bounds(M.clip_bounds(train, features, plan.feature_clip))
            found["bounds"] += bounds
            held = M.loaded_bounds(rows.sparkSession, bounds)
            train, valid = M.clipped(train, held, features), M.clipped(valid, held, features)
        train = prepared(train, plan)
        models = {seed: plan.regressor.fit(train, features, seed, valid=valid) for seed in plan.seeds}
        found["best"][fold.name] = {str(s): m.best for s, m in models.items()}
        mean = seed_mean([m.predict(valid) for m in models.values()])
        parts.append(valid.select("sample_id", "month", "target", "fold").join(mean, "sample_id").select("sample_id", "month", "target", "prediction", "fold"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    found["rounds"] = median_rounds([b for x in found["best"].values() for b in x.values()])
    return out, found | {"seeds": len(plan.seeds)}


def seed_mean(predictions: list[DataFrame]) -> DataFrame:
    out = predictions[0]
    for p in predictions[1:]:
        out = out.unionByName(p)
    return out.groupBy("sample_id").agg(F.avg("prediction").alias("prediction"))


def full(rows: DataFrame, test: DataFrame, features: list[str], plan: Plan, rounds: int) -> tuple[DataFrame, list[Model]]:
    """Test predictions (sample_id, prediction) of fits on all months with a fixed number of rounds, mean over seeds."""
    train = rows.withColumn("fold", F.lit("all"))
    if plan.recent:
        train = M.recent_months(train, plan.recent)
    if plan.feature_clip:
        held = M.loaded_bounds(rows.sparkSession, M.saved_bounds(M.clip_bounds(train, features, plan.feature_clip)))
        train, test = M.clipped(train, held, features), M.clipped(test.withColumn("fold", F.lit("all")), held, features)
    train = prepared(train, plan)
    models = [plan.regressor.fit(train, features, seed, rounds=rounds) for seed in plan.seeds]
    return seed_mean([m.predict(test) for m in models]), models
