"""A linear probe: L2-regularised logistic regression on standardised features, fitted over a table by Newton's method.

The objective is the mean log loss plus |w|^2 / (2 C n), the intercept free. Each step needs one pass: every task forms the
gradient and the Gram matrix of its rows, weighted by p (1 - p), and these are added in a tree, so that the driver gets a few
matrices of the size of the model whatever the rows. A pass also gives the loss, by which a step that went too far is halved.
Fit and scores depend on the rows alone up to rounding, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import hash_fold
from marlstone.functions.vectors import dot
from marlstone.operators.aggregates import roc_auc
from marlstone.storage import scratch_tables

#: Features of a model, at most: its Gram matrix is what tasks and driver exchange.
MOST_FEATURES = 1024
LEAST_DEVIATION = 1e-5
#: Sums that come to the driver, at most.
BRANCHES = 8


@dataclass(frozen=True)
class Probe:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    intercept: float
    n: int
    steps: int
    loss: float

    def logit(self, features: str) -> Column:
        """Logit of an array column, within the plan."""
        w = self.weights / self.deviation
        return dot(F.col(features), F.array(*[F.lit(float(x)) for x in w])) + F.lit(float(self.intercept - self.mean @ w))

    def score(self, features: str) -> Column:
        return 1 / (1 + F.exp(-self.logit(features)))


def _tree_sum(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of a vector of ``size`` that ``part`` makes of a batch's features (rows x d) and labels."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                total += part(x, b.column("y").to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "v"])

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for v in group.column("v"):
            total += np.frombuffer(v.as_py())
        return pa.table({"i": group.column("i")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("x", "y").mapInArrow(partial, "i int, v binary").groupBy((F.col("i") % BRANCHES).alias("g")).applyInArrow(added, "i int, v binary")
    return np.sum([np.frombuffer(r["v"]) for r in sums.collect()], axis=0) if size else np.zeros(0)


def fit(rows: DataFrame, features: str = "features", label: str = "label", *, c: float = 1.0, tolerance: float = 1e-10, most_steps: int = 100) -> Probe:
    """The probe of ``rows``: ``features`` is an array of numbers, ``label`` is 1 or 0. Rows without label or features don't count.

    Raises if the rows' features differ in number, hold a null, or if one of the labels is missing.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), (F.col(label) == 1).cast("int").alias("y"))
    with scratch_tables(rows.sparkSession) as written:
        table = written(known)
        seen = table.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count("*").alias("n"), F.sum("y").alias("p"), F.bool_or(F.exists("x", lambda v: v.isNull() | F.isnan(v))).alias("gap")).first()
        if not seen["n"] or not 0 < seen["p"] < seen["n"]:
            raise ValueError("the rows lack one of the labels")
        if seen["low"] != seen["high"] or not 0 < seen["low"] <= MOST_FEATURES or seen["gap"]:
            raise ValueError(f"features must be arrays of one length, {MOST_FEATURES} at most, without nulls or NaN")
        d, n = seen["low"], seen["n"]
        mean = _tree_sum(table, lambda x, y: x.sum(axis=0), d) / n
        deviation = np.maximum(np.sqrt(_tree_sum(table, lambda x, y: ((x - mean) ** 2).sum(axis=0), d) / n), LEAST_DEVIATION)

        def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            """Loss, gradient and Hessian at ``w`` (the intercept last)."""

            def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
                logit = z @ w
                p = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
                loss = (np.logaddexp(0, logit) - y * logit).sum()
                return np.concatenate([[loss], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

            total = _tree_sum(table, part, 1 + (d + 1) + (d + 1) ** 2) / n
            ridge = np.append(np.full(d, 1 / (c * n)), 0.0)
            return total[0] + (ridge * w * w).sum() / 2, total[1 : d + 2] + ridge * w, total[d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge)

        w, step, passes = np.zeros(d + 1), np.zeros(d + 1), 1
        loss, gradient, hessian = at(w)
        while passes < most_steps:
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            while passes < most_steps:
                passes += 1
                new = at(w + step)
                if new[0] <= loss + 1e-12 * abs(loss):
                    break
                step = step / 2
            w, (loss, gradient, hessian) = w + step, new
            if np.abs(step).max() < tolerance:
                break
    return Probe(mean, deviation, w[:-1], float(w[-1]), n, passes, float(loss))


def evaluated(rows: DataFrame, features: str, label: str, group: str, *, seed: int = 1337, folds: int = 5, c: float = 1.0) -> tuple[Probe, DataFrame]:
    """The probe fitted on the rows whose ``group`` isn't in hash fold 0, and the rows of that fold with ``score``: no group is in both."""
    held_out = hash_fold(seed, F.col(group), folds, ":") == 0
    probe = fit(rows.where(~held_out), features, label, c=c)
    return probe, rows.where(held_out & F.col(label).isNotNull() & F.col(features).isNotNull()).withColumn("score", probe.score(features))


def held_out_auc(rows: DataFrame, features: str, label: str, group: str, *, seed: int = 1337, folds: int = 5, c: float = 1.0, draws: int = 500) -> DataFrame:
    """n_train, n_test, auc, ci_low, ci_high, n_draws: how well the labels can be told apart on groups that the fit hasn't seen."""
    from marlstone.operators.bootstrap import auc_interval

    probe, test = evaluated(rows, features, label, group, seed=seed, folds=folds, c=c)
    auc = roc_auc(test, label, "score").first()
    if auc is None or auc["auc"] is None:
        raise ValueError("the held-out rows lack one of the labels")
    interval = auc_interval(test, label, "score", draws=draws, seed=seed)
    return interval.select(F.lit(probe.n).cast("long").alias("n_train"), F.lit(auc["n_pos"] + auc["n_neg"]).cast("long").alias("n_test"), F.col("value").alias("auc"), "ci_low", "ci_high", "n_draws")
