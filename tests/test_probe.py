"""The linear probe against a dense fit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import probe
from marlstone.plans import registry


def dense(x, y, c):
    """The same objective by Newton's method on whole arrays, started elsewhere."""
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-5)
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1 / (c * len(x))), 0)
    w = np.full(z.shape[1], 0.01)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z.T * (p * (1 - p))) @ z / len(x) + np.diag(ridge), z.T @ (p - y) / len(x) + ridge * w)
    return mean, dev, w


def data(seed, n, d):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 30, d) + rng.normal(size=d)
    x[:, -1] = 4.0  # no deviation
    y = (x[:, 0] / 10 + rng.normal(size=n) > 0.3).astype(int)
    return x, y


@pytest.mark.parametrize("n,d,c", [(400, 6, 1.0), (60, 12, 0.05), (300, 3, 1000.0)])
def test_fit_against_a_dense_solution(spark, n, d, c):
    x, y = data(n, n, d)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)] + [(n, None, 1), (n + 1, [1.0] * d, None)], "id long, features array<double>, label int")
    mean, dev, w = dense(x, y, c)
    for rows in (df, df.repartition(7)):
        got = probe.fit(rows, c=c)
        assert got.n == n and got.mean == pytest.approx(mean) and got.deviation == pytest.approx(dev)
        assert np.abs(np.append(got.weights, got.intercept) - w).max() < 1e-6 and got.steps < 20
    scores = {r.id: r.s for r in df.where("features is not null").select("id", got.score("features").alias("s")).collect()}
    z = (x - mean) / dev @ w[:-1] + w[-1]
    assert all(math.isclose(scores[i], 1 / (1 + math.exp(-z[i])), abs_tol=1e-6) for i in range(n))


def test_separable_rows_have_a_finite_fit(spark):
    df = spark.createDataFrame([([float(i)], int(i > 4)) for i in range(10)], "features array<double>, label int")
    x, y = np.arange(10.0)[:, None], np.array([int(i > 4) for i in range(10)])
    got = probe.fit(df)
    assert got.weights == pytest.approx(dense(x, y, 1.0)[2][:1], abs=1e-6)


def test_groups_are_not_shared_and_faults_raise(spark):
    x, y = data(3, 200, 4)
    df = spark.createDataFrame([(i // 4, x[i].tolist(), int(y[i])) for i in range(200)], "g long, features array<double>, label int")
    fitted, test = probe.evaluated(df, "features", "label", "g", folds=3)
    inside = {r.g for r in test.select("g").distinct().collect()}
    assert 0 < len(inside) < 50 and fitted.n == 200 - 4 * len(inside)
    r = probe.held_out_auc(df, "features", "label", "g", folds=3, draws=50).first()
    assert r.n_train == fitted.n and r.n_train + r.n_test == 200 and r.ci_low <= r.auc <= r.ci_high
    for wrong in (df.where("label = 1"), df.limit(0), df.withColumn("features", F.when(F.col("g") > 3, F.col("features")).otherwise(F.array(F.lit(1.0)))), df.withColumn("features", F.array(F.lit(None).cast("double"), F.lit(1.0)))):
        with pytest.raises(ValueError):
            probe.fit(wrong)


def test_probe_queries(spark):
    r = registry.queries()["probe_auc"](spark, "/root/testdata/sf0.01").first()
    assert r.n_train + r.n_test == 500 and r.ci_low <= r.auc <= r.ci_high
    rows = registry.queries()["probe_scores"](spark, "/root/testdata/sf0.01")
    assert rows.count() == 500 and rows.where("held_out").count() == r.n_test
