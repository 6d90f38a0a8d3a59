"""Principal components and elimination from covariances, against fits of the rows themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barriometrics.operators import selection

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    data = []
    for _ in range(500):
        a, b, c = rng.gauss(50, 9), rng.gauss(-3, 1), rng.gauss(0, 4)
        data.append((a, b, c, a * 0.3 + rng.gauss(0, 2), 5 * a - 40 * b + 0.2 * c + rng.gauss(0, 3)))
    data += [(None, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, "a double, b double, c double, d double, price double").cache()


def arrays(table):
    rows = [r for r in map(tuple, table.collect()) if None not in r and not any(np.isnan(v) for v in r)]
    return np.array([r[:4] for r in rows]), np.array([r[4] for r in rows])


def test_components_are_those_of_the_standardised_rows(table):
    x, _ = arrays(table)
    z = (x - x.mean(0)) / x.std(0)
    _, scale, vectors = np.linalg.svd(z, full_matrices=False)
    got = selection.pca_explained(table, FEATURES, 0.8).collect()
    assert np.allclose([r["explained"] for r in got], scale**2 / (scale**2).sum())
    for r, v in zip(got, vectors, strict=True):
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose([r["loadings"][f] for f in FEATURES], v)
    assert got[-1]["cumulative"] == pytest.approx(1) and [r["needed"] for r in got] == [True, *[r["cumulative"] < 0.8 for r in got[:-1]]]


def test_elimination_drops_what_a_refit_drops(table):
    x, y = arrays(table)
    left = list(range(4))
    for keep in (3, 2, 1):
        w = np.linalg.lstsq(np.column_stack((x[:, left], np.ones(len(y)))), y, rcond=None)[0][:-1]
        left.pop(int(np.abs(w).argmin()))
        assert selection.rfe(table, FEATURES, keep=keep) == [FEATURES[i] for i in left]


def test_features_that_determine_each_other_and_constants(table):
    twin = table.withColumn("e", F.col("b") * 1.0).withColumn("flat", F.lit(2.0))
    assert selection.rfe(twin, ["b", "e", "a"], keep=2) == ["b", "e"]
    assert selection.rfe(twin, ["b", "e", "a"], keep=1) == ["b"]
    shares = [r["explained"] for r in selection.pca_explained(twin, ["a", "flat"]).collect()]
    assert shares == pytest.approx([1.0, 0.0])
    with pytest.raises(ValueError):
        selection.rfe(table.limit(0), FEATURES, keep=2)
