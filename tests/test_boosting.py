"""Boosting over folded rows against a row-wise fit, on a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barriometrics.operators import boosting, models

WHOLE = {"subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


def grown(rows, y, depth, least, fewest):
    """A row-wise regression tree: (feature, value it cuts behind, below, above) or a leaf's mean."""
    mean = sum(y) / len(y)
    best = (1e-9, None)
    if depth and len(y) >= fewest:
        for f in range(len(rows[0])):
            for cut in sorted({r[f] for r in rows})[:-1]:
                low = [v for r, v in zip(rows, y) if r[f] <= cut]
                high = [v for r, v in zip(rows, y) if r[f] > cut]
                if min(len(low), len(high)) >= least:
                    gain = sum(low) ** 2 / len(low) + sum(high) ** 2 / len(high) - sum(y) ** 2 / len(y)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
    if best[1] is None:
        return mean
    f, cut = best[1]
    sides = [[(r, v) for r, v in zip(rows, y) if (r[f] > cut) == high] for high in (False, True)]
    return (f, cut, *(grown([r for r, _ in s], [v for _, v in s], depth - 1, least, fewest) for s in sides))


def value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def row_wise(rows, y, trees, depth, rate, least, fewest):
    now = [sum(y) / len(y)] * len(y)
    for _ in range(trees):
        tree = grown(rows, [a - b for a, b in zip(y, now)], depth, least, fewest)
        now = [b + rate * value(tree, r) for r, b in zip(rows, now)]
    return now


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    data = []
    for i in range(300):
        area, rooms, age, flag = float(rng.randint(1, 12)), float(rng.randint(1, 4)), float(rng.randint(0, 5)), float(rng.random() < 0.3)
        data.append((i, area, rooms, age, flag, area * 3.7 + rooms**2 * 1.3 + age * flag + rng.gauss(0, 1), "n" + str(int(rooms) % 2)))
    return spark.createDataFrame(data, "code long, total_area double, rooms double, bedrooms double, antiquity double, price double, neighborhood string").cache()


def test_folded_fit_equals_the_row_wise_one(table):
    settings = models._params({**WHOLE, "maxIter": 12, "maxDepth": 4, "stepSize": 0.3})
    fitted = boosting.fit(table, models.FEATURES, "price", settings)
    got = {r["code"]: r["p"] for r in boosting.score(table, fitted, "p").collect()}
    rows = table.orderBy("code").collect()
    expected = row_wise([[r[f] for f in models.FEATURES] for r in rows], [r["price"] for r in rows], 12, 4, 0.3, 2, 5)
    assert np.allclose([got[r["code"]] for r in rows], expected)


def test_models_side_by_side_are_those_of_their_own_rows(table):
    settings = models._params({**WHOLE, "maxIter": 8, "maxDepth": 3, "stepSize": 0.3})
    fitted = boosting.fit(table, models.FEATURES, "price", settings, F.col("neighborhood"))
    got = {r["code"]: r["p"] for r in boosting.score(table, fitted, "p", F.col("neighborhood")).collect()}
    for name in ("n0", "n1"):
        rows = table.where(F.col("neighborhood") == name).orderBy("code").collect()
        expected = row_wise([[r[f] for f in models.FEATURES] for r in rows], [r["price"] for r in rows], 8, 3, 0.3, 2, 5)
        assert np.allclose([got[r["code"]] for r in rows], expected)


def test_repeated_rows_weigh_as_often_as_they_occur(table):
    settings = models._params({**WHOLE, "maxIter": 5, "maxDepth": 3})
    twice = table.unionByName(table)
    one, two = (boosting.fit(t, models.FEATURES, "price", {**settings, "minInstancesPerNode": k, "minInstancesToSplit": 5 * k // 2}) for t, k in ((table, 2), (twice, 4)))
    assert np.allclose(one["all"].value, two["all"].value)


def test_samples_draw_about_half_and_repeat_with_the_seed(table):
    settings = models._params({"maxIter": 40, "maxDepth": 4, "stepSize": 0.1})
    first, again = (boosting.fit(t, models.FEATURES, "price", settings)["all"] for t in (table, table.repartition(7)))
    assert np.allclose(first.value, again.value) and np.array_equal(first.feature, again.feature)
    other = boosting.fit(table, models.FEATURES, "price", {**settings, "seed": 6})["all"]
    assert not np.array_equal(first.feature, other.feature[: len(first.feature)])
    assert set(first.feature.tolist()) >= {-1, 0, 1, 2, 3}


def test_many_values_fall_into_even_bins(spark):
    wide = spark.range(5_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(1.0).alias("z"))
    x, y, z = boosting.bin_edges(wide, ["x", "y", "z"], 32)
    assert len(x) == 31 and y == (0.5, 1.5) and z == ()
    counts = wide.groupBy(boosting._bin("x", x).alias("b")).count().collect()
    assert len(counts) == 32 and max(r["count"] for r in counts) < 170


def test_gaps_and_unknown_models_have_no_score(spark, table):
    settings = models._params({"maxIter": 2, "maxDepth": 2})
    fitted = boosting.fit(table.withColumn("price", F.when(F.col("code") > 5, F.col("price"))), models.FEATURES, "price", settings, F.col("neighborhood"))
    gaps = table.withColumn("rooms", F.when(F.col("code") == 1, F.lit(None).cast("double")).when(F.col("code") == 2, F.lit(float("nan"))).otherwise(F.col("rooms")))
    scored = boosting.score(gaps, fitted, "p", F.when(F.col("code") != 3, F.col("neighborhood")))
    assert sorted(r["code"] for r in scored.where("p is null").collect()) == [1, 2, 3]
    assert scored.count() == 300 and boosting.score(gaps, {}, "p").where("p is null").count() == 300
    with pytest.raises(ValueError):
        boosting.fit(table.limit(0), models.FEATURES, "price", settings)
    with pytest.raises(ValueError):
        models.train_simple(table, params={"trees": 3})


def test_tuples_are_those_of_the_bins_and_scores_are_joined_without_sorting_rows(spark, table):
    edges = [(2.0, 4.5, 9.0), (), (0.0,)]
    values = [(2.0, 1.0, -0.0), (2.5, 1.0, 0.0), (99.0, 0.0, 1.0), (None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (float("-inf"), 1.0, 2.0)]
    rows = spark.createDataFrame(values, "x double, y double, z double")
    found = rows.select(boosting._tuple(["x", "y", "z"], edges).alias("t"), F.struct(*[boosting._bin(f, e) for f, e in zip("xyz", edges)]).alias("b")).collect()
    assert [None if None in tuple(r["b"]) else tuple(r["b"]) for r in found] == [r["t"] and tuple(np.frombuffer(r["t"], np.int16)) for r in found]
    fitted = boosting.fit(table, models.FEATURES, "price", models._params({"maxIter": 2, "maxDepth": 2}))
    plan = boosting.score(table, fitted, "p")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
