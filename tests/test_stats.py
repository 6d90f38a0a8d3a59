import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barriometrics.operators import cleaning, lookups
from barriometrics.operators.order_stats import order_statistics, quantiles


def sample(kind, n, rng):
    if kind == "hot":
        return [7.0 if rng.random() < 0.6 else rng.uniform(-50, 50) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 9) for _ in range(n)]
    if kind == "tiny":
        return [rng.choice([-1, 0, 1]) * 10 ** rng.uniform(-300, -3) for _ in range(n)]
    if kind == "near":
        return [5.0 + rng.random() * 1e-9 for _ in range(n)]
    if kind == "negative":
        return [-1000.0 - rng.random() for _ in range(n)]
    return [round(rng.uniform(0, 10), 1) for _ in range(n)]


@pytest.mark.parametrize("kind", ["hot", "wide", "ties", "tiny", "near", "negative"])
def test_quantiles_match_numpy(spark, kind):
    rng = random.Random(3)
    groups = {"a": sample(kind, 501, rng), "b": sample(kind, 8, rng), "c": [1.5]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 1.0}
    out = {r["g"]: r for r in quantiles(df, F.col("v"), probabilities, ["g"]).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        assert out[g]["n"] == len(vs)
        for name, p in probabilities.items():
            assert out[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)
    whole = quantiles(df.filter("g = 'a'"), F.col("v"), {"m": 0.5}).first()
    assert whole["m"] == pytest.approx(np.quantile(groups["a"], 0.5))


def test_rank_outside_the_group_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    out = {r["g"]: (r["n"], r["second"], r["none"]) for r in order_statistics(df, F.col("v"), {"second": lambda n: F.lit(2), "none": lambda n: F.lit(0)}, ["g"]).collect()}
    assert out == {"a": (2, 2.0, None), "b": (1, None, None)}


def test_infinite_values_are_ordered_and_undefined_ones_left_out(spark):
    values = [float("nan"), float("inf"), 3.0, float("-inf"), 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(1, 6)}
    row = order_statistics(df, F.col("v"), ranks).first()
    assert [row[f"r{i}"] for i in range(1, 6)] == [float("-inf"), 1.0, 3.0, float("inf"), None] and row["n"] == 4


def test_no_full_percentile_buffer_in_the_plan(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    plan = quantiles(df, F.col("v"), {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_iqr_filter_is_a_filter(spark):
    values = [float(v) for v in range(100)] + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in values], "price double")
    kept = cleaning.iqr_outlier_filter(df, "price")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert sorted(r[0] for r in kept.collect()) == [v for v in sorted(values) if low <= v <= high]
    assert "NestedLoop" not in kept._jdf.queryExecution().executedPlan().toString()
    report = cleaning.outlier_report(df, "price").first()
    assert (report["outliers"], report["rows_before"], report["rows_after"]) == (2, 102, 100)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_salted_equals_broadcast(spark, how):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", i) for i in range(2000)] + [(None, -1)]
    big = spark.createDataFrame(rows, "k string, i int").repartition(4)
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(20)], "k string, v int")
    by_broadcast = lookups.attach(big, small, ["k"], how)
    by_salt = lookups.attach(big, small, ["k"], how, broadcast_rows=3)
    key = lambda r: (r["k"] or "", r["i"])
    assert sorted(by_salt.collect(), key=key) == sorted(by_broadcast.collect(), key=key)
    assert sorted(by_salt.columns) == sorted(by_broadcast.columns)


@pytest.mark.parametrize("hot_rows", [100, lookups.HOT_KEY_ROWS])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_never_broadcasts_a_large_table_and_repeats_hot_keys_only(spark, monkeypatch, how, hot_rows):
    monkeypatch.setattr(lookups, "HOT_KEY_ROWS", hot_rows)
    rows = [("hot", i) for i in range(1000)] + [(f"k{i}", i) for i in range(50)] + [(None, -1), (None, -2)]
    big = spark.createDataFrame(rows, "k string, i int").repartition(8)
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    found = lookups.attach(big, small, ["k"], how, broadcast_rows=3)
    assert sorted(map(str, found.collect())) == sorted(map(str, big.join(small, ["k"], how).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "sequence(0, 63" not in plan


def test_group_mean_and_lookup(spark):
    rows = [("Recoleta", 10.2), ("Recoleta", None), ("Recoleta", 11.0), ("Tribunales", None), ("Nowhere", None), (None, None)]
    df = spark.createDataFrame(rows, "n string, age double")
    out = cleaning.impute_lookup(cleaning.impute_group_mean(df, "age", "n"), "age", "n")
    assert sorted((r["n"] or "", r["age"]) for r in out.collect()) == [
        ("", 50.0), ("Nowhere", 50.0), ("Recoleta", 11.0), ("Recoleta", 11.0), ("Recoleta", 11.0), ("Tribunales", 80.0),
    ]
