import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.plans import ranks
from custlens.plans.quantiles import exact_quantiles, mode_smallest
from custlens.plans.ranks import _sign_pair_sum, average_rank, kendall_tau_b


def _frame(spark, values, groups=None):
    rows = [(i, None if v is None else float(v), groups[i] if groups else "a") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, x double, g string")


@pytest.mark.parametrize("per_bucket", [200_000, 7])
def test_exact_quantiles_match_numpy(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(ranks.bucket_count, "__defaults__", (per_bucket, 1))
    rng = np.random.default_rng(3)
    vals = list(np.round(rng.lognormal(size=400), 2)) + [5.0] * 150 + [None, float("nan")]
    groups = ["a" if i % 3 else "b" for i in range(len(vals))]
    df = _frame(spark, vals, groups)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, "x", probs, ["g"]).collect()}
    pdf = pd.DataFrame({"x": vals, "g": groups}).dropna()
    for g, part in pdf.groupby("g"):
        want = np.quantile(part["x"].to_numpy(float), probs)
        assert [got[g][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want), rel=1e-12)


def test_mode_smallest_of_ties(spark):
    df = _frame(spark, [3, 1, 3, 1, 2, None])
    assert mode_smallest(df, "x").collect()[0]["mode"] == 1.0


def test_average_rank_matches_pandas_and_is_partition_invariant(spark):
    rng = np.random.default_rng(5)
    vals = list(rng.integers(0, 30, size=300).astype(float)) + [None]
    df = _frame(spark, vals)
    want = pd.Series(vals, dtype=float).rank(method="average")
    for parts in (1, 13):
        got = average_rank(df.repartition(parts), "x", "r").orderBy("id").toPandas()["r"]
        assert np.allclose(got.fillna(-1), want.fillna(-1))


def _tau_b_brute(x, y):
    n = len(x)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(n), 2))
    n0 = n * (n - 1) / 2
    tx = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    ty = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    return s / np.sqrt((n0 - tx) * (n0 - ty))


def test_sign_pair_sum_matches_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(2, 40)
        x = np.array([rng.randint(0, 6) for _ in range(n)], float)
        y = np.array([rng.randint(0, 6) for _ in range(n)], float)
        brute = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(n), 2))
        assert _sign_pair_sum(x, y, np.ones(n)) == pytest.approx(brute)


@pytest.mark.parametrize("buckets", [4, 256])
def test_kendall_tau_b_with_ties(spark, buckets):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 15, size=250).astype(float)
    y = (x + rng.integers(0, 10, size=250)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": y}))
    got = kendall_tau_b(df, "a", "b", buckets=buckets).collect()[0]["tau_b"]
    assert got == pytest.approx(_tau_b_brute(x, y), rel=1e-12)
    rev = kendall_tau_b(df.withColumn("b", -F.col("b")), "a", "b", buckets=buckets).collect()[0]["tau_b"]
    assert rev == pytest.approx(-got, rel=1e-12)


def test_grouped_average_rank(spark):
    rng = np.random.default_rng(8)
    vals = [float(v) for v in rng.integers(0, 12, size=200)]
    groups = ["a" if i % 4 else "b" for i in range(200)]
    df = _frame(spark, vals, groups)
    got = average_rank(df, "x", "r", by=["g"]).orderBy("id").toPandas()["r"]
    want = pd.DataFrame({"x": vals, "g": groups}).groupby("g")["x"].rank(method="average")
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_kendall_heavy_value_is_skipped_not_loaded(spark):
    # a third of the rows share one x value: its bucket holds one value only
    x = [5.0] * 100 + [float(v) for v in range(200)]
    y = [float((7 * i) % 31) for i in range(300)]
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": y}))
    got = kendall_tau_b(df, "a", "b", buckets=8).collect()[0]["tau_b"]
    assert got == pytest.approx(_tau_b_brute(np.array(x), np.array(y)), rel=1e-12)


def test_balanced_zero_one_and_many_probabilities(spark, monkeypatch):
    monkeypatch.setattr(ranks.bucket_count, "__defaults__", (1, 1))  # a bucket per value
    df = _frame(spark, [0, 1] * 50)
    probs = [i / 49 for i in range(50)]
    got = exact_quantiles(df, "x", [0.5, *probs]).collect()[0]
    assert got["q0"] == 0.5
    assert [got[f"q{i + 1}"] for i in range(50)] == pytest.approx(list(np.quantile([0, 1] * 50, probs)))
    assert exact_quantiles(df.where("false"), "x", [0.5]).count() == 0


def test_large_whole_numbers_keep_their_digits(spark):
    top = 2 ** 53
    df = spark.createDataFrame([(top,), (top + 1,), (top + 2,), (top + 1,), (None,)], "x long")
    assert mode_smallest(df, "x").collect()[0]["mode"] == top + 1
    got = {r["x"]: r["r"] for r in average_rank(df, "x", "r").collect()}
    assert got == {top: 1.0, top + 1: 2.5, top + 2: 4.0, None: None}


def test_kendall_buckets_hold_no_heavy_value(spark):
    """A third of x at 0, the rest continuous: the zeros are alone in their bucket."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random(6000) < 1 / 3, 0.0, rng.normal(size=6000))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    bounds = ranks.range_bounds(df, "x", 64)
    sizes = ranks._apart(df, "x", "b", bounds).groupBy("b").agg(F.count("*").alias("n"), F.countDistinct("x").alias("d"))
    assert max(r["n"] for r in sizes.where("d > 1").collect()) <= 3 * 6000 / 64
