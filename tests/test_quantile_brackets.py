"""Quantiles by sketch brackets: exact on any values, no value outside a bracket is kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.plans import quantiles as Q

PROBS = [0, 0.013, 0.25, 0.5, 0.75, 0.999, 1]


def _check(spark, x, probs=PROBS, groups=None):
    rows = [(None if groups is None else groups[i], float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    got = Q.exact_quantiles(df, "x", probs, [] if groups is None else ["g"]).collect()
    assert len(got) == (1 if groups is None else len(set(groups)))
    for r in got:
        own = x if groups is None else np.array([v for v, k in zip(x, groups) if k == r["g"]])
        assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(own, probs), rel=1e-12)


@pytest.mark.parametrize("name", ["one", "two", "constant", "normal", "hot", "few", "huge"])
def test_ungrouped(spark, name):
    rng = np.random.default_rng(7)
    x = {"one": np.array([5.0]), "two": np.array([1.0, 2.0]), "constant": np.zeros(100), "normal": rng.normal(size=4000),
         "hot": np.r_[np.zeros(2000), rng.normal(size=1000)], "few": rng.integers(0, 4, 900).astype(float),
         "huge": rng.normal(size=500) * 1e300}[name]
    _check(spark, x)


def test_groups_with_null_key(spark):
    rng = np.random.default_rng(8)
    _check(spark, rng.exponential(size=3000), groups=[None if i % 7 == 0 else i % 3 for i in range(3000)])


def test_many_probabilities(spark):
    _check(spark, np.random.default_rng(9).normal(size=2000), [j / 101 for j in range(1, 101)])


@pytest.mark.parametrize("by", [[], ["g"]])
def test_a_bad_sketch_is_noticed(spark, monkeypatch, by):
    # brackets that miss the wanted ranks on purpose: the whole range is counted instead
    monkeypatch.setattr(Q, "_near", lambda p: (0.01, 0.02))
    x = np.random.default_rng(10).normal(size=1000)
    df = spark.createDataFrame([(1, float(v)) for v in x], "g int, x double")
    r = Q.exact_quantiles(df, "x", [0.5, 0.9], by).first()
    assert [r["q0"], r["q1"]] == pytest.approx(np.quantile(x, [0.5, 0.9]), rel=1e-12)


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    r = Q.exact_quantiles(df, "x", [0, 0.5, 1]).first()
    assert [r["q0"], r["q1"], r["q2"]] == [float("-inf"), 1.5, float("inf")]


def test_few_rows_are_counted_by_value(spark):
    x = spark.range(100_000).select((F.xxhash64("id") / 1e9).alias("x"))
    near = [tuple(r) for r in x.agg(F.percentile_approx("x", list(Q._near(0.5)), Q.SKETCH)).collect()]
    counted = Q._bracketed(x, "x", [tuple(near[0][0])])
    assert counted.count() < 100
    assert counted.agg(F.sum("_cnt")).first()[0] == 100_000
