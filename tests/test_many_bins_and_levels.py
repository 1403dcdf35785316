"""Many bins, and tables above the broadcast limit."""

import numpy as np
import pytest

from custlens.operators import wrangle as W
from custlens.plans import common
from custlens.plans.split import stratified_flag


def test_more_than_two_hundred_bins(spark):
    x = np.random.default_rng(0).normal(size=500).tolist() + [None, float("nan"), 0.25, 0.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x double")
    out = W.bin_equal_width(df, "x", 1000).orderBy("id").collect()
    edges, labels = W.equal_width_edges(min(v for v in x if v is not None), max(v for v in x if v is not None), 1000)
    for r in out:
        if r["x"] is None or np.isnan(r["x"]):
            assert r["x_bin"] is None and r["x_group"] is None
        else:
            b = 1 + sum(e < r["x"] for e in edges[1:-1])
            assert (r["x_bin"], r["x_group"], r["x_lo"], r["x_hi"]) == (b, labels[b - 1], edges[b - 1], edges[b])
    assert W.bin_equal_width(df.where("x IS NULL"), "x", 1000).select("x_bin").collect()[0][0] is None
    with pytest.raises(ValueError):
        W.bin_equal_width(df, "x", 1)


def test_the_same_rows_with_and_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"c{min(i % 9, i % 5)}") for i in range(200)], "k int, c string")
    split, pooled = stratified_flag(df, "k", "c"), W.pool_rare(df, "c", 3)
    monkeypatch.setattr(common, "BROADCAST_ROW_LIMIT", 1)
    monkeypatch.setattr(W, "BROADCAST_ROW_LIMIT", 1)
    assert sorted(split.collect()) == sorted(stratified_flag(df, "k", "c").select(*split.columns).collect())
    assert sorted(pooled.collect()) == sorted(W.pool_rare(df, "c", 3).select(*pooled.columns).collect())
