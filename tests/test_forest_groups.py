"""The forest's groups: what is shuffled does not grow with the trees, and dealing changes nothing."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.plans import forest as P

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(size=(n, 3))
    x[: n // 4] = 0.5  # a heavy point
    y = ((x[:, 0] > 0) ^ (rng.random(n) < 0.3)).astype(int)
    pdf = pd.DataFrame(x, columns=XS).assign(k=np.arange(n), y=y, _train=rng.random(n) < 0.7)
    return spark.createDataFrame(pdf).persist()


def _shuffle_files(spark):
    top = os.path.dirname(os.path.dirname(spark.sparkContext._temp_dir))
    return {f: os.path.getsize(f) for f in glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data")}


def test_shuffled_bytes_do_not_grow_with_the_trees(spark, rows):
    moved = []
    for trees in (16, 96):
        old = _shuffle_files(spark)
        pred, _ = P.fit_predict(rows, XS, "y", "k", trees=trees)
        assert pred.count() == rows.where("not _train").count()
        moved.append(sum(size for f, size in _shuffle_files(spark).items() if f not in old))
    assert 0 < moved[1] < 2 * moved[0], moved


def test_dealing_by_region_changes_no_result(rows):
    got = []
    for limits in ({}, {"group_rows": 900, "region_rows": 700}):
        pred, imp = P.fit_predict(rows, XS, "y", "k", trees=4, node_rows=400, **limits)
        got.append((sorted(map(tuple, pred.collect())), imp))
    assert got[1][0] == got[0][0] and got[1][1] == pytest.approx(got[0][1])
    assert len(got[0][0]) == rows.where("not _train").count() and all(r[2] is not None for r in got[0][0])


def test_every_node_is_in_one_bounded_group_of_near_nodes():
    rng = np.random.default_rng(1)
    tops = [P.Top() for _ in range(10)]
    for top in tops:
        for n in range(1, 41):
            top.small[n] = float(rng.integers(50, 101)), rng.random(2) * [1.0, 100.0]
    every = sorted((t, n) for t, top in enumerate(tops) for n in top.small)
    total = sum(top.small[n][0] for top in tops for n in top.small)
    ranges = np.array([[0.0, 1.0], [0.0, 100.0]])
    for most, region in ((10**9, 10**9), (1500, 10**9), (1500, 400), (60, 60)):
        groups = P._dealt(tops, ranges, 4, most, region)
        assert sorted(x for g in groups for x in g) == every
        assert max(sum(tops[t].small[n][0] for t, n in g) for g in groups) <= min(most, total / 4) + 100
        assert len(groups) >= 4
    near = P._dealt(tops, ranges, 4, 10**9, 400)
    wide = [np.ptp([tops[t].small[n][1] / [1.0, 100.0] for t, n in g], axis=0).max() for g in near]
    assert np.mean(wide) < 0.6
    assert P._dealt([P.Top()], ranges, 4, 10, 10) == []


def test_rows_of_large_leaves_get_their_votes(spark):
    # one point holds every row: all trees are one large leaf
    data = spark.createDataFrame([(i, 1.0, i % 4 // 3, i % 3 > 0) for i in range(600)], "k int, a double, y int, _train boolean")
    pred, imp = P.fit_predict(data, ["a"], "y", "k", trees=5, node_rows=50)
    assert pred.agg(F.count("pred"), F.sum("pred")).first()[:] == (200, 0) and imp.tolist() == [0.0]
