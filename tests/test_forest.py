"""The fully grown forest against a plain recursive tree, and its Spark levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.operators import classify as M
from custlens.plans import forest as P


def _gini(w, y, classes):
    n = np.bincount(y, weights=w, minlength=classes)
    return n.sum() - (n ** 2).sum() / n.sum()


def _plain(x, y, w, classes, won):
    """Recursive exhaustive tree over all features; a function of one row."""
    share = np.bincount(y, weights=w, minlength=classes) / w.sum()
    best = None
    if (share > 0).sum() > 1:
        for f in range(x.shape[1]):
            vals = np.unique(x[:, f])
            for a, b in zip(vals, vals[1:]):
                low = x[:, f] <= a
                g = _gini(w, y, classes) - _gini(w[low], y[low], classes) - _gini(w[~low], y[~low], classes)
                if best is None or g > best[0] + 1e-12:
                    best = (g, f, (a + b) / 2)
    if best is None:
        return lambda r: share
    g, f, c = best
    won[f] += g
    low = x[:, f] <= c
    lo, hi = _plain(x[low], y[low], w[low], classes, won), _plain(x[~low], y[~low], w[~low], classes, won)
    return lambda r: lo(r) if r[f] <= c else hi(r)


@pytest.mark.parametrize("seed", range(6))
def test_grow_equals_a_plain_tree(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=80), rng.integers(0, 4, 80), rng.normal(size=80)]).astype(float)
    y = ((x[:, 0] > 0).astype(int) + (rng.random(80) < 0.3)).astype(int)
    w = rng.integers(1, 4, 80).astype(float)
    test = np.column_stack([rng.normal(size=50), rng.integers(0, 4, 50), rng.normal(size=50)]).astype(float)
    share, won = P.grow(x, y, w, test, 3, 3, 0, 1)
    want_won = np.zeros(3)
    tree = _plain(x, y, w, 3, want_won)
    # splits of equal gain may fall on another feature: same impurity in all, same leaves for nearly all rows
    assert won.sum() == pytest.approx(_gini(w, y, 3)) == pytest.approx(want_won.sum())
    assert np.mean([np.allclose(s, tree(r)) for s, r in zip(share, test)]) > 0.8
    # every training row ends in a pure leaf
    own, _ = P.grow(x, y, w, x, 3, 1, 0, 1)
    assert (own.argmax(1) == y).all() and own.max(1).min() == 1.0


def test_equal_rows_share_a_leaf():
    x = np.array([[1.0, 2.0]] * 5)
    share, won = P.grow(x, np.array([0, 0, 1, 1, 1]), np.ones(5), np.array([[9.0, 9.0]]), 2, 1, 0, 1)
    assert share.tolist() == [[0.4, 0.6]] and won.tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.normal(size=(n, 3))
    x[: n // 3] = 0.5  # a third of all rows are equal in every feature
    y = ((x[:, 0] + 0.5 * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=np.arange(n), y=y, _train=rng.random(n) < 0.7)
    return spark.createDataFrame(pdf).persist()


def test_spark_levels_give_as_good_a_forest(rows):
    acc, imp = {}, {}
    for node_rows in (150, 50_000):
        pred, imp[node_rows] = P.fit_predict(rows, ["a", "b", "c"], "y", "k", trees=12, node_rows=node_rows)
        acc[node_rows] = pred.agg(F.avg((F.col("truth") == F.col("pred")).cast("int")), F.count("pred")).first()
    assert acc[150][1] == acc[50_000][1] == rows.where("not _train").count()
    assert acc[150][0] > 0.88 and abs(acc[150][0] - acc[50_000][0]) < 0.03
    assert np.argmax(imp[150]) == 0 and np.abs(imp[150] - imp[50_000]).max() < 0.1
    assert imp[150].sum() == pytest.approx(1.0)


def test_no_group_is_larger_than_asked_and_the_heavy_point_is_closed(rows):
    cols = ["_x0", "_x1", "_x2"]
    train = rows.where("_train").select(F.col("a").alias("_x0"), F.col("b").alias("_x1"), F.col("c").alias("_x2"),
                                        F.col("y").alias("_cls"), F.xxhash64("k").alias("_h")).persist()
    tops = [P.Top() for _ in range(3)]
    won = np.zeros((3, 3))
    P._levels(train, cols, tops, won, 2, 1, 1, 150, 16, np.array([[-9.0, 9.0]] * 3))
    pdf = train.toPandas()
    x = pdf[cols].to_numpy()
    for t, top in enumerate(tops):
        w = P._bootstrap(pdf["_h"].to_numpy().view(np.uint64), t, 1)
        node = top.route(x)
        sizes = np.bincount(node, weights=w)
        assert len(top.closed) >= 1 and all(sizes[n] > 150 for n in top.closed)
        assert max(s for n, s in enumerate(sizes) if n not in top.closed) <= 150


def test_forest_of_text_labels_and_edge_tables(spark):
    data = spark.createDataFrame([(i, float(i % 10), "low" if i % 10 < 5 else "high", i % 3 > 0) for i in range(60)],
                                 "k int, x double, y string, _train boolean")
    model, pred = M.forest(data, ["x"], "y", "k", trees=5)
    got = pred.collect()
    assert len(got) == 20 and all(r["pred"] == r["truth"] for r in got)
    assert M.importance(spark, model, ["x"]).collect()[0]["importance"] == pytest.approx(1.0)
    model, pred = M.forest(data.where("not _train"), ["x"], "y", "k", trees=5)
    assert {r["pred"] for r in pred.collect()} == {None} and model.importances.tolist() == [0.0]
    _, pred = M.forest(data.where("_train"), ["x"], "y", "k", trees=5)
    assert pred.count() == 0
    constant = data.withColumn("x", F.lit(1.0))
    model, pred = M.forest(constant, ["x"], "y", "k", trees=5)
    assert pred.count() == 20 and model.importances.tolist() == [0.0]
    assert M.forest(data.limit(0), ["x"], "y", "k", trees=5)[1].count() == 0


def test_rows_are_counted_and_packed_by_many(spark, monkeypatch):
    parts = [pd.DataFrame({"a": np.arange(n)}) for n in (3, 4, 1, 9, 2)]
    got = list(P._gathered(iter(parts), rows=7))
    assert [len(g) for g in got] == [7, 10, 2] and pd.concat(got)["a"].tolist() == pd.concat(parts)["a"].tolist()
    # votes of rows in other partitions and of repeated keys meet again
    data = spark.createDataFrame([(i % 50, float(i % 10), float(i // 20), int(i % 10 > 4), i % 3 > 0) for i in range(300)],
                                 "k int, x double, z double, y int, _train boolean")
    monkeypatch.setattr(P, "BUCKET_BITS", 2)
    one, imp = P.fit_predict(data.coalesce(1), ["x", "z"], "y", "k", trees=6)
    two, imp2 = P.fit_predict(data.repartition(7), ["x", "z"], "y", "k", trees=6, node_rows=30)
    assert one.count() == two.count() == data.where("not _train").count()
    assert one.where("truth = pred").count() == one.count() == two.where("truth = pred").count()
    assert np.argmax(imp) == np.argmax(imp2) == 0
