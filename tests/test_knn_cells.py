"""k-NN by a k-d tree: exact on uneven points, and a query looks at few leaves."""

import numpy as np
import pandas as pd
import pytest

from custlens.plans import neighbors as N


def _uneven(n, rng):
    # a dense core, a line and a few points very far away
    return np.vstack([rng.normal(size=(n, 3)) * 1e-3, np.column_stack([rng.normal(size=n), np.zeros((n, 2))]),
                      rng.normal(size=(8, 3)) * 1e4])


@pytest.mark.parametrize("leaf_rows, query_rows", [(20, 7), (150, 50_000), (10_000, 40)])
def test_cells_equal_brute_force_on_uneven_points(spark, leaf_rows, query_rows):
    rng = np.random.default_rng(leaf_rows)
    tr, te = _uneven(300, rng), _uneven(40, rng)
    tr[50:90] = tr[50]  # more copies than neighbours
    te[5] = tr[50]
    rid = np.array([f"r{i:04d}" for i in rng.permutation(len(tr))])
    tdf = spark.createDataFrame(pd.DataFrame(tr, columns=list("abc")).assign(_rid=rid, _label=np.arange(len(tr)) % 3))
    qdf = spark.createDataFrame(pd.DataFrame(te, columns=list("abc")).assign(_tid=np.arange(len(te))))
    got = {r["_tid"]: r["neighbours"] for r in
           N.knn(tdf, qdf, ["a", "b", "c"], 5, leaf_rows=leaf_rows, query_rows=query_rows).collect()}
    assert len(got) == len(te)
    for i, q in enumerate(te):
        d = 0.0 + (q[0] - tr[:, 0]) ** 2 + (q[1] - tr[:, 1]) ** 2 + (q[2] - tr[:, 2]) ** 2
        best = np.lexsort((rid, d))[:5]
        assert [(n["dist2"], n["rid"], n["label"]) for n in got[i]] == [(d[j], rid[j], j % 3) for j in best]


def test_a_dense_core_does_not_meet_itself():
    rng = np.random.default_rng(1)
    tr, te = _uneven(20_000, rng), _uneven(500, rng)
    cells = N.Cells.fit(tr[::4], 50)
    leaf = cells.route(tr)
    assert np.bincount(leaf).max() < 400
    cells.bound({n: (tr[leaf == n].min(0), tr[leaf == n].max(0)) for n in np.unique(leaf)}, 3)
    home = cells.route(te)
    r2 = np.array([np.sort(((tr[leaf == h] - q) ** 2).sum(1))[8] for q, h in zip(te, home)])
    row, _ = cells.near(te, home, r2)
    assert len(row) / len(te) < 12  # of about 800 leaves


def test_no_training_rows_and_no_queries(spark):
    tdf = spark.createDataFrame([(1, 0, 1.0)], "_rid int, _label int, a double")
    qdf = spark.createDataFrame([(7, 2.0)], "_tid int, a double")
    assert N.knn(tdf.limit(0), qdf, ["a"], 3).count() == 0
    assert N.knn(tdf, qdf.limit(0), ["a"], 3).count() == 0
    assert [n["rid"] for n in N.knn(tdf, qdf, ["a"], 3).first()["neighbours"]] == [1]
