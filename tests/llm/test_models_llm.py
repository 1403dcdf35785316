"""Toxicity, quality and nearest neighbours: held-out accuracy, recall, edge rows."""

import zlib

import numpy as np
import pytest

from custlens.llm import ann, quality, registry, toxicity

BIG = "/root/testdata/sf0.1"


def _auc(label, score):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("query,label,folds,held,least", [(registry.q_toxicity, "toxic", 5, 0, 0.94),
                                                          (registry.q_quality, "quality", 3, 1, 0.98)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    got = query(spark, BIG).toPandas()
    assert got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == held) for i, h in zip(got.doc_id, got.held_out))
    known = got[got.held_out].merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas(), on="doc_id")
    y = known[label].to_numpy()
    assert _auc(y, known.score.to_numpy()) >= least
    wrong = known.predicted.to_numpy() != y
    assert wrong[y == 1].mean() < 0.15 and wrong[y == 0].mean() < 0.06


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 9)] + [(4, None, 1), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores_of_edge_rows(spark, edge_docs, no_docs, score):
    labels = _labels(spark)
    got = score(edge_docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert score(no_docs, labels).count() == 0
    alone = score(edge_docs, labels.where("false")).collect()  # nothing to learn from
    assert len({r.score for r in alone}) == 1 and len(alone) == len(rows)


def test_drop_toxic_catches_planted_rows_and_keeps_columns(spark, edge_docs):
    clean = [(i, f"plain words number {i} about a garden and its {i % 13} trees", 0) for i in range(400)]
    toxic = [(1000 + i, f"you are a {['grumbol', 'snarfle', 'wretchit'][i % 3]} in garden {i}", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, t) for i, t, _ in clean + toxic], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + toxic if i % 2 == 0], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in clean}
    assert toxicity.drop_toxic(edge_docs, labels).columns == edge_docs.columns


def test_label_model_finds_copied_voters():
    """A voter that repeats another one is its neighbour in the tree and adds no evidence."""
    rng = np.random.default_rng(1)
    entries = [f"w:{i}" for i in range(toxicity.LEXICON_VOTERS)]
    model = toxicity.LabelModel(entries)
    y = rng.random(4000) < 0.3
    votes = np.zeros((4000, model.width), np.int64)
    votes[:, 0] = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.1)
    votes[:, 1] = votes[:, 0]
    votes[:, 2] = np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.2)
    joint = np.zeros((2, model.width, model.width, 2, 2))
    for k in (0, 1):
        v = votes[y == k]
        both = [1 - v, v]
        for a in (0, 1):
            for b in (0, 1):
                joint[k, :, :, a, b] = both[a].T @ both[b]
    model.fit(joint, learn_tree=True)
    assert model.parent[1] == 0 or model.parent[0] == 1
    one, two = np.zeros((2, 1, model.width), np.int64)
    one[0, [0, 1]] = 1
    odds = model.posterior(one)[0] / (1 - model.posterior(one)[0])
    assert odds == pytest.approx(0.3 / 0.7 * 0.8 / 0.1 * 0.3 / 0.8, rel=0.3)


def test_class_moments_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(y, x)], "label int, x array<double>").repartition(5)
    for k, (n, mean, cov) in quality.class_moments(rows, 3).items():
        assert n == (y == k).sum() and np.allclose(mean, x[y == k].mean(0))
        assert np.allclose(cov, np.cov(x[y == k].T, bias=True))


# ---------------------------------------------------------------- nearest neighbours
def _brute(rows, k, asks):
    ok = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, u in ok:
        if asks(q):
            near = sorted(((-(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)), i) for i, v in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_against_brute_force(spark, sf):
    got = registry.q_nearest(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = _brute(rows, 5, lambda i: i % 50 == 0)
    found = sum(any(i == r.vec_id for i, _ in want[r.query_id]) for r in got)
    assert len(got) == 5 * len(want) and found / len(got) >= 0.9


def test_forest_stops_early_and_still_finds_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 16))
    rows = [(i, (centres[i % 200] + 0.05 * rng.normal(size=16)).tolist()) for i in range(4000)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(docs, k=5, is_query=docs.vec_id % 100 == 0, search_share=0.05, least_rows=1, trees=8).collect()
    want = _brute(rows, 5, lambda i: i % 100 == 0)
    assert sum(any(i == r.vec_id for i, _ in want[r.query_id]) for r in got) / len(got) >= 0.9


def test_nearest_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]),
            (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [-1.0, 0.0]),
            (2, [0.0, 1.0]), (100, None), (None, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(docs.selectExpr("*", "1 AS id", "2 AS score"), k=5, is_query=docs.vec_id % 50 == 0).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {
        (0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (0, 4, 9, -1.0),
        (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0), (50, 4, 9, -1.0)}
    none = ann.nearest(docs.where("false"), k=5)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(i, [1.0, float(i % 7)]) for i in range(300, 400)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(docs, k=5, is_query=docs.vec_id % 50 == 0).collect()
    want = _brute(rows, 5, lambda i: i % 50 == 0)
    for q, near in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for i, _ in near] or np.allclose([s for _, _, s in mine], [s for _, s in near])
