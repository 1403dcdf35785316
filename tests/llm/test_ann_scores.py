"""Scores of the nearest neighbours are the plain double-precision cosine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.llm import ann


def _plain(a, b):
    return float(np.clip((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), -1.0, 1.0))


@pytest.mark.parametrize("width", [1, 7, 64])
def test_scores_and_order_equal_the_plain_measure(spark, width):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(60, width))
    # parallel vectors: cosines of 1, and near ties everywhere else
    x = np.vstack([base * f for f in (1.0, 2.0, 3.0, 0.1, -0.7)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, 5, F.col("vec_id") % 7 == 0).collect()
    assert {r["query_id"] for r in got} == set(range(0, len(x), 7))
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = sorted(((-_plain(x[q], x[j]), j) for j in range(len(x)) if j != q))[:5]
        assert [(j, s) for _, j, s in mine] == [(j, -s) for s, j in want]
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(-1.0 <= s <= 1.0 for _, _, s in mine)


def test_a_score_does_not_depend_on_its_block():
    rng = np.random.default_rng(0)
    q, y = rng.normal(size=(40, 64)), rng.normal(size=(500, 64))
    i, j = np.repeat(np.arange(40), 500), np.tile(np.arange(500), 40)
    whole = ann._cosine(q, y, i, j)
    assert (whole == ann._cosine(q, y, i, j, chunk=13)).all()
    assert (whole[:500] == ann._cosine(q[:1], y, i[:500], j[:500])).all()
