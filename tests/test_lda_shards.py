"""Topics of many texts: terms in shards, texts in blocks, no table of all terms in one place."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from custlens.operators import text as T
from custlens.plans import lda


def _texts(n=500, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        own = rng.choices(range(3), [0.5, 0.3, 0.2])[0]
        mix = [own if rng.random() < 0.85 else rng.randrange(3) for _ in range(rng.randrange(5, 50))]
        rows.append((" ".join(f"Word{t}x{min(29, int(rng.expovariate(0.2)))}" for t in mix),))
    return [*rows, (None,), ("",), ("the and of",), ("rare1 rare2",)]


def test_many_texts_need_no_table_of_all_terms(spark, monkeypatch):
    df = spark.createDataFrame(_texts(200), "t string").repartition(3)

    def fit(*_):
        raise AssertionError("all terms in one place")

    monkeypatch.setattr(T.LDA, "fit", fit)
    monkeypatch.setattr(T.CountVectorizer, "fit", fit)
    got = T.topics(df, "t", k=3, top=3, max_iter=1, lda_chars=100)
    rows = got.collect()
    assert got.columns == ["topic", "rank", "term", "weight"] and len(rows) == 9
    for t in (1, 2, 3):
        own = sorted((r for r in rows if r["topic"] == t), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3] and own[0]["weight"] >= own[1]["weight"] >= own[2]["weight"]


def test_blocks_and_shards_equal_one_table(spark):
    texts = [(t or "").lower().split() for (t,) in _texts(300)]
    words = spark.createDataFrame([(" ".join(t),) for t in texts], "w string").repartition(2)
    got = {(r["topic"], r["term"]): r["weight"] for r in lda.topics(
        words, 5, 10_000, 3, 10_000, 7, 3, block_words=700).collect()}
    # the same rounds over one table of all terms
    kept = sorted(w for w, n in Counter(w for t in texts for w in set(t)).items() if n >= 5)
    shard = pd.util.hash_array(np.array(kept, object), categorize=False) % lda.LEAST_SHARDS
    kept = [w for _, w in sorted(zip(shard.tolist(), kept, strict=True))]
    table = np.concatenate([np.random.default_rng([7, s]).gamma(100, 0.01, (3, n)) for s, n in sorted(Counter(
        shard.tolist()).items())], axis=1)
    place, alpha = {w: i for i, w in enumerate(kept)}, np.full(3, 1 / 3)
    counts = [c for c in (Counter(w for w in t if w in place) for t in texts) if c]
    ptr = np.append(0, np.cumsum([len(c) for c in counts]))
    idx = np.array([place[w] for c in counts for w in c])
    cnt = np.array([float(n) for c in counts for n in c.values()])
    for turn in range(3):
        beta = np.exp(lda.digamma(table) - lda.digamma(table.sum(1))[:, None])
        gamma, stat = lda.infer(ptr, idx, cnt, beta, alpha, np.random.default_rng(0))
        weight = (1024 + turn + 1) ** -0.51
        table = (1 - weight) * table + weight * (stat * beta + 1 / 3)
        alpha = lda.next_alpha(alpha, lda._log_share(gamma).mean(0), len(counts), weight)
    share = table / table.sum(1)[:, None]
    assert len(got) == 3 * len(kept)
    assert [got[t + 1, w] for t in range(3) for w in kept] == pytest.approx(share.ravel().tolist(), rel=0.1)


def test_inference_settles_where_a_plain_loop_does():
    rng = np.random.default_rng(3)
    beta, alpha = rng.dirichlet(np.ones(40) * 0.3, 3), np.array([0.2, 0.3, 0.5])
    docs = [np.sort(rng.choice(40, rng.integers(1, 40), replace=False)) for _ in range(300)]
    ptr, idx = np.append(0, np.cumsum([len(d) for d in docs])), np.concatenate(docs)
    cnt = rng.integers(1, 6, len(idx))
    gamma, stat = lda.infer(ptr, idx, cnt, beta, alpha, np.random.default_rng(9))
    sums = np.zeros_like(beta)
    for d, g in enumerate(np.random.default_rng(9).gamma(100, 0.01, (300, 3))):
        w, c = docs[d], cnt[ptr[d]:ptr[d + 1]]
        theta, change = lda._theta(g[None])[0], 1.0
        while change > 1e-3:
            old, g = g, theta * (beta[:, w] @ (c / (theta @ beta[:, w] + 1e-100))) + alpha
            theta, change = lda._theta(g[None])[0], np.abs(g - old).mean()
        assert gamma[d] == pytest.approx(g)
        sums[:, w] += theta[:, None] * (c / (theta @ beta[:, w] + 1e-100))
    assert stat == pytest.approx(sums)


def test_digamma_and_trigamma():
    assert lda.digamma(1.0) == pytest.approx(-0.5772156649015329, rel=1e-12)
    assert lda.digamma(0.5) == pytest.approx(-0.5772156649015329 - 2 * math.log(2), rel=1e-12)
    assert lda.trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-12)
    assert lda.trigamma(0.01) == pytest.approx(lda.trigamma(1.01) + 1e4, rel=1e-12)


def test_no_terms_of_many_texts(spark):
    df = spark.createDataFrame([("abc def",), (None,), ("the of",)], "t string")
    assert T.topics(df, "t", min_df=5, lda_chars=1).count() == 0
