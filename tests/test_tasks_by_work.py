"""Few bytes with much work: tasks go by points and texts, not by the files' row groups."""

import numpy as np
import pandas as pd

from custlens.operators import text as T
from custlens.plans import kmeans as K


def test_kmeans_passes_use_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(40_000, 2)), columns=["a", "b"])).coalesce(1)
    seen, plain = [], K._pass

    def watched(data, *args):
        seen.append(data.rdd.getNumPartitions())
        return plain(data, *args)

    monkeypatch.setattr(K, "_pass", watched)
    fit = K.fit_many(df, ["a", "b"], [K.Run(0, 4, 1)], max_iter=2)[0]
    assert min(seen) >= 4 and fit.sizes.sum() == 40_000


def test_nearest_of_many_centres_in_small_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(5000, 3)), rng.normal(size=(700, 3))
    c[300] = c[20]  # the first of equal centres
    want = ((x[:, None, :] - c) ** 2).sum(-1).argmin(1)
    assert (K._nearest(x, c) == want).all() and (K._nearest(x, c, cells=1) == want).all()
    assert len(K._nearest(x[:0], c)) == 0


def test_topics_of_one_row_group_use_many_tasks(spark, monkeypatch):
    words = ["coffee bean roast", "parcel late courier", "price cheap offer"]
    df = spark.createDataFrame([(i, " ".join([words[i % 3]] * 4)) for i in range(240)], "id int, t string").coalesce(1)
    seen, plain = [], T.LDA.fit

    def watched(self, vec, *args):
        seen.append((vec.rdd.getNumPartitions(), vec.count()))
        return plain(self, vec, *args)

    monkeypatch.setattr(T.LDA, "fit", watched)
    got = T.topics(df, "t", k=3, top=3, max_iter=5, texts_per_task=60)
    assert seen == [(4, 240)] and got.count() == 9
