import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.functions.porter import stem
from custlens.operators import images as I
from custlens.operators import segment as G
from custlens.operators import text as T
from custlens.operators.segment import _ward_merges
from custlens.plans.kmeans import Run, best_of, fit_many
from custlens.plans.neighbors import knn


def _ward_brute(x):
    clusters = {i: [i] for i in range(len(x))}
    out, nxt = [], len(x)
    while len(clusters) > 1:
        best = None
        for a in clusters:
            for b in clusters:
                if a < b:
                    A, B = x[clusters[a]], x[clusters[b]]
                    c = 2 * len(A) * len(B) / (len(A) + len(B)) * ((A.mean(0) - B.mean(0)) ** 2).sum()
                    if best is None or c < best[0]:
                        best = (c, a, b)
        c, a, b = best
        out.append((a, b, np.sqrt(c)))
        clusters[nxt] = clusters.pop(a) + clusters.pop(b)
        nxt += 1
    return out


def test_ward_chain_equals_greedy():
    x = np.random.default_rng(0).normal(size=(40, 3))
    got = _ward_merges(x, np.ones(40))
    want = _ward_brute(x)
    assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _ in want]
    assert [h for _, _, h, _ in got] == pytest.approx([h for _, _, h in want])


def test_multi_run_kmeans_finds_separated_clusters(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(c, 0.1, size=(50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["a", "b"]))
    centers, inertia, settled, sizes = best_of(df, ["a", "b"], 3, restarts=4)
    assert settled and sorted(sizes) == [50, 50, 50]
    assert sorted(map(tuple, np.round(centers).astype(int).tolist())) == [(0, 0), (0, 5), (5, 5)]
    assert inertia == pytest.approx(sum(((pts[i * 50:(i + 1) * 50] - pts[i * 50:(i + 1) * 50].mean(0)) ** 2).sum()
                                        for i in range(3)), rel=1e-9)


def _lloyd(x, c, steps=10_000):
    for _ in range(steps):
        lab = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c, atol=1e-12):
            break
        c = new
    return c, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum()


def test_settled_centres_rest_on_all_rows(spark):
    # no clusters at all: the slowest case, and the table of drawn points only resembles the rows
    x = np.random.default_rng(5).random((6000, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).persist()
    fits = fit_many(df, ["a", "b", "c"], [Run(0, 4, 1), Run(1, 7, 2)], tol=1e-9)
    for fit in fits.values():
        assert fit.settled and fit.sizes.sum() == len(x)
        rest, inertia = _lloyd(x, fit.centers)
        assert np.abs(rest - fit.centers).max() < 1e-3 and fit.inertia == pytest.approx(inertia, rel=1e-5)
    again = fit_many(df, ["a", "b", "c"], [Run(0, 4, 1), Run(1, 7, 2)], tol=1e-9)
    assert all(np.allclose(again[r].centers, fits[r].centers) for r in fits)


def test_restarts_are_as_good_as_plain_kmeans_plus_plus(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(rng.normal(size=2) * 6, 1.0, (150, 2)) for _ in range(8)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    best = best_of(df, ["a", "b"], 8, restarts=10)
    tries = [_lloyd(x, x[np.random.default_rng(s).choice(len(x), 8, replace=False)])[1] for s in range(40)]
    assert best.inertia <= min(tries) * 1.01


def test_given_first_centres_take_plain_steps(spark):
    x = np.random.default_rng(3).normal(size=(400, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    first = np.array([[-1.0, 0.0], [1.0, 0.5], [0.0, 9.0]])
    fit = fit_many(df, ["a", "b"], [Run(0, 3, 0)], max_iter=2, tol=0.0, first={0: first})[0]
    want, inertia = _lloyd(x, first, 2)
    assert not fit.settled and fit.inertia == pytest.approx(inertia)
    assert np.allclose(fit.centers, want)


def test_weights_stand_for_repeated_rows(spark):
    x = [(float(i % 7), float(i % 3), 1 + i % 4) for i in range(21)]
    weighted = spark.createDataFrame(x, "a double, b double, n int")
    rows = spark.createDataFrame([(a, b) for a, b, n in x for _ in range(n)], "a double, b double")
    one = fit_many(weighted, ["a", "b"], [Run(0, 3, 4)], weight="n")[0]
    two = fit_many(rows, ["a", "b"], [Run(0, 3, 4)])[0]
    assert np.allclose(one.centers, two.centers) and one.sizes.sum() == two.sizes.sum() == len(rows.collect())


def test_grid_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    tr = rng.normal(size=(300, 3)) * np.array([1.0, 5.0, 0.2])
    te = rng.normal(size=(60, 3)) * 3
    tdf = spark.createDataFrame(pd.DataFrame({"_rid": np.arange(300), "_label": rng.integers(0, 2, 300),
                                              "a": tr[:, 0], "b": tr[:, 1], "c": tr[:, 2]}))
    qdf = spark.createDataFrame(pd.DataFrame({"_tid": np.arange(60), "a": te[:, 0], "b": te[:, 1], "c": te[:, 2]}))
    got = {r["_tid"]: [n["rid"] for n in r["neighbours"]] for r in knn(tdf, qdf, ["a", "b", "c"], 5).collect()}
    assert len(got) == 60
    for i in range(60):
        d = ((tr - te[i]) ** 2).sum(1)
        assert got[i] == list(np.lexsort((np.arange(300), d))[:5])


def test_silhouette_table_equals_evaluator(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=120), "b": rng.normal(size=120), "k": rng.integers(0, 3, 120)})
    pdf.loc[pdf.k == 1, "a"] += 3
    df = spark.createDataFrame(pdf)
    got = G.silhouette_table(df, ["a", "b"], "k").collect()[0]["silhouette"]
    assert got == pytest.approx(G.silhouette(df, ["a", "b"], "k"), rel=1e-9)


def test_porter_examples_from_the_paper():
    pairs = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "hopping": "hop", "filing": "file",
             "relational": "relat", "hopefulness": "hope", "adjustment": "adjust", "generalizations": "gener",
             "oscillators": "oscil", "controll": "control", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def test_word_counts_and_polarity_modifiers(spark):
    docs = spark.createDataFrame([(1, "Great taste, not great shipping!"), (2, "The box was bad"), (3, None),
                                  (4, "nothing here")], "id long, text string")
    wc = {r["word"]: r["count"] for r in T.word_counts(docs, "text", stem=False).collect()}
    assert wc == {"great": 2, "taste": 1, "shipping": 1, "box": 1, "bad": 1, "nothing": 1, "here": 1}
    lex = spark.createDataFrame([("great", 0.8), ("bad", -0.7)], "word string, polarity double")
    plain = {r["id"]: r["polarity"] for r in T.polarity(docs, "id", "text", lex).collect()}
    assert plain == {1: pytest.approx(0.8), 2: pytest.approx(-0.7), 4: 0.0}
    neg = {r["id"]: r["polarity"] for r in T.polarity(docs, "id", "text", lex, negations=["not"]).collect()}
    assert neg[1] == pytest.approx((0.8 - 0.4) / 2)
    pol = docs.join(T.polarity(docs, "id", "text", lex), "id")
    asp = {r["aspect"]: (r["n"], r["mean_polarity"]) for r in T.aspect_sentiment(pol, "text").collect()}
    assert asp == {"flavor": (1, pytest.approx(0.8)), "shipping": (1, pytest.approx(0.8)),
                   "packaging": (1, pytest.approx(-0.7))}


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[i].astype(np.uint8).tobytes() for i in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_end_to_end(spark, tmp_path):
    red = np.zeros((30, 40, 3))
    red[..., 0] = 200
    split = np.zeros((20, 20, 3))
    split[:, :10] = (0, 0, 255)
    split[:, 10:] = (255, 255, 255)
    _png(tmp_path / "red.png", red)
    _png(tmp_path / "split.png", split)
    (tmp_path / "broken.png").write_bytes(b"not an image")
    imgs = I.load_images(spark, str(tmp_path))
    status = {r["image"].rsplit("/", 1)[-1]: r["status"] for r in imgs.select("image", "status").collect()}
    assert status == {"red.png": "ok", "split.png": "ok", "broken.png": "unreadable"}
    px = I.pixels(imgs, grid=12)
    stats = {r["image"].rsplit("/", 1)[-1]: r for r in I.image_stats(px).collect()}
    assert stats["red.png"]["n_pixels"] == 144
    assert stats["red.png"]["brightness"] == pytest.approx(200 / 3)
    assert stats["red.png"]["colorfulness"] == pytest.approx(0.3 * np.sqrt(200 ** 2 + 100 ** 2))
    dom = I.dominant_colors(px.where(F.col("image").endswith("split.png")), k=3)
    top = sorted((r["hex"], r["share"]) for r in dom.collect())
    assert top == [("#0000ff", pytest.approx(0.5)), ("#ffffff", pytest.approx(0.5))]


def test_entry_smoke(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.columns == ["measure", "value"] and out.count() == 13


def test_knn_with_many_identical_training_points(spark):
    rng = np.random.default_rng(5)
    tr = np.vstack([np.zeros((200, 2)), rng.normal(size=(100, 2))])
    te = rng.normal(size=(20, 2)) * 0.5
    tdf = spark.createDataFrame(pd.DataFrame({"_rid": np.arange(300)[::-1].copy(), "_label": rng.integers(0, 2, 300),
                                              "a": tr[:, 0], "b": tr[:, 1]}))
    qdf = spark.createDataFrame(pd.DataFrame({"_tid": np.arange(20), "a": te[:, 0], "b": te[:, 1]}))
    got = {r["_tid"]: [n["rid"] for n in r["neighbours"]] for r in knn(tdf, qdf, ["a", "b"], 3).collect()}
    rid = np.arange(300)[::-1]
    for i in range(20):
        d = ((tr - te[i]) ** 2).sum(1)
        assert got[i] == [int(rid[j]) for j in np.lexsort((rid, d))[:3]]
