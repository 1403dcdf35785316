"""Extended stems, cubic resampling and the pair signs of Kendall's grid."""

import math

import numpy as np
import pytest

from custlens.functions.porter import stem
from custlens.operators import images as I
from custlens.operators import text as T
from custlens.plans import ranks


def test_extended_stems():
    pairs = {"skies": "sky", "sky": "sky", "dying": "die", "news": "news", "innings": "inning", "proceed": "proceed",
             "dies": "die", "ties": "tie", "tied": "tie", "flies": "fli", "spied": "spi", "cried": "cri",
             "enjoy": "enjoy", "say": "say", "by": "by", "happy": "happi", "owed": "owe", "geology": "geolog",
             "possibly": "possibl", "generally": "gener", "hopefully": "hope", "caresses": "caress", "hopping": "hop",
             "filing": "file", "relational": "relat", "oscillators": "oscil", "": "", "a": "a", "SKIES": "sky"}
    assert {w: stem(w, extended=True) for w in pairs} == pairs
    assert {w: stem(w) for w in ("ties", "enjoy", "geology")} == {"ties": "ti", "enjoy": "enjoi", "geology": "geologi"}


def test_counts_by_either_stem(spark):
    docs = spark.createDataFrame([("skies sky geology",), (None,), ("",)], "text string")
    count = lambda **kw: {r["word"]: r["count"] for r in T.word_counts(docs, "text", **kw).collect()}
    assert count() == {"sky": 2, "geolog": 1}
    assert count(extended=False) == {"ski": 1, "sky": 1, "geologi": 1}


def _plain_resize(rgb, grid):
    def kernel(x):
        x = abs(x)
        return 1.5 * x ** 3 - 2.5 * x ** 2 + 1 if x < 1 else -0.5 * x ** 3 + 2.5 * x ** 2 - 4 * x + 2 if x < 2 else 0.0

    def line(values):
        out, step = [], len(values) / grid
        for i in range(grid):
            c, wide = (i + 0.5) * step, max(step, 1.0)
            ws = [kernel((j + 0.5 - c) / wide) for j in range(len(values))]
            v = sum(w * x for w, x in zip(ws, values)) / sum(ws)
            out.append(min(255, max(0, math.floor(v + 0.5 + 1e-9))))
        return out

    h, w, _ = rgb.shape
    narrow = np.array([[line(rgb[y, :, c]) for c in range(3)] for y in range(h)]).transpose(0, 2, 1)
    return np.array([[line(narrow[:, x, c]) for c in range(3)] for x in range(grid)]).transpose(2, 0, 1)


@pytest.mark.parametrize("h,w,grid", [(7, 5, 12), (40, 31, 6), (1, 1, 4), (9, 30, 9), (300, 3, 2)])
def test_resize_equals_the_plain_sum(h, w, grid):
    rgb = np.random.default_rng(h * w).integers(0, 256, (h, w, 3)).astype(np.uint8)
    got = I._resize(rgb, grid)
    assert got.shape == (grid, grid, 3)
    assert np.abs(got - _plain_resize(rgb.astype(float), grid)).max() <= 1  # halves may round either way
    assert (np.abs(got - _plain_resize(rgb.astype(float), grid)) > 0).mean() < 0.02


def test_resize_keeps_its_own_size_and_even_colour():
    rgb = np.random.default_rng(1).integers(0, 256, (12, 12, 3)).astype(np.uint8)
    assert (I._resize(rgb, 12) == rgb).all()
    assert (I._resize(np.full((500, 33, 3), 77, np.uint8), 120) == 77).all()


@pytest.mark.parametrize("sides,rows", [(1, 1), (2, 3), (9, 40), (64, 500), (100, 0)])
def test_grid_signs_equal_all_pairs(spark, sides, rows):
    rnd = np.random.default_rng(sides)
    cells = {(int(x), int(y)): float(rnd.integers(1, 9)) for x, y in rnd.integers(0, sides, (rows, 2))}
    df = spark.createDataFrame([(x, y, g) for (x, y), g in cells.items()], "_bx int, _by int, g double")
    items = list(cells.items())
    want = sum(g * h * np.sign(x - u) * np.sign(y - v) for i, ((x, y), g) in enumerate(items)
               for (u, v), h in items[:i])
    assert (ranks._grid_sign_sum(df, sides).collect()[0]["s"] or 0.0) == pytest.approx(want)


def test_resized_image_query(spark):
    import __spark_entry__ as entry

    got = entry.q_image_resized_stats(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r["n_pixels"] == 14_400 and 0 <= r["brightness"] <= 255 for r in got)
