"""Image colour statistics: loading, pixel tables, brightness, colourfulness,
dominant colours and a batch summary.

Spark's ``image`` source decodes the files (no codec is written here); each
image becomes at most grid x grid pixel rows, so every per-image group is
bounded however large the original file is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL_SCHEMA = "image string, r double, g double, b double"


def load_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(image, height, width, channels, mode, data, status); unreadable files
    stay in the table with status 'unreadable' (height -1) so a batch goes on."""
    df = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive).load(path)
    return df.select(
        F.col("image.origin").alias("image"), F.col("image.height").alias("height"),
        F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
        F.col("image.mode").alias("mode"), F.col("image.data").alias("data"),
        F.when(F.col("image.height") > 0, "ok").otherwise("unreadable").alias("status"),
    )


def _to_rgb(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    arr = np.frombuffer(data, dtype=np.uint8)[: h * w * c].reshape(h, w, c)
    if c == 1:
        return np.repeat(arr, 3, axis=2)
    return arr[:, :, [2, 1, 0]]  # the image source stores BGR(A)


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with slope -1/2 at 1."""
    x = np.abs(x)
    near = 1.5 * x ** 3 - 2.5 * x ** 2 + 1
    far = -0.5 * x ** 3 + 2.5 * x ** 2 - 4 * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _resample_weights(size: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell the places of its neighbours (cells x k) and their weights,
    which add up to 1.  When an axis shrinks the kernel widens with it, so
    every pixel counts; beyond the border there is nothing."""
    step = size / grid
    wide = max(step, 1.0)
    centre = (np.arange(grid) + 0.5) * step
    first = np.floor(centre - 2 * wide + 0.5).astype(int)
    at = first[:, None] + np.arange(int(np.ceil(4 * wide)) + 1)
    weights = _cubic((at + 0.5 - centre[:, None]) / wide) * ((at >= 0) & (at < size))
    return np.clip(at, 0, size - 1), weights / weights.sum(axis=1, keepdims=True)


def _whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255)


def _resize(rgb: np.ndarray, grid: int) -> np.ndarray:
    """grid x grid pixels by cubic convolution, columns first, each pass
    rounded to whole colour values; rows are taken in turn, so a large image
    needs little more than itself."""
    h, w, _ = rgb.shape
    at, weights = _resample_weights(w, grid)
    narrow = np.stack([_whole(np.einsum("gk,gkc->gc", weights, row[at])) for row in rgb])
    at, weights = _resample_weights(h, grid)
    return np.stack([_whole(np.einsum("k,kgc->gc", weights[i], narrow[at[i]])) for i in range(grid)])


def _resize_nearest(rgb: np.ndarray, grid: int) -> np.ndarray:
    h, w, _ = rgb.shape
    rows = np.minimum(((np.arange(grid) + 0.5) * h / grid).astype(int), h - 1)
    cols = np.minimum(((np.arange(grid) + 0.5) * w / grid).astype(int), w - 1)
    return rgb[rows][:, cols].astype(float)


_RESAMPLE = {"nearest": _resize_nearest, "cubic": _resize}


def pixels(images: DataFrame, grid: int = 120, resample: str = "nearest") -> DataFrame:
    """(image, r, g, b) with each readable image resampled to grid x grid
    (Arrow batches through ``mapInPandas``): by ``nearest`` cell, which keeps
    colours as they are, or smoothly by ``cubic`` convolution; an image of
    exactly that size keeps its pixels."""
    resize = _RESAMPLE[resample]

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.height is None or row.height <= 0:
                    continue
                px = resize(_to_rgb(row.data, row.height, row.width, row.channels), grid).reshape(-1, 3)
                yield pd.DataFrame({"image": row.image, "r": px[:, 0], "g": px[:, 1], "b": px[:, 2]})

    ok = images.where(F.col("status") == "ok").select("image", "height", "width", "channels", "data")
    return ok.mapInPandas(expand, PIXEL_SCHEMA)


def image_stats(px: DataFrame) -> DataFrame:
    """(image, n_pixels, brightness, colorfulness) per image.

    Brightness is the mean of (r+g+b)/3; colourfulness (Hasler and
    Suesstrunk 2003) is sqrt(var(rg) + var(yb)) + 0.3 sqrt(mean(rg)^2 +
    mean(yb)^2) with rg = r - g, yb = (r + g)/2 - b and population variances."""
    rg = F.col("r") - F.col("g")
    yb = 0.5 * (F.col("r") + F.col("g")) - F.col("b")
    agg = px.groupBy("image").agg(
        F.count("*").alias("n_pixels"),
        F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("brightness"),
        F.var_pop(rg).alias("_vrg"), F.var_pop(yb).alias("_vyb"), F.avg(rg).alias("_mrg"), F.avg(yb).alias("_myb"),
    )
    col = F.sqrt(F.col("_vrg") + F.col("_vyb")) + 0.3 * F.sqrt(F.col("_mrg") ** 2 + F.col("_myb") ** 2)
    return agg.select("image", "n_pixels", "brightness", col.alias("colorfulness"))


def _kmeans_pp(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = [x[rng.integers(len(x))]]
    d2 = ((x - centers[0]) ** 2).sum(1)
    for _ in range(1, k):
        tot = d2.sum()
        idx = rng.integers(len(x)) if tot <= 0 else rng.choice(len(x), p=d2 / tot)
        centers.append(x[idx])
        d2 = np.minimum(d2, ((x - x[idx]) ** 2).sum(1))
    return np.array(centers)


def _lloyd(x: np.ndarray, k: int, seed: int, n_init: int = 4, max_iter: int = 300, tol: float = 1e-4):
    rng = np.random.default_rng(seed)
    best = None
    scale = np.mean(np.var(x, axis=0)) or 1.0
    for _ in range(n_init):
        c = _kmeans_pp(x, k, rng)
        for _ in range(max_iter):
            lab = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1).argmin(1)
            new = np.array([x[lab == j].mean(0) if np.any(lab == j) else c[j] for j in range(k)])
            shift = ((new - c) ** 2).sum()
            c = new
            if shift <= tol * scale:
                break
        lab = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1).argmin(1)
        inertia = float(((x - c[lab]) ** 2).sum())
        if best is None or inertia < best[0]:
            best = (inertia, c, lab)
    return best[1], best[2]


def dominant_colors(px: DataFrame, k: int = 5, seed: int = 42, n_init: int = 4) -> DataFrame:
    """(image, rank, r, g, b, share, hex) - k-means colours of each image,
    ordered by pixel share.  One image per ``applyInPandas`` group (a group
    holds at most grid^2 pixel rows)."""

    def per_image(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[["r", "g", "b"]].to_numpy(float)
        kk = min(k, len(np.unique(x, axis=0)))
        c, lab = _lloyd(x, kk, seed, n_init)
        shares = np.bincount(lab, minlength=kk) / len(lab)
        order = np.argsort(-shares, kind="stable")
        ci = c.astype(int)
        return pd.DataFrame({
            "image": pdf["image"].iloc[0], "rank": np.arange(1, kk + 1),
            "r": ci[order, 0], "g": ci[order, 1], "b": ci[order, 2], "share": shares[order],
            "hex": ["#%02x%02x%02x" % tuple(ci[j]) for j in order],
        })

    return px.groupBy("image").applyInPandas(
        per_image, "image string, rank int, r int, g int, b int, share double, hex string")


def batch_summary(stats: DataFrame) -> DataFrame:
    """One row: number of images, mean and sample sd of brightness and
    colourfulness."""
    return stats.agg(
        F.count("*").alias("n_images"),
        F.avg("brightness").alias("brightness_mean"), F.stddev_samp("brightness").alias("brightness_sd"),
        F.avg("colorfulness").alias("colorfulness_mean"), F.stddev_samp("colorfulness").alias("colorfulness_sd"),
    )
