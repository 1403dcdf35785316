"""Deterministic hash splits and folds.

A row's score is a pure function of its key and a seed (first 8 hex digits of
md5(key ':' seed) over 2^32), so a split is reproducible across task retries,
executor loss and engines - unlike ``randomSplit``, which depends on the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import hash_unit
from custlens.plans.common import attach


def split_flag(key: str, frac: float = 0.7, seed: int = 42) -> Column:
    """True for training rows (score below ``frac``)."""
    return hash_unit(key, seed) < F.lit(float(frac))


def fold_id(key: str, k: int = 5, seed: int = 42) -> Column:
    """Fold number 0..k-1."""
    return F.least(F.floor(hash_unit(key, seed) * k), F.lit(k - 1)).cast("int")


def stratified_flag(df: DataFrame, key: str, label: str, frac: float = 0.7, seed: int = 42) -> DataFrame:
    """Append ``_train``: per class, the rows whose hash score is within the
    class's lowest ``frac`` share.  The per-class cut is an exact quantile of
    the scores (one small row per class), so every class keeps its share."""
    from custlens.plans.quantiles import exact_quantiles

    scored = df.withColumn("_score", hash_unit(key, seed))
    cuts = exact_quantiles(scored, "_score", [frac], [label], names=["_cut"])
    j = attach(scored, cuts, [label], "left")
    return j.withColumn("_train", F.col("_score") <= F.col("_cut")).drop("_score", "_cut")
