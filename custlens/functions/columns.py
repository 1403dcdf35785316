"""Reusable Column expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_num(c: str | Column) -> Column:
    """Cast to double and treat NaN as missing (NULL), like pandas ``isna``."""
    x = col_of(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def clean_value(df: DataFrame, c: str) -> Column:
    """The column in its own type, NaN as missing: whole numbers and decimals
    keep all their digits; other types are read as doubles."""
    kind = dict(df.dtypes)[c]
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.col(f"`{c}`")
    return clean_num(c)


def skew_g1(c: str | Column) -> Column:
    """Bias-corrected sample skewness G1 (aggregate). NULL when n < 3."""
    x = clean_num(c)
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(c: str | Column) -> Column:
    """Bias-corrected sample excess kurtosis G2 (aggregate). NULL when n < 4."""
    x = clean_num(c)
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def strength_label(r: str | Column) -> Column:
    """Verbal strength of a correlation coefficient."""
    a = F.abs(col_of(r))
    # fixed values: cut points and labels of the strength scale
    return (
        F.when(a.isNull(), F.lit(None).cast("string"))
        .when(a < 0.1, "very weak / none")
        .when(a < 0.3, "weak")
        .when(a < 0.7, "moderate")
        .otherwise("strong")
    )


def direction_label(r: str | Column) -> Column:
    x = col_of(r)
    return F.when(x >= 0, "positive").when(x < 0, "negative")


def hash_unit(key: str | Column, seed: int = 42) -> Column:
    """Deterministic uniform score in [0, 1) from a row key and a seed.

    First 8 hex digits of md5(key ':' seed) over 2^32; the same value is
    reproducible in any SQL engine with md5, so splits survive task retries.
    """
    k = col_of(key).cast("string")
    h = F.conv(F.substring(F.md5(F.concat(k, F.lit(f":{seed}"))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)
