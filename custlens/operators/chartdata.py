"""The aggregated tables behind charts: frequencies, histograms, contingency
tables, scatter points and monthly series.  Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num, hash_unit, skew_g1
from custlens.plans.common import one_row


def frequency(df: DataFrame, col: str, sort: str = "count") -> DataFrame:
    """(col, count, share) per non-missing level; share of the non-missing total.

    The total is a one-row aggregate broadcast to the level table (no
    unpartitioned window).  Ordered by count (desc, then level) or by level.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_tot"))
    out = counts.crossJoin(F.broadcast(total)).select(
        col, "count", (F.col("count") / F.col("_tot")).alias("share")
    )
    return out.orderBy(F.desc("count"), F.asc(col)) if sort == "count" else out.orderBy(col)


def _edges(lo: float, hi: float, bins: int) -> np.ndarray:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return np.linspace(lo, hi, bins + 1)


def histogram(df: DataFrame, cols: str | Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram(s): (column, bin, lo, hi, count), empty bins kept.

    Bins are half-open [lo, hi) except the last, closed on the right.  Several
    columns are stacked into (column, value) first and counted in one
    ``groupBy``.  Only per-column min/max (one row) reach the driver."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    mm = one_row(df.agg(*[F.min(clean_num(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                        *[F.max(clean_num(c)).alias(f"hi{i}") for i, c in enumerate(cols)]))
    parts, grid = [], []
    for i, c in enumerate(cols):
        if mm[f"lo{i}"] is None:
            continue
        e = _edges(mm[f"lo{i}"], mm[f"hi{i}"], bins)
        x = clean_num(c)
        b = F.lit(0)
        for edge in e[1:-1]:
            b = b + F.when(x >= F.lit(float(edge)), 1).otherwise(0)
        parts.append(F.struct(F.lit(c).alias("column"), F.when(x.isNotNull(), b + 1).alias("bin")))
        grid += [(c, k + 1, float(e[k]), float(e[k + 1])) for k in range(bins)]
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    stacked = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(F.col("bin").isNotNull())
    counts = stacked.groupBy("column", "bin").agg(F.count("*").alias("count"))
    # the bin grid is bins x columns rows, built from the collected edges
    g = df.sparkSession.createDataFrame(grid, "column string, bin int, lo double, hi double")
    return g.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def skew_label(df: DataFrame, col: str) -> DataFrame:
    """One row (skewness, label): >0.5 right-skewed, <-0.5 left-skewed."""
    s = df.agg(skew_g1(col).alias("skewness"))
    # fixed values: skew label cut points
    lab = (F.when(F.col("skewness") > 0.5, "right-skewed").when(F.col("skewness") < -0.5, "left-skewed")
           .when(F.col("skewness").isNotNull(), "roughly symmetric"))
    return s.withColumn("label", lab)


def crosstab(df: DataFrame, a: str, b: str, normalize: str | None = None) -> DataFrame:
    """Contingency table in long form (a, b, count[, row_pct]); missing levels
    are left out, zero cells are present.

    Rows are counted per cell first; the table's frame, every ``a`` level with
    every ``b`` level, comes from the two level lists and has exactly the rows
    of the result.  ``normalize='row'`` adds the percentage within each ``a``
    level."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("_c"))
    frame = cells.select(a).distinct().crossJoin(cells.select(b).distinct())
    long = frame.join(cells, [a, b], "left").select(a, b, F.coalesce("_c", F.lit(0)).cast("bigint").alias("count"))
    if normalize == "row":
        tot = long.groupBy(a).agg(F.sum("count").alias("_rt"))
        long = long.join(tot, a).withColumn("row_pct", F.col("count") / F.col("_rt") * 100.0).drop("_rt")
    elif normalize is not None:
        raise ValueError("normalize must be None or 'row'")
    return long


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None, key: str | None = None,
                   fraction: float | None = None, seed: int = 42) -> DataFrame:
    """(x, y[, color]) pairs with both coordinates present (and a present
    colour group).  ``fraction`` keeps a deterministic hash sample of rows
    identified by ``key``, for plotting very large tables."""
    cols = [F.col(x), F.col(y)] + ([F.col(color)] if color else [])
    out = df.where(clean_num(x).isNotNull() & clean_num(y).isNotNull())
    if color:
        out = out.where(F.col(color).isNotNull())
    if fraction is not None:
        if key is None:
            raise ValueError("a key column is needed for a reproducible sample")
        out = out.where(hash_unit(key, seed) < fraction)
    return out.select(*cols)


def monthly_series(df: DataFrame, date: str, value: str | None = None, keep_missing: bool = False) -> DataFrame:
    """(month 'yyyy-MM', n[, total]) in time order; rows without a date are a
    NULL month that is dropped unless ``keep_missing``."""
    from custlens.operators.wrangle import as_date

    m = F.date_format(as_date(df, date), "yyyy-MM").alias("month")
    aggs = [F.count("*").alias("n")]
    if value:
        aggs.append(F.sum(clean_num(value)).alias("total"))
    out = df.groupBy(m).agg(*aggs)
    if not keep_missing:
        out = out.where(F.col("month").isNotNull())
    return out.orderBy("month")
