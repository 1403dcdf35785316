"""Wrangling: imputation, row filters, rare-level pooling, binning, date features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from custlens.functions.columns import clean_num
from custlens.plans.common import BROADCAST_ROW_LIMIT, one_row
from custlens.plans.quantiles import exact_quantiles


def impute(df: DataFrame, col: str, strategy: str = "median", name: str | None = None) -> DataFrame:
    """Fill missing (NULL or NaN) values of a numeric column with its exact
    median or mean; the statistic is one aggregated number."""
    if strategy == "median":
        stat = exact_quantiles(df, col, [0.5], names=["_fill"])
    elif strategy == "mean":
        stat = df.agg(F.avg(clean_num(col)).alias("_fill"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = df.crossJoin(F.broadcast(stat))
    return out.withColumn(name or col, F.coalesce(clean_num(col), F.col("_fill"))).drop("_fill")


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of ``cols`` is missing (NULL, or NaN for numbers)."""
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        x = clean_num(c) if types[c] in ("float", "double") else F.col(c)
        cond = cond & x.isNotNull()
    return df.where(cond)


def drop_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows before, rows kept, rows dropped by :func:`drop_missing`."""
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        x = clean_num(c) if types[c] in ("float", "double") else F.col(c)
        cond = cond & x.isNotNull()
    return filter_preview(df, cond).select(
        F.col("total").alias("rows_before"), F.col("kept").alias("rows_kept"),
        (F.col("total") - F.col("kept")).alias("rows_dropped"),
    )


_OPS = {">=": "__ge__", "<=": "__le__", "==": "__eq__", "=": "__eq__", ">": "__gt__", "<": "__lt__"}


def num_condition(col: str, op: str, value: float | Column) -> Column:
    x = clean_num(col)
    v = value if isinstance(value, Column) else F.lit(float(value))
    return getattr(x, _OPS[op])(v) & x.isNotNull()


def filter_num(df: DataFrame, col: str, op: str, value: float | None = None) -> DataFrame:
    """Keep rows with ``col op value``; missing never passes.  Without a value
    the column's exact median is used (joined as a one-row broadcast)."""
    if value is not None:
        return df.where(num_condition(col, op, value))
    med = exact_quantiles(df, col, [0.5], names=["_med"])
    return df.crossJoin(F.broadcast(med)).where(num_condition(col, op, F.col("_med"))).drop("_med")


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep rows whose value is in ``values``; an empty list keeps every row."""
    values = list(values or [])
    return df if not values else df.where(F.col(col).isin(values))


def filter_preview(df: DataFrame, cond: Column) -> DataFrame:
    """One row (kept, total): how many rows a filter would keep."""
    return df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("kept"), F.count(F.lit(1)).alias("total"))


def level_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count"))


def pool_rare(df: DataFrame, col: str, n: int, name: str | None = None, other: str = "Other") -> DataFrame:
    """Replace the ``n`` least frequent levels by ``other`` in ``<col>_reduced``.

    Level counts are a (levels x 2) table; ties in frequency are broken by the
    level value.  The chosen levels ride to the rows as a broadcast up to
    ``BROADCAST_ROW_LIMIT`` of them, beyond by a plain join.  NULL stays NULL.
    """
    counts = level_counts(df, col)
    rare = counts.orderBy(F.col("count").asc(), F.col(col).asc()).limit(int(n)).select(
        F.col(col).alias("_rare_level")
    )
    if int(n) <= BROADCAST_ROW_LIMIT:
        rare = F.broadcast(rare)
    j = df.join(rare, F.col(col) == F.col("_rare_level"), "left")
    new = F.when(F.col(col).isNull(), F.lit(None).cast("string")).when(
        F.col("_rare_level").isNotNull(), F.lit(other)
    ).otherwise(F.col(col).cast("string"))
    return j.withColumn(name or f"{col}_reduced", new).drop("_rare_level")


# ---------------------------------------------------------------- binning
def _round_frac(x: float, precision: int) -> float:
    if not np.isfinite(x) or x == 0:
        return float(x)
    frac, whole = np.modf(x)
    digits = -int(np.floor(np.log10(abs(frac)))) - 1 + precision if whole == 0 else precision
    return float(np.around(x, digits))


def equal_width_edges(lo: float, hi: float, n: int, precision: int = 3) -> tuple[list[float], list[str]]:
    """Edges and right-closed labels of ``n`` equal-width bins over [lo, hi].

    The lowest edge is lowered by 0.1 % of the range so the minimum falls in
    the first bin; a constant column is widened by 0.1 % on both sides.
    Label numbers are rounded to ``precision`` digits (more if needed to keep
    the labels distinct)."""
    if lo == hi:
        lo, hi = (lo - 0.001 * abs(lo), hi + 0.001 * abs(hi)) if lo != 0 else (-0.001, 0.001)
        edges = np.linspace(lo, hi, n + 1)
    else:
        edges = np.linspace(lo, hi, n + 1)
        edges[0] -= (hi - lo) * 0.001
    prec = precision
    while prec < 20 and len({_round_frac(e, prec) for e in edges}) < len(edges):
        prec += 1
    shown = [_round_frac(e, prec) for e in edges]
    labels = [f"({shown[i]}, {shown[i + 1]}]" for i in range(n)]
    return [float(e) for e in edges], labels


def _bin_number(inner: np.ndarray):
    """1 + how many inner edges lie below a value."""
    @F.pandas_udf("int")
    def number(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(inner, v.to_numpy(float), side="left").astype(np.int32) + 1)

    return number


def bin_equal_width(df: DataFrame, col: str, n: int, name: str | None = None) -> DataFrame:
    """Append ``<col>_group`` (label), ``<col>_bin`` (1..n), ``<col>_lo`` and
    ``<col>_hi``.  Missing values stay missing.

    Only the global min/max (one aggregated row) reaches the driver, where the
    n+1 edges and labels are made; rows are then assigned with literal edge
    comparisons inside codegen, or for more than 200 bins by binary search in
    Arrow batches."""
    if n < 2:
        raise ValueError("n must be at least 2")
    x = clean_num(col)
    mm = one_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
    name = name or f"{col}_group"
    if mm["lo"] is None:
        return df.withColumns({name: F.lit(None).cast("string"), f"{col}_bin": F.lit(None).cast("int"),
                               f"{col}_lo": F.lit(None).cast("double"), f"{col}_hi": F.lit(None).cast("double")})
    edges, labels = equal_width_edges(mm["lo"], mm["hi"], n)
    if n <= 200:
        b = F.lit(1)
        for e in edges[1:-1]:
            b = b + F.when(x > F.lit(e), 1).otherwise(0)
    else:
        b = _bin_number(np.array(edges[1:-1]))(x)
    b = F.when(x.isNotNull(), b)
    # element_at is guarded: with a NULL index it must give NULL
    lab = F.when(b.isNotNull(), F.element_at(F.array(*[F.lit(s) for s in labels]), b))
    lo = F.when(b.isNotNull(), F.element_at(F.array(*[F.lit(e) for e in edges[:-1]]), b))
    hi = F.when(b.isNotNull(), F.element_at(F.array(*[F.lit(e) for e in edges[1:]]), b))
    return df.withColumns({name: lab, f"{col}_bin": b.cast("int"), f"{col}_lo": lo, f"{col}_hi": hi})


# ---------------------------------------------------------------- dates
DATE_OPS = ("season", "month", "quarter", "year", "dayofweek", "weekend", "days_since", "months_since",
            "holiday_season")


def as_date(df: DataFrame, col: str) -> Column:
    """Date value of a column; strings are parsed leniently (bad values -> NULL)."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, StringType):
        return F.to_date(F.try_to_timestamp(c))
    return F.to_date(c)


def date_features(
    df: DataFrame, col: str, ops: Sequence[str] = DATE_OPS, as_of: str | None = None, null_flag_as_zero: bool = False
) -> DataFrame:
    """Append calendar features of a date column as ``<col>_<op>`` columns.

    ``as_of`` (a date string) is required for the recency features so results
    repeat; the original uses the server clock."""
    d = as_date(df, col)
    m = F.month(d)
    zero = (lambda e: F.coalesce(e, F.lit(0))) if null_flag_as_zero else (lambda e: e)
    # fixed values: month -> season mapping
    season = (
        F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall")
    )
    days = F.datediff(F.to_date(F.lit(as_of)), d) if as_of else None
    out = {}
    for op in ops:
        if op == "season":
            out[f"{col}_season"] = season
        elif op == "month":
            out[f"{col}_month"] = F.date_format(d, "MMMM")
        elif op == "quarter":
            out[f"{col}_quarter"] = F.concat(F.lit("Q"), F.quarter(d).cast("string"))
        elif op == "year":
            out[f"{col}_year"] = F.year(d)
        elif op == "dayofweek":
            out[f"{col}_dayofweek"] = F.date_format(d, "EEEE")
        elif op == "weekend":
            out[f"{col}_weekend"] = zero(F.when(d.isNotNull(), (F.weekday(d) >= 5).cast("int")))
        elif op == "holiday_season":
            out[f"{col}_holiday_season"] = zero(F.when(d.isNotNull(), m.isin(11, 12).cast("int")))
        elif op in ("days_since", "months_since"):
            if days is None:
                raise ValueError("as_of is required for recency features")
            out[f"{col}_{op}"] = days if op == "days_since" else F.bround(days / 30.44, 1)
        else:
            raise ValueError(f"unknown date feature {op!r}")
    return df.withColumns(out)
