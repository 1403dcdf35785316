"""Summary measures, box statistics, outliers and derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num, kurt_g2, skew_g1
from custlens.plans.common import attach
from custlens.plans.quantiles import exact_quantiles, mode_of_counts
from custlens.plans.ranks import average_rank

# fixed values: measure names and their order in the summary table
MEASURES = [
    "count", "mean", "median", "mode", "p25", "p75", "range", "mean_abs_dev",
    "variance", "std_dev", "coef_variation", "skewness", "kurtosis",
]


def _moments(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    x = clean_num(col)
    return df.groupBy(*keys).agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std_dev"),
        skew_g1(col).alias("skewness"),
        kurt_g2(col).alias("kurtosis"),
    )


def summary_wide(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """All summary measures of ``col`` as one row per group (wide form)."""
    keys = list(by)
    mom = _moments(df, col, keys).persist()  # one row per group
    rows = df.select(*keys, clean_num(col).alias("_x")).where(F.col("_x").isNotNull())
    q = exact_quantiles(rows, "_x", [0.5, 0.25, 0.75], keys, names=["median", "p25", "p75"])
    mode = mode_of_counts(rows.groupBy(*keys, "_x").agg(F.count("*").alias("_cnt")), "_x", keys)
    mad = attach(rows, mom.select(*keys, F.col("mean").alias("_mean")), keys).groupBy(*keys).agg(
        F.avg(F.abs(F.col("_x") - F.col("_mean"))).alias("mean_abs_dev"))
    joined = mom
    for part in (q, mode, mad):
        joined = joined.join(part, keys, "left") if keys else joined.join(part, F.lit(True), "left")
    return joined.select(
        *keys,
        F.col("count").cast("double").alias("count"),
        "mean", "median", "mode", "p25", "p75",
        (F.col("max") - F.col("min")).alias("range"),
        "mean_abs_dev", "variance", "std_dev",
        F.try_divide(F.col("std_dev"), F.when(F.col("mean") != 0, F.col("mean"))).alias("coef_variation"),
        "skewness", "kurtosis",
    )


def summary_measures(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """The 13 summary measures as (``by``..., measure, value) rows."""
    keys = list(by)
    wide = summary_wide(df, col, keys)
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in MEASURES)
    return wide.select(*keys, F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, value)"))


def fences(df: DataFrame, col: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Quartiles and Tukey fences q1 - k*IQR, q3 + k*IQR per group."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], by, names=["q1", "median", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *by, "q1", "median", "q3", iqr.alias("iqr"),
        (F.col("q1") - k * iqr).alias("lower_fence"), (F.col("q3") + k * iqr).alias("upper_fence"),
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Boxplot numbers: quartiles, whiskers (furthest points inside the fences),
    number of points outside, per group."""
    keys = list(by)
    # one row per group, used twice below: cached so the quantile plan runs once
    f = fences(df, col, keys).cache()
    rows = df.select(*keys, clean_num(col).alias("_x")).where(F.col("_x").isNotNull())
    inside = F.col("_x").between(F.col("lower_fence"), F.col("upper_fence"))
    w = attach(rows, f, keys).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return f.join(w, keys, "inner") if keys else f.crossJoin(w)


def outliers(df: DataFrame, col: str, method: str = "iqr", cut: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows flagged as outliers: IQR rule (outside the Tukey fences) or |z| > cut
    (sample sd), within ``by`` groups.  Missing values never qualify.
    Order/limit is the caller's."""
    x, keys = clean_num(col), list(by)
    if method == "iqr":
        f = fences(df, col, keys).select(*keys, "lower_fence", "upper_fence")
        j = attach(df, f, keys)
        return j.where((x < F.col("lower_fence")) | (x > F.col("upper_fence"))).drop("lower_fence", "upper_fence")
    if method == "z":
        s = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
        j = attach(df, s, keys)
        return j.where(F.abs((x - F.col("_m")) / F.col("_s")) > cut).drop("_m", "_s")
    raise ValueError(f"unknown method {method!r}")


def outlier_counts(df: DataFrame, col: str, cut: float = 3.0) -> DataFrame:
    """One row: IQR-rule count, |z|>cut count and both fences."""
    x = clean_num(col)
    f = fences(df, col).select("lower_fence", "upper_fence")
    s = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    j = df.select(x.alias("_x")).crossJoin(F.broadcast(f.crossJoin(s)))
    return j.groupBy("lower_fence", "upper_fence").agg(
        F.count_if((F.col("_x") < F.col("lower_fence")) | (F.col("_x") > F.col("upper_fence"))).alias("n_iqr"),
        F.count_if(F.abs((F.col("_x") - F.col("_m")) / F.col("_s")) > cut).alias("n_z"),
    )


def add_zscore(df: DataFrame, col: str, ddof: int = 1, name: str | None = None) -> DataFrame:
    """Append ``<col>_z`` = (x - mean) / sd; NULL for a constant column."""
    return standardize(df, [col], ddof=ddof, names=[name or f"{col}_z"])


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 1, names: Sequence[str] | None = None) -> DataFrame:
    """Z-scores of many columns from one aggregate pass (sample sd by default,
    ``ddof=0`` for the population sd used before distance-based models)."""
    names = list(names or [f"{c}_z" for c in cols])
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(clean_num(c)).alias(f"_m{i}"), sd(clean_num(c)).alias(f"_s{i}")]
    stats = df.agg(*aggs)
    j = df.crossJoin(F.broadcast(stats))
    new = {
        n: (clean_num(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") != 0, F.col(f"_s{i}"))
        for i, (c, n) in enumerate(zip(cols, names))
    }
    return j.withColumns(new).drop(*[f"_{p}{i}" for i in range(len(cols)) for p in "ms"])


def add_outlier_flag(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Append ``<col>_outlier`` = 1 outside the Tukey fences else 0 (missing -> 0)."""
    x = clean_num(col)
    f = fences(df, col).select("lower_fence", "upper_fence")
    j = df.crossJoin(F.broadcast(f))
    flag = F.when((x < F.col("lower_fence")) | (x > F.col("upper_fence")), 1).otherwise(0)
    return j.withColumn(name or f"{col}_outlier", flag).drop("lower_fence", "upper_fence")


def add_percentile_rank(df: DataFrame, col: str, decimals: int | None = 1, name: str | None = None) -> DataFrame:
    """Append ``<col>_pctile`` = average rank / non-missing count * 100.

    Ties share their average rank (not ``percent_rank``, which starts at 0);
    rounding is half-to-even at ``decimals`` (None = unrounded).
    """
    ranked = average_rank(df, col, "_avg_rank")
    n = df.agg(F.count(clean_num(col)).alias("_nn"))
    pct = F.col("_avg_rank") / F.col("_nn") * 100.0
    if decimals is not None:
        pct = F.bround(pct, decimals)
    return ranked.crossJoin(F.broadcast(n)).withColumn(name or f"{col}_pctile", pct).drop("_avg_rank", "_nn")


def scale_report(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """Mean, sd, min, max of each column before and after z-scoring:
    (column, stage, mean, sd, min, max)."""
    z = standardize(df.select(*cols), cols, ddof=ddof)
    parts = []
    for c in cols:
        for stage, src in (("before", c), ("after", f"{c}_z")):
            x = clean_num(src)
            parts.append(F.struct(
                F.lit(c).alias("column"), F.lit(stage).alias("stage"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
            ))
    return z.agg(F.array(*parts).alias("_r")).select(F.explode("_r").alias("r")).select("r.*")
