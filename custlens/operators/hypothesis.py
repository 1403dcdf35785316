"""t-tests and the chi-square test of independence.

Statistics are single-pass aggregates; p-values are finished on those few
numbers with :mod:`custlens.functions.dist`.  All tests are two-sided.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions import dist
from custlens.functions.columns import clean_num
from custlens.plans.common import judged, one_row, stat_frame
from custlens.plans.quantiles import exact_quantiles

ALPHA = 0.05


def _frame(df: DataFrame, row: dict, schema: str) -> DataFrame:
    return stat_frame(df.sparkSession, [[row[k.split()[0]] for k in schema.split(", ")]], schema)


def ttest_1samp(df: DataFrame, col: str, mu: float | None = None) -> DataFrame:
    """One-sample t-test of the mean against ``mu`` (default: the exact median).

    One row (n, mean, mu, t, df, p, significant); what is undefined (no or one
    value, no spread) is NULL."""
    x = clean_num(col)
    st = one_row(df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")))
    if mu is None:
        found = exact_quantiles(df, col, [0.5], names=["m"]).collect()  # no row without values
        mu = found[0]["m"] if found else math.nan
    n, mean, sd = st["n"], st["mean"], st["sd"]
    t = (mean - mu) / (sd / math.sqrt(n)) if n and n > 1 and sd else math.nan
    p = dist.t_two_sided(t, n - 1) if not math.isnan(t) else math.nan
    row = dict(n=n, mean=mean, mu=float(mu), t=t, df=float(n - 1) if n else math.nan, p=p, significant=judged(p, ALPHA))
    return _frame(df, row, "n bigint, mean double, mu double, t double, df double, p double, significant boolean")


def _welch(n1, m1, v1, n2, m2, v2):
    if min(n1, n2) < 2:  # a group of one row has no variance
        return math.nan, math.nan
    se2 = v1 / n1 + v2 / n2
    t = (m1 - m2) / math.sqrt(se2) if se2 > 0 else math.nan
    dof = se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if se2 > 0 else math.nan
    return t, dof


def ttest_welch(df: DataFrame, col: str, group: str, a, b) -> DataFrame:
    """Welch two-sample t-test of ``col`` between group levels ``a`` and ``b``.

    One ``groupBy`` over the two levels; one row (group_a, group_b, n_a, n_b,
    mean_a, mean_b, t, df, p, significant)."""
    x = clean_num(col)
    rows = (df.where(F.col(group).isin([a, b]) & x.isNotNull())
            .groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).collect())
    g = {r[group]: r for r in rows}
    if a not in g or b not in g:
        raise ValueError("both groups need values")
    ra, rb = g[a], g[b]
    t, dof = _welch(ra["n"], ra["m"], ra["v"] or 0.0, rb["n"], rb["m"], rb["v"] or 0.0)
    p = dist.t_two_sided(t, dof) if not math.isnan(t) else math.nan
    row = dict(group_a=str(a), group_b=str(b), n_a=ra["n"], n_b=rb["n"], mean_a=ra["m"], mean_b=rb["m"],
               t=t, df=dof, p=p, significant=judged(p, ALPHA))
    return _frame(df, row, "group_a string, group_b string, n_a bigint, n_b bigint, mean_a double, mean_b double, "
                           "t double, df double, p double, significant boolean")


def ttest_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t-test on rows with both values.  ``t`` is of a - b; ``mean_change``
    is b - a.  One row (n, mean_a, mean_b, mean_change, t, df, p, significant);
    what is undefined is NULL."""
    xa, xb = clean_num(a), clean_num(b)
    both = df.where(xa.isNotNull() & xb.isNotNull())
    st = one_row(both.agg(F.count("*").alias("n"), F.avg(xa).alias("ma"), F.avg(xb).alias("mb"),
                          F.avg(xa - xb).alias("md"), F.stddev_samp(xa - xb).alias("sd")))
    n = st["n"]
    t = st["md"] / (st["sd"] / math.sqrt(n)) if n and n > 1 and st["sd"] else math.nan
    p = dist.t_two_sided(t, n - 1) if not math.isnan(t) else math.nan
    row = dict(n=n, mean_a=st["ma"], mean_b=st["mb"], mean_change=(st["mb"] - st["ma"]) if n else None,
               t=t, df=float(n - 1) if n else math.nan, p=p, significant=judged(p, ALPHA))
    return _frame(df, row, "n bigint, mean_a double, mean_b double, mean_change double, t double, df double, "
                           "p double, significant boolean")


def chi2_expected(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Cell table (a, b, observed, expected, contribution) with zero cells.

    Row and column totals are small (levels) tables joined to the cell table;
    ``contribution`` includes the continuity correction when dof = 1."""
    from custlens.operators.chartdata import crosstab

    cells = crosstab(df, a, b)
    rt = cells.groupBy(a).agg(F.sum("count").alias("_rt"))
    ct = cells.groupBy(b).agg(F.sum("count").alias("_ct"))
    tot = cells.agg(F.sum("count").alias("_n"), F.countDistinct(a).alias("_r"), F.countDistinct(b).alias("_c"))
    j = cells.join(rt, a).join(ct, b).crossJoin(F.broadcast(tot))
    e = F.col("_rt") * F.col("_ct") / F.col("_n")
    o = F.col("count").cast("double")
    diff = F.abs(o - e)
    corr = F.when(F.lit(yates) & ((F.col("_r") - 1) * (F.col("_c") - 1) == 1), F.least(F.lit(0.5), diff)).otherwise(0.0)
    return j.select(a, b, F.col("count").alias("observed"), e.alias("expected"),
                    ((diff - corr) * (diff - corr) / e).alias("contribution"))


def chi2_independence(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """Chi-square test of independence of two categorical columns.

    One row (chi2, dof, p, n, cramers_v, strength, min_expected, low_expected)
    - Yates' correction when dof = 1 (as the usual library default), Cramér's V
    from the same statistic, and a flag when any expected count is below 5.
    What is undefined (no rows, one level) is NULL; an empty table has dof 0."""
    cells = chi2_expected(df, a, b, yates)
    st = one_row(cells.agg(
        F.sum("contribution").alias("chi2"), F.sum("observed").alias("n"), F.countDistinct(a).alias("r"),
        F.countDistinct(b).alias("c"), F.min("expected").alias("min_expected"),
    ))
    r, c, n, chi2 = st["r"], st["c"], st["n"] or 0, st["chi2"]
    dof = (r - 1) * (c - 1) if n else 0
    p = dist.chi2_sf(chi2, dof) if dof > 0 else math.nan
    v = math.sqrt(chi2 / (n * (min(r, c) - 1))) if n and min(r, c) > 1 else math.nan
    # fixed values: Cramér's V strength scale
    strength = None if math.isnan(v) else ("negligible" if v < 0.1 else "weak" if v < 0.3 else
                                           "moderate" if v < 0.5 else "strong")
    row = dict(chi2=chi2, dof=dof, p=p, n=n, cramers_v=v, strength=strength, min_expected=st["min_expected"],
               low_expected=None if st["min_expected"] is None else bool(st["min_expected"] < 5),
               significant=judged(p, ALPHA))
    return _frame(df, row, "chi2 double, dof bigint, p double, n bigint, cramers_v double, strength string, "
                           "min_expected double, low_expected boolean, significant boolean")
