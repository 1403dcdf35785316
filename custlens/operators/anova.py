"""ANOVA (one-way, two-way and N-way, type II sums of squares) and post-hoc
pairwise comparisons.

Rows are compressed to cells - one row per combination of factor levels with
(n, mean, within-cell sum of squares) - in one ``groupBy``.  Every model in an
ANOVA predicts a constant per cell, so a residual sum of squares is
``SS_within + sum_c n_c (mean_c - fit_c)^2``: the least-squares fits run on
the small cell table, never on rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions import dist
from custlens.functions.columns import clean_num

ALPHA = 0.05
MAX_CELLS = 100_000


def cell_stats(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """(factors..., n, mean, ss) per cell over complete rows; factors as strings."""
    x = clean_num(y)
    cond = x.isNotNull()
    for f in factors:
        cond = cond & F.col(f).isNotNull()
    rows = df.where(cond).select(*[F.col(f).cast("string").alias(f) for f in factors], x.alias("_y"))
    return rows.groupBy(*factors).agg(
        F.count("*").alias("n"), F.avg("_y").alias("mean"),
        (F.coalesce(F.var_pop("_y"), F.lit(0.0)) * F.count("*")).alias("ss"),
    )


def _collect_cells(df: DataFrame, y: str, factors: Sequence[str]) -> pd.DataFrame:
    cells = cell_stats(df, y, factors)
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; reduce the factors")
    return pd.DataFrame([r.asDict() for r in rows], columns=[*factors, "n", "mean", "ss"])


def _terms(factors: Sequence[str], interactions: bool) -> list[tuple[str, ...]]:
    if not interactions:
        return [(f,) for f in factors]
    return [t for k in range(1, len(factors) + 1) for t in itertools.combinations(factors, k)]


def _dummies(cells: pd.DataFrame, f: str) -> np.ndarray:
    levels = sorted(cells[f].unique())
    return np.column_stack([(cells[f] == lv).to_numpy(float) for lv in levels[1:]]) if len(levels) > 1 else \
        np.zeros((len(cells), 0))


def _design(cells: pd.DataFrame, terms: Sequence[tuple[str, ...]]) -> np.ndarray:
    cols = [np.ones((len(cells), 1))]
    dums = {f: _dummies(cells, f) for t in terms for f in t}
    for t in terms:
        block = np.ones((len(cells), 1))
        for f in t:
            d = dums[f]
            block = np.column_stack([block[:, i] * d[:, j] for i in range(block.shape[1]) for j in range(d.shape[1])]) \
                if d.shape[1] else np.zeros((len(cells), 0))
        if block.shape[1]:
            cols.append(block)
    return np.column_stack(cols)


def _rss(cells: pd.DataFrame, terms: Sequence[tuple[str, ...]]) -> tuple[float, int]:
    x = _design(cells, terms)
    w = np.sqrt(cells["n"].to_numpy(float))
    yb = cells["mean"].to_numpy(float)
    coef, _, rank, _ = np.linalg.lstsq(x * w[:, None], yb * w, rcond=None)
    fit = x @ coef
    rss = float(cells["ss"].sum() + np.sum(cells["n"].to_numpy(float) * (yb - fit) ** 2))
    return rss, int(rank)


def anova_table(cells: pd.DataFrame, factors: Sequence[str], interactions: bool = False) -> pd.DataFrame:
    """Type II ANOVA table from a cell table (driver-side, cells are few)."""
    terms = _terms(factors, interactions)
    n = float(cells["n"].sum())
    rss_full, rank_full = _rss(cells, terms)
    df_res = n - rank_full
    ms_res = rss_full / df_res if df_res > 0 else math.nan
    out = []
    for t in terms:
        reduced = [u for u in terms if u != t and not set(t) <= set(u)]
        rss_r, rank_r = _rss(cells, reduced)
        rss_f, rank_f = _rss(cells, reduced + [t])
        ss = max(rss_r - rss_f, 0.0)
        d = rank_f - rank_r
        fval = (ss / d) / ms_res if d > 0 and ms_res > 0 else math.nan
        p = dist.f_sf(fval, d, df_res) if not math.isnan(fval) else math.nan
        out.append((":".join(t), ss, float(d), fval, p))
    out.append(("Residual", rss_full, float(df_res), math.nan, math.nan))
    tab = pd.DataFrame(out, columns=["term", "sum_sq", "df", "F", "p"])
    tab["significant"] = tab["p"] < ALPHA
    return tab


def anova(df: DataFrame, y: str, factors: Sequence[str], interactions: bool = False) -> DataFrame:
    """ANOVA of ``y`` on one or more factors over complete rows.

    (term, sum_sq, df, F, p, significant); the last row is the residual.
    Significance is judged on the unrounded p."""
    factors = list(factors)
    tab = anova_table(_collect_cells(df, y, factors), factors, interactions)
    tab = tab.astype({"sum_sq": float, "df": float, "F": float, "p": float})
    tab = tab.replace({np.nan: None})
    return df.sparkSession.createDataFrame(
        [tuple(r) for r in tab.itertuples(index=False)],
        "term string, sum_sq double, df double, F double, p double, significant boolean",
    )


def group_means(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """(factors..., n, mean) over complete rows."""
    return cell_stats(df, y, factors).select(*factors, "n", "mean")


def _level_stats(df: DataFrame, y: str, f: str) -> DataFrame:
    """(g, n, mean, var) per level."""
    x = clean_num(y)
    return df.where(x.isNotNull() & F.col(f).isNotNull()).groupBy(F.col(f).cast("string").alias("g")).agg(
        F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def posthoc(df: DataFrame, y: str, f: str, method: str = "tukey", alpha: float = ALPHA) -> DataFrame:
    """Pairwise comparisons of the levels of ``f``.

    tukey:      (group1, group2, meandiff, p_adj, lower, upper, reject),
                Tukey-Kramer with the exact studentised range;
    scheffe:    (group1, group2, p) from F = d^2 / (MSE (1/n1 + 1/n2) (k-1));
    bonferroni: (group1, group2, p), Welch t per pair, p times the number of
                pairs, capped at 1.
    The pairs of levels, which are the rows of the result, are made and tested
    by Spark from the table of level statistics; one row of totals reaches the
    driver.  Where the groups have no variance the statistics are NULL."""
    if method not in ("tukey", "scheffe", "bonferroni"):
        raise ValueError("method must be tukey, scheffe or bonferroni")
    g = _level_stats(df, y, f).persist()
    tot = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"),
                F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss")).collect()[0]
    k, df_w = tot["k"], float((tot["n"] or 0) - tot["k"])
    mse = tot["ss"] / df_w if df_w > 0 else math.nan
    ok = not math.isnan(mse) and mse > 0
    qcrit = dist.qtukey(1 - alpha, k, df_w) if method == "tukey" and k >= 2 and ok else math.nan
    side = lambda i: g.select(F.col("g").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("mean").alias(f"m{i}"),
                              F.col("var").alias(f"v{i}"))
    pairs = side(1).join(side(2), F.col("g1") < F.col("g2"))

    def tukey(r) -> tuple:
        diff = r.m2 - r.m1
        if not ok:
            return diff, None, None, None, None
        se = math.sqrt(mse / 2.0 * (1.0 / r.n1 + 1.0 / r.n2))
        p = dist.tukey_sf(abs(diff) / se, k, df_w)
        return diff, p, diff - qcrit * se, diff + qcrit * se, bool(p < alpha)

    def scheffe(r) -> tuple:
        if not ok:
            return (None,)
        return (dist.f_sf((r.m1 - r.m2) ** 2 / (mse * (1.0 / r.n1 + 1.0 / r.n2) * (k - 1)), k - 1, df_w),)

    def bonferroni(r) -> tuple:
        se2 = r.v1 / r.n1 + r.v2 / r.n2
        if min(r.n1, r.n2) < 2 or not se2 > 0:
            return (None,)
        dof = se2 ** 2 / ((r.v1 / r.n1) ** 2 / (r.n1 - 1) + (r.v2 / r.n2) ** 2 / (r.n2 - 1))
        p = dist.t_two_sided((r.m1 - r.m2) / math.sqrt(se2), dof)
        return (min(1.0, p * (k * (k - 1) // 2)),)

    test, fields = {"tukey": (tukey, "meandiff double, p_adj double, lower double, upper double, reject boolean"),
                    "scheffe": (scheffe, "p double"), "bonferroni": (bonferroni, "p double")}[method]
    names = ["group1", "group2", *[x.split()[0] for x in fields.split(", ")]]

    def run(parts):
        for part in parts:
            rows = [(r.g1, r.g2, *test(r)) for r in part.itertuples()]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return pairs.mapInPandas(run, f"group1 string, group2 string, {fields}")
