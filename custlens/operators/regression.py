"""OLS regression with diagnostics and validation, from sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.functions import dist
from custlens.functions.columns import clean_num
from custlens.plans.common import judged, one_row, stat_frame
from custlens.plans.quantiles import exact_quantiles
from custlens.plans.split import fold_id, split_flag
from custlens.plans.suffstats import LinearFit, Moments, column_means, moments, solve, sse_on

ALPHA = 0.05
MAX_LEVELS = 1000


@dataclass(frozen=True)
class OlsSpec:
    """Outcome, numeric and categorical predictors and transforms.

    ``square`` adds x^2 of one numeric predictor, ``log_x`` replaces one
    numeric predictor by its log, ``log_y`` models log(y).  Categorical
    predictors enter as dummies with the first sorted level as baseline."""

    y: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    square: str | None = None
    log_x: str | None = None
    log_y: bool = False

    def __post_init__(self):
        if self.square and self.square == self.log_x:
            raise ValueError("square and log of the same column are not supported together")

    def columns(self) -> list[str]:
        cols = [self.y, *self.numeric, *self.categorical]
        if self.square and self.square not in cols:
            cols.append(self.square)
        return cols

    def without_square(self) -> "OlsSpec":
        return OlsSpec(self.y, self.numeric, self.categorical, None, self.log_x, self.log_y)


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        x = clean_num(c) if types[c] in ("float", "double") else F.col(c)
        cond = cond & x.isNotNull()
    return df.where(cond)


def check_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, all_positive): logs need every value > 0."""
    row = one_row(df.agg(*[F.coalesce(F.bool_and(clean_num(c) > 0), F.lit(True)).alias(c) for c in cols]))
    return df.sparkSession.createDataFrame([(c, bool(row[c])) for c in cols], "column string, all_positive boolean")


def _levels(df: DataFrame, col: str) -> list[str]:
    vals = [r[0] for r in df.select(F.col(col).cast("string")).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(vals) > MAX_LEVELS:
        raise ValueError(f"{col} has more than {MAX_LEVELS} levels")
    return sorted(v for v in vals if v is not None)


def design(df: DataFrame, spec: OlsSpec, levels: Mapping[str, list[str]] | None = None):
    """(term names, term Columns, outcome Column, levels used)."""
    names, terms = [], []
    for c in spec.numeric:
        if c == spec.log_x:
            names.append(f"log({c})")
            terms.append(F.log(clean_num(c)))
        else:
            names.append(c)
            terms.append(clean_num(c))
    if spec.square:
        names.append(f"{spec.square}^2")
        terms.append(clean_num(spec.square) * clean_num(spec.square))
    lv = dict(levels or {})
    for c in spec.categorical:
        if c not in lv:
            lv[c] = _levels(df, c)
        for level in lv[c][1:]:
            names.append(f"{c}[{level}]")
            terms.append((F.col(c).cast("string") == F.lit(level)).cast("double"))
    y = F.log(clean_num(spec.y)) if spec.log_y else clean_num(spec.y)
    return names, terms, y, lv


@dataclass(frozen=True)
class OlsResult:
    spec: OlsSpec
    names: tuple[str, ...]
    fit: LinearFit
    levels: Mapping[str, list[str]] = field(default_factory=dict)

    @property
    def df_resid(self) -> float:
        return self.fit.n - self.fit.rank - 1

    @property
    def sigma2(self) -> float:
        return self.fit.rss / self.df_resid if self.df_resid > 0 else math.nan

    def coef_table(self) -> list[tuple]:
        f = self.fit
        s2 = self.sigma2
        cov = s2 * f.xtx_inv
        se_slopes = np.sqrt(np.maximum(np.diag(cov), 0.0)) if len(f.beta) else np.zeros(0)
        se_int = math.sqrt(max(s2 * (1.0 / f.n + f.x_mean @ f.xtx_inv @ f.x_mean), 0.0)) if f.n else math.nan
        tcrit = dist.t_ppf(1 - ALPHA / 2, self.df_resid) if self.df_resid > 0 else math.nan
        rows = []
        for name, b, se in [("Intercept", f.intercept, se_int), *zip(self.names, f.beta, se_slopes)]:
            t = b / se if se > 0 else math.nan
            p = dist.t_two_sided(t, self.df_resid) if not math.isnan(t) else math.nan
            rows.append((name, float(b), float(se), float(t), float(p), float(b - tcrit * se), float(b + tcrit * se),
                         judged(p, ALPHA)))
        return rows

    def coefficients(self, spark) -> DataFrame:
        """(term, coef, se, t, p, ci_low, ci_high, significant)."""
        return stat_frame(spark, self.coef_table(), "term string, coef double, se double, t double, p double, "
                                                        "ci_low double, ci_high double, significant boolean")

    def fit_stats_row(self) -> dict:
        f = self.fit
        k = f.rank
        r2 = 1 - f.rss / f.tss if f.tss > 0 else math.nan
        adj = 1 - (1 - r2) * (f.n - 1) / self.df_resid if self.df_resid > 0 else math.nan
        fval = ((f.tss - f.rss) / k) / self.sigma2 if k > 0 and self.sigma2 > 0 else math.nan
        fp = dist.f_sf(fval, k, self.df_resid) if not math.isnan(fval) else math.nan
        return dict(r2=r2, adj_r2=adj, f=fval, f_p=fp, n=int(f.n), df_model=float(k), df_resid=float(self.df_resid),
                    rmse=math.sqrt(f.rss / f.n) if f.n else math.nan)

    def fit_stats(self, spark) -> DataFrame:
        r = self.fit_stats_row()
        return stat_frame(spark, [tuple(r.values())], "r2 double, adj_r2 double, f double, f_p double, n bigint, "
                                                          "df_model double, df_resid double, rmse double")

    def fitted_expr(self, df: DataFrame) -> Column:
        _, terms, _, _ = design(df, self.spec, self.levels)
        e = F.lit(self.fit.intercept)
        for b, t in zip(self.fit.beta, terms):
            e = e + F.lit(float(b)) * t
        return e

    def residuals(self, df: DataFrame, fitted: str = "fitted", resid: str = "resid") -> DataFrame:
        """Append fitted values and residuals (complete rows only), on the
        modelled (possibly log) scale."""
        _, _, y, _ = design(df, self.spec, self.levels)
        data = complete_rows(df, self.spec.columns())
        fx = self.fitted_expr(data)
        return data.withColumn(fitted, fx).withColumn(resid, y - F.col(fitted))

    def turning_point(self) -> float | None:
        """-b1 / (2 b2) for the squared predictor (None without one)."""
        sq = self.spec.square
        if not sq or sq not in self.names or f"{sq}^2" not in self.names:
            return None
        b = dict(zip(self.names, self.fit.beta))
        return None if b[f"{sq}^2"] == 0 else float(-b[sq] / (2 * b[f"{sq}^2"]))


def _prepare(df: DataFrame, spec: OlsSpec):
    data = complete_rows(df, spec.columns())
    logs = [spec.log_x] if spec.log_x else []
    if spec.log_y:
        logs.append(spec.y)
    if logs:
        bad = [r["column"] for r in check_positive(data, logs).collect() if not r["all_positive"]]
        if bad:
            raise ValueError(f"log transform needs strictly positive values: {bad}")
    names, terms, y, lv = design(data, spec)
    exprs = [*terms, y]
    return data, names, exprs, lv


def ols(df: DataFrame, spec: OlsSpec) -> OlsResult:
    """Fit OLS with intercept on complete rows: one pass for column means,
    one for centred cross-products; the solve is p x p on the driver.  Without
    complete rows all estimates are missing (NULL in the tables)."""
    data, names, exprs, lv = _prepare(df, spec)
    center = column_means(data, exprs)
    mom = moments(data, exprs, center)[None]
    return OlsResult(spec, tuple(names), solve(mom, center), lv)


# ---------------------------------------------------------------- diagnostics
def qq_points(df: DataFrame, col: str, m: int = 100) -> DataFrame:
    """(theoretical, sample) for m plotting positions j/(m+1): exact quantiles
    of the standardised column (population sd) against the normal."""
    x = clean_num(col)
    st = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = df.crossJoin(F.broadcast(st)).select(((x - F.col("_m")) / F.col("_s")).alias("_z"))
    probs = [j / (m + 1) for j in range(1, m + 1)]
    q = exact_quantiles(z, "_z", probs, names=[f"q{j}" for j in range(m)])
    theo = ", ".join(f"{dist.norm_ppf(p)!r}D, q{j}" for j, p in enumerate(probs))
    return q.select(F.expr(f"stack({m}, {theo}) as (theoretical, sample)"))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, vif) = diagonal of the inverse correlation matrix of the numeric
    predictors (complete rows), i.e. 1 / (1 - R^2_j) with an intercept."""
    data = complete_rows(df, cols)
    exprs = [clean_num(c) for c in cols]
    center = column_means(data, exprs)
    mean, c = moments(data, exprs, center)[None].centred()
    d = np.sqrt(np.diag(c))
    corr = c / np.outer(d, d)
    inv = np.linalg.pinv(corr)
    return df.sparkSession.createDataFrame([(col, float(inv[i, i])) for i, col in enumerate(cols)],
                                           "column string, vif double")


def breusch_pagan(df: DataFrame, res: OlsResult) -> DataFrame:
    """Studentised Breusch-Pagan: LM = n R^2 of e^2 on the model terms.
    One row (lm, df, p)."""
    data, names, exprs, _ = _prepare(df, res.spec)
    e2 = (exprs[-1] - res.fitted_expr(data)) ** 2
    ex = [*exprs[:-1], e2]
    center = column_means(data, ex)
    aux = solve(moments(data, ex, center)[None], center)
    r2 = 1 - aux.rss / aux.tss if aux.tss > 0 else math.nan
    lm = aux.n * r2
    k = aux.rank
    return df.sparkSession.createDataFrame([(float(lm), float(k), dist.chi2_sf(lm, k))], "lm double, df double, p double")


def durbin_watson(df: DataFrame, resid: str, order_by: Sequence[str]) -> DataFrame:
    """Durbin-Watson statistic of a residual column in the order of
    ``order_by``, without a global sort into one task.

    The order must be total (ties have no defined order).  Rows are dealt out
    in ranges of the whole order key (so one frequent first key is cut by the
    others) and sorted inside each range; a range adds up its own differences
    and reports its first and last residual, and the differences across the
    borders come from that table of one row per range.  One row (dw, n)."""
    order = list(order_by)
    data = df.select(*order, clean_num(resid).alias("_e")).where(F.col("_e").isNotNull())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = data.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("_range"), "_e")

    def sums(batches):
        part, n, squares, steps, first, last = None, 0, 0.0, 0.0, None, None
        for b in batches:
            e = b.column(1).to_numpy()
            if not len(e):
                continue
            part = b.column(0)[0].as_py()
            first = e[0] if first is None else first
            d = np.diff(e, prepend=e[0] if last is None else last)
            n, squares, steps, last = n + len(e), squares + float(e @ e), steps + float(d @ d), e[-1]
        if n:
            doubles = [pa.array([float(x)]) for x in (squares, steps, first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), *doubles],
                                             names=["part", "n", "ee", "dd", "first", "last"])

    per = dealt.mapInArrow(sums, "part int, n long, ee double, dd double, first double, last double")
    border = per.withColumn("b", F.coalesce(F.col("first") - F.lag("last").over(Window.orderBy("part")), F.lit(0.0)))
    return border.agg(((F.sum("dd") + F.sum(F.col("b") * F.col("b"))) / F.sum("ee")).alias("dw"), F.sum("n").alias("n"))


def jarque_bera(df: DataFrame, col: str) -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) with population skewness S and excess kurtosis K;
    p = exp(-JB/2) (chi-square, 2 df).  One row (jb, p, skewness, kurtosis, n)."""
    x = clean_num(col)
    st = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return st.select(jb.alias("jb"), F.exp(-jb / 2.0).alias("p"), "skewness", "kurtosis", "n")


# ---------------------------------------------------------------- validation
def _split_moments(df: DataFrame, spec: OlsSpec, group: Column):
    data, names, exprs, lv = _prepare(df, spec)
    center = column_means(data, exprs)
    return moments(data, exprs, center, group), center


def holdout_rmse(df: DataFrame, spec: OlsSpec, key: str, frac: float = 0.7, seed: int = 42) -> float:
    """Fit on the hash-selected training share, RMSE on the rest (modelled
    scale).  One grouped pass of sufficient statistics, no refit pass."""
    mom, center = _split_moments(df, spec, split_flag(key, frac, seed))
    fit = solve(mom[True], center)
    test = mom.get(False)
    return math.sqrt(sse_on(fit, test, center) / test.n) if test else math.nan


def kfold_rmse(df: DataFrame, spec: OlsSpec, key: str, k: int = 5, seed: int = 42) -> float:
    """Mean of the k fold RMSEs.  One ``groupBy(fold)`` of sufficient statistics;
    each training set is total minus its fold."""
    mom, center = _split_moments(df, spec, fold_id(key, k, seed))
    total = None
    for m in mom.values():
        total = m if total is None else total + m
    rmses = []
    for f, m in sorted(mom.items()):
        fit = solve(total - m, center)
        rmses.append(math.sqrt(sse_on(fit, m, center) / m.n))
    return float(np.mean(rmses)) if rmses else math.nan


def compare_specs(df: DataFrame, specs: Mapping[str, OlsSpec], key: str, frac: float = 0.7, k: int = 5,
                  seed: int = 42) -> DataFrame:
    """(model, holdout_rmse, cv_rmse) per named specification."""
    rows = [(name, holdout_rmse(df, s, key, frac, seed), kfold_rmse(df, s, key, k, seed)) for name, s in specs.items()]
    return df.sparkSession.createDataFrame(rows, "model string, holdout_rmse double, cv_rmse double")


def _sub(mom: Moments, idx: Sequence[int]) -> Moments:
    ix = np.asarray(idx)
    return Moments(mom.n, mom.s[ix], mom.m[np.ix_(ix, ix)])


def _validation_from(moms: dict, center: Sequence[float], idx: Sequence[int], k: int) -> tuple[float, float]:
    """(holdout RMSE, mean k-fold RMSE) for the design columns ``idx`` (outcome
    last) from moments grouped by (train flag, fold)."""
    cen = [center[i] for i in idx]
    parts = {g: _sub(m, idx) for g, m in moms.items()}
    train = test = None
    folds: dict[int, Moments] = {}
    for (flag, fold), m in parts.items():
        if flag:
            train = m if train is None else train + m
        else:
            test = m if test is None else test + m
        folds[fold] = m if fold not in folds else folds[fold] + m
    hold = math.sqrt(sse_on(solve(train, cen), test, cen) / test.n) if train and test else math.nan
    total = None
    for m in folds.values():
        total = m if total is None else total + m
    rmses = [math.sqrt(sse_on(solve(total - m, cen), m, cen) / m.n) for _, m in sorted(folds.items())]
    return hold, float(np.mean(rmses)) if rmses else math.nan


def compare_square(df: DataFrame, spec: OlsSpec, key: str, frac: float = 0.7, k: int = 5,
                   seed: int = 42) -> DataFrame:
    """Holdout and k-fold RMSE with versus without the squared term.

    The smaller model is nested in the larger one, so a single pass of
    moments of the larger design, grouped by (train flag, fold), serves both
    models and both validation schemes."""
    if not spec.square:
        raise ValueError("the specification has no squared term")
    data, names, exprs, _ = _prepare(df, spec)
    center = column_means(data, exprs)
    group = F.struct(split_flag(key, frac, seed).alias("t"), fold_id(key, k, seed).alias("f"))
    raw = moments(data, exprs, center, group)
    moms = {(g["t"], g["f"]): m for g, m in raw.items()}
    full = list(range(len(exprs)))
    sq = names.index(f"{spec.square}^2")
    rows = []
    for label, idx in (("without squared term", [i for i in full if i != sq]), ("with squared term", full)):
        hold, cv = _validation_from(moms, center, idx, k)
        rows.append((label, hold, cv))
    return df.sparkSession.createDataFrame(rows, "model string, holdout_rmse double, cv_rmse double")


__all__ = ["OlsSpec", "OlsResult", "ols", "qq_points", "vif", "breusch_pagan", "durbin_watson", "jarque_bera",
           "holdout_rmse", "kfold_rmse", "compare_specs", "compare_square", "check_positive", "Moments"]
