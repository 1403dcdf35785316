"""Logistic regression (maximum likelihood), scoring, confusion matrices and
cutoff sweeps."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num
from custlens.plans.common import judged, stat_frame
from custlens.plans.quantiles import exact_quantiles
from custlens.plans.split import stratified_flag
from custlens.operators.regression import complete_rows

ALPHA = 0.05


@dataclass(frozen=True)
class LogitResult:
    y: str
    xs: tuple[str, ...]
    coef: tuple[float, ...]  # intercept first
    se: tuple[float, ...]
    z: tuple[float, ...]
    p: tuple[float, ...]
    n: int
    base_rate: float
    deviance: float
    null_deviance: float
    converged: bool
    separated: bool = False  # a linear score parts the classes: no finite maximum exists

    def coefficients(self, spark) -> DataFrame:
        """(term, coef, se, z, p, odds_ratio, significant)."""
        rows = []
        for name, b, se, z, p in zip(("Intercept", *self.xs), self.coef, self.se, self.z, self.p):
            rows.append((name, b, se, z, p, math.inf if b >= 700 else math.exp(b), judged(p, ALPHA)))
        return stat_frame(spark, rows, "term string, coef double, se double, z double, p double, "
                                           "odds_ratio double, significant boolean")

    def fit_stats(self, spark) -> DataFrame:
        """(n, base_rate, pseudo_r2 (McFadden), deviance, null_deviance, converged, status);
        status is ok, separated, one class, not converged or no rows."""
        r2 = 1 - self.deviance / self.null_deviance if self.null_deviance > 0 else math.nan
        return stat_frame(spark, [(self.n, self.base_rate, r2, self.deviance, self.null_deviance, self.converged, self.status)],
                          "n bigint, base_rate double, pseudo_r2 double, deviance double, null_deviance double, "
                          "converged boolean, status string")

    @property
    def status(self) -> str:
        if not self.n:
            return "no rows"
        if self.base_rate in (0.0, 1.0):
            return "one class"
        return "separated" if self.separated else "ok" if self.converged else "not converged"

    def linear_expr(self) -> Column:
        e = F.lit(self.coef[0])
        for b, x in zip(self.coef[1:], self.xs):
            e = e + F.lit(b) * clean_num(x)
        return e

    def score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        """Append the fitted probability 1 / (1 + exp(-x'b)); a one-row table
        scores a single profile."""
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.linear_expr())))

    def median_profile(self, df: DataFrame) -> DataFrame:
        """One-row table of the predictors' exact medians (the default profile)."""
        parts = [exact_quantiles(df, x, [0.5], names=[x]) for x in self.xs]
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(p)
        return out


def logit(df: DataFrame, y: str, xs: Sequence[str], max_iter: int = 100, tol: float = 1e-10) -> LogitResult:
    """Unpenalised logistic regression by IRLS (``GeneralizedLinearRegression``,
    binomial/logit) on complete rows.  Each iteration is one distributed
    weighted least-squares pass; standard errors from the Fisher information.

    Where the fitted score parts the two classes (one pass over score ranges) or
    only one class is there, the likelihood has no maximum: the coefficients are
    those of the last step, ``converged`` is false and no errors, z or p are
    given.  Without rows all estimates are missing."""
    xs = tuple(xs)
    data = complete_rows(df, [y, *xs]).select(clean_num(y).alias("_label"), *[clean_num(x).alias(x) for x in xs])
    # each IRLS iteration reads these rows again
    feats = VectorAssembler(inputCols=list(xs), outputCol="_features").transform(data).persist()
    base = feats.agg(F.avg("_label").alias("b"), F.count("*").alias("n")).first()
    if not base["n"]:
        feats.unpersist()
        none = (math.nan,) * (len(xs) + 1)
        return LogitResult(y, xs, none, none, none, none, 0, math.nan, math.nan, math.nan, False)
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_features", labelCol="_label",
                                      maxIter=max_iter, tol=tol, regParam=0.0)
    model = glr.fit(feats)
    s = model.summary
    try:
        se = list(s.coefficientStandardErrors)
        zv = list(s.tValues)
        pv = list(s.pValues)
    except Exception:  # noqa: BLE001 - singular information matrix (e.g. separation)
        k = len(xs) + 1
        se, zv, pv = [math.nan] * k, [math.nan] * k, [math.nan] * k
    coef = (float(model.intercept), *[float(c) for c in model.coefficients])
    # Spark lists the intercept last in its summary vectors
    order = [len(xs), *range(len(xs))]
    score = F.lit(coef[0])
    for b, x in zip(coef[1:], xs):
        score = score + F.lit(b) * F.col(x)
    ends = feats.agg(F.min(F.when(F.col("_label") == 1, score)).alias("one"), F.max(F.when(F.col("_label") == 0, score)).alias("zero")).first()
    separated = ends["one"] is not None and ends["zero"] is not None and ends["one"] >= ends["zero"]
    converged = s.numIterations < max_iter and not separated and None not in (ends["one"], ends["zero"])
    if not converged:
        se, zv, pv = ([math.nan] * (len(xs) + 1) for _ in range(3))
    feats.unpersist()
    # the intercept-only fit of 0/1 outcomes has the base rate as its
    # probability, so its deviance is closed form (no second IRLS run)
    pb, n = float(base["b"]), int(base["n"])
    null_dev = 0.0 if pb in (0.0, 1.0) else -2.0 * n * (pb * math.log(pb) + (1 - pb) * math.log(1 - pb))
    return LogitResult(
        y, xs, coef, tuple(float(se[i]) for i in order), tuple(float(zv[i]) for i in order),
        tuple(float(pv[i]) for i in order), n, pb, float(s.deviance), float(null_dev), bool(converged),
        bool(separated),
    )


def stratified_split(df: DataFrame, y: str, key: str, frac: float = 0.7, seed: int = 42) -> DataFrame:
    """Append boolean ``_train``: a per-class hash split keeping each class's share."""
    return stratified_flag(df, key, y, frac, seed)


def confusion(df: DataFrame, y: str | Column, pred: str | Column) -> DataFrame:
    """One row (tp, fp, tn, fn, accuracy, sensitivity, specificity) for 0/1
    truth and prediction; an undefined ratio is NULL.  Always 2 x 2."""
    t = F.col(y) if isinstance(y, str) else y
    p = F.col(pred) if isinstance(pred, str) else pred
    c = df.agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 1) & (p == 0)).alias("fn"),
    )
    return _ratios(c)


def _ratios(c: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    tot = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return c.select(
        *keep, "tp", "fp", "tn", "fn",
        F.try_divide(F.col("tp") + F.col("tn"), F.when(tot > 0, tot)).cast("double").alias("accuracy"),
        F.try_divide(F.col("tp"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") + F.col("fn"))).cast("double")
        .alias("sensitivity"),
        F.try_divide(F.col("tn"), F.when(F.col("tn") + F.col("fp") > 0, F.col("tn") + F.col("fp"))).cast("double")
        .alias("specificity"),
    )


def cutoff_sweep(df: DataFrame, y: str, prob: str, cutoffs: Sequence[float] | None = None) -> DataFrame:
    """Confusion matrix at every cutoff (default 0.05, 0.10, ..., 0.90), one row
    per cutoff; a row is predicted positive when prob >= cutoff.

    Rows are not multiplied by the cutoffs: each row is counted once at its
    level (number of cutoffs <= prob) and the small (level x class) table is
    accumulated from the top."""
    cuts = sorted(cutoffs if cutoffs is not None else [round(0.05 * i, 2) for i in range(1, 19)])
    pcol = clean_num(prob)
    level = F.lit(0)
    for c in cuts:
        level = level + F.when(pcol >= F.lit(float(c)), 1).otherwise(0)
    counts = df.where(pcol.isNotNull()).groupBy(level.alias("_lvl")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    grid = df.sparkSession.createDataFrame([(i + 1, float(c)) for i, c in enumerate(cuts)], "_j int, cutoff double")
    tot = counts.agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    # rows predicted positive at cutoff j are those with level >= j (grid and counts are tiny)
    j = grid.join(F.broadcast(counts), F.col("_lvl") >= F.col("_j"), "left").groupBy("_j", "cutoff").agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("_neg"), F.lit(0)).alias("fp"))
    j = j.crossJoin(F.broadcast(tot)).select(
        "cutoff", F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        (F.col("N") - F.col("fp")).cast("bigint").alias("tn"), (F.col("P") - F.col("tp")).cast("bigint").alias("fn"))
    return _ratios(j, ["cutoff"])
