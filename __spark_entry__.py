"""

Every query reads the given tables whole (no id subsets, no row caps except
where a limit is the feature, e.g. a preview or a top-k list) and rounds its
floating outputs to fixed decimals so that the Spark result and the DuckDB
statement can be compared value for value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.operators import anova as A
from custlens.operators import chartdata as V
from custlens.operators import correlate as C
from custlens.operators import classify as M
from custlens.operators import hypothesis as H
from custlens.operators import images as I
from custlens.operators import logistic as L
from custlens.operators import regression as R
from custlens.operators import segment as G
from custlens.operators import text as T
from custlens.operators import describe as D
from custlens.operators import wrangle as W
from custlens.sources import io as IO
from custlens.sources import profiling as P

# The training-data operators live in a subpackage of their own that may be absent,
# as may the libraries that only it needs; the pipeline is a file beside it.
try:
    from custlens.llm import registry as _llm
except ImportError:
    _llm = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), d) for c, d in decimals.items()})


# decimals per summary measure (large second moments get fewer decimals)
_MEASURE_DEC = {"variance": 1, "std_dev": 5, "coef_variation": 8, "skewness": 8, "kurtosis": 8}


def _round_measure(df: DataFrame) -> DataFrame:
    e = None
    for m, d in _MEASURE_DEC.items():
        e = (e if e is not None else F).when(F.col("measure") == m, F.round("value", d))
    e = e.otherwise(F.round("value", 4))
    return df.withColumn("value", e)


def _sql_round_measure(src: str) -> str:
    cases = " ".join(f"WHEN measure = '{m}' THEN round(value, {d})" for m, d in _MEASURE_DEC.items())
    return f"SELECT * REPLACE (CASE {cases} ELSE round(value, 4) END AS value) FROM ({src})"


# ---------------------------------------------------------------- flagship
def q_summary_measures(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return _round_measure(D.summary_measures(li, "l_extendedprice"))


def _sql_summary(table: str, col: str, where: str = "TRUE", by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    measures = [
        ("count", "CAST(n AS DOUBLE)"), ("mean", "mean"), ("median", "median"), ("mode", "mode"),
        ("p25", "p25"), ("p75", "p75"), ("range", "rng"), ("mean_abs_dev", "mad"), ("variance", "var"),
        ("std_dev", "sd"), ("coef_variation", "CASE WHEN mean <> 0 THEN sd / mean END"),
        ("skewness", "sk"), ("kurtosis", "ku"),
    ]
    unions = " UNION ALL ".join(f"SELECT {g}'{m}' AS measure, CAST({e} AS DOUBLE) AS value FROM allm" for m, e in measures)
    src = f"""
    WITH x AS (SELECT {g}CAST({col} AS DOUBLE) AS v FROM {table} WHERE {where} AND {col} IS NOT NULL AND NOT isnan({col})),
    s AS (SELECT {g}count(v) n, avg(v) mean, quantile_cont(v, 0.5) median, quantile_cont(v, 0.25) p25,
                 quantile_cont(v, 0.75) p75, max(v) - min(v) rng, var_samp(v) var, stddev_samp(v) sd,
                 CASE WHEN count(v) >= 3 THEN skewness(v) END sk, CASE WHEN count(v) >= 4 THEN kurtosis(v) END ku
          FROM x {gb}),
    m AS (SELECT {g}avg(abs(x.v - s.mean)) mad FROM x JOIN s {j} {gb}),
    vc AS (SELECT {g}v, count(*) c FROM x GROUP BY {g}v),
    mo AS (SELECT {g}arg_max(v, c * 1e12 - v) AS mode FROM (SELECT {g}v, c FROM vc) {gb}),
    allm AS (SELECT * FROM s JOIN m {j} JOIN mo {j})
    {unions}"""
    return _sql_round_measure(src)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: summary measures of lineitem.l_extendedprice shipped since 1996."""
    return q_summary_measures(spark, SMOKE_DIR)


# ---------------------------------------------------------------- sources, profile
def q_preview(spark, d):
    return IO.preview(_t(spark, d, "customer"), 10, ["c_custkey"])


def q_shape(spark, d):
    return IO.shape(_t(spark, d, "lineitem"))


def q_profile(spark, d):
    p = P.profile(_t(spark, d, "customer"))
    return _round(p, {"mean_len": 6, "min_value": 4, "max_value": 4})


def q_roles(spark, d):
    return P.roles(P.profile(_t(spark, d, "documents")))


# ---------------------------------------------------------------- wrangling
def _events_nulls(spark, d):
    e = _t(spark, d, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value")))


def q_impute_median(spark, d):
    out = W.impute(_events_nulls(spark, d), "value", "median")
    return _round(out.select("event_id", "value"), {"value": 4})


def q_impute_mean(spark, d):
    out = W.impute(_events_nulls(spark, d), "value", "mean")
    return _round(out.select("event_id", "value"), {"value": 4})


def q_drop_missing(spark, d):
    return W.drop_missing(_events_nulls(spark, d), ["value"]).select("event_id", "value")


def q_drop_report(spark, d):
    return W.drop_report(_events_nulls(spark, d), ["value"])


def q_filter_num_median(spark, d):
    li = _t(spark, d, "lineitem")
    return W.filter_num(li, "l_quantity", ">=").select("l_orderkey", "l_linenumber", "l_quantity")


def q_filter_num_value(spark, d):
    li = _t(spark, d, "lineitem")
    return W.filter_num(li, "l_discount", "==", 0.05).select("l_orderkey", "l_linenumber", "l_discount")


def q_filter_in(spark, d):
    c = _t(spark, d, "customer")
    return W.filter_in(c, "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


def q_filter_in_empty(spark, d):
    return W.filter_in(_t(spark, d, "customer"), "c_mktsegment", []).select("c_custkey")


def q_filter_preview(spark, d):
    return W.filter_preview(_t(spark, d, "lineitem"), F.col("l_discount") >= 0.05)


def q_pool_rare(spark, d):
    return W.pool_rare(_t(spark, d, "part"), "p_type", 2).select("p_partkey", "p_type", "p_type_reduced")


def q_bin_equal_width(spark, d):
    out = W.bin_equal_width(_t(spark, d, "part"), "p_retailprice", 5)
    out = out.select("p_partkey", "p_retailprice_group", "p_retailprice_bin", "p_retailprice_lo", "p_retailprice_hi")
    return _round(out, {"p_retailprice_lo": 6, "p_retailprice_hi": 6})


def q_date_features(spark, d):
    out = W.date_features(_t(spark, d, "orders"), "o_orderdate", as_of="2002-01-01")
    return out.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


# ---------------------------------------------------------------- describe
def q_summary_by_group(spark, d):
    return _round_measure(D.summary_measures(_t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]))


def q_box_stats(spark, d):
    out = D.box_stats(_t(spark, d, "customer"), "c_acctbal")
    return _round(out, {c: 6 for c in ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                                         "whisker_low", "whisker_high"]})


def q_box_stats_by(spark, d):
    out = D.box_stats(_t(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return _round(out, {c: 4 for c in ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                                         "whisker_low", "whisker_high"]})


def q_outliers_iqr(spark, d):
    out = D.outliers(_t(spark, d, "lineitem"), "l_extendedprice", "iqr")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


def q_outliers_z(spark, d):
    out = D.outliers(_t(spark, d, "lineitem"), "l_extendedprice", "z", cut=3.0)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


def q_outlier_counts(spark, d):
    return _round(D.outlier_counts(_t(spark, d, "lineitem"), "l_extendedprice"),
                  {"lower_fence": 4, "upper_fence": 4})


def q_add_zscore(spark, d):
    out = D.add_zscore(_t(spark, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal_z")
    return _round(out, {"c_acctbal_z": 8})


def q_add_outlier_flag(spark, d):
    out = D.add_outlier_flag(_t(spark, d, "lineitem"), "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice_outlier")


def q_percentile_rank(spark, d):
    out = D.add_percentile_rank(_t(spark, d, "lineitem"), "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_quantity_pctile")


def q_percentile_rank_unrounded(spark, d):
    out = D.add_percentile_rank(_t(spark, d, "customer"), "c_acctbal", decimals=None)
    return _round(out.select("c_custkey", "c_acctbal_pctile"), {"c_acctbal_pctile": 8})


_STD_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def q_standardize(spark, d):
    out = D.standardize(_t(spark, d, "lineitem"), _STD_COLS)
    out = out.select("l_orderkey", "l_linenumber", *[f"{c}_z" for c in _STD_COLS])
    return _round(out, {f"{c}_z": 6 for c in _STD_COLS})


def q_scale_report(spark, d):
    out = D.scale_report(_t(spark, d, "lineitem"), _STD_COLS)
    return _round(out, {"mean": 6, "sd": 6, "min": 6, "max": 6})


# ---------------------------------------------------------------- chart data
def q_frequency(spark, d):
    return _round(V.frequency(_t(spark, d, "part"), "p_type"), {"share": 8})


def q_frequency_events(spark, d):
    return _round(V.frequency(_t(spark, d, "events"), "event_type"), {"share": 8})


def q_histogram(spark, d):
    return _round(V.histogram(_t(spark, d, "lineitem"), "l_quantity", 10), {"lo": 6, "hi": 6})


def q_histogram_multi(spark, d):
    return _round(V.histogram(_t(spark, d, "part"), ["p_retailprice", "p_size"], 8), {"lo": 6, "hi": 6})


def q_skew_label(spark, d):
    return _round(V.skew_label(_t(spark, d, "customer"), "c_acctbal"), {"skewness": 8})


def q_crosstab(spark, d):
    return V.crosstab(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


def q_crosstab_row(spark, d):
    out = V.crosstab(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority", normalize="row")
    return _round(out, {"row_pct": 8})


def q_scatter(spark, d):
    return V.scatter_points(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", color="l_returnflag")


def q_monthly_series(spark, d):
    return _round(V.monthly_series(_t(spark, d, "orders"), "o_orderdate", "o_totalprice"), {"total": 2})



# ---------------------------------------------------------------- correlation
_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_corr_pearson(spark, d):
    return _round(C.corr(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "pearson"), {"r": 10})


def q_corr_spearman(spark, d):
    return _round(C.corr(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "spearman"), {"r": 10})


def q_corr_kendall(spark, d):
    return _round(C.corr(_t(spark, d, "lineitem"), "l_quantity", "l_discount", "kendall"), {"r": 10})


def q_corr_kendall_customer(spark, d):
    return _round(C.corr(_t(spark, d, "customer"), "c_acctbal", "c_nationkey", "kendall"), {"r": 10})


def q_corr_matrix(spark, d):
    return _round(C.corr_matrix(_t(spark, d, "lineitem"), _CORR_COLS, "pearson"), {"r": 10})


def q_corr_matrix_spearman(spark, d):
    return _round(C.corr_matrix(_t(spark, d, "lineitem"), _CORR_COLS[:3], "spearman"), {"r": 10})


def q_corr_report(spark, d):
    return _round(C.corr_report(_t(spark, d, "customer"), "c_acctbal", "c_custkey", "pearson"), {"r": 10})


# ---------------------------------------------------------------- hypothesis tests
def q_ttest_1samp(spark, d):
    out = H.ttest_1samp(_t(spark, d, "lineitem"), "l_quantity", 25.0)
    return _round(out.select("n", "mean", "mu", "t", "df"), {"mean": 8, "t": 8})


def q_ttest_1samp_median(spark, d):
    out = H.ttest_1samp(_t(spark, d, "customer"), "c_acctbal")
    return _round(out.select("n", "mean", "mu", "t", "df"), {"mean": 8, "mu": 8, "t": 8})


def q_ttest_welch(spark, d):
    out = H.ttest_welch(_t(spark, d, "lineitem"), "l_quantity", "l_linestatus", "F", "O")
    return _round(out.drop("p", "significant"), {"mean_a": 8, "mean_b": 8, "t": 8, "df": 6})


def q_ttest_paired(spark, d):
    out = H.ttest_paired(_t(spark, d, "lineitem"), "l_discount", "l_tax")
    return _round(out.drop("p", "significant"), {"mean_a": 10, "mean_b": 10, "mean_change": 10, "t": 8})


def q_chi2_orders(spark, d):
    out = H.chi2_independence(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return _round(out, {"chi2": 8, "p": 10, "cramers_v": 10, "min_expected": 8})


def q_chi2_yates(spark, d):
    out = H.chi2_independence(_t(spark, d, "labels"), "quality", "toxic")
    return _round(out.drop("p", "significant"), {"chi2": 8, "cramers_v": 10, "min_expected": 8})


def q_chi2_expected(spark, d):
    out = H.chi2_expected(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return _round(out, {"expected": 8, "contribution": 8})


# ---------------------------------------------------------------- ANOVA
def q_anova_oneway(spark, d):
    out = A.anova(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return _round(out, {"sum_sq": 4, "F": 8, "p": 10})


def q_anova_twoway(spark, d):
    out = A.anova(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return _round(out, {"sum_sq": 4, "F": 8, "p": 10})


def q_anova_twoway_interaction(spark, d):
    out = A.anova(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], interactions=True)
    return _round(out, {"sum_sq": 4, "F": 8, "p": 10})


# The names ending in _sums, _spans and _estimates hold the columns of the query
# before that have an SQL form (p-values and quantiles of t, F and the studentised
# range have none).
def q_anova_twoway_sums(spark, d):
    out = A.anova(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return _round(out.drop("p", "significant"), {"sum_sq": 3, "F": 6})


def q_anova_twoway_interaction_sums(spark, d):
    out = A.anova(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], interactions=True)
    return _round(out.drop("p", "significant"), {"sum_sq": 3, "F": 6})


def q_anova_threeway(spark, d):
    out = A.anova(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus", "l_linenumber"],
                  interactions=True)
    return _round(out, {"sum_sq": 4, "F": 8, "p": 10})


def q_group_means(spark, d):
    out = A.group_means(_t(spark, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])
    return _round(out, {"mean": 8})


def q_posthoc_tukey(spark, d):
    out = A.posthoc(_t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "tukey")
    return _round(out, {"meandiff": 8, "p_adj": 8, "lower": 6, "upper": 6})


def q_posthoc_tukey_spans(spark, d):
    out = A.posthoc(_t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "tukey")
    # the interval is meandiff -+ q * se with one q for all pairs: its half widths
    # are compared as shares of the widest (q itself has no SQL form)
    half = out.withColumn("half", (F.col("upper") - F.col("lower")) / 2)
    widest = half.agg(F.max("half").alias("_w"))
    out = half.join(F.broadcast(widest)).select("group1", "group2", "meandiff", (F.col("half") / F.col("_w")).alias("half_share"))
    return _round(out, {"meandiff": 6, "half_share": 6})


def q_posthoc_scheffe(spark, d):
    return _round(A.posthoc(_t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "scheffe"), {"p": 10})


def q_posthoc_bonferroni(spark, d):
    return _round(A.posthoc(_t(spark, d, "lineitem"), "l_quantity", "l_returnflag", "bonferroni"), {"p": 10})



# ---------------------------------------------------------------- OLS regression
_OLS = R.OlsSpec("l_extendedprice", ("l_quantity", "l_discount"))
_OLS_SQ = R.OlsSpec("l_extendedprice", ("l_quantity",), square="l_quantity")
_OLS_LOG = R.OlsSpec("l_extendedprice", ("l_quantity", "l_discount"), log_x="l_quantity", log_y=True)
_OLS_CAT = R.OlsSpec("l_extendedprice", ("l_quantity",), ("l_returnflag",))


def _keyed_lineitem(spark, d):
    li = _t(spark, d, "lineitem")
    return li.withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))


_COEF = {"coef": 6, "se": 6, "t": 6, "p": 10, "ci_low": 6, "ci_high": 6}


def q_ols_coefficients(spark, d):
    return _round(R.ols(_t(spark, d, "lineitem"), _OLS).coefficients(spark), _COEF)


def q_ols_estimates(spark, d):
    res = R.ols(_t(spark, d, "lineitem"), _OLS)
    return _round(res.coefficients(spark).select("term", "coef", "se", "t"), {"coef": 6, "se": 6, "t": 6})


def q_ols_fit_stats(spark, d):
    res = R.ols(_t(spark, d, "lineitem"), _OLS)
    return _round(res.fit_stats(spark), {"r2": 10, "adj_r2": 10, "f": 6, "f_p": 10, "rmse": 6})


def q_ols_residuals(spark, d):
    li = _t(spark, d, "lineitem")
    out = R.ols(li, _OLS).residuals(li).select("l_orderkey", "l_linenumber", "fitted", "resid")
    return _round(out, {"fitted": 4, "resid": 4})


def q_ols_square(spark, d):
    res = R.ols(_t(spark, d, "lineitem"), _OLS_SQ)
    tp = res.turning_point()
    out = res.coefficients(spark).select("term", "coef", "se", "t").withColumn("turning_point", F.lit(tp))
    return _round(out, {"coef": 6, "se": 6, "t": 6, "turning_point": 6})


def q_ols_log(spark, d):
    res = R.ols(_t(spark, d, "lineitem"), _OLS_LOG)
    return _round(res.coefficients(spark).select("term", "coef", "se", "t"), {"coef": 8, "se": 8, "t": 6})


def q_ols_categorical(spark, d):
    return _round(R.ols(_t(spark, d, "lineitem"), _OLS_CAT).coefficients(spark), _COEF)


def q_ols_categorical_estimates(spark, d):
    res = R.ols(_t(spark, d, "lineitem"), _OLS_CAT)
    return _round(res.coefficients(spark).select("term", "coef", "se", "t"), {"coef": 4, "se": 4, "t": 4})


def q_check_positive(spark, d):
    return R.check_positive(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


def _resid(spark, d):
    li = _t(spark, d, "lineitem")
    return R.ols(li, _OLS).residuals(li)


def q_qq_points(spark, d):
    return _round(R.qq_points(_resid(spark, d), "resid", 50), {"theoretical": 8, "sample": 8})


def q_resid_histogram(spark, d):
    return _round(V.histogram(_resid(spark, d), "resid", 30), {"lo": 4, "hi": 4})


def q_vif(spark, d):
    return _round(R.vif(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"]), {"vif": 10})


def q_breusch_pagan(spark, d):
    li = _t(spark, d, "lineitem")
    return _round(R.breusch_pagan(li, R.ols(li, _OLS)), {"lm": 6, "p": 10})


def q_durbin_watson(spark, d):
    # the order must be total: (orderkey, linenumber) repeats in this table
    return _round(R.durbin_watson(_resid(spark, d), "resid", _LI_ORDER), {"dw": 10})


def q_jarque_bera(spark, d):
    return _round(R.jarque_bera(_resid(spark, d), "resid"), {"jb": 6, "p": 10, "skewness": 10, "kurtosis": 10})


def q_holdout_rmse(spark, d):
    li = _keyed_lineitem(spark, d)
    v = R.holdout_rmse(li, _OLS, "row_key", 0.7, 42)
    return spark.createDataFrame([(round(v, 6),)], "holdout_rmse double")


def q_compare_square(spark, d):
    return _round(R.compare_square(_keyed_lineitem(spark, d), _OLS_SQ, "row_key"),
                  {"holdout_rmse": 6, "cv_rmse": 6})



# ---------------------------------------------------------------- logistic regression
_LOGIT_X = ["l_quantity", "l_discount", "l_tax"]


def _li_target(spark, d):
    li = _keyed_lineitem(spark, d)
    return li.withColumn("is_return", (F.col("l_returnflag") == "R").cast("int"))


def q_logit_coefficients(spark, d):
    res = L.logit(_li_target(spark, d), "is_return", _LOGIT_X)
    return _round(res.coefficients(spark), {"coef": 8, "se": 8, "z": 6, "p": 8, "odds_ratio": 8})


def q_logit_estimates(spark, d):
    res = L.logit(_li_target(spark, d), "is_return", _LOGIT_X)
    out = res.coefficients(spark).select("term", "coef", "se", "z", "odds_ratio", "significant")
    return _round(out, {"coef": 6, "se": 6, "z": 4, "odds_ratio": 6})


def q_logit_fit_stats(spark, d):
    res = L.logit(_li_target(spark, d), "is_return", _LOGIT_X)
    return _round(res.fit_stats(spark), {"base_rate": 8, "pseudo_r2": 8, "deviance": 3, "null_deviance": 3})


def q_logit_score_profile(spark, d):
    li = _li_target(spark, d)
    res = L.logit(li, "is_return", _LOGIT_X)
    return _round(res.score(res.median_profile(li)), {"probability": 6})


def q_logit_holdout(spark, d):
    data = L.stratified_split(_li_target(spark, d), "is_return", "row_key")
    res = L.logit(data.where("_train"), "is_return", _LOGIT_X)
    test = res.score(data.where(~F.col("_train")))
    return _round(L.confusion(test, "is_return", (F.col("probability") >= 0.3).cast("int")),
                  {"accuracy": 10, "sensitivity": 10, "specificity": 10})


def q_stratified_split(spark, d):
    data = L.stratified_split(_li_target(spark, d), "is_return", "row_key")
    return data.groupBy("is_return", "_train").agg(F.count("*").alias("n")).withColumnRenamed("_train", "train")


def _scored(spark, d):
    return _li_target(spark, d).withColumn("score", F.col("l_discount") * 10.0)


def q_confusion(spark, d):
    return _round(L.confusion(_scored(spark, d), "is_return", (F.col("score") >= 0.5).cast("int")),
                  {"accuracy": 10, "sensitivity": 10, "specificity": 10})


def q_cutoff_sweep(spark, d):
    return _round(L.cutoff_sweep(_scored(spark, d), "is_return", "score"),
                  {"cutoff": 2, "accuracy": 10, "sensitivity": 10, "specificity": 10})


# ---------------------------------------------------------------- classifiers
# customers of one market segment against the others, from all their numbers
_CLS_X = ["c_acctbal", "total_spend", "n_orders"]


def _cls_split(spark, d):
    rows = _customers(spark, d).select("c_custkey", *[F.col(c).cast("double").alias(c) for c in _CLS_X],
                                       (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    return M.prepare(rows, _CLS_X, "y", "c_custkey")


def q_scaler(spark, d):
    s = M.fit_scaler(_cls_split(spark, d).where("_train"), _CLS_X)
    return _round(s, {c: 6 for c in s.columns})


def q_knn(spark, d):
    return M.knn_classify(_cls_split(spark, d), _CLS_X, "y", "c_custkey", k=9)


def q_naive_bayes(spark, d):
    return M.gaussian_nb(_cls_split(spark, d), _CLS_X, "y", "c_custkey")


def q_tree_rules(spark, d):
    model, _ = M.tree(_cls_split(spark, d), _CLS_X, "y", "c_custkey", depth=4)
    return M.tree_rules(spark, model, _CLS_X)


def q_forest_importance(spark, d):
    model, _ = M.forest(_cls_split(spark, d), _CLS_X, "y", "c_custkey", trees=200)
    return _round(M.importance(spark, model, _CLS_X), {"importance": 8})


def q_compare_classifiers(spark, d):
    out = M.compare_classifiers(_cls_split(spark, d), _CLS_X, "y", "c_custkey")
    return _round(out, {"accuracy": 10, "sensitivity": 10, "specificity": 10})



# ---------------------------------------------------------------- segmentation
_SEG_X = ["c_acctbal", "total_spend", "n_orders"]


def _customers(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("total_spend"), F.count("*").alias("n_orders"))
    # customers without orders have spent nothing
    return _t(spark, d, "customer").join(o, "c_custkey", "left").fillna(0, ["total_spend", "n_orders"])


def q_cluster_scaled(spark, d):
    out = G.scale_for_clustering(_customers(spark, d), _SEG_X).select("c_custkey", *[f"{c}_z" for c in _SEG_X])
    return _round(out, {f"{c}_z": 8 for c in _SEG_X})


def q_elbow(spark, d):
    return _round(G.elbow(_customers(spark, d), _SEG_X, range(1, 8)), {"inertia": 4})


def q_kmeans_segments(spark, d):
    seg = G.kmeans_segments(_customers(spark, d), _SEG_X, 4, restarts=10)
    return seg.labels.select("c_custkey", "cluster")


_FIRST_CENTRES = [[-1.0, -1.0, -1.0], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [-1.0, 1.0, 1.0]]


def q_kmeans_from(spark, d):
    seg = G.kmeans_from(_customers(spark, d), _SEG_X, _FIRST_CENTRES, max_iter=3, tol=0.0)
    out = G.cluster_profiles(seg.labels, [f"{c}_z" for c in _SEG_X], "cluster")
    return _round(out, {f"{c}_z": 8 for c in _SEG_X})


def q_ward_segments(spark, d):
    return G.ward_segments(_customers(spark, d), _SEG_X, 4).select("c_custkey", "cluster")


def q_ward_merges(spark, d):
    return _round(G.ward_merges(_customers(spark, d), _SEG_X, last=30), {"height": 8})


def q_silhouette(spark, d):
    c = G.scale_for_clustering(_customers(spark, d), _SEG_X)
    return _round(G.silhouette_table(c, [f"{x}_z" for x in _SEG_X], "c_mktsegment"), {"silhouette": 10})


def q_cluster_sizes(spark, d):
    return G.cluster_sizes(_customers(spark, d), "c_mktsegment")


def q_cluster_profiles(spark, d):
    return _round(G.cluster_profiles(_customers(spark, d), _SEG_X, "c_mktsegment"), {c: 6 for c in _SEG_X})


def q_compare_segments(spark, d):
    cust = _customers(spark, d)
    km = G.kmeans_segments(cust, _SEG_X, 4, restarts=3).labels.select("c_custkey", F.col("cluster").alias("kmeans"))
    wd = G.ward_segments(cust, _SEG_X, 4).select("c_custkey", F.col("cluster").alias("ward"))
    return G.compare_segments(km.join(wd, "c_custkey"), "kmeans", "ward")



# ---------------------------------------------------------------- text
# a small polarity lexicon and aspect list over words that occur in `documents`
_LEXICON = [("rewh", 0.5), ("orre", -0.4), ("thatin", 0.8), ("ononst", -0.6), ("inoran", 0.3),
            ("orantion", -0.2), ("hehely", 1.0), ("ble", -1.0), ("tion", 0.1), ("ther", -0.3)]
_ASPECTS = [("service", ["rewh", "hehely"]), ("value", ["thatin", "orre"]), ("quality", ["ononst", "ble"]),
            ("missing", ["zzzz"])]


# English function words dropped by ``top_words_english_stop`` (both sides use this list)
_EN_STOP = """a about above after again all am an and any are as at be because been before being below between both
but by can did do does doing down during each few for from further had has have having he her here hers him his how i
if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should
so some such than that the their them then there these they this those through to too under until up very was we were
what when where which while who whom why will with you your""".split()


def _lexicon(spark):
    return spark.createDataFrame(_LEXICON, "word string, polarity double")


def _doc_polarity(spark, d):
    return T.with_polarity(_t(spark, d, "documents"), "text", _lexicon(spark))


def q_tokens(spark, d):
    return T.tokens(_t(spark, d, "documents"), "doc_id", "text")


def q_word_counts(spark, d):
    return T.word_counts(_t(spark, d, "documents"), "text", stem=False)


def q_top_words(spark, d):
    return T.top_words(_t(spark, d, "documents"), "text", 15)


def q_top_words_unstemmed(spark, d):
    return T.top_words(_t(spark, d, "documents"), "text", 15, stem=False)


def q_top_words_english_stop(spark, d):
    return T.top_words(_t(spark, d, "documents"), "text", 15, stem=False, stop=_EN_STOP)


def q_word_weights(spark, d):
    return _round(T.word_weights(_t(spark, d, "documents"), "text", stem=False), {"weight": 10})


def q_polarity(spark, d):
    return _round(T.polarity(_t(spark, d, "documents"), "doc_id", "text", _lexicon(spark)), {"polarity": 10})


_NEGATIONS = ["the", "not"]
_INTENSIFIERS = [("of", 1.5), ("and", 2.0)]


def q_polarity_modifiers(spark, d):
    more = spark.createDataFrame(_INTENSIFIERS, "word string, intensity double")
    return _round(T.polarity(_t(spark, d, "documents"), "doc_id", "text", _lexicon(spark), negations=_NEGATIONS,
                             intensifiers=more), {"polarity": 8})


def q_polarity_summary(spark, d):
    return _round(T.polarity_summary(_doc_polarity(spark, d)),
                  {"share_positive": 10, "share_negative": 10, "mean_polarity": 10})


def q_polarity_histogram(spark, d):
    # polarity is an average of lexicon values and lands on bin edges; round it
    # first so that summation order cannot move a value across an edge
    pol = _round(_doc_polarity(spark, d), {"polarity": 10})
    return _round(V.histogram(pol, "polarity", 30), {"lo": 8, "hi": 8})


def q_polarity_rating_corr(spark, d):
    j = _doc_polarity(spark, d).join(_t(spark, d, "labels"), "doc_id")
    return _round(C.corr(j, "polarity", "quality"), {"r": 10})


def q_aspect_sentiment(spark, d):
    return _round(T.aspect_sentiment(_doc_polarity(spark, d), "text", "polarity", _ASPECTS), {"mean_polarity": 10})


def q_topics(spark, d):
    return _round(T.topics(_t(spark, d, "documents"), "text", k=3, min_df=5, top=8), {"weight": 8})



# ---------------------------------------------------------------- image colour statistics
def _pixels(spark, d):
    """A pixel table derived from `embeddings`: each component with its two
    successors (around the end) is a pixel, mapped to 0..255 colour channels;
    225 vectors make an image of 14,400 pixels."""
    e = _t(spark, d, "embeddings")
    ch = lambda i: F.floor((F.element_at("embedding", (i % F.size("embedding") + 1).cast("int")).cast("double") + 1.0)
                           * 127.5).cast("double")
    p = F.col("p")
    pixels = e.select(F.floor(F.col("vec_id") / 225).cast("string").alias("block"), "embedding",
                      F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("p"))
    return pixels.select(F.concat(F.lit("image-"), "block").alias("image"), ch(p).alias("r"), ch(p + 1).alias("g"),
                         ch(p + 2).alias("b"))


def q_image_stats(spark, d):
    return _round(I.image_stats(_pixels(spark, d)), {"brightness": 8, "colorfulness": 8})


def q_image_batch_summary(spark, d):
    out = I.batch_summary(I.image_stats(_pixels(spark, d)))
    return _round(out, {c: 8 for c in out.columns if c != "n_images"})


def _images(spark, d):
    """Images in the form of ``load_images`` from `embeddings`: a vector's
    leading components are a row of blue, green and red bytes, 225 vectors an image."""
    e = _t(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    width = F.floor(F.size("embedding") / 3).cast("int")
    byte = lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1.0) * 127.5).cast("int") % 256), 2, "0")
    row = F.array_join(F.transform(F.slice("embedding", F.lit(1), 3 * width), byte), "")
    rows = e.groupBy(F.floor(F.col("vec_id") / 225).cast("string").alias("block")).agg(
        F.count("*").cast("int").alias("height"), F.min(width).alias("width"),
        F.array_sort(F.collect_list(F.struct("vec_id", row.alias("row")))).alias("rows"))
    return rows.select(F.concat(F.lit("image-"), "block").alias("image"), "height", "width", F.lit(3).alias("channels"),
                       F.lit(16).alias("mode"), F.unhex(F.array_join(F.col("rows.row"), "")).alias("data"),
                       F.lit("ok").alias("status"))


def q_image_resized_stats(spark, d):
    return _round(I.image_stats(I.pixels(_images(spark, d), resample="cubic")), {"brightness": 8, "colorfulness": 8})


def q_dominant_colors(spark, d):
    return _round(I.dominant_colors(_pixels(spark, d), k=5), {"share": 8})



# ---------------------------------------------------------------- sources and pipelines
def q_read_table(spark, d):
    return IO.read_table(spark, f"{d}/part.parquet").select("p_partkey", "p_type", "p_size")


def q_catalog_default(spark, d):
    cat = IO.Catalog({"parts": f"{d}/part.parquet", "nations": f"{d}/nation.parquet"}, default="nations")
    return cat.load(spark, "no-such-dataset")


def q_pipeline(spark, d):
    pipe = IO.Pipeline([
        lambda df: W.filter_in(df, "event_type", ["click", "view"]),
        lambda df: W.impute(df, "value", "mean"),
    ])
    out = pipe.apply(_events_nulls(spark, d)).select("event_id", "event_type", "value")
    return _round(out, {"value": 4})


def q_outliers_first15(spark, d):
    out = D.outliers(_t(spark, d, "events"), "value", "iqr").orderBy("event_id").limit(15)
    return out.select("event_id", "value")


def q_outliers_by(spark, d):
    return D.outliers(_t(spark, d, "events"), "value", "iqr", by=["event_type"]).select("event_id", "event_type", "value")


def q_outlier_counts_events(spark, d):
    return _round(D.outlier_counts(_t(spark, d, "events"), "value"), {"lower_fence": 6, "upper_fence": 6})


def q_zscore_histogram(spark, d):
    z = D.add_zscore(_t(spark, d, "customer"), "c_acctbal")
    return _round(V.histogram(z, ["c_acctbal", "c_acctbal_z"], 20), {"lo": 6, "hi": 6})


def q_kfold_rmse(spark, d):
    v = R.kfold_rmse(_keyed_lineitem(spark, d), _OLS, "row_key", 5, 42)
    return spark.createDataFrame([(round(v, 6),)], "cv_rmse double")



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "summary_measures": q_summary_measures,
        "preview": q_preview,
        "shape": q_shape,
        "profile": q_profile,
        "roles": q_roles,
        "impute_median": q_impute_median,
        "impute_mean": q_impute_mean,
        "drop_missing": q_drop_missing,
        "drop_report": q_drop_report,
        "filter_num_median": q_filter_num_median,
        "filter_num_value": q_filter_num_value,
        "filter_in": q_filter_in,
        "filter_in_empty": q_filter_in_empty,
        "filter_preview": q_filter_preview,
        "pool_rare": q_pool_rare,
        "bin_equal_width": q_bin_equal_width,
        "date_features": q_date_features,
        "summary_by_group": q_summary_by_group,
        "box_stats": q_box_stats,
        "box_stats_by": q_box_stats_by,
        "outliers_iqr": q_outliers_iqr,
        "outliers_z": q_outliers_z,
        "outlier_counts": q_outlier_counts,
        "add_zscore": q_add_zscore,
        "add_outlier_flag": q_add_outlier_flag,
        "percentile_rank": q_percentile_rank,
        "percentile_rank_unrounded": q_percentile_rank_unrounded,
        "standardize": q_standardize,
        "scale_report": q_scale_report,
        "frequency": q_frequency,
        "frequency_events": q_frequency_events,
        "histogram": q_histogram,
        "histogram_multi": q_histogram_multi,
        "skew_label": q_skew_label,
        "crosstab": q_crosstab,
        "crosstab_row": q_crosstab_row,
        "scatter": q_scatter,
        "monthly_series": q_monthly_series,
        "corr_pearson": q_corr_pearson,
        "corr_spearman": q_corr_spearman,
        "corr_kendall": q_corr_kendall,
        "corr_kendall_customer": q_corr_kendall_customer,
        "corr_matrix": q_corr_matrix,
        "corr_matrix_spearman": q_corr_matrix_spearman,
        "corr_report": q_corr_report,
        "ttest_1samp": q_ttest_1samp,
        "ttest_1samp_median": q_ttest_1samp_median,
        "ttest_welch": q_ttest_welch,
        "ttest_paired": q_ttest_paired,
        "chi2_orders": q_chi2_orders,
        "chi2_yates": q_chi2_yates,
        "chi2_expected": q_chi2_expected,
        "anova_oneway": q_anova_oneway,
        "anova_twoway": q_anova_twoway,
        "anova_twoway_sums": q_anova_twoway_sums,
        "anova_twoway_interaction_sums": q_anova_twoway_interaction_sums,
        "anova_twoway_interaction": q_anova_twoway_interaction,
        "anova_threeway": q_anova_threeway,
        "group_means": q_group_means,
        "posthoc_tukey": q_posthoc_tukey,
        "posthoc_tukey_spans": q_posthoc_tukey_spans,
        "posthoc_scheffe": q_posthoc_scheffe,
        "posthoc_bonferroni": q_posthoc_bonferroni,
        "ols_coefficients": q_ols_coefficients,
        "ols_estimates": q_ols_estimates,
        "ols_fit_stats": q_ols_fit_stats,
        "ols_residuals": q_ols_residuals,
        "ols_square": q_ols_square,
        "ols_log": q_ols_log,
        "ols_categorical": q_ols_categorical,
        "ols_categorical_estimates": q_ols_categorical_estimates,
        "check_positive": q_check_positive,
        "qq_points": q_qq_points,
        "resid_histogram": q_resid_histogram,
        "vif": q_vif,
        "breusch_pagan": q_breusch_pagan,
        "durbin_watson": q_durbin_watson,
        "jarque_bera": q_jarque_bera,
        "holdout_rmse": q_holdout_rmse,
        "compare_square": q_compare_square,
        "logit_coefficients": q_logit_coefficients,
        "logit_estimates": q_logit_estimates,
        "logit_fit_stats": q_logit_fit_stats,
        "logit_score_profile": q_logit_score_profile,
        "logit_holdout": q_logit_holdout,
        "stratified_split": q_stratified_split,
        "confusion": q_confusion,
        "cutoff_sweep": q_cutoff_sweep,
        "scaler": q_scaler,
        "knn": q_knn,
        "naive_bayes": q_naive_bayes,
        "tree_rules": q_tree_rules,
        "forest_importance": q_forest_importance,
        "compare_classifiers": q_compare_classifiers,
        "cluster_scaled": q_cluster_scaled,
        "elbow": q_elbow,
        "kmeans_segments": q_kmeans_segments,
        "kmeans_from": q_kmeans_from,
        "ward_segments": q_ward_segments,
        "ward_merges": q_ward_merges,
        "silhouette": q_silhouette,
        "cluster_sizes": q_cluster_sizes,
        "cluster_profiles": q_cluster_profiles,
        "compare_segments": q_compare_segments,
        "tokens": q_tokens,
        "word_counts": q_word_counts,
        "top_words": q_top_words,
        "top_words_unstemmed": q_top_words_unstemmed,
        "top_words_english_stop": q_top_words_english_stop,
        "word_weights": q_word_weights,
        "polarity": q_polarity,
        "polarity_modifiers": q_polarity_modifiers,
        "outliers_by": q_outliers_by,
        "polarity_summary": q_polarity_summary,
        "polarity_histogram": q_polarity_histogram,
        "polarity_rating_corr": q_polarity_rating_corr,
        "aspect_sentiment": q_aspect_sentiment,
        "topics": q_topics,
        "image_stats": q_image_stats,
        "image_batch_summary": q_image_batch_summary,
        "image_resized_stats": q_image_resized_stats,
        "dominant_colors": q_dominant_colors,
        "read_table": q_read_table,
        "catalog_default": q_catalog_default,
        "table_pipeline": q_pipeline,
        "outliers_first15": q_outliers_first15,
        "outlier_counts_events": q_outlier_counts_events,
        "zscore_histogram": q_zscore_histogram,
        "kfold_rmse": q_kfold_rmse,
    }
    if _llm is not None:
        out |= _llm.queries()
    if corpus_pipeline is not None:
        out["pipeline"] = corpus_pipeline.run
    return out


_PROFILE_SQL = """
SELECT * FROM (
  SELECT 'c_custkey' AS "column", 'bigint' AS dtype, count(*) - count(c_custkey) AS missing,
         count(DISTINCT c_custkey) AS unique, CAST(NULL AS DOUBLE) AS mean_len,
         round(min(c_custkey)::DOUBLE, 4) AS min_value, round(max(c_custkey)::DOUBLE, 4) AS max_value FROM customer
  UNION ALL SELECT 'c_name', 'string', count(*) - count(c_name), count(DISTINCT c_name), round(avg(length(c_name)), 6), NULL, NULL FROM customer
  UNION ALL SELECT 'c_nationkey', 'int', count(*) - count(c_nationkey), count(DISTINCT c_nationkey), NULL,
         round(min(c_nationkey)::DOUBLE, 4), round(max(c_nationkey)::DOUBLE, 4) FROM customer
  UNION ALL SELECT 'c_acctbal', 'double', count(*) - count(c_acctbal), count(DISTINCT c_acctbal), NULL,
         round(min(c_acctbal), 4), round(max(c_acctbal), 4) FROM customer
  UNION ALL SELECT 'c_mktsegment', 'string', count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment),
         round(avg(length(c_mktsegment)), 6), NULL, NULL FROM customer
) p, LATERAL (SELECT CASE
    WHEN lower(p."column") LIKE '%date%' THEN 'date'
    WHEN p.dtype IN ('bigint','int','double') AND p.unique = 2 AND p.min_value = 0 AND p.max_value = 1 THEN 'binary'
    WHEN p.dtype IN ('bigint','int','double') AND p.unique <= 10 THEN 'numeric, few values'
    WHEN p.dtype IN ('bigint','int','double') THEN 'numeric'
    WHEN p.dtype = 'string' AND p.mean_len > 30 THEN 'text'
    WHEN p.dtype = 'string' AND p.unique <= 25 THEN 'categorical'
    WHEN p.dtype = 'string' THEN 'categorical, many levels' ELSE 'other' END AS role)
"""

_ROLES_SQL = """
WITH p AS (
  SELECT 'doc_id' AS "column", 'bigint' AS dtype, count(DISTINCT doc_id) AS u, NULL::DOUBLE AS ml, min(doc_id)::DOUBLE lo, max(doc_id)::DOUBLE hi FROM documents
  UNION ALL SELECT 'text', 'string', count(DISTINCT text), avg(length(text)), NULL, NULL FROM documents
  UNION ALL SELECT 'lang', 'string', count(DISTINCT lang), avg(length(lang)), NULL, NULL FROM documents
  UNION ALL SELECT 'source', 'string', count(DISTINCT source), avg(length(source)), NULL, NULL FROM documents
  UNION ALL SELECT 'n_chars', 'bigint', count(DISTINCT n_chars), NULL, min(n_chars), max(n_chars) FROM documents)
SELECT "column",
       dtype <> 'string' AS is_numeric,
       (dtype = 'string' AND u <= 25) OR (dtype <> 'string' AND u <= 10) AS is_categorical,
       COALESCE(dtype = 'string' AND ml > 30, FALSE) AS is_text,
       lower("column") LIKE '%date%' AS is_date,
       COALESCE(dtype <> 'string' AND u = 2 AND lo = 0 AND hi = 1, FALSE) AS is_binary
FROM p
"""

_EVENTS_NULLS = "(SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events)"


def _hist_bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    step = f"(({hi}) - ({lo})) / {n}"
    terms = " + ".join(f"CASE WHEN {x} >= {k} * {step} + ({lo}) THEN 1 ELSE 0 END" for k in range(1, n))
    return f"(1 + {terms})"


def _bin_equal_width_sql() -> str:
    n = 5
    step = "((hi - lo) / 5)"
    edge = lambda k: f"({k} * {step} + lo)" if k < n else "hi"
    e0 = f"(lo - (hi - lo) * 0.001)"
    edges = [e0] + [edge(k) for k in range(1, n + 1)]
    binx = "(1 + " + " + ".join(f"CASE WHEN p_retailprice > {edges[k]} THEN 1 ELSE 0 END" for k in range(1, n)) + ")"
    lab = lambda e: f"CAST(round({e}, 3) AS VARCHAR)"
    cases_lab = " ".join(f"WHEN {k + 1} THEN '(' || {lab(edges[k])} || ', ' || {lab(edges[k + 1])} || ']'" for k in range(n))
    cases_lo = " ".join(f"WHEN {k + 1} THEN {edges[k]}" for k in range(n))
    cases_hi = " ".join(f"WHEN {k + 1} THEN {edges[k + 1]}" for k in range(n))
    return f"""
    WITH mm AS (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part),
    b AS (SELECT p_partkey, p_retailprice, lo, hi, CAST({binx} AS INTEGER) AS bin FROM part, mm)
    SELECT p_partkey, CASE bin {cases_lab} END AS p_retailprice_group, bin AS p_retailprice_bin,
           round(CASE bin {cases_lo} END, 6) AS p_retailprice_lo, round(CASE bin {cases_hi} END, 6) AS p_retailprice_hi
    FROM b"""


def _hist_sql(table: str, cols: list[str], n: int) -> str:
    # edges are materialised once, then rows are compared with them (no
    # arithmetic inside the comparison that an optimizer could rearrange)
    parts = []
    for c in cols:
        edge_cols = ", ".join(f"{k} * ((hi - lo) / {n}) + lo AS e{k}" for k in range(1, n))
        binx = "1 + " + " + ".join(f"CASE WHEN x.v >= ed.e{k} THEN 1 ELSE 0 END" for k in range(1, n))
        parts.append(f"""
        SELECT '{c}' AS "column", CAST(g.bin AS INTEGER) AS bin, round(g.k * ((hi - lo) / {n}) + lo, 6) AS lo,
               round(CASE WHEN g.bin = {n} THEN hi ELSE g.bin * ((hi - lo) / {n}) + lo END, 6) AS hi,
               CAST(count(xb.bin) AS BIGINT) AS count
        FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END::DOUBLE lo,
                     CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END::DOUBLE hi FROM {table}) mm
        CROSS JOIN (SELECT range + 1 AS bin, range AS k FROM range({n})) g
        LEFT JOIN (SELECT {binx} AS bin FROM (SELECT {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL) x,
                   (SELECT {edge_cols} FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END::DOUBLE lo,
                     CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END::DOUBLE hi FROM {table})) ed) xb
          ON xb.bin = g.bin
        GROUP BY g.bin, g.k, lo, hi""")
    return " UNION ALL ".join(parts)


_DATE_SQL = """
SELECT o_orderkey,
  CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'
       WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS o_orderdate_season,
  strftime(o_orderdate, '%B') AS o_orderdate_month,
  'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS o_orderdate_quarter,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
  strftime(o_orderdate, '%A') AS o_orderdate_dayofweek,
  CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS o_orderdate_weekend,
  CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS o_orderdate_days_since,
  CAST(round_even(datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 30.44, 1) AS DOUBLE) AS o_orderdate_months_since,
  CASE WHEN month(o_orderdate) IN (11, 12) THEN 1 ELSE 0 END AS o_orderdate_holiday_season
FROM orders
"""


def _box_sql(table: str, col: str, by: str | None, dec: int) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    r = lambda e: f"round({e}, {dec})"
    return f"""
    WITH q AS (SELECT {g}quantile_cont({col}, 0.25) q1, quantile_cont({col}, 0.5) median, quantile_cont({col}, 0.75) q3
               FROM {table} {gb}),
    f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
    SELECT {g}{r('q1')} q1, {r('median')} median, {r('q3')} q3, {r('iqr')} iqr, {r('lower_fence')} lower_fence,
           {r('upper_fence')} upper_fence, count(*) AS n,
           {r(f'min(CASE WHEN {col} BETWEEN lower_fence AND upper_fence THEN {col} END)')} whisker_low,
           {r(f'max(CASE WHEN {col} BETWEEN lower_fence AND upper_fence THEN {col} END)')} whisker_high,
           count(*) FILTER (WHERE NOT ({col} BETWEEN lower_fence AND upper_fence)) AS n_outliers
    FROM {table} JOIN f {j}
    GROUP BY {g}q1, median, q3, iqr, lower_fence, upper_fence"""


_FENCE_CTE = """f AS (SELECT quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS lo,
                      quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS hi
               FROM lineitem)"""

_Z_CTE = "z AS (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM lineitem)"


def _std_sql() -> str:
    cols = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_z" for c in _STD_COLS)
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM lineitem"


def _scale_sql() -> str:
    parts = []
    for c in _STD_COLS:
        z = f"(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem))"
        for stage, e in (("before", c), ("after", z)):
            parts.append(
                f"SELECT '{c}' AS \"column\", '{stage}' AS stage, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS sd, "
                f"round(min({e}), 6) AS min, round(max({e}), 6) AS max FROM lineitem")
    return " UNION ALL ".join(parts)


def _pct_sql(table: str, key: str, col: str, rounding: str) -> str:
    return f"""
    SELECT {key}, {rounding} AS {col}_pctile FROM (
      SELECT {key}, (rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)
                    / count({col}) OVER () * 100.0 AS p FROM {table})"""


def _kendall_sql(table: str, a: str, b: str) -> str:
    return f"""
    WITH p AS (SELECT {a}::DOUBLE x, {b}::DOUBLE y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
    c AS (SELECT x, y, count(*)::DOUBLE w FROM p GROUP BY x, y),
    s AS (SELECT sum(c1.w * c2.w * sign(c1.x - c2.x) * sign(c1.y - c2.y)) / 2 AS s FROM c c1, c c2),
    t AS (SELECT count(*)::DOUBLE n FROM p),
    tx AS (SELECT sum(k * (k - 1) / 2) v FROM (SELECT count(*)::DOUBLE k FROM p GROUP BY x)),
    ty AS (SELECT sum(k * (k - 1) / 2) v FROM (SELECT count(*)::DOUBLE k FROM p GROUP BY y))
    SELECT '{a}' AS col_a, '{b}' AS col_b, 'kendall' AS method, CAST(n AS BIGINT) AS n,
           round(s / sqrt((n * (n - 1) / 2 - tx.v) * (n * (n - 1) / 2 - ty.v)), 10) AS r
    FROM s, t, tx, ty"""


def _avg_rank_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def _spearman_sql(table: str, a: str, b: str) -> str:
    return f"""
    WITH p AS (SELECT {a}::DOUBLE x, {b}::DOUBLE y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
    r AS (SELECT {_avg_rank_sql('x')} rx, {_avg_rank_sql('y')} ry FROM p)
    SELECT '{a}' AS col_a, '{b}' AS col_b, 'spearman' AS method, count(*) AS n, round(corr(rx, ry), 10) AS r FROM r"""


def _corr_matrix_sql(cols: list[str]) -> str:
    parts = []
    for x in cols:
        for y in cols:
            r = "1.0" if x == y else f"round(corr({x}, {y}), 10)"
            src = "" if x == y else " FROM lineitem"
            parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, {r} AS r{src}")
    return " UNION ALL ".join(parts)


def _spearman_matrix_sql(cols: list[str]) -> str:
    parts = []
    for x in cols:
        for y in cols:
            if x == y:
                parts.append(f"SELECT '{x}' AS col_a, '{y}' AS col_b, 1.0 AS r")
            else:
                parts.append(f"SELECT col_a, col_b, r FROM ({_spearman_sql('lineitem', x, y)})")
    return " UNION ALL ".join(parts)


_CHI_CELLS = """
    cells AS (SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey)::DOUBLE AS obs
              FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
              LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority
              GROUP BY ALL),
    ex AS (SELECT *, sum(obs) OVER (PARTITION BY o_orderstatus) * sum(obs) OVER (PARTITION BY o_orderpriority)
                      / sum(obs) OVER () AS e FROM cells)"""

_CHI_ORDERS_SQL = f"""
WITH {_CHI_CELLS},
st AS (SELECT sum((obs - e) * (obs - e) / e) x, sum(obs) n, min(e) me FROM ex)
SELECT round(x, 8) AS chi2, CAST(8 AS BIGINT) AS dof,
       round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 10) AS p,
       CAST(n AS BIGINT) AS n, round(sqrt(x / (n * 2)), 10) AS cramers_v,
       CASE WHEN sqrt(x / (n * 2)) < 0.1 THEN 'negligible' WHEN sqrt(x / (n * 2)) < 0.3 THEN 'weak'
            WHEN sqrt(x / (n * 2)) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength,
       round(me, 8) AS min_expected, me < 5 AS low_expected,
       exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6) < 0.05 AS significant
FROM st"""

_CHI_YATES_SQL = """
WITH cells AS (SELECT q.quality, t.toxic, count(l.doc_id)::DOUBLE obs
               FROM (SELECT DISTINCT quality FROM labels) q CROSS JOIN (SELECT DISTINCT toxic FROM labels) t
               LEFT JOIN labels l ON l.quality = q.quality AND l.toxic = t.toxic GROUP BY ALL),
ex AS (SELECT *, sum(obs) OVER (PARTITION BY quality) * sum(obs) OVER (PARTITION BY toxic) / sum(obs) OVER () AS e
       FROM cells),
st AS (SELECT sum(pow(abs(obs - e) - least(0.5, abs(obs - e)), 2) / e) x, sum(obs) n, min(e) me FROM ex)
SELECT round(x, 8) AS chi2, CAST(1 AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, round(sqrt(x / n), 10) AS cramers_v,
       CASE WHEN sqrt(x / n) < 0.1 THEN 'negligible' WHEN sqrt(x / n) < 0.3 THEN 'weak'
            WHEN sqrt(x / n) < 0.5 THEN 'moderate' ELSE 'strong' END AS strength,
       round(me, 8) AS min_expected, me < 5 AS low_expected
FROM st"""

_CHI_EXPECTED_SQL = f"""
WITH {_CHI_CELLS}
SELECT o_orderstatus, o_orderpriority, CAST(obs AS BIGINT) AS observed, round(e, 8) AS expected,
       round((obs - e) * (obs - e) / e, 8) AS contribution FROM ex"""

_ANOVA1_SQL = """
WITH g AS (SELECT l_returnflag, count(*) n, avg(l_quantity) m, var_pop(l_quantity) * count(*) ss FROM lineitem
           GROUP BY l_returnflag),
t AS (SELECT sum(n) n, sum(n * m) / sum(n) gm, sum(ss) ssw, count(*) k FROM g),
b AS (SELECT sum(g.n * (g.m - t.gm) * (g.m - t.gm)) ssb FROM g, t),
f AS (SELECT ssb, ssw, k - 1 AS d1, n - k AS d2, (ssb / (k - 1)) / (ssw / (n - k)) AS fv FROM b, t)
SELECT 'l_returnflag' AS term, round(ssb, 4) AS sum_sq, CAST(d1 AS DOUBLE) AS df, round(fv, 8) AS F,
       round(pow(1 + 2 * fv / d2, -d2 / 2), 10) AS p, pow(1 + 2 * fv / d2, -d2 / 2) < 0.05 AS significant FROM f
UNION ALL
SELECT 'Residual', round(ssw, 4), CAST(d2 AS DOUBLE), NULL, NULL, FALSE FROM f"""

_SCHEFFE_SQL = """
WITH g AS (SELECT l_returnflag AS grp, count(*) n, avg(l_quantity) m FROM lineitem GROUP BY l_returnflag),
t AS (SELECT sum(n) n, count(*) k FROM g),
w AS (SELECT sum(pow(l_quantity - g.m, 2)) / ((SELECT n FROM t) - (SELECT k FROM t)) mse
      FROM lineitem JOIN g ON l_returnflag = g.grp),
pr AS (SELECT a.grp g1, b.grp g2, pow(a.m - b.m, 2) / (w.mse * (1.0 / a.n + 1.0 / b.n) * (t.k - 1)) fv, t.n - t.k d2
       FROM g a JOIN g b ON a.grp < b.grp, w, t)
SELECT g1 AS group1, g2 AS group2, round(pow(1 + 2 * fv / d2, -d2 / 2), 10) AS p FROM pr"""


def _ols2_ctes(src: str) -> str:
    """CTEs fitting y ~ x1 + x2 in closed form over ``src`` (columns y, x1, x2)."""
    return f"""
    st AS (SELECT count(*)::DOUBLE n, avg(x1) m1, avg(x2) m2, avg(y) my,
                  var_pop(x1) * count(*) s11, var_pop(x2) * count(*) s22, covar_pop(x1, x2) * count(*) s12,
                  covar_pop(x1, y) * count(*) s1y, covar_pop(x2, y) * count(*) s2y, var_pop(y) * count(*) syy FROM ({src})),
    fa AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM st),
    fb AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM fa),
    fit AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, syy - (b1 * s1y + b2 * s2y) AS rss,
                   (syy - (b1 * s1y + b2 * s2y)) / (n - 3) AS s2 FROM fb)"""


def _ols2_coef_sql(src: str, names: tuple[str, str], dec: int = 6) -> str:
    se0 = "sqrt(s2 * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det))"
    se1, se2 = "sqrt(s2 * s22 / det)", "sqrt(s2 * s11 / det)"
    rows = [("Intercept", "b0", se0), (names[0], "b1", se1), (names[1], "b2", se2)]
    sel = " UNION ALL ".join(
        f"SELECT '{t}' AS term, round({b}, {dec}) AS coef, round({se}, {dec}) AS se, round({b} / {se}, 6) AS t FROM fit"
        for t, b, se in rows)
    return f"WITH {_ols2_ctes(src)} {sel}"


_SQ_SRC = "SELECT l_extendedprice AS y, l_quantity AS x1, l_quantity * l_quantity AS x2 FROM lineitem"
_LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_LI2 = ("SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_orderkey, l_linenumber, l_partkey, "
        "l_suppkey, l_extendedprice, l_shipdate FROM lineitem")

_RESID_CTE = f"""{_ols2_ctes(_LI2)},
    res AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, x1, x2, b0 + b1 * x1 + b2 * x2 AS fitted, y - (b0 + b1 * x1 + b2 * x2) AS e
            FROM ({_LI2}), fit)"""

_ROWKEY_SCORE = "(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || ':42'), 1, 8))::BIGINT / 4294967296.0)"


def _qq_sql(m: int) -> str:
    from custlens.functions.dist import norm_ppf

    probs = [j / (m + 1) for j in range(1, m + 1)]
    qs = ", ".join(f"quantile_cont(z, {p!r})" for p in probs)
    theo = ", ".join(repr(norm_ppf(p)) for p in probs)
    return f"""WITH {_RESID_CTE},
    z AS (SELECT (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS z FROM res),
    q AS (SELECT [{qs}] AS qs FROM z)
    SELECT CAST(round(unnest([{theo}]), 8) AS DOUBLE) AS theoretical, round(unnest(qs), 8) AS sample FROM q"""


def _resid_hist_sql() -> str:
    n = 30
    return f"""WITH {_RESID_CTE},
    mm AS (SELECT min(e) lo, max(e) hi FROM res),
    g AS (SELECT range + 1 AS bin, range AS k FROM range({n}))
    SELECT 'resid' AS "column", CAST(g.bin AS INTEGER) AS bin, round(g.k * ((hi - lo) / {n}) + lo, 4) AS lo,
           round(CASE WHEN g.bin = {n} THEN hi ELSE g.bin * ((hi - lo) / {n}) + lo END, 4) AS hi,
           CAST(count(res.e) AS BIGINT) AS count
    FROM mm CROSS JOIN g LEFT JOIN res ON {_hist_bin_sql('res.e', 'mm.lo', 'mm.hi', n)} = g.bin
    GROUP BY g.bin, g.k, lo, hi"""


def _holdout_sql() -> str:
    src = f"SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem WHERE {_ROWKEY_SCORE} < 0.7"
    return f"""WITH {_ols2_ctes(src)}
    SELECT round(sqrt(avg(pow(l_extendedprice - (b0 + b1 * l_quantity + b2 * l_discount), 2))), 6) AS holdout_rmse
    FROM lineitem, fit WHERE {_ROWKEY_SCORE} >= 0.7"""


_HASH42 = "(('0x' || substr(md5(CAST({k} AS VARCHAR) || ':42'), 1, 8))::BIGINT / 4294967296.0)"

_STRAT_SQL = f"""
WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return,
                  {_HASH42.format(k="CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)")} AS s FROM lineitem),
c AS (SELECT is_return, quantile_cont(s, 0.7) AS cut FROM b GROUP BY is_return)
SELECT is_return, s <= cut AS train, count(*) AS n FROM b JOIN c USING (is_return) GROUP BY ALL"""

_SCORE_SRC = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10.0 AS score FROM lineitem)"


def _ratio_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    return (f"round(({tp} + {tn}) / ({tp} + {fp} + {tn} + {fn})::DOUBLE, 10) AS accuracy, "
            f"round(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn})::DOUBLE END, 10) AS sensitivity, "
            f"round(CASE WHEN {tn} + {fp} > 0 THEN {tn} / ({tn} + {fp})::DOUBLE END, 10) AS specificity")


_CONFUSION_SQL = f"""
WITH c AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= 0.5) tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) fp,
                  count(*) FILTER (WHERE y = 0 AND score < 0.5) tn, count(*) FILTER (WHERE y = 1 AND score < 0.5) fn
           FROM {_SCORE_SRC})
SELECT tp, fp, tn, fn, {_ratio_sql()} FROM c"""

_SWEEP_SQL = f"""
WITH g AS (SELECT CAST(round(0.05 * range, 2) AS DOUBLE) AS cutoff FROM range(1, 19)),
c AS (SELECT cutoff, count(*) FILTER (WHERE y = 1 AND score >= cutoff) tp, count(*) FILTER (WHERE y = 0 AND score >= cutoff) fp,
             count(*) FILTER (WHERE y = 0 AND score < cutoff) tn, count(*) FILTER (WHERE y = 1 AND score < cutoff) fn
      FROM g, {_SCORE_SRC} GROUP BY cutoff)
SELECT cutoff, tp, fp, tn, fn, {_ratio_sql()} FROM c"""

_CUST = """(SELECT c.*, coalesce(o.total_spend, 0) AS total_spend, coalesce(o.n_orders, 0) AS n_orders FROM customer c LEFT JOIN
            (SELECT o_custkey, sum(o_totalprice) AS total_spend, count(*) AS n_orders FROM orders GROUP BY o_custkey) o
            ON c.c_custkey = o.o_custkey)"""

_CLS_SPLIT = f"""
    base AS (SELECT c_custkey, c_acctbal::DOUBLE e1, total_spend::DOUBLE e2, n_orders::DOUBLE e3,
                    CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y, {_HASH42.format(k="c_custkey")} AS s FROM {_CUST}),
    cut AS (SELECT y, quantile_cont(s, 0.7) AS c FROM base GROUP BY y),
    sp AS (SELECT base.*, s <= c AS train FROM base JOIN cut USING (y)),
    sc AS (SELECT avg(e1) m1, stddev_pop(e1) s1, avg(e2) m2, stddev_pop(e2) s2, avg(e3) m3, stddev_pop(e3) s3
           FROM sp WHERE train)"""

_SCALER_SQL = f"""WITH {_CLS_SPLIT}
SELECT {", ".join(f"round(m{i}, 6) AS {c}_mean, round(s{i}, 6) AS {c}_sd" for i, c in enumerate(_CLS_X, 1))} FROM sc"""

_KNN_SQL = f"""WITH {_CLS_SPLIT},
    z AS (SELECT c_custkey, y, train, (e1 - m1) / s1 z1, (e2 - m2) / s2 z2, (e3 - m3) / s3 z3 FROM sp, sc),
    pr AS (SELECT te.c_custkey tid, te.y ty, tr.c_custkey rid, tr.y ry,
                  0.0 + pow(te.z1 - tr.z1, 2) + pow(te.z2 - tr.z2, 2) + pow(te.z3 - tr.z3, 2) AS d
           FROM z te JOIN z tr ON NOT te.train AND tr.train),
    rk AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, rid) rn FROM pr),
    v AS (SELECT tid, ty, ry, count(*) c FROM rk WHERE rn <= 9 GROUP BY ALL),
    best AS (SELECT tid, ty, arg_max(ry, c * 10 - ry) AS pred FROM v GROUP BY tid, ty)
SELECT tid AS c_custkey, CAST(ty AS INTEGER) AS truth, CAST(pred AS INTEGER) AS pred FROM best"""

_NB_SQL = f"""WITH {_CLS_SPLIT},
    eps AS (SELECT greatest(var_pop(e1), var_pop(e2), var_pop(e3)) * 1e-9 AS e FROM sp WHERE train),
    cls AS (SELECT y AS cls, count(*) nc, avg(e1) m1, avg(e2) m2, avg(e3) m3,
                   var_pop(e1) + (SELECT e FROM eps) v1, var_pop(e2) + (SELECT e FROM eps) v2,
                   var_pop(e3) + (SELECT e FROM eps) v3 FROM sp WHERE train GROUP BY y),
    tot AS (SELECT count(*)::DOUBLE n FROM sp WHERE train),
    scored AS (SELECT t.c_custkey, t.y, c.cls,
                  ln(c.nc / tot.n)
                  - 0.5 * ln(2 * pi() * v1) - pow(t.e1 - m1, 2) / (2 * v1)
                  - 0.5 * ln(2 * pi() * v2) - pow(t.e2 - m2, 2) / (2 * v2)
                  - 0.5 * ln(2 * pi() * v3) - pow(t.e3 - m3, 2) / (2 * v3) AS ll
           FROM sp t, cls c, tot WHERE NOT t.train)
SELECT c_custkey, CAST(y AS INTEGER) AS truth, CAST(arg_max(cls, ll) AS INTEGER) AS pred FROM scored GROUP BY c_custkey, y"""


_Z_SQL = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}_z" for c in _SEG_X)

_Z_COLS = [f"{c}_z" for c in _SEG_X]
_MEANS_SQL = ", ".join(f"avg({z}) AS {z}" for z in _Z_COLS)


def _nearest_sql(name, centres):
    d = " + ".join(f"pow(z.{c} - m.{c}, 2)" for c in _Z_COLS)
    return (f"{name} AS (SELECT c_custkey, arg_min(cluster, {d}) AS cluster FROM z, {centres} m GROUP BY c_custkey)")


# three steps: rows to their nearest centre, centres to the means of their rows
_KMEANS_FROM_SQL = (
    f"WITH z AS MATERIALIZED (SELECT c_custkey, {_Z_SQL} FROM {_CUST}),\n"
    f"m0(cluster, {', '.join(_Z_COLS)}) AS (VALUES "
    + ", ".join(f"({i}, {', '.join(f'CAST({v} AS DOUBLE)' for v in c)})" for i, c in enumerate(_FIRST_CENTRES)) + "),\n"
    + ",\n".join(_nearest_sql(f"l{i}", f"m{i}") + f",\nm{i + 1} AS (SELECT cluster, {_MEANS_SQL} "
                 f"FROM z JOIN l{i} USING (c_custkey) GROUP BY cluster)" for i in range(3))
    + ",\n" + _nearest_sql("l3", "m3")
    + f"\nSELECT cluster, count(*) AS n, {', '.join(f'round(avg({z}), 8) AS {z}' for z in _Z_COLS)}"
    + " FROM z JOIN l3 USING (c_custkey) GROUP BY cluster")

_SIL_SQL = f"""
WITH z AS (SELECT c_mktsegment AS c, {_Z_SQL} FROM {_CUST}),
x AS (SELECT c, c_acctbal_z x1, total_spend_z x2, n_orders_z x3, x1 * x1 + x2 * x2 + x3 * x3 AS q FROM z),
cl AS (SELECT c, count(*) n, sum(q) sq, sum(x1) s1, sum(x2) s2, sum(x3) s3 FROM x GROUP BY c),
d AS (SELECT x.c AS own, cl.c AS other, cl.n, (x.q * cl.n - 2 * (x.x1 * cl.s1 + x.x2 * cl.s2 + x.x3 * cl.s3) + cl.sq) AS tot,
             x.x1, x.x2, x.x3 FROM x, cl),
per AS (SELECT own, x1, x2, x3,
               max(CASE WHEN own = other AND n > 1 THEN tot / (n - 1) END) AS a,
               max(CASE WHEN own = other THEN n END) AS nown,
               min(CASE WHEN own <> other THEN tot / n END) AS b FROM d GROUP BY own, x1, x2, x3)
SELECT round(avg(CASE WHEN nown > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 10) AS silhouette, count(*) AS n FROM per"""


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(T.REVIEW_STOP_WORDS)))
_EN_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(_EN_STOP)))
_TOK_SQL = f"""(SELECT doc_id, unnest(w) AS token, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos
               FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))"""
_WC_SQL = f"""SELECT token AS word, count(*) AS count FROM {_TOK_SQL}
              WHERE length(token) >= 3 AND token NOT IN ({_STOP_SQL}) GROUP BY token"""
_LEX_SQL = "(VALUES " + ", ".join(f"('{w}', {p!r})" for w, p in _LEXICON) + ") AS lex(word, polarity)"
_POL_SQL = f"""(SELECT d.doc_id, coalesce(p.pol, 0.0) AS polarity, coalesce(p.n, 0) AS n_matched, d.text
   FROM documents d LEFT JOIN (
     SELECT doc_id, avg(greatest(-1.0, least(1.0, lex.polarity))) AS pol, count(*) AS n
     FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents WHERE text IS NOT NULL) t
     JOIN {_LEX_SQL} USING (word) GROUP BY doc_id) p USING (doc_id) WHERE d.text IS NOT NULL)"""


def _aspect_sql() -> str:
    parts = []
    for name, kws in _ASPECTS:
        cond = " OR ".join(f"contains(lower(text), '{k}')" for k in kws)
        parts.append(f"SELECT '{name}' AS aspect, count(*) AS n, round(avg(polarity), 10) AS mean_polarity "
                     f"FROM {_POL_SQL} WHERE {cond} HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


_PIX_SQL = """(SELECT 'image-' || CAST(vec_id // 225 AS VARCHAR) AS image,
                      floor((embedding[p % len(embedding) + 1]::DOUBLE + 1.0) * 127.5) AS r,
                      floor((embedding[(p + 1) % len(embedding) + 1]::DOUBLE + 1.0) * 127.5) AS g,
                      floor((embedding[(p + 2) % len(embedding) + 1]::DOUBLE + 1.0) * 127.5) AS b
               FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS p FROM embeddings))"""

_IMG_STATS_SQL = f"""SELECT image, count(*) AS n_pixels, avg((r + g + b) / 3.0) AS brightness,
       sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg(0.5 * (r + g) - b), 2)) AS colorfulness
FROM {_PIX_SQL} GROUP BY image"""


_EV_FENCE = """f AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
                      quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi
               FROM events)"""


def _kfold_sql() -> str:
    score = _ROWKEY_SCORE
    return f"""
    WITH g AS (SELECT avg(l_quantity) c1, avg(l_discount) c2, avg(l_extendedprice) cy FROM lineitem),
    z AS (SELECT least(floor({score} * 5), 4) AS fold, l_quantity - c1 AS a, l_discount - c2 AS b,
                 l_extendedprice - cy AS y FROM lineitem, g),
    fs AS (SELECT fold, count(*)::DOUBLE n, sum(a) sa, sum(b) sb, sum(y) sy, sum(a * a) saa, sum(b * b) sbb,
                  sum(a * b) sab, sum(a * y) say, sum(b * y) sby, sum(y * y) syy FROM z GROUP BY fold),
    tot AS (SELECT sum(n) n, sum(sa) sa, sum(sb) sb, sum(sy) sy, sum(saa) saa, sum(sbb) sbb, sum(sab) sab,
                   sum(say) say, sum(sby) sby, sum(syy) syy FROM fs),
    tr AS (SELECT fs.fold, t.n - fs.n n, t.sa - fs.sa sa, t.sb - fs.sb sb, t.sy - fs.sy sy, t.saa - fs.saa saa,
                  t.sbb - fs.sbb sbb, t.sab - fs.sab sab, t.say - fs.say say, t.sby - fs.sby sby FROM fs, tot t),
    cen AS (SELECT fold, sa / n ma, sb / n mb, sy / n my, saa - sa * sa / n caa, sbb - sb * sb / n cbb,
                   sab - sa * sb / n cab, say - sa * sy / n cay, sby - sb * sy / n cby FROM tr),
    co AS (SELECT fold, ma, mb, my, (cbb * cay - cab * cby) / (caa * cbb - cab * cab) b1,
                  (caa * cby - cab * cay) / (caa * cbb - cab * cab) b2 FROM cen),
    fit AS (SELECT fold, b1, b2, my - b1 * ma - b2 * mb AS a0 FROM co),
    err AS (SELECT z.fold, sqrt(avg(pow(z.y - (fit.a0 + fit.b1 * z.a + fit.b2 * z.b), 2))) rmse
            FROM z JOIN fit USING (fold) GROUP BY z.fold)
    SELECT round(avg(rmse), 6) AS cv_rmse FROM err"""


# ---------------------------------------------------------------- least squares in SQL
def _lsq_columns(p: int) -> str:
    """Select list that solves the normal equations a (p x p, upper part) x = b:
    Cholesky factor l, its inverse m, solution x, variances v of a unit-variance fit."""
    out = []
    for i in range(p):
        for j in range(i):
            minus = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            out.append(f"(a{j}_{i}{minus}) / l{j}_{j} AS l{i}_{j}")
        minus = "".join(f" - l{i}_{k} * l{i}_{k}" for k in range(i))
        out.append(f"sqrt(a{i}_{i}{minus}) AS l{i}_{i}")
    for i in range(p):
        out.append(f"(b{i}{''.join(f' - l{i}_{k} * f{k}' for k in range(i))}) / l{i}_{i} AS f{i}")
    for i in reversed(range(p)):
        out.append(f"(f{i}{''.join(f' - l{k}_{i} * x{k}' for k in range(i + 1, p))}) / l{i}_{i} AS x{i}")
    for i in range(p):
        for j in range(i):
            terms = " + ".join(f"l{i}_{k} * m{k}_{j}" for k in range(j, i))
            out.append(f"-({terms}) / l{i}_{i} AS m{i}_{j}")
        out.append(f"1.0 / l{i}_{i} AS m{i}_{i}")
    out += ["(" + " + ".join(f"m{k}_{i} * m{k}_{i}" for k in range(i, p)) + f") AS v{i}" for i in range(p)]
    return ", ".join(out)


def _normal_sums(xs: list[str], y: str, w: str = "1.0") -> str:
    """Select list of the sums a (upper part) and b of a weighted least squares fit."""
    a = [f"sum({w} * ({xi}) * ({xj})) AS a{i}_{j}" for i, xi in enumerate(xs) for j, xj in enumerate(xs) if j >= i]
    return ", ".join(a + [f"sum({w} * ({x}) * ({y})) AS b{i}" for i, x in enumerate(xs)])


def _rss_cte(name: str, src: str, xs: list[str], y: str) -> str:
    """CTE ``name`` (rss, n, p) of an unweighted fit, with the solution x0.. and unit variances v0.."""
    p = len(xs)
    explained = " + ".join(f"x{i} * b{i}" for i in range(p))
    return (f"{name} AS (SELECT *, yy - ({explained}) AS rss, {p} AS p FROM (SELECT *, {_lsq_columns(p)} FROM "
            f"(SELECT {_normal_sums(xs, y)}, sum(({y}) * ({y})) AS yy, count(*) AS n FROM {src})))")


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


def _anova_sql(interaction: bool) -> str:
    src = "(SELECT l_returnflag, l_linestatus, l_quantity - (SELECT avg(l_quantity) FROM lineitem) AS y FROM lineitem)"
    a = [_flag("l_returnflag = 'N'"), _flag("l_returnflag = 'R'")]
    b = [_flag("l_linestatus = 'O'")]
    fits = {"fa": a, "fb": b, "fab": a + b}
    ctes = ", ".join(_rss_cte(k, src, ["1.0", *xs], "y") for k, xs in fits.items())
    if interaction:
        # the crossed model fits every cell by its mean: what is left is the spread inside cells
        fits["full"] = []
        ctes += (f", full AS (SELECT sum(ss) AS rss, sum(k) AS n, count(*) AS p FROM (SELECT count(*) AS k, "
                 f"sum(y * y) - sum(y) * sum(y) / count(*) AS ss FROM {src} GROUP BY l_returnflag, l_linestatus))")
    full = "full" if interaction else "fab"
    rows = [("l_returnflag", "fb.rss - fab.rss", "fab.p - fb.p"), ("l_linestatus", "fa.rss - fab.rss", "fab.p - fa.p")]
    if interaction:
        rows.append(("l_returnflag:l_linestatus", 'fab.rss - "full".rss', '"full".p - fab.p'))
    names = ", ".join(f'"{k}"' for k in fits)
    res = f'"{full}".rss / ("{full}".n - "{full}".p)'
    parts = [f"SELECT '{t}' AS term, round({ss}, 3) AS sum_sq, CAST({d} AS DOUBLE) AS df, "
             f"round(({ss}) / ({d}) / ({res}), 6) AS F FROM {names}" for t, ss, d in rows]
    parts.append(f"SELECT 'Residual', round(\"{full}\".rss, 3), CAST(\"{full}\".n - \"{full}\".p AS DOUBLE), NULL FROM {names}")
    ctes = ctes.replace("full AS (", '"full" AS (', 1) if interaction else ctes
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


def _ols_cat_sql() -> str:
    xs = ["1.0", "l_quantity", _flag("l_returnflag = 'N'"), _flag("l_returnflag = 'R'")]
    # term names as the query gives them
    terms = ["Intercept", "l_quantity", "l_returnflag[N]", "l_returnflag[R]"]
    rows = [f"SELECT '{t}' AS term, round(x{i}, 4) AS coef, round(sqrt(v{i} * rss / (n - p)), 4) AS se, "
            f"round(x{i} / sqrt(v{i} * rss / (n - p)), 4) AS t FROM f" for i, t in enumerate(terms)]
    return f"WITH {_rss_cte('f', 'lineitem', xs, 'l_extendedprice')} " + " UNION ALL ".join(rows)


_TUKEY_SQL = """WITH g AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY 1),
    p AS (SELECT a.g AS group1, b.g AS group2, b.m - a.m AS d, sqrt(1.0 / a.n + 1.0 / b.n) AS se FROM g a JOIN g b ON a.g < b.g)
    SELECT group1, group2, round(d, 6) AS meandiff, round(se / max(se) OVER (), 6) AS half_share FROM p"""


def _logit_ctes(src: str, steps: int = 9) -> str:
    """Newton steps of a logistic fit of y on _LOGIT_X over ``src``: CTE fit has
    the coefficients c0.. and unit variances v0.. of the last step."""
    xs = ["1.0", *_LOGIT_X]
    k = len(xs)
    lin = " + ".join(f"c{i} * ({x})" for i, x in enumerate(xs))
    ctes = [f"rows_ AS (SELECT * FROM {src})",
            "s0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS c{i}" for i in range(k)) + ")"]
    for t in range(steps):
        ctes.append(f"n{t} AS (SELECT {_normal_sums(xs, '(y - p) / (p * (1 - p))', 'p * (1 - p)')} FROM "
                    f"(SELECT *, 1.0 / (1.0 + exp(-({lin}))) AS p FROM rows_, s{t}))")
        new = ", ".join(f"s{t}.c{i} + q.x{i} AS c{i}, q.v{i} AS v{i}" for i in range(k))
        ctes.append(f"s{t + 1} AS (SELECT {new} FROM s{t}, (SELECT *, {_lsq_columns(k)} FROM n{t}) q)")
    ctes.append(f"fit AS (SELECT * FROM s{steps})")
    ctes.append(f"scored AS (SELECT *, 1.0 / (1.0 + exp(-({lin}))) AS p FROM rows_, fit)")
    return ", ".join(ctes)


_LOGIT_SRC = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity, l_discount, l_tax FROM lineitem)"


def _logit_sql(kind: str) -> str:
    with_ = f"WITH {_logit_ctes(_LOGIT_SRC)}"
    if kind == "coefficients":
        rows = [f"SELECT '{t}' AS term, round(c{i}, 6) AS coef, round(sqrt(v{i}), 6) AS se, round(c{i} / sqrt(v{i}), 4) AS z, "
                f"round(exp(c{i}), 6) AS odds_ratio, abs(c{i} / sqrt(v{i})) > 1.9599639845400545 AS significant FROM fit"
                for i, t in enumerate(["Intercept", *_LOGIT_X])]
        return with_ + " " + " UNION ALL ".join(rows)
    if kind == "fit":
        return with_ + """, d AS (SELECT count(*) AS n, avg(y) AS b, -2 * sum(y * ln(p) + (1 - y) * ln(1 - p)) AS dev FROM scored),
            e AS (SELECT *, -2 * n * (b * ln(b) + (1 - b) * ln(1 - b)) AS nul FROM d)
            SELECT n, round(b, 8) AS base_rate, round(1 - dev / nul, 8) AS pseudo_r2, round(dev, 3) AS deviance,
                   round(nul, 3) AS null_deviance, true AS converged, 'ok' AS status FROM e"""
    med = ", ".join(f"quantile_cont({x}, 0.5) AS {x}" for x in _LOGIT_X)
    lin = " + ".join(["c0", *[f"c{i} * {x}" for i, x in enumerate(_LOGIT_X, 1)]])
    return with_ + f", m AS (SELECT {med} FROM lineitem) SELECT {', '.join(_LOGIT_X)}, round(1.0 / (1.0 + exp(-({lin}))), 6) AS probability FROM m, fit"


def _logit_holdout_sql() -> str:
    key = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
    base = (f"(SELECT *, s <= cut AS train FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity, l_discount, "
            f"l_tax, {_HASH42.format(k=key)} AS s FROM lineitem) JOIN (SELECT y, quantile_cont(s, 0.7) AS cut FROM "
            f"(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, {_HASH42.format(k=key)} AS s FROM lineitem) GROUP BY y) USING (y))")
    lin = " + ".join(["c0", *[f"c{i} * {x}" for i, x in enumerate(_LOGIT_X, 1)]])
    return f"""WITH {_logit_ctes(f"(SELECT y, l_quantity, l_discount, l_tax FROM {base} WHERE train)")},
        h AS (SELECT y, 1.0 / (1.0 + exp(-({lin}))) >= 0.3 AS hit FROM {base}, fit WHERE NOT train),
        c AS (SELECT count(*) FILTER (WHERE y = 1 AND hit) tp, count(*) FILTER (WHERE y = 0 AND hit) fp,
                     count(*) FILTER (WHERE y = 0 AND NOT hit) tn, count(*) FILTER (WHERE y = 1 AND NOT hit) fn FROM h)
        SELECT tp, fp, tn, fn, {_ratio_sql()} FROM c"""


def oracle_sql() -> dict[str, str]:
    out = {
        "summary_measures": _sql_summary("lineitem", "l_extendedprice", "l_shipdate >= TIMESTAMP '1996-01-01'"),
        "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
        "shape": "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem",
        "profile": _PROFILE_SQL,
        "roles": _ROLES_SQL,
        "impute_median": f"""SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {_EVENTS_NULLS})), 4) AS value
                             FROM {_EVENTS_NULLS}""",
        "impute_mean": f"""SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {_EVENTS_NULLS})), 4) AS value
                           FROM {_EVENTS_NULLS}""",
        "drop_missing": f"SELECT event_id, value FROM {_EVENTS_NULLS} WHERE value IS NOT NULL",
        "drop_report": f"""SELECT count(*) AS rows_before, count(value) AS rows_kept, count(*) - count(value) AS rows_dropped
                           FROM {_EVENTS_NULLS}""",
        "filter_num_median": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
                                WHERE l_quantity >= (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem)""",
        "filter_num_value": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount = 0.05",
        "filter_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
        "filter_in_empty": "SELECT c_custkey FROM customer",
        "filter_preview": "SELECT count(*) FILTER (WHERE l_discount >= 0.05) AS kept, count(*) AS total FROM lineitem",
        "pool_rare": """WITH rare AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*), p_type LIMIT 2)
                        SELECT p_partkey, p_type, CASE WHEN p_type IN (SELECT p_type FROM rare) THEN 'Other' ELSE p_type END
                               AS p_type_reduced FROM part""",
        "bin_equal_width": _bin_equal_width_sql(),
        "date_features": _DATE_SQL,
        "summary_by_group": _sql_summary("lineitem", "l_extendedprice", by="l_returnflag"),
        "box_stats": _box_sql("customer", "c_acctbal", None, 6),
        "box_stats_by": _box_sql("lineitem", "l_extendedprice", "l_returnflag", 4),
        "outliers_iqr": f"""WITH {_FENCE_CTE} SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, f
                            WHERE l_extendedprice < lo OR l_extendedprice > hi""",
        "outliers_z": f"""WITH {_Z_CTE} SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, z
                          WHERE abs((l_extendedprice - m) / s) > 3""",
        "outlier_counts": f"""WITH {_FENCE_CTE}, {_Z_CTE}
            SELECT round(lo, 4) AS lower_fence, round(hi, 4) AS upper_fence,
                   count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS n_iqr,
                   count(*) FILTER (WHERE abs((l_extendedprice - m) / s) > 3) AS n_z
            FROM lineitem, f, z GROUP BY lo, hi""",
        "add_zscore": """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 8)
                         AS c_acctbal_z FROM customer""",
        "add_outlier_flag": f"""WITH {_FENCE_CTE} SELECT l_orderkey, l_linenumber,
            CASE WHEN l_extendedprice < lo OR l_extendedprice > hi THEN 1 ELSE 0 END AS l_extendedprice_outlier
            FROM lineitem, f""",
        "percentile_rank": _pct_sql("lineitem", "l_orderkey, l_linenumber", "l_quantity", "CAST(round_even(p, 1) AS DOUBLE)"),
        "percentile_rank_unrounded": _pct_sql("customer", "c_custkey", "c_acctbal", "round(p, 8)"),
        "standardize": _std_sql(),
        "scale_report": _scale_sql(),
        "frequency": """SELECT p_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 8) AS share
                        FROM part WHERE p_type IS NOT NULL GROUP BY p_type""",
        "frequency_events": """SELECT event_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 8) AS share
                               FROM events WHERE event_type IS NOT NULL GROUP BY event_type""",
        "histogram": _hist_sql("lineitem", ["l_quantity"], 10),
        "histogram_multi": _hist_sql("part", ["p_retailprice", "p_size"], 8),
        "skew_label": """SELECT round(skewness(c_acctbal), 8) AS skewness,
                                CASE WHEN skewness(c_acctbal) > 0.5 THEN 'right-skewed'
                                     WHEN skewness(c_acctbal) < -0.5 THEN 'left-skewed' ELSE 'roughly symmetric' END AS label
                         FROM customer""",
        "crosstab": """SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS count
                       FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
                       LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority
                       GROUP BY ALL""",
        "crosstab_row": """SELECT *, round(count * 100.0 / sum(count) OVER (PARTITION BY o_orderstatus), 8) AS row_pct FROM (
                       SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS count
                       FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
                       LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority
                       GROUP BY ALL)""",
        "scatter": """SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
                      WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL""",
        "corr_pearson": """SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, 'pearson' AS method,
                                  count(*) AS n, round(corr(l_quantity, l_extendedprice), 10) AS r FROM lineitem""",
        "corr_spearman": _spearman_sql("lineitem", "l_quantity", "l_extendedprice"),
        "corr_kendall": _kendall_sql("lineitem", "l_quantity", "l_discount"),
        "corr_kendall_customer": _kendall_sql("customer", "c_acctbal", "c_nationkey"),
        "corr_matrix": _corr_matrix_sql(_CORR_COLS),
        "corr_matrix_spearman": _spearman_matrix_sql(_CORR_COLS[:3]),
        "corr_report": """SELECT 'c_acctbal' AS col_a, 'c_custkey' AS col_b, 'pearson' AS method, count(*) AS n,
                                 round(corr(c_acctbal, c_custkey), 10) AS r,
                                 CASE WHEN abs(corr(c_acctbal, c_custkey)) < 0.1 THEN 'very weak / none'
                                      WHEN abs(corr(c_acctbal, c_custkey)) < 0.3 THEN 'weak'
                                      WHEN abs(corr(c_acctbal, c_custkey)) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength,
                                 CASE WHEN corr(c_acctbal, c_custkey) > 0 THEN 'positive'
                                      WHEN corr(c_acctbal, c_custkey) < 0 THEN 'negative' ELSE 'none' END AS direction
                          FROM customer""",
        "ttest_1samp": """SELECT count(*) AS n, round(avg(l_quantity), 8) AS mean, 25.0::DOUBLE AS mu,
                                 round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 8) AS t,
                                 CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem""",
        "ttest_1samp_median": """SELECT count(*) AS n, round(avg(c_acctbal), 8) AS mean, round(median(c_acctbal), 8) AS mu,
                                 round((avg(c_acctbal) - median(c_acctbal)) / (stddev_samp(c_acctbal) / sqrt(count(*))), 8) AS t,
                                 CAST(count(*) - 1 AS DOUBLE) AS df FROM customer""",
        "ttest_welch": """WITH a AS (SELECT count(*) n, avg(l_quantity) m, var_samp(l_quantity) v FROM lineitem WHERE l_linestatus = 'F'),
                          b AS (SELECT count(*) n, avg(l_quantity) m, var_samp(l_quantity) v FROM lineitem WHERE l_linestatus = 'O')
                          SELECT 'F' AS group_a, 'O' AS group_b, a.n AS n_a, b.n AS n_b, round(a.m, 8) AS mean_a,
                                 round(b.m, 8) AS mean_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 8) AS t,
                                 round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS df
                          FROM a, b""",
        "ttest_paired": """SELECT count(*) AS n, round(avg(l_discount), 10) AS mean_a, round(avg(l_tax), 10) AS mean_b,
                                  round(avg(l_tax) - avg(l_discount), 10) AS mean_change,
                                  round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 8) AS t,
                                  CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem""",
        "chi2_orders": _CHI_ORDERS_SQL,
        "chi2_yates": _CHI_YATES_SQL,
        "chi2_expected": _CHI_EXPECTED_SQL,
        "anova_oneway": _ANOVA1_SQL,
        "group_means": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 8) AS mean
                          FROM lineitem GROUP BY ALL""",
        "posthoc_scheffe": _SCHEFFE_SQL,
        "ols_estimates": _ols2_coef_sql(_LI2, ("l_quantity", "l_discount")),
        "ols_fit_stats": f"""WITH {_ols2_ctes(_LI2)}
            SELECT round(1 - rss / syy, 10) AS r2, round(1 - (rss / syy) * (n - 1) / (n - 3), 10) AS adj_r2,
                   round(((syy - rss) / 2) / s2, 6) AS f, round(pow(1 + 2 * (((syy - rss) / 2) / s2) / (n - 3), -(n - 3) / 2), 10) AS f_p,
                   CAST(n AS BIGINT) AS n, 2.0::DOUBLE AS df_model, n - 3 AS df_resid, round(sqrt(rss / n), 6) AS rmse FROM fit""",
        "ols_residuals": f"WITH {_RESID_CTE} SELECT l_orderkey, l_linenumber, round(fitted, 4) AS fitted, round(e, 4) AS resid FROM res",
        "ols_square": f"""SELECT *, round((WITH {_ols2_ctes(_SQ_SRC)} SELECT -b1 / (2 * b2) FROM fit), 6) AS turning_point
                          FROM ({_ols2_coef_sql(_SQ_SRC, ("l_quantity", "l_quantity^2"))})""",
        "ols_log": _ols2_coef_sql("SELECT ln(l_extendedprice) AS y, ln(l_quantity) AS x1, l_discount AS x2 FROM lineitem",
                                  ("log(l_quantity)", "l_discount"), 8),
        "check_positive": """SELECT 'l_quantity' AS "column", bool_and(l_quantity > 0) AS all_positive FROM lineitem
                             UNION ALL SELECT 'l_discount', bool_and(l_discount > 0) FROM lineitem
                             UNION ALL SELECT 'l_extendedprice', bool_and(l_extendedprice > 0) FROM lineitem""",
        "qq_points": _qq_sql(50),
        "resid_histogram": _resid_hist_sql(),
        "vif": """SELECT 'l_quantity' AS "column", round(1 / (1 - pow(corr(l_quantity, l_discount), 2)), 10) AS vif FROM lineitem
                  UNION ALL SELECT 'l_discount', round(1 / (1 - pow(corr(l_quantity, l_discount), 2)), 10) FROM lineitem""",
        "breusch_pagan": f"""WITH {_RESID_CTE},
            aux AS (SELECT corr(x1, e * e) r1, corr(x2, e * e) r2, corr(x1, x2) r12, count(*)::DOUBLE n FROM res),
            lm AS (SELECT n * (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS lm FROM aux)
            SELECT round(lm, 6) AS lm, 2.0::DOUBLE AS df, round(exp(-lm / 2), 10) AS p FROM lm""",
        "durbin_watson": f"""WITH {_RESID_CTE},
            d AS (SELECT e, e - lag(e) OVER (ORDER BY {", ".join(_LI_ORDER)}) AS de FROM res)
            SELECT round(sum(coalesce(de * de, 0)) / sum(e * e), 10) AS dw, count(*) AS n FROM d""",
        "jarque_bera": f"""WITH {_RESID_CTE},
            m AS (SELECT avg(e) mu, count(*) n FROM res),
            c AS (SELECT avg(pow(e - mu, 2)) m2, avg(pow(e - mu, 3)) m3, avg(pow(e - mu, 4)) m4, any_value(n) n FROM res, m),
            g AS (SELECT m3 / pow(m2, 1.5) s, m4 / (m2 * m2) - 3 k, n FROM c)
            SELECT round(n / 6.0 * (s * s + k * k / 4), 6) AS jb, round(exp(-(n / 6.0 * (s * s + k * k / 4)) / 2), 10) AS p,
                   round(s, 10) AS skewness, round(k, 10) AS kurtosis, n FROM g""",
        "holdout_rmse": _holdout_sql(),
        "stratified_split": _STRAT_SQL,
        "confusion": _CONFUSION_SQL,
        "cutoff_sweep": _SWEEP_SQL,
        "scaler": _SCALER_SQL,
        "knn": _KNN_SQL,
        "naive_bayes": _NB_SQL,
        "cluster_scaled": f"""SELECT c_custkey, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 8) AS {c}_z" for c in _SEG_X)}
                              FROM {_CUST}""",
        "silhouette": _SIL_SQL,
        "kmeans_from": _KMEANS_FROM_SQL,
        "cluster_sizes": f"SELECT c_mktsegment, count(*) AS n FROM {_CUST} GROUP BY 1",
        "cluster_profiles": f"""SELECT c_mktsegment, count(*) AS n, {", ".join(f"round(avg({c}), 6) AS {c}" for c in _SEG_X)}
                                FROM {_CUST} GROUP BY 1""",
        "tokens": f"SELECT doc_id, pos, token FROM {_TOK_SQL} WHERE length(token) >= 3 AND token NOT IN ({_STOP_SQL})",
        "word_counts": _WC_SQL,
        "top_words_unstemmed": f"SELECT * FROM ({_WC_SQL}) ORDER BY count DESC, word LIMIT 15",
        "top_words_english_stop": f"""SELECT token AS word, count(*) AS count FROM
               (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
               WHERE length(token) >= 3 AND token NOT IN ({_EN_STOP_SQL}) GROUP BY token ORDER BY count DESC, word LIMIT 15""",
        "word_weights": f"SELECT word, count, round(count / max(count) OVER (), 10) AS weight FROM ({_WC_SQL})",
        "polarity_modifiers": f"""WITH t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM
                (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL)),
            p AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM t),
            v AS (SELECT doc_id, greatest(-1.0, least(1.0, lex.polarity
                         * CASE WHEN prev IN ({", ".join(f"'{w}'" for w in _NEGATIONS)}) THEN -0.5 ELSE 1.0 END
                         * CASE {" ".join(f"WHEN prev = '{w}' THEN {x!r}" for w, x in _INTENSIFIERS)} ELSE 1.0 END)) AS v
                  FROM p JOIN {_LEX_SQL} USING (word))
            SELECT d.doc_id, round(coalesce(avg(v), 0.0), 8) AS polarity, count(v) AS n_matched
            FROM documents d LEFT JOIN v USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
        "outliers_by": """WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                                     FROM events GROUP BY event_type)
            SELECT event_id, event_type, value FROM events JOIN f USING (event_type)
            WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
        "polarity": f"SELECT doc_id, round(polarity, 10) AS polarity, n_matched FROM {_POL_SQL}",
        "polarity_summary": f"""SELECT round(avg(CASE WHEN polarity > 0.05 THEN 1.0 ELSE 0.0 END), 10) AS share_positive,
                                       round(avg(CASE WHEN polarity < -0.05 THEN 1.0 ELSE 0.0 END), 10) AS share_negative,
                                       round(avg(polarity), 10) AS mean_polarity, count(*) AS n FROM {_POL_SQL}""",
        "polarity_histogram": _hist_sql(f"(SELECT round(polarity, 10) AS polarity FROM {_POL_SQL}) pp", ["polarity"], 30).replace(", 6) AS lo", ", 8) AS lo").replace(", 6) AS hi", ", 8) AS hi"),
        "polarity_rating_corr": f"""SELECT 'polarity' AS col_a, 'quality' AS col_b, 'pearson' AS method, count(*) AS n,
                                           round(corr(polarity, quality), 10) AS r FROM {_POL_SQL} p JOIN labels USING (doc_id)""",
        "aspect_sentiment": _aspect_sql(),
        "image_stats": f"SELECT image, n_pixels, round(brightness, 8) AS brightness, round(colorfulness, 8) AS colorfulness FROM ({_IMG_STATS_SQL})",
        "image_batch_summary": f"""SELECT count(*) AS n_images, round(avg(brightness), 8) AS brightness_mean,
                round(stddev_samp(brightness), 8) AS brightness_sd, round(avg(colorfulness), 8) AS colorfulness_mean,
                round(stddev_samp(colorfulness), 8) AS colorfulness_sd FROM ({_IMG_STATS_SQL})""",
        "read_table": "SELECT p_partkey, p_type, p_size FROM part",
        "catalog_default": "SELECT * FROM nation",
        "table_pipeline": """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value
                                  FROM events WHERE event_type IN ('click', 'view'))
                       SELECT event_id, event_type, round(coalesce(value, (SELECT avg(value) FROM e)), 4) AS value FROM e""",
        "outliers_first15": f"""WITH {_EV_FENCE} SELECT event_id, value FROM events, f WHERE value < lo OR value > hi
                                ORDER BY event_id LIMIT 15""",
        "outlier_counts_events": f"""WITH {_EV_FENCE}, z AS (SELECT avg(value) m, stddev_samp(value) s FROM events)
            SELECT round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence,
                   count(*) FILTER (WHERE value < lo OR value > hi) AS n_iqr,
                   count(*) FILTER (WHERE abs((value - m) / s) > 3) AS n_z
            FROM events, f, z GROUP BY lo, hi""",
        "zscore_histogram": _hist_sql("(SELECT c_acctbal, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS c_acctbal_z FROM customer) zz",
                                      ["c_acctbal", "c_acctbal_z"], 20),
        "kfold_rmse": _kfold_sql(),
        "monthly_series": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total
                             FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""",
    }
    out |= {
        "anova_twoway_sums": _anova_sql(False), "anova_twoway_interaction_sums": _anova_sql(True),
        "ols_categorical_estimates": _ols_cat_sql(), "posthoc_tukey_spans": _TUKEY_SQL, "logit_estimates": _logit_sql("coefficients"), "logit_fit_stats": _logit_sql("fit"),
        "logit_score_profile": _logit_sql("profile"), "logit_holdout": _logit_holdout_sql(),
    }
    if _llm is not None:
        out |= _llm.oracle_sql()
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
