import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.functions import dist
from custlens.operators import anova as A
from custlens.operators import hypothesis as H
from custlens.operators import logistic as L
from custlens.operators import regression as R
from custlens.plans.split import fold_id


@pytest.fixture(scope="module")
def reg_data(spark):
    rng = np.random.default_rng(7)
    n = 300
    x1 = rng.normal(10, 2, n)
    x2 = rng.uniform(0, 1, n)
    g = rng.choice(["a", "b", "c"], n)
    y = 3 + 2 * x1 - 4 * x2 + 0.3 * x1 ** 2 + np.where(g == "b", 1.5, 0) + rng.normal(0, 1, n)
    pdf = pd.DataFrame({"id": np.arange(n), "x1": x1, "x2": x2, "g": g, "y": y})
    return pdf, spark.createDataFrame(pdf)


def _lstsq(pdf, cols):
    X = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in cols])
    y = pdf["y"].to_numpy(float)
    b, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    return X, y, b


def test_ols_matches_lstsq(spark, reg_data):
    pdf, df = reg_data
    res = R.ols(df, R.OlsSpec("y", ("x1", "x2"), ("g",), square="x1"))
    pdf2 = pdf.assign(x1sq=pdf.x1 ** 2, gb=(pdf.g == "b") * 1.0, gc=(pdf.g == "c") * 1.0)
    X, y, b = _lstsq(pdf2, ["x1", "x2", "x1sq", "gb", "gc"])
    tab = res.coefficients(spark).toPandas()
    assert tab["term"].tolist() == ["Intercept", "x1", "x2", "x1^2", "g[b]", "g[c]"]
    assert tab["coef"].to_numpy() == pytest.approx(b, rel=1e-8)
    resid = y - X @ b
    s2 = resid @ resid / (len(y) - X.shape[1])
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    assert tab["se"].to_numpy() == pytest.approx(se, rel=1e-7)
    st = res.fit_stats(spark).collect()[0]
    assert st["r2"] == pytest.approx(1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())), rel=1e-10)
    assert res.turning_point() == pytest.approx(-b[1] / (2 * b[3]), rel=1e-8)


def test_log_guard_refuses(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 2.0)], "y double, x double")
    with pytest.raises(ValueError):
        R.ols(df, R.OlsSpec("y", ("x",), log_x="x"))


def test_kfold_equals_refits(spark, reg_data):
    pdf, df = reg_data
    spec = R.OlsSpec("y", ("x1", "x2"))
    got = R.kfold_rmse(df, spec, "id", k=5, seed=42)
    folds = df.select("id", fold_id("id", 5, 42).alias("f")).toPandas().set_index("id")["f"]
    rmses = []
    for f in range(5):
        te = pdf[folds.loc[pdf.id].to_numpy() == f]
        tr = pdf[folds.loc[pdf.id].to_numpy() != f]
        _, _, b = _lstsq(tr, ["x1", "x2"])
        pred = b[0] + b[1] * te.x1 + b[2] * te.x2
        rmses.append(math.sqrt(((te.y - pred) ** 2).mean()))
    assert got == pytest.approx(np.mean(rmses), rel=1e-9)


def test_durbin_watson_bucketed_equals_sorted(spark, reg_data):
    pdf, df = reg_data
    e = pdf.assign(e=pdf.y - pdf.y.mean())
    want = (np.diff(e.sort_values("id").e) ** 2).sum() / (e.e ** 2).sum()
    from custlens.plans import ranks

    old = ranks.bucket_count
    ranks.bucket_count = lambda n, **kw: 5  # force several buckets on a small table
    try:
        got = R.durbin_watson(spark.createDataFrame(e[["id", "e"]]).repartition(7), "e", ["id"])
        got = got.collect()[0]["dw"]
    finally:
        ranks.bucket_count = old
    assert got == pytest.approx(want, rel=1e-12)


def test_vif_two_predictors(spark, reg_data):
    pdf, df = reg_data
    r = np.corrcoef(pdf.x1, pdf.x2)[0, 1]
    got = {row["column"]: row["vif"] for row in R.vif(df, ["x1", "x2"]).collect()}
    assert got["x1"] == pytest.approx(1 / (1 - r * r), rel=1e-10)


def test_anova_type2_matches_nested_lstsq(spark):
    rng = np.random.default_rng(3)
    n = 240
    a = rng.choice(["p", "q", "r"], n)
    b = rng.choice(["u", "v"], n, p=[0.3, 0.7])
    y = rng.normal(0, 1, n) + (a == "q") * 0.8 + (b == "v") * 0.5 + ((a == "r") & (b == "v")) * 1.0
    pdf = pd.DataFrame({"a": a, "b": b, "y": y})
    tab = A.anova(spark.createDataFrame(pdf), "y", ["a", "b"], interactions=True).toPandas().set_index("term")

    def rss(cols):
        X = np.column_stack([np.ones(n)] + cols)
        r = y - X @ np.linalg.lstsq(X, y, rcond=None)[0]
        return r @ r

    A_ = [(a == "q") * 1.0, (a == "r") * 1.0]
    B_ = [(b == "v") * 1.0]
    AB = [A_[0] * B_[0], A_[1] * B_[0]]
    full = rss(A_ + B_ + AB)
    assert tab.loc["a", "sum_sq"] == pytest.approx(rss(B_) - rss(A_ + B_), rel=1e-9)
    assert tab.loc["b", "sum_sq"] == pytest.approx(rss(A_) - rss(A_ + B_), rel=1e-9)
    assert tab.loc["a:b", "sum_sq"] == pytest.approx(rss(A_ + B_) - full, rel=1e-9)
    assert tab.loc["Residual", "sum_sq"] == pytest.approx(full, rel=1e-9)
    f = ((rss(B_) - rss(A_ + B_)) / 2) / (full / (n - 6))
    assert tab.loc["a", "p"] == pytest.approx(dist.f_sf(f, 2, n - 6), rel=1e-9)


def test_posthoc_tukey_reject_and_bonferroni(spark):
    rows = [("a", float(v)) for v in range(10)] + [("b", float(v) + 0.5) for v in range(10)] + \
           [("c", float(v) + 20) for v in range(10)]
    df = spark.createDataFrame(rows, "g string, y double")
    t = {(r["group1"], r["group2"]): r for r in A.posthoc(df, "y", "g", "tukey").collect()}
    assert not t[("a", "b")]["reject"] and t[("a", "c")]["reject"]
    assert t[("a", "b")]["meandiff"] == pytest.approx(0.5)
    bo = {(r["group1"], r["group2"]): r["p"] for r in A.posthoc(df, "y", "g", "bonferroni").collect()}
    assert bo[("a", "b")] == pytest.approx(min(1.0, 3 * dist.t_two_sided(-0.5 / math.sqrt(2 * 9.1666666667 / 10), 18)),
                                           rel=1e-6)


def test_ttests(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (2.0, 2.5, "x"), (3.0, 5.0, "y"), (4.0, 4.0, "y"), (6.0, 9.0, "y")],
                               "a double, b double, g string")
    one = H.ttest_1samp(df, "a", 2.0).collect()[0]
    assert one["t"] == pytest.approx((3.2 - 2) / (np.std([1, 2, 3, 4, 6], ddof=1) / math.sqrt(5)))
    pr = H.ttest_paired(df, "a", "b").collect()[0]
    d = np.array([1, 2, 3, 4, 6]) - np.array([2, 2.5, 5, 4, 9])
    assert pr["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(5)))
    assert pr["mean_change"] == pytest.approx(-d.mean())


def test_chi2_yates_2x2(spark):
    rows = [(0, 0)] * 12 + [(0, 1)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 9
    df = spark.createDataFrame(rows, "a int, b int")
    got = H.chi2_independence(df, "a", "b").collect()[0]
    obs = np.array([[12, 5], [3, 9]], float)
    e = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    chi = (((np.abs(obs - e) - 0.5) ** 2) / e).sum()
    assert got["chi2"] == pytest.approx(chi) and got["dof"] == 1
    assert got["p"] == pytest.approx(math.erfc(math.sqrt(chi / 2)), rel=1e-10)


def _irls(X, y, it=50):
    b = np.zeros(X.shape[1])
    for _ in range(it):
        p = 1 / (1 + np.exp(-X @ b))
        W = p * (1 - p)
        b = b + np.linalg.solve(X.T @ (X * W[:, None]), X.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(X.T @ (X * W[:, None]))))


def test_logit_matches_irls(spark):
    rng = np.random.default_rng(4)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + 1.2 * x1 - 0.7 * x2)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x1": x1, "x2": x2}))
    res = L.logit(df, "y", ["x1", "x2"])
    b, se = _irls(np.column_stack([np.ones(n), x1, x2]), y)
    assert np.array(res.coef) == pytest.approx(b, rel=1e-6)
    assert np.array(res.se) == pytest.approx(se, rel=1e-5)
    assert res.base_rate == pytest.approx(y.mean())


def test_confusion_one_class_and_cutoff_sweep(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.2), (0, 0.6), (1, 0.05)], "y int, p double")
    c = L.confusion(df.where("y = 1"), "y", (F.col("p") >= 0.5).cast("int")).collect()[0]
    assert (c["tp"], c["fn"], c["specificity"]) == (1, 2, None)
    sweep = {r["cutoff"]: r for r in L.cutoff_sweep(df, "y", "p").collect()}
    for cut, r in sweep.items():
        pdf = df.toPandas()
        pred = pdf.p >= cut
        assert r["tp"] == int(((pdf.y == 1) & pred).sum()) and r["fp"] == int(((pdf.y == 0) & pred).sum())
    assert len(sweep) == 18


def test_compare_square_single_pass_equals_separate_fits(spark, reg_data):
    pdf, df = reg_data
    spec = R.OlsSpec("y", ("x1", "x2"), square="x1")
    got = {r["model"]: r for r in R.compare_square(df, spec, "id").collect()}
    for name, s in (("with squared term", spec), ("without squared term", spec.without_square())):
        assert got[name]["holdout_rmse"] == pytest.approx(R.holdout_rmse(df, s, "id"), rel=1e-9)
        assert got[name]["cv_rmse"] == pytest.approx(R.kfold_rmse(df, s, "id"), rel=1e-9)


def test_logit_null_deviance_closed_form(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    y = (rng.uniform(size=300) < 0.3).astype(float)
    res = L.logit(spark.createDataFrame(pd.DataFrame({"y": y, "x": x})), "y", ["x"])
    p = y.mean()
    assert res.null_deviance == pytest.approx(-2 * (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), rel=1e-10)
    ll = -res.deviance / 2
    b, _ = _irls(np.column_stack([np.ones(300), x]), y)
    q = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
    assert ll == pytest.approx((y * np.log(q) + (1 - y) * np.log(1 - q)).sum(), rel=1e-8)
