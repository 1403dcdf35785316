"""Empty, one-row and constant tables have defined results in every model operator."""

import math

import pytest
from pyspark.sql import functions as F

from custlens.operators import classify as M
from custlens.operators import describe as D
from custlens.operators import hypothesis as H
from custlens.operators import logistic as L
from custlens.operators import regression as R
from custlens.operators import segment as G
from custlens.operators import text as T
from custlens.operators import wrangle as W

SCHEMA = "k long, x double, c double, y int, g string, t string, _train boolean"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, 2.5, 7.0, 1, "a", "some words here", True)], SCHEMA)


@pytest.fixture(scope="module")
def constant(spark):
    """Column c never changes."""
    return spark.createDataFrame([(i, float(i % 5), 7.0, i % 2, "ab"[i % 2], "w", i % 3 > 0) for i in range(30)], SCHEMA)


def test_tests_without_values_are_null(empty, one):
    r = H.ttest_1samp(empty, "x").first()
    assert r["n"] == 0 and r["t"] is None and r["p"] is None and r["df"] is None and r["significant"] is None
    r = H.ttest_1samp(one, "x").first()
    assert (r["n"], r["mu"], r["df"], r["t"], r["significant"]) == (1, 2.5, 0.0, None, None)
    r = H.ttest_paired(empty, "x", "c").first()
    assert r["n"] == 0 and r["df"] is None and r["significant"] is None
    r = H.chi2_independence(empty, "g", "t").first()
    assert r["n"] == 0 and r["dof"] == 0 and r["chi2"] is None and r["low_expected"] is None
    r = H.chi2_independence(one, "g", "t").first()
    assert r["n"] == 1 and r["dof"] == 0 and r["p"] is None and r["significant"] is None


def test_quantiles_and_box_statistics(empty, one, constant):
    assert D.box_stats(empty, "x").count() == 0
    r = D.box_stats(one, "x").first()
    assert (r["q1"], r["median"], r["q3"], r["n_outliers"]) == (2.5, 2.5, 2.5, 0)
    r = D.box_stats(constant, "c", ["g"]).collect()
    assert {(x["median"], x["iqr"]) for x in r} == {(7.0, 0.0)}
    assert W.impute(empty, "x", "median").count() == 0
    got = {r["measure"]: r["value"] for r in D.summary_measures(empty, "x").collect()}
    assert got["count"] == 0 and got["median"] is None


def test_least_squares_without_rows(empty, one):
    spark = empty.sparkSession
    res = R.ols(empty, R.OlsSpec("x", ("c", "k")))
    assert [tuple(r)[1:] for r in res.coefficients(spark).collect()] == [(None,) * 7] * 3
    r = res.fit_stats(spark).first()
    assert r["n"] == 0 and r["r2"] is None and r["f_p"] is None
    r = R.ols(one, R.OlsSpec("x", ("c",))).coefficients(spark).collect()
    assert r[0]["coef"] == 2.5 and r[0]["significant"] is None


def test_logit_says_why_there_is_no_fit(spark, empty, one):
    res = L.logit(empty, "y", ["x"])
    assert res.status == "no rows" and not res.converged
    assert res.coefficients(spark).first()["coef"] is None
    assert L.logit(one, "y", ["x"]).status == "one class"
    parted = spark.createDataFrame([(float(i), int(i >= 10)) for i in range(20)], "x double, y int")
    res = L.logit(parted, "y", ["x"])
    assert res.status == "separated" and not res.converged
    assert {r["p"] for r in res.coefficients(spark).collect()} == {None}
    assert res.fit_stats(spark).first()["status"] == "separated"
    mixed = spark.createDataFrame([(float(i), (i * 7) % 3 % 2) for i in range(60)], "x double, y int")
    assert L.logit(mixed, "y", ["x"]).status == "ok"


def test_naive_bayes_with_one_feature_and_without_rows(empty, constant):
    got = M.gaussian_nb(constant, ["x"], "y", "k").collect()
    assert len(got) == 10 and all(r["pred"] in (0, 1) for r in got)
    assert M.gaussian_nb(empty, ["x", "c"], "y", "k").count() == 0


def test_segments_of_constant_columns(constant):
    z = G.scale_for_clustering(constant, ["x", "c"])
    assert z.agg(F.max(F.abs("c_z"))).first()[0] == 0.0
    seg = G.kmeans_segments(constant, ["x", "c"], 2, restarts=2)
    assert seg.labels.select("cluster").distinct().count() == 2 and math.isfinite(seg.inertia)
    inertia = {r["k"]: r["inertia"] for r in G.elbow(constant, ["x", "c"], ks=(1, 2), restarts=2).collect()}
    assert inertia[1] == pytest.approx(30.0) and inertia[2] < inertia[1]
    assert G.ward_segments(constant, ["x", "c"], 2, centres=8).select("cluster").distinct().count() == 2


def test_segments_of_one_row_and_none(empty, one):
    seg = G.kmeans_segments(one, ["x", "c"], 2, restarts=2)
    assert [r["cluster"] for r in seg.labels.collect()] == [0] and seg.inertia == 0
    seg = G.kmeans_segments(empty, ["x", "c"], 2, restarts=2)
    assert seg.labels.count() == 0 and seg.inertia == 0 and seg.centers.shape == (0, 2)
    assert {r["inertia"] for r in G.elbow(empty, ["x", "c"], ks=(1, 2), restarts=2).collect()} == {0.0}
    assert G.ward_segments(empty, ["x", "c"], 2).count() == 0
    assert [r["cluster"] for r in G.ward_segments(one, ["x", "c"], 2, centres=4).collect()] == [0]
    assert G.ward_merges(empty, ["x", "c"]).count() == G.ward_merges(one, ["x", "c"], centres=4).count() == 0


def test_topics_without_terms(empty, one):
    assert T.topics(empty, "t").count() == 0
    assert T.topics(one, "t", min_df=5).count() == 0
