"""Inputs that once broke an operator or gave a wrong answer."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.functions import dist
from custlens.operators import anova as A
from custlens.operators import chartdata as V
from custlens.operators import correlate as C
from custlens.operators import describe as D
from custlens.operators import hypothesis as H
from custlens.operators import regression as R
from custlens.operators import text as T
from custlens.sources.profiling import profile, roles


def test_levels_with_apostrophes(spark):
    df = spark.createDataFrame([("men's", "it's"), ("men's", "x"), ("women's", "x"), (None, "x")], "a string, b string")
    got = {(r["a"], r["b"]): r["count"] for r in V.crosstab(df, "a", "b").collect()}
    assert got == {("men's", "it's"): 1, ("men's", "x"): 1, ("women's", "it's"): 0, ("women's", "x"): 1}
    assert H.chi2_independence(df, "a", "b").count() == 1


def test_matrix_of_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 5.0, 1.0), (4.0, 4.0, 7.0)],
                               "`it's` double, `b` double, `c` double")
    for method in ("pearson", "spearman"):
        got = {(r["col_a"], r["col_b"]): r["r"] for r in C.corr_matrix(df, ["it's", "b", "c"], method).collect()}
        want = df.toPandas().corr(method=method)
        assert all(got[x, y] == pytest.approx(want.loc[x, y]) for x in want for y in want)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in C.corr_matrix(df, ["it's", "b"], "kendall").collect()}
    assert got["it's", "b"] == got["b", "it's"] == pytest.approx(1 / 3) and got["b", "b"] == 1.0


def test_welch_with_a_group_of_one_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, x double")
    row = H.ttest_welch(df, "x", "g", "a", "b").collect()[0]
    assert row["t"] is None and row["significant"] is None


@pytest.mark.parametrize("method", ["tukey", "scheffe", "bonferroni"])
def test_posthoc_without_variance_inside_groups(spark, method):
    df = spark.createDataFrame([(g, float(i)) for i, g in enumerate("abc") for _ in range(4)], "g string, x double")
    rows = A.posthoc(df, "x", "g", method).collect()
    assert len(rows) == 3 and all(r["p_adj" if method == "tukey" else "p"] is None for r in rows)


def test_studentised_range_has_no_step_in_df_and_keeps_small_tails():
    below, above = dist.tukey_sf(3.5, 4, 99_999), dist.tukey_sf(3.5, 4, 100_001)
    assert below == pytest.approx(above, rel=1e-6)
    assert dist.tukey_sf(3.5, 4, 1e7) == pytest.approx(dist.tukey_sf(3.5, 4, math.inf), rel=1e-5)
    assert 0 < dist.tukey_sf(14.0, 3, 1e6) < 1e-18
    assert dist.tukey_sf(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)  # printed tables
    assert dist.ptukey(3.877, 3, 10) + dist.tukey_sf(3.877, 3, 10) == pytest.approx(1)


def test_profile_of_large_ids_and_plain_timestamps(spark):
    df = spark.sql("""SELECT * FROM VALUES (9007199254740992L, TIMESTAMP_NTZ'2024-01-01 00:00:00'),
                      (9007199254740993L, NULL), (9007199254740994L, NULL) AS t(id, seen)""")
    got = {r["column"]: r for r in profile(df).collect()}
    assert got["id"]["unique"] == 3 and got["seen"]["unique"] == 1 and got["seen"]["role"] == "date"
    assert {r["column"]: r["is_date"] for r in roles(profile(df)).collect()} == {"id": False, "seen": True}


def test_durbin_watson_with_null_text_and_heavy_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 9 == 0 else "k" if i % 3 else f"k{i}", i, float(e)) for i, e in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "a string, b long, e double").repartition(7)
    e = np.array([r[2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))])
    got = R.durbin_watson(df, "e", ["a", "b"]).collect()[0]
    assert got["n"] == 600 and got["dw"] == pytest.approx(float((np.diff(e) ** 2).sum() / (e ** 2).sum()))


def test_outliers_by_group_equal_each_group_alone(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if i % 3 else "b", float(v) * (10 if i % 3 else 1)) for i, v in enumerate(rng.standard_t(2, size=400))]
    df = spark.createDataFrame(rows, "g string, x double")
    for method in ("iqr", "z"):
        together = sorted(tuple(r) for r in D.outliers(df, "x", method, by=["g"]).collect())
        alone = sorted(tuple(r) for g in "ab" for r in D.outliers(df.where(F.col("g") == g), "x", method).collect())
        assert together == alone and together


def test_polarity_with_negations_and_intensifiers(spark):
    df = spark.createDataFrame([(1, "Good, not good; very bad"), (2, "none"), (3, ""), (4, None), (5, "very good")],
                               "id long, text string")
    lex = spark.createDataFrame([("good", 0.6), ("bad", -0.5)], "word string, polarity double")
    very = spark.createDataFrame([("very", 3.0)], "word string, intensity double")
    got = {r["id"]: (r["polarity"], r["n_matched"]) for r in T.polarity(df, "id", "text", lex, ["not"], -0.5, very).collect()}
    assert got[1] == (pytest.approx((0.6 - 0.3 - 1.0) / 3), 3)
    assert got[2] == (0.0, 0) and got[3] == (0.0, 0) and 4 not in got and got[5] == (1.0, 1)


def test_polarity_and_aspects_never_move_the_text(spark):
    df = spark.range(10).select("id", F.lit("good taste").alias("text"))
    lex = spark.createDataFrame([("good", 0.6)], "word string, polarity double")
    plan = T.with_polarity(df, "text", lex)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_zero_correlation_reads_as_positive(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 3.0, 2.0], "b": [1.0, 2.0, 1.0, 0.0]}))
    assert C.corr_report(df, "a", "b").collect()[0]["direction"] == "positive"
