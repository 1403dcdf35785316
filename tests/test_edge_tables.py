"""Edge tables: all-null column, one-level factor, empty two-factor cell,
separated logistic target, small expected counts, Unicode text."""

import numpy as np
import pandas as pd
import pytest

from custlens.operators import anova as A
from custlens.operators import describe as D
from custlens.operators import hypothesis as H
from custlens.operators import logistic as L
from custlens.operators import text as T
from custlens.sources.profiling import profile


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    got = {r["measure"]: r["value"] for r in D.summary_measures(df, "x").collect()}
    assert got["count"] == 0 and got["mean"] is None and got["median"] is None
    prof = {r["column"]: r for r in profile(df).collect()}
    assert prof["x"]["missing"] == 2 and prof["x"]["unique"] == 0


def test_one_level_factor_has_no_test(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0)], "g string, y double")
    tab = {r["term"]: r for r in A.anova(df, "y", ["g"]).collect()}
    assert tab["g"]["df"] == 0 and tab["g"]["p"] is None
    assert tab["Residual"]["df"] == 2


def test_empty_cell_in_two_factor_table(spark):
    rng = np.random.default_rng(0)
    rows = [(a, b, float(rng.normal())) for a in "pq" for b in "uv" for _ in range(5) if (a, b) != ("q", "v")]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    tab = {r["term"]: r for r in A.anova(df, "y", ["a", "b"], interactions=True).collect()}
    # with one empty cell the interaction is not estimable: 0 degrees of freedom
    assert tab["a:b"]["df"] == 0
    assert tab["Residual"]["df"] == 15 - 3


def test_separated_logistic_target_reports_status(spark):
    xs = [float(v) for v in range(20)]
    df = spark.createDataFrame([(x, 1.0 if x >= 10 else 0.0) for x in xs], "x double, y double")
    res = L.logit(df, "y", ["x"])
    assert res.converged is False


def test_small_expected_counts_flag(spark):
    rows = [("a", "u")] * 3 + [("a", "v")] * 1 + [("b", "u")] * 1 + [("b", "v")] * 4
    got = H.chi2_independence(spark.createDataFrame(rows, "p string, q string"), "p", "q").collect()[0]
    # row totals 4 and 5, column totals 4 and 5, n = 9: smallest expected count 4 * 4 / 9
    assert got["low_expected"] is True and got["min_expected"] == pytest.approx(16 / 9)


def test_unicode_text_tokens(spark):
    df = spark.createDataFrame([(1, "Crème brûlée — très BON, naïve café!")], "id long, t string")
    toks = [r["token"] for r in T.tokens(df, "id", "t", stop=[]).orderBy("pos").collect()]
    # the token rule keeps runs of a-z after lower-casing, three letters or more
    assert toks == ["bon", "caf"]
