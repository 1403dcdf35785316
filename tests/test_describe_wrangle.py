import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens.operators import chartdata as V
from custlens.operators import describe as D
from custlens.operators import wrangle as W


def _df(spark, vals):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")


def test_summary_measures_match_pandas(spark):
    vals = [1.0, 2.0, 2.0, 3.5, 7.0, 10.0, None, float("nan"), 2.5, 9.0]
    got = {r["measure"]: r["value"] for r in D.summary_measures(_df(spark, vals), "x").collect()}
    s = pd.Series(vals, dtype=float).dropna()
    want = {
        "count": len(s), "mean": s.mean(), "median": s.median(), "mode": s.mode().iloc[0], "p25": s.quantile(0.25),
        "p75": s.quantile(0.75), "range": s.max() - s.min(), "mean_abs_dev": (s - s.mean()).abs().mean(),
        "variance": s.var(), "std_dev": s.std(), "coef_variation": s.std() / s.mean(), "skewness": s.skew(),
        "kurtosis": s.kurt(),
    }
    assert list(got) == D.MEASURES
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-10), k


def test_summary_edge_tables(spark):
    empty = spark.createDataFrame([], "id long, x double")
    e = {r["measure"]: r["value"] for r in D.summary_measures(empty, "x").collect()}
    assert e["count"] == 0 and all(v is None for k, v in e.items() if k != "count")
    one = {r["measure"]: r["value"] for r in D.summary_measures(_df(spark, [4.0]), "x").collect()}
    assert one["count"] == 1 and one["median"] == 4.0 and one["variance"] is None and one["skewness"] is None
    const = {r["measure"]: r["value"] for r in D.summary_measures(_df(spark, [2.0] * 5), "x").collect()}
    assert const["std_dev"] == 0.0 and const["range"] == 0.0


def test_zscore_constant_column_is_null(spark):
    out = D.add_zscore(_df(spark, [3.0, 3.0, 3.0]), "x").collect()
    assert all(r["x_z"] is None for r in out)


def test_percentile_rank_ties_and_missing(spark):
    vals = [10.0, 20.0, 20.0, None, 40.0]
    got = D.add_percentile_rank(_df(spark, vals), "x").orderBy("id").toPandas()["x_pctile"]
    want = (pd.Series(vals).rank(pct=True) * 100).round(1)
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


def test_outlier_flag_missing_is_zero(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 2.0, 100.0, None]
    got = D.add_outlier_flag(_df(spark, vals), "x").orderBy("id").toPandas()["x_outlier"].tolist()
    assert got == [0, 0, 0, 0, 0, 1, 0]


def test_impute_and_filters(spark):
    df = _df(spark, [1.0, None, 3.0, float("nan"), 10.0])
    med = [r["x"] for r in W.impute(df, "x", "median").orderBy("id").collect()]
    assert med == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert W.filter_num(df, "x", ">=").count() == 2  # median 3: 3 and 10; missing never passes
    assert W.filter_in(df, "id", []).count() == 5
    assert W.drop_report(df, ["x"]).collect()[0].asDict() == {"rows_before": 5, "rows_kept": 3, "rows_dropped": 2}


def test_pool_rare_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,), ("a",), ("b",)], "c string")
    out = [r["c_reduced"] for r in W.pool_rare(df, "c", 1).collect()]
    assert sorted(out, key=str) == sorted(["a", "a", "a", "b", "b", "Other", None], key=str)


def test_equal_width_bins_follow_pandas_cut(spark):
    vals = [0.0, 1.0, 2.5, 3.3, 9.9, 10.0, None]
    out = W.bin_equal_width(_df(spark, vals), "x", 4).orderBy("id").toPandas()
    cut = pd.cut(pd.Series(vals), 4)
    assert out["x_group"].iloc[:6].tolist() == [str(v) for v in cut.iloc[:6]]
    assert out["x_group"].iloc[6] is None


def test_date_features(spark):
    df = spark.createDataFrame([("2024-12-28",), ("2024-03-01",), ("not a date",)], "order_date string")
    out = W.date_features(df, "order_date", as_of="2025-01-01").toPandas()
    assert out["order_date_season"].tolist()[:2] == ["Winter", "Spring"]
    assert out["order_date_weekend"].tolist()[:2] == [1, 0]
    assert out["order_date_days_since"].tolist()[:2] == [4, 306]
    assert out["order_date_quarter"].tolist()[:2] == ["Q4", "Q1"]
    assert out["order_date_holiday_season"].tolist()[:2] == [1, 0]
    assert out.iloc[2].isna().sum() >= 8  # bad value -> missing features


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(2)
    vals = [float(v) for v in rng.normal(size=200)]
    got = V.histogram(_df(spark, vals), "x", 7).orderBy("bin").toPandas()
    counts, edges = np.histogram(vals, bins=7)
    assert got["count"].tolist() == counts.tolist()
    assert got["lo"].tolist() == pytest.approx(list(edges[:-1]))


def test_crosstab_zero_cells_and_frequency(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "q")], "a string, b string")
    ct = {(r["a"], r["b"]): r["count"] for r in V.crosstab(df, "a", "b").collect()}
    assert ct == {("x", "p"): 1, ("x", "q"): 1, ("y", "p"): 1, ("y", "q"): 0}
    fr = V.frequency(df, "a").collect()
    assert [(r["a"], r["count"], r["share"]) for r in fr] == [("x", 2, 2 / 3), ("y", 1, 1 / 3)]
