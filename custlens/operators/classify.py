"""Classifiers on a stratified hash split: k-nearest neighbours, Gaussian
naive Bayes, decision tree, random forest; feature importance; comparison."""

from __future__ import annotations

import math

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num
from custlens.operators.logistic import confusion
from custlens.operators.regression import complete_rows
from custlens.plans.forest import fit_predict
from custlens.plans.neighbors import knn
from custlens.plans.split import stratified_flag
from custlens.session import cut_lineage


def fit_scaler(train: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    """One row of means and standard deviations (population by default) fitted
    on the training rows only: columns ``<c>_mean``, ``<c>_sd``."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return train.agg(*[F.avg(clean_num(c)).alias(f"{c}_mean") for c in cols],
                     *[sd(clean_num(c)).alias(f"{c}_sd") for c in cols])


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(scaler))
    z = {c: (clean_num(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") != 0, F.col(f"{c}_sd")).otherwise(1.0)
         for c in cols}
    return j.withColumns(z).drop(*[f"{c}_{s}" for c in cols for s in ("mean", "sd")])


def prepare(df: DataFrame, xs: Sequence[str], y: str, key: str, frac: float = 0.7, seed: int = 42) -> DataFrame:
    """Complete rows with a stratified 70/30 hash split in ``_train``."""
    data = complete_rows(df, [*xs, y, key])
    return stratified_flag(data, key, y, frac, seed)


def _label(data: DataFrame, y: str, value: Column) -> Column:
    """A label as it is reported: text stays text, numbers are whole."""
    return value if dict(data.dtypes)[y] == "string" else value.cast("int")


def knn_classify(data: DataFrame, xs: Sequence[str], y: str, key: str, k: int = 5) -> DataFrame:
    """Exact k-NN (Euclidean on features scaled by the training mean and
    population sd); majority vote, smallest label on a tie; labels are numbers
    or text.  Rows of the test part: (key, truth, pred)."""
    train = data.where("_train")
    scaler = fit_scaler(train, xs)
    scaled = apply_scaler(data, scaler, xs)
    tr = scaled.where("_train").select(F.col(key).alias("_rid"), F.col(y).alias("_label"), *xs)
    te = scaled.where(~F.col("_train")).select(F.col(key).alias("_tid"), *xs)
    nb = knn(tr, te, xs, k)
    votes = nb.select("_tid", F.explode("neighbours").alias("n")).groupBy("_tid", F.col("n.label").alias("lab")).agg(
        F.count("*").alias("c"))
    pred = votes.groupBy("_tid").agg(F.min(F.struct((-F.col("c")).alias("less"), "lab")).alias("m")).select(
        F.col("_tid").alias(key), _label(data, y, F.col("m.lab")).alias("pred"))
    truth = data.where(~F.col("_train")).select(key, _label(data, y, F.col(y)).alias("truth"))
    return truth.join(pred, key, "left")


def gaussian_nb(data: DataFrame, xs: Sequence[str], y: str, key: str, var_smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes: per-class priors, means and population variances
    (plus ``var_smoothing`` x the largest feature variance) from one
    ``groupBy(class)``; the test rows are scored by a JVM expression against
    the broadcast class table.  Labels are numbers or text.  (key, truth, pred); without
    training rows pred is NULL."""
    train = data.where("_train")
    spread = train.agg(*[F.var_pop(clean_num(x)).alias(f"v{i}") for i, x in enumerate(xs)]).first()
    eps = max((v for v in spread if v is not None), default=0.0) * var_smoothing
    stats = train.groupBy(F.col(y).alias("_cls")).agg(
        F.count("*").alias("_nc"), *[F.avg(clean_num(x)).alias(f"_m{i}") for i, x in enumerate(xs)],
        *[(F.var_pop(clean_num(x)) + F.lit(eps)).alias(f"_v{i}") for i, x in enumerate(xs)])
    tot = train.count()
    # the class table rides along as one array, and each row picks its class
    # itself: no row is multiplied or shuffled
    table = stats.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("_classes"))
    test = data.where(~F.col("_train")).join(F.broadcast(table))

    def log_density(c):
        ll = F.log(c["_nc"] / F.lit(float(tot)))
        for i, x in enumerate(xs):
            ll = ll - 0.5 * F.log(2 * F.lit(math.pi) * c[f"_v{i}"]) - (clean_num(x) - c[f"_m{i}"]) ** 2 / (2 * c[f"_v{i}"])
        return F.struct(F.coalesce(-ll, F.lit(math.inf)).alias("less"), c["_cls"].alias("cls"))

    # the likeliest class, the smallest label on a tie
    best = F.array_min(F.transform("_classes", log_density))
    return test.select(key, _label(data, y, F.col(y)).alias("truth"), _label(data, y, best["cls"]).alias("pred"))


def _assemble(data: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    return VectorAssembler(inputCols=list(xs), outputCol="_features").transform(
        data.select(*[clean_num(x).alias(x) for x in xs], clean_num(y).alias("_label"), *[c for c in data.columns
                                                                                          if c not in xs and c != y]))


def tree(data: DataFrame, xs: Sequence[str], y: str, key: str, depth: int = 3, seed: int = 1):
    """Decision tree (Gini) fitted on the training part; returns (model,
    test predictions (key, truth, pred))."""
    a = _assemble(data, xs, y)
    model = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=depth, impurity="gini",
                                   seed=seed).fit(a.where("_train"))
    pred = model.transform(a.where(~F.col("_train"))).select(
        key, F.col("_label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))
    return model, pred


@dataclass(frozen=True)
class GrownForest:
    importances: np.ndarray


def forest(data: DataFrame, xs: Sequence[str], y: str, key: str, trees: int = 200, seed: int = 1,
           depth: int | None = None):
    """Random forest (sqrt features per split) whose trees grow until leaves are
    pure or hold equal rows; with a ``depth`` (at most 30) Spark's own forest of
    that many levels.  (model, predictions (key, truth, pred))."""
    if depth is None:
        plain = data.select(*[clean_num(x).alias(x) for x in xs], *[c for c in data.columns if c not in xs])
        pred, importances = fit_predict(plain, xs, y, key, trees, seed)
        return GrownForest(importances), pred.select(key, _label(data, y, F.col("truth")).alias("truth"),
                                                     _label(data, y, F.col("pred")).alias("pred"))
    a = _assemble(data, xs, y)
    model = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees,
                                   featureSubsetStrategy="sqrt", seed=seed, maxDepth=depth).fit(a.where("_train"))
    pred = model.transform(a.where(~F.col("_train"))).select(
        key, F.col("_label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred"))
    return model, pred


def importance(spark, model, xs: Sequence[str]) -> DataFrame:
    """(feature, importance) sorted descending."""
    imp = model.importances if isinstance(model, GrownForest) else model.featureImportances.toArray()
    rows = sorted(zip(xs, [float(v) for v in imp]), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


_RULE = re.compile(r"^(\s*)(If|Else|Predict)\s*(?:\((.*)\)|:\s*(.*))$")


def tree_rules(spark, model, xs: Sequence[str]) -> DataFrame:
    """Readable rules from a fitted tree: (rule_no, conditions, prediction)."""
    path, rules = [], []
    for line in model.toDebugString.splitlines()[1:]:
        m = _RULE.match(line)
        if not m:
            continue
        depth = (len(m.group(1)) - 1) // 1
        kind = m.group(2)
        text = m.group(3) if m.group(3) is not None else m.group(4)
        text = re.sub(r"feature (\d+)", lambda g: xs[int(g.group(1))], text or "")
        while path and path[-1][0] >= depth:
            path.pop()
        if kind in ("If", "Else"):
            path.append((depth, text))
        else:
            rules.append((len(rules) + 1, " and ".join(t for _, t in path) or "(all)", float(text)))
    return spark.createDataFrame(rules, "rule_no int, conditions string, prediction double")


def compare_classifiers(data: DataFrame, xs: Sequence[str], y: str, key: str, k: int = 9, depth: int = 4,
                        trees: int = 200, seed: int = 1) -> DataFrame:
    """(model, tp, fp, tn, fn, accuracy, sensitivity, specificity) per classifier."""
    # split and scaled once, not once per classifier
    data = cut_lineage(data.select(key, *xs, y, "_train"))
    preds = {
        "k-nearest neighbours": knn_classify(data, xs, y, key, k),
        "naive Bayes": gaussian_nb(data, xs, y, key),
        "decision tree": tree(data, xs, y, key, depth, seed)[1],
        "random forest": forest(data, xs, y, key, trees, seed)[1],
    }
    out = None
    for name, p in preds.items():
        c = confusion(p, "truth", "pred").select(F.lit(name).alias("model"), "*")
        out = c if out is None else out.unionByName(c)
    return out
