"""Customer segmentation: scaling, elbow, k-means with restarts, Ward
hierarchical clustering of a codebook, silhouette, sizes and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num
from custlens.operators.describe import standardize
from custlens.operators.regression import complete_rows
from custlens.plans.kmeans import Run, assign_column, assign_expr, best_of, fit_many


def scale_for_clustering(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Complete rows with ``<c>_z`` columns (population sd), as distance-based
    models expect; a column without spread is 0 everywhere."""
    z = standardize(complete_rows(df, cols), cols, ddof=0)
    return z.withColumns({f"{c}_z": F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) for c in cols})


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="_features").transform(df)


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(1, 8), restarts: int = 10,
          seed: int = 42) -> DataFrame:
    """(k, inertia) on the standardised columns, best of ``restarts`` runs for
    every k; all k and restarts advance together in shared passes.  k = 1 is
    the total sum of squares about the mean.  Without rows every inertia is 0."""
    z = [f"{c}_z" for c in cols]
    data = scale_for_clustering(df, cols).select(*z)
    runs, owner = [], {}
    for k in ks:
        if k > 1:
            for r in range(restarts):
                runs.append(Run(len(runs), int(k), seed + r))
                owner[runs[-1].run] = int(k)
    res = fit_many(data, z, runs) if runs else {}
    best: dict[int, float] = {}
    for run, fit in res.items():
        k = owner[run]
        best[k] = min(best.get(k, float("inf")), fit.inertia)
    rows = []
    for k in ks:
        if k == 1:
            tss = data.select(sum((F.col(c) ** 2 for c in z), F.lit(0.0)).alias("s")).agg(F.sum("s")).collect()[0][0]
            rows.append((1, float(tss or 0.0)))
        else:
            rows.append((int(k), best[int(k)]))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


@dataclass(frozen=True)
class Segmentation:
    labels: DataFrame  # input rows + cluster column
    centers: np.ndarray  # in standardised units
    inertia: float
    settled: bool = True  # False: centres still moved after the last allowed pass


def kmeans_segments(df: DataFrame, cols: Sequence[str], k: int, restarts: int = 10, seed: int = 42,
                    label: str = "cluster") -> Segmentation:
    """K-means (seeds by shared oversampling rounds, Lloyd iterations) on
    standardised columns, best of ``restarts`` runs by within-cluster sum of
    squares.  The restarts share their passes over the rows; labels come from a
    JVM expression with the chosen centres."""
    z = [f"{c}_z" for c in cols]
    data = scale_for_clustering(df, cols)
    fit = best_of(data.select(*z), z, k, restarts, seed)
    return Segmentation(data.withColumn(label, assign_expr(z, fit.centers)), fit.centers, fit.inertia, fit.settled)


def kmeans_from(df: DataFrame, cols: Sequence[str], first: Sequence[Sequence[float]], max_iter: int = 300,
                tol: float = 1e-4, label: str = "cluster") -> Segmentation:
    """K-means from given first centres (in standardised units, one row each),
    at most ``max_iter`` steps; ``settled`` says whether it came to rest."""
    z = [f"{c}_z" for c in cols]
    data = scale_for_clustering(df, cols)
    fit = fit_many(data.select(*z), z, [Run(0, len(first), 0)], max_iter, tol,
                   first={0: np.array(first, float)})[0]
    return Segmentation(data.withColumn(label, assign_expr(z, fit.centers)), fit.centers, fit.inertia, fit.settled)


# ---------------------------------------------------------------- Ward
def _ward_merges(cent: np.ndarray, sizes: np.ndarray):
    """Ward agglomeration of the m weighted centres of a codebook, by the nearest-neighbour chain with Lance-Williams updates, O(m^2).

    Returns merges [(left, right, height, size)] sorted by height with
    linkage-matrix ids (leaves 0..m-1, merge t gets id m+t)."""
    m = len(sizes)
    if m < 2:
        return []
    n = sizes.astype(float).copy()
    diff = cent[:, None, :] - cent[None, :, :]
    d2 = 2.0 * np.outer(n, n) / (n[:, None] + n[None, :]) * (diff ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    alive = np.ones(m, dtype=bool)
    raw = []  # (slot a, slot b, height, size); merged cluster keeps slot a
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            row = np.where(alive, d2[x], np.inf)
            row[x] = np.inf
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        y = chain.pop()
        x = chain.pop()
        a, b = min(x, y), max(x, y)
        dab = d2[a, b]
        na, nb = n[a], n[b]
        nk = n
        new = ((na + nk) * d2[a] + (nb + nk) * d2[b] - nk * dab) / (na + nb + nk)
        raw.append((a, b, float(np.sqrt(max(dab, 0.0))), na + nb))
        d2[a, :] = new
        d2[:, a] = new
        d2[a, a] = np.inf
        alive[b] = False
        d2[b, :] = np.inf
        d2[:, b] = np.inf
        n[a] = na + nb
    # order by height and give linkage ids (union-find over slots)
    order = sorted(range(len(raw)), key=lambda t: raw[t][2])
    parent = list(range(m))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    cluster_of_root = {i: i for i in range(m)}
    for t, idx in enumerate(order):
        a, b, h, sz = raw[idx]
        ra, rb = find(a), find(b)
        ia, ib = cluster_of_root[ra], cluster_of_root[rb]
        parent[rb] = ra
        cluster_of_root[ra] = m + t
        out.append((min(ia, ib), max(ia, ib), h, sz))
    return out


def _cut(merges, m: int, k: int) -> np.ndarray:
    """Cluster number (0..k-1) of each of the m leaves after m - k merges."""
    parent = list(range(m + len(merges)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (a, b, _, _) in enumerate(merges[: max(m - k, 0)]):
        parent[find(a)] = m + step
        parent[find(b)] = m + step
    roots = [find(i) for i in range(m)]
    order = {r: i for i, r in enumerate(sorted(set(roots), key=roots.index))}
    return np.array([order[r] for r in roots])


def _codebook(data: DataFrame, z: Sequence[str], centres: int, seed: int):
    """(rows with their centre, centres in use, their places (m x d), rows per
    centre); nothing in use without rows."""
    if data.isEmpty():
        return data.withColumn("_centre", F.lit(None).cast("int")), [], np.empty((0, len(z))), np.empty(0)
    # equal rows are one weighted point; few points are the codebook themselves
    points = data.groupBy(*z).agg(F.count("*").alias("_n")).persist()
    few = points.limit(centres + 1).collect()
    if len(few) <= centres:
        points.unpersist()
        few.sort()
        book = data.sparkSession.createDataFrame([(*(r[c] for c in z), i) for i, r in enumerate(few)],
                                                 [*z, "_centre"]).withColumn("_centre", F.col("_centre").cast("int"))
        return (data.join(F.broadcast(book), list(z), "left").select(*data.columns, "_centre"), list(range(len(few))),
                np.array([[r[c] for c in z] for r in few], float), np.array([r["_n"] for r in few], float))
    fit = fit_many(points, z, [Run(0, centres, seed)], max_iter=5, weight="_n")[0]
    points.unpersist()
    used = np.flatnonzero(fit.sizes)
    return (data.withColumn("_centre", assign_column(z, fit.centers)), used.tolist(), fit.centers[used],
            fit.sizes[used])


def ward_segments(df: DataFrame, cols: Sequence[str], k: int, centres: int = 256, label: str = "cluster",
                  seed: int = 42) -> DataFrame:
    """Ward hierarchical clustering into k clusters on standardised columns, of
    a codebook: k-means (at most 5 passes of corrected steps) reduces the rows to ``centres``
    weighted points at every size, Ward's merges run on those (a table of that fixed size), and
    rows take the cluster of their centre."""
    z = [f"{c}_z" for c in cols]
    coded, used, points, sizes = _codebook(scale_for_clustering(df, cols), z, centres, seed)
    lab = _cut(_ward_merges(points, sizes), len(sizes), k)
    m = df.sparkSession.createDataFrame([(int(c), int(x)) for c, x in zip(used, lab)], f"_centre int, `{label}` int")
    return coded.join(F.broadcast(m), "_centre", "left").drop("_centre")


def ward_merges(df: DataFrame, cols: Sequence[str], centres: int = 256, last: int = 30, seed: int = 42) -> DataFrame:
    """Dendrogram table of the last ``last`` merges of the codebook: (step,
    left, right, height, size), ids numbered like the usual linkage matrix."""
    z = [f"{c}_z" for c in cols]
    _, _, points, sizes = _codebook(scale_for_clustering(df, cols), z, centres, seed)
    merges = _ward_merges(points, sizes)
    rows = [(i + 1, int(a), int(b), float(h), int(s)) for i, (a, b, h, s) in enumerate(merges)][-last:]
    return df.sparkSession.createDataFrame(rows, "step int, left int, right int, height double, size bigint")


# ---------------------------------------------------------------- evaluation
def silhouette(df: DataFrame, cols: Sequence[str], label: str, distance: str = "squaredEuclidean") -> float:
    """Mean silhouette with Spark's linear-time evaluator (squared Euclidean,
    or cosine).  The plain-Euclidean silhouette needs every pair of rows and is
    deliberately not offered."""
    ev = ClusteringEvaluator(featuresCol="_features", predictionCol=label, metricName="silhouette",
                             distanceMeasure=distance)
    data = _vectors(df.select(*cols, F.col(label).cast("double").alias(label)), cols)
    return float(ev.evaluate(data))


def silhouette_table(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Squared-Euclidean silhouette in the DataFrame API (the same identity the
    evaluator uses): per cluster, n, sum of x and sum of |x|^2 give every row's
    mean squared distance to each cluster in one pass.  One row (silhouette, n)."""
    x = [clean_num(c) for c in cols]
    data = df.select(*[e.alias(f"_x{i}") for i, e in enumerate(x)], F.col(label).alias("_c"))
    sq = sum((F.col(f"_x{i}") ** 2 for i in range(len(cols))), F.lit(0.0))
    per = data.groupBy("_c").agg(F.count("*").alias("_n"), F.sum(sq).alias("_q"),
                                 *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(cols))])
    # one row per cluster: bounded by k
    cl = per.select(F.collect_list(F.struct("*")).alias("_cl"))
    j = data.withColumn("_sq", sq).crossJoin(F.broadcast(cl))
    dot = lambda s: sum((F.col(f"_x{i}") * s[f"_s{i}"] for i in range(len(cols))), F.lit(0.0))
    dist = F.transform("_cl", lambda s: F.struct(
        s["_c"].alias("c"), s["_n"].alias("n"),
        ((F.col("_sq") * s["_n"] - 2 * dot(s) + s["_q"])).alias("tot")))
    j = j.withColumn("_d", dist)
    own = F.filter("_d", lambda s: s["c"] == F.col("_c"))[0]
    a = F.when(own["n"] > 1, own["tot"] / (own["n"] - 1))
    others = F.filter("_d", lambda s: s["c"] != F.col("_c"))
    b = F.array_min(F.transform(others, lambda s: s["tot"] / s["n"]))
    s = F.when(own["n"] > 1, (b - a) / F.greatest(a, b)).otherwise(0.0)
    return j.select(s.alias("_s")).agg(F.avg("_s").alias("silhouette"), F.count("*").alias("n"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def cluster_profiles(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Mean of each column per cluster, in original units."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(clean_num(c)).alias(c) for c in cols])


def compare_segments(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """Cross-tabulation of two segmentations: (label_a, label_b, count)."""
    from custlens.operators.chartdata import crosstab

    return crosstab(df, label_a, label_b)
