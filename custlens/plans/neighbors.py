"""Exact k-nearest neighbours without an all-pairs join.

The space is cut by a k-d tree into leaves of about ``leaf_rows`` training
points.  The tree is fitted on a sample of about 64 points a leaf (at most
``max_leaves`` leaves, so the driver's share is bounded); every training row is
placed in it, and every leaf keeps the box of all its rows.  A query first looks
at its own leaf.  The k-th distance found there bounds the rest: it then looks
only at the other leaves whose box is as near, which makes the answer exact
however dense or uneven the points lie.  A query costs about one leaf and a
few neighbours; rows, not pairs, are shuffled, and a leaf asked by many queries
is given to several tasks.  Identical training points beyond the k with the
smallest keys are dropped first (exact, see ``_drop_shadowed_copies``), so a
leaf does not fill up with copies.  Meant for the low-dimensional, standardised
feature spaces of the classifiers (d up to ~6).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_LEAF = 64


@dataclass
class Cells:
    """A k-d tree: nodes in the order they were made, a child after its parent."""

    feature: list[int] = field(default_factory=list)  # -1: leaf
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    lo: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # boxes of the nodes' rows
    hi: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    @classmethod
    def fit(cls, points: np.ndarray, most: int) -> Cells:
        """Halve the widest side until a leaf holds at most ``most`` of the points."""
        out, todo = cls([-1], [0.0], [-1]), [(0, points)]
        while todo:
            node, p = todo.pop()
            if len(p) <= most:
                continue
            f = int(np.nanargmax(np.ptp(p, axis=0))) if not np.isnan(np.ptp(p, axis=0)).all() else 0
            v = np.sort(p[:, f])
            cut = v[(len(v) - 1) // 2]
            if not cut < v[-1]:
                below = v[v < v[-1]]
                if not len(below):
                    continue
                cut = below[-1]
            out.feature[node], out.cut[node], out.left[node] = f, float(cut), len(out.feature)
            up = p[:, f] > cut
            for part in (p[~up], p[up]):
                todo.append((len(out.feature), part))
                out.feature.append(-1)
                out.cut.append(0.0)
                out.left.append(-1)
        return out

    def route(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(x), dtype=np.int64)
        go = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, dtype=np.int64)
        while len(go):
            n = at[go]
            at[go] = left[n] + (x[go, feature[n]] > cut[n])
            go = go[feature[at[go]] >= 0]
        return at

    def bound(self, boxes: dict[int, tuple[Sequence[float], Sequence[float]]], d: int) -> None:
        """Set the boxes, from those of the leaves that hold rows."""
        n = len(self.feature)
        self.lo, self.hi = np.full((n, d), np.inf), np.full((n, d), -np.inf)
        for node in range(n - 1, -1, -1):
            if node in boxes:
                self.lo[node], self.hi[node] = boxes[node]
            elif self.feature[node] >= 0:
                kids = [self.left[node], self.left[node] + 1]
                self.lo[node], self.hi[node] = self.lo[kids].min(0), self.hi[kids].max(0)

    def near(self, x: np.ndarray, home: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the other leaves whose box is within a row's squared
        distance ``r2``.  A box is never farther than its rows: the sums are taken in
        the order of the distances, and each step of rounding keeps the order."""
        rows, leaves = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            far = np.zeros(len(at))
            for i in range(x.shape[1]):
                q = x[at, i]
                far = far + np.maximum(np.maximum(self.lo[node, i] - q, q - self.hi[node, i]), 0.0) ** 2
            at = at[~(far > r2[at])]
            if not len(at):
                continue
            if self.feature[node] >= 0:
                todo += [(self.left[node], at), (self.left[node] + 1, at)]
            else:
                at = at[home[at] != node]
                rows.append(at)
                leaves.append(np.full(len(at), node))
        return np.concatenate(rows), np.concatenate(leaves)


def _drop_shadowed_copies(train: DataFrame, cols: Sequence[str], k: int, train_key: str,
                          rows_per_task: int = 1_000_000) -> DataFrame:
    """Keep at most k training points per identical coordinate vector.

    Identical points are equally far from every query and ties go to the
    smaller key, so only the k smallest keys of a coordinate can ever be
    chosen; dropping the rest is exact.  A coordinate holding many copies is
    ranked in salted slices of about ``rows_per_task`` rows, then the
    survivors (at most k per slice) are ranked once more."""
    mult = train.groupBy(*cols).count().agg(F.max("count").alias("m")).collect()[0]["m"] or 0
    if mult <= k:
        return train
    slices = int(max(1, -(-mult // rows_per_task)))
    salted = train.withColumn("_slice", F.pmod(F.xxhash64(F.col(train_key)), F.lit(slices)))
    w1 = Window.partitionBy(*cols, "_slice").orderBy(train_key)
    first = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*cols).orderBy(train_key)
    return first.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k).drop("_r", "_slice")


def _cells_of(train: DataFrame, names: Sequence[str], leaf_rows: int, max_leaves: int) -> Cells:
    n = train.count()
    leaves = min(max_leaves, -(-n // leaf_rows))
    if leaves <= 1:
        return Cells.fit(np.empty((0, len(names))), 1)
    want = leaves * SAMPLE_PER_LEAF
    some = train.where(F.pmod(F.xxhash64("_rid", *names), F.lit(n)) < want).select(*names).toArrow()
    points = np.column_stack([some.column(c).to_numpy() for c in names])
    return Cells.fit(points, max(1, SAMPLE_PER_LEAF * 3 // 2))


def _k_smallest(d2: np.ndarray, k: int, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of each row's k smallest values up to ``r2``, smallest
    first, ties to the smaller column."""
    least = np.minimum(np.partition(d2, k - 1, axis=1)[:, k - 1], r2) if d2.shape[1] > k else r2
    i, j = np.nonzero(d2 <= least[:, None])
    v = d2[i, j]
    order = np.lexsort((j, v, i))
    i, j, v = i[order], j[order], v[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], v[keep]


def _search(train: DataFrame, asked: DataFrame, cells: Cells, names: Sequence[str], k: int, query_rows: int,
            look_on: bool) -> DataFrame:
    """Per query (row of ``asked`` with its leaf and the squared distance to stay
    within) its nearest training points in that leaf, and with ``look_on`` the other
    leaves that may hold nearer ones."""
    names, d = list(names), len(names)
    kinds = {f.name: f.dataType.simpleString() for f in [*train.schema, *asked.schema]}
    load = asked.groupBy("_leaf").count().collect()
    spark = asked.sparkSession
    # small rows, much work: tasks by leaves, not by bytes
    tasks = max(1, min(len(load), 4 * spark.sparkContext.defaultParallelism))
    shares = spark.createDataFrame([(r["_leaf"], -(-r["count"] // query_rows)) for r in load],
                                                "_leaf int, _shares int")
    queries = asked.join(F.broadcast(shares), "_leaf").withColumn(
        "_share", F.pmod(F.xxhash64("_tid", *names), F.col("_shares")).cast("int")).drop("_shares")
    points = train.join(F.broadcast(shares), "_leaf").withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")

    def nearest(here: pa.Table, asks: pa.Table) -> pa.Table:
        here = here.take(pc.sort_indices(here, sort_keys=[("_rid", "ascending")], null_placement="at_start"))
        t = np.column_stack([here.column(c).to_numpy() for c in names])
        q = np.column_stack([asks.column(c).to_numpy() for c in names])
        r2 = asks.column("_r2").to_numpy()
        got = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        step = max(1, (1 << 18) // max(1, len(t)))
        for s in range(0, len(q) if len(t) else 0, step):
            part, d2 = q[s:s + step], 0.0
            for c in range(d):
                d2 = d2 + (part[:, c:c + 1] - t[:, c]) ** 2
            i, j, v = _k_smallest(np.where(np.isnan(d2), np.inf, d2), k, r2[s:s + step])
            got.append((i + s, j, v))
        i, j, v = (np.concatenate(c) for c in zip(*got))
        n = np.bincount(i, minlength=len(q))
        ends = np.cumsum(n)
        near = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(v), here.column("_rid").take(pa.array(j)).combine_chunks(),
             here.column("_label").take(pa.array(j)).combine_chunks()], names=["dist2", "rid", "label"]))
        out = [asks.column("_tid"), near]
        if look_on:
            kth = np.full(len(q), np.inf)
            kth[n == k] = v[ends[n == k] - 1]
            row, leaf = cells.near(q, asks.column("_leaf").to_numpy(), kth)
            order = np.argsort(row, kind="stable")
            at = np.r_[0, np.cumsum(np.bincount(row, minlength=len(q)))].astype(np.int32)
            out += [pa.ListArray.from_arrays(pa.array(at), pa.array(leaf[order].astype(np.int32))), pa.array(kth),
                    *[asks.column(c) for c in names]]
        return pa.table(out, names=["_tid", "near", *(["leaves", "_r2", *names] if look_on else [])])

    schema = (f"_tid {kinds['_tid']}, near array<struct<dist2:double,rid:{kinds['_rid']},label:{kinds['_label']}>>"
              + (", leaves array<int>, _r2 double, " + ", ".join(f"{c} double" for c in names) if look_on else ""))
    points, queries = (t.repartition(tasks, "_leaf", "_share") for t in (points, queries))
    return points.groupBy("_leaf", "_share").cogroup(queries.groupBy("_leaf", "_share")).applyInArrow(nearest, schema)


def knn(train: DataFrame, test: DataFrame, cols: Sequence[str], k: int, key: str = "_tid", train_key: str = "_rid",
        label: str = "_label", leaf_rows: int = 2048, max_leaves: int = 8192, query_rows: int = 50_000) -> DataFrame:
    """(key, neighbours) with ``neighbours`` = array of struct(dist2, train key,
    label) of the k nearest training points, nearest first (ties by train key).

    ``train`` has (train_key, cols..., label); ``test`` has (key, cols...)."""
    cols = list(cols)
    names = [f"_x{i}" for i in range(len(cols))]
    xs = [F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]
    kept = _drop_shadowed_copies(train, cols, k, train_key).select(
        F.col(train_key).alias("_rid"), F.col(label).alias("_label"), *xs).persist(StorageLevel.MEMORY_AND_DISK)
    cells = _cells_of(kept, names, leaf_rows, max_leaves)

    @F.pandas_udf("int")
    def leaf_of(*v: pd.Series) -> pd.Series:
        return pd.Series(cells.route(np.column_stack([c.to_numpy(float) for c in v])).astype(np.int32))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_leaf", leaf_of(*names))

    points = placed(kept).persist(StorageLevel.MEMORY_AND_DISK)
    boxes = points.groupBy("_leaf").agg(*[f(c) for f in (F.min, F.max) for c in names]).collect()
    cells.bound({r[0]: (r[1:1 + len(cols)], r[1 + len(cols):]) for r in boxes}, len(cols))
    kept.unpersist()
    asked = placed(test.select(F.col(key).alias("_tid"), *xs, F.lit(float("inf")).alias("_r2"))).persist(
        StorageLevel.MEMORY_AND_DISK)
    first = _search(points, asked, cells, names, k, query_rows, True).persist(StorageLevel.MEMORY_AND_DISK)
    on = first.select("_tid", "_r2", *names, F.explode("leaves").alias("_leaf"))
    second = _search(points, on, cells, names, k, query_rows, False)
    asked.unpersist()
    found = first.select("_tid", F.explode("near").alias("n")).unionByName(
        second.select("_tid", F.explode("near").alias("n")))
    # the k nearest are picked on the map side first (window group limit)
    best = Window.partitionBy("_tid").orderBy("n.dist2", "n.rid")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy("_tid").agg(
        F.sort_array(F.collect_list("n")).alias("neighbours")).withColumnRenamed("_tid", key)
