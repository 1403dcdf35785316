"""Distributed average ranks and Kendall's tau-b.

Neither uses an unpartitioned window (which would move every row to one task)
or an all-pairs join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num, clean_value

BUCKET_VALUES = 200_000  # distinct values that one range bucket holds on average


def bucket_count(n_items: int, per_bucket: int = BUCKET_VALUES, lo: int = 1) -> int:
    """Buckets so that one bucket holds about ``per_bucket`` items."""
    return int(max(lo, -(-n_items // per_bucket)))


def range_bounds(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets`` - 1 rising bounds near the quantiles of ``value``."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, max(10000, 10 * buckets)).alias("_b"))
    return sorted({float(v) for v in found.collect()[0]["_b"] or []})


def with_bucket(df: DataFrame, value: str, out: str, bounds: Sequence[float]) -> DataFrame:
    """Append ``out`` = index of the range bucket of the numeric column
    ``value``, found by binary search in the JVM (``Bucketizer``).  A function
    of the value, so equal values share a bucket; retries see the same literal
    bounds."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return df.withColumn(out, F.lit(0))
    tmp = f"_{out}_x"
    splits = [-float("inf"), *bounds, float("inf")]
    bz = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return bz.transform(df.withColumn(tmp, F.col(value).cast("double"))).withColumn(
        out, F.col(out).cast("int")).drop(tmp)


def range_buckets(df: DataFrame, value: str, out: str, n_items: int | None = None) -> DataFrame:
    """:func:`with_bucket` with as many buckets as the number of items asks for."""
    n = n_items if n_items is not None else df.count()
    return with_bucket(df, value, out, range_bounds(df, value, bucket_count(n)))


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, _cnt): a hot value is combined on the map side.  Kept,
    since bounds, totals and running sums each read it."""
    return df.groupBy(*by, value).agg(F.count("*").alias("_cnt")).persist()


def cumulated(counts: DataFrame, value: str, by: Sequence[str] = (), total: str | None = None,
              keep: Sequence[str] = ()) -> DataFrame:
    """A (by..., value, _cnt) table with ``_before`` = the group's rows with a
    smaller value (and ``total`` = the group's rows).

    Distinct values are cut into range buckets over all groups; bucket totals
    (one row per group and bucket) give offsets, a window per group and bucket
    gives the position inside, so no window holds more than a bucket's values.
    """
    keys = list(by)
    b = range_buckets(counts, value, "_bkt")
    sums = b.groupBy(*keys, "_bkt").agg(F.sum("_cnt").alias("_sum"))
    whole = Window.partitionBy(*keys)
    offsets = sums.select(*keys, "_bkt", (F.sum("_sum").over(whole.orderBy("_bkt")) - F.col("_sum")).alias("_off"),
                          *([F.sum("_sum").over(whole).alias(total)] if total else []))
    inside = Window.partitionBy(*keys, "_bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = b.withColumn("_in", F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
    renamed = offsets.select(*[F.col(k).alias(f"_o_{i}") for i, k in enumerate(keys)], F.col("_bkt").alias("_o_bkt"),
                             "_off", *([total] if total else []))
    on = F.col("_bkt") == F.col("_o_bkt")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{i}"))
    return placed.join(renamed, on).select(*keys, value, "_cnt", *keep, (F.col("_off") + F.col("_in")).alias("_before"),
                                           *([total] if total else []))


def value_ranks(df: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Average rank of every distinct value of the (already clean, non-null)
    column ``value_col`` within its group: (by..., value_col, _cnt, _avg_rank)."""
    c = cumulated(value_counts(df, value_col, by), value_col, by)
    return c.select(*by, value_col, "_cnt", (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias("_avg_rank"))


def average_rank(df: DataFrame, col: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Append ``name`` = average rank of ``col`` (1-based, ties averaged) within
    ``by`` groups; missing values get a missing rank and stay out of the join."""
    keys, tmp = list(by), f"_rk_{name}"
    base = df.withColumn(tmp, clean_value(df, col))
    there = base.where(F.col(tmp).isNotNull())
    ranks = value_ranks(there.select(*keys, tmp), tmp, keys)
    renamed = ranks.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)], F.col(tmp).alias("_r_v"),
                           F.col("_avg_rank").alias(name))
    on = F.col(tmp) == F.col("_r_v")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{i}"))
    found = there.join(renamed, on).drop("_r_v", *[f"_r_{i}" for i in range(len(keys))])
    missing = base.where(F.col(tmp).isNull()).withColumn(name, F.lit(None).cast("double"))
    return found.unionByName(missing).drop(tmp)


# ------------------------------------------------------------------ Kendall tau-b
def _sign_pair_sum(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """sum over i<j of w_i w_j sign(u_i-u_j) sign(v_i-v_j) for weighted
    points (repeats allowed), O(m log^2 m) in vectorised numpy.

    Points are put in (u, v) order; a bottom-up divide and conquer over the
    positions counts, for every point of a right half, the weight of the left
    half below and above it in v (two sorts per level).  Pairs that share u
    were counted as concordant by position and are taken out at the end."""
    m = len(u)
    if m < 2:
        return 0.0
    order = np.lexsort((v, u))
    u, v, w = u[order], v[order], w[order].astype(float)
    vr = np.searchsorted(np.unique(v), v)
    pos = np.arange(m)
    s = 0.0
    size = 1
    while size < m:
        block = pos // (2 * size)
        left = (pos // size) % 2 == 0
        lw = np.where(left, w, 0.0)
        ltot = np.bincount(block, weights=lw)
        for strict in (True, False):
            # equal v: right before left counts "strictly below", left first counts "at or below"
            tie = left.astype(np.int8) if strict else (~left).astype(np.int8)
            o = np.lexsort((tie, vr, block))
            cs = np.cumsum(lw[o]) - lw[o]
            first = np.r_[0, np.flatnonzero(np.diff(block[o])) + 1]
            base = np.repeat(cs[first], np.diff(np.r_[first, m]))
            below = np.empty(m)
            below[o] = cs - base
            if strict:
                less = below
            else:
                greater = ltot[block] - below
        right = ~left
        s += float(np.sum(w[right] * (less[right] - greater[right])))
        size *= 2
    # pairs with equal u and different v sit in v order, so each was counted
    # as +w_i w_j; pairs with equal u and equal v were counted as 0
    ug = np.searchsorted(np.unique(u), u)
    wg = np.bincount(ug, weights=w)
    cell = ug.astype(np.int64) * (int(vr.max()) + 1) + vr
    _, inv = np.unique(cell, return_inverse=True)
    wc = np.bincount(inv, weights=w)
    s -= float((np.sum(wg ** 2) - np.sum(wc ** 2)) / 2.0)
    return s


def _group_s(key: str, ucol: str, vcol: str):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        s = _sign_pair_sum(
            pdf[ucol].to_numpy(dtype=float), pdf[vcol].to_numpy(dtype=float), pdf["_c"].to_numpy(dtype=float)
        )
        return pd.DataFrame({"s": [s]})

    return fn


def _apart(df: DataFrame, value: str, out: str, bounds: Sequence[float]) -> DataFrame:
    """Append ``out``: 2i for values strictly between bounds i - 1 and i, and
    2i + 1 for the bound i itself (a Bucketizer bucket starts at its bound)."""
    b = with_bucket(df, value, out, bounds)
    lows = F.array(F.lit(None).cast("double"), *[F.lit(x) for x in bounds])
    at_bound = F.coalesce(F.get(lows, F.col(out)) == F.col(value), F.lit(False))
    return b.withColumn(out, 2 * F.col(out) - F.when(at_bound, 1).otherwise(0))


def _grid_sign_sum(cells: DataFrame, sides: int) -> DataFrame:
    """One row ``s``: the signed weight of all pairs of cells (_bx, _by, g) that
    differ in both buckets.  Two x buckets part at the highest bit in which they
    differ, so every pair is seen at one bit: there the cells of one block (the
    bits above) are the lower and the upper half, and running sums over y sign
    the upper against the lower.  A block has at most ``sides`` rows."""
    bits = cells.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, sides.bit_length() - 1)))).alias("bit"),
                        "_bx", "_by", "g")
    upper = F.expr("shiftright(_bx, bit) % 2 = 1")
    halves = bits.groupBy("bit", F.expr("shiftright(_bx, bit + 1)").alias("block"), "_by").agg(
        F.sum(F.when(~upper, F.col("g")).otherwise(0.0)).alias("lo"),
        F.sum(F.when(upper, F.col("g")).otherwise(0.0)).alias("hi"))
    block = Window.partitionBy("bit", "block")
    upto = F.sum("lo").over(block.orderBy("_by").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # below minus above
    signed = (upto - F.col("lo")) - (F.sum("lo").over(block) - upto)
    return halves.select((F.col("hi") * signed).alias("s")).agg(F.sum("s").alias("s"))


def kendall_tau_b(df: DataFrame, a: str, b: str, buckets: int | None = None) -> DataFrame:
    """Kendall's tau-b of two columns over rows with both present.

    One row: n, s (concordant minus discordant), tau_b.  Pairs are split by
    quantile buckets of x and y: pairs in different x and y buckets are signed
    by the bucket grid (running sums in Spark, bit by bit of the x bucket; only
    their sum is collected); pairs sharing an x bucket, or a y bucket only, are counted exactly per bucket by
    a vectorised inversion count (``applyInPandas``).  Every bound is a bucket
    of its own: a heavy value is a bound, so it shares its bucket with no other
    value, and buckets of one value are skipped (their inner pairs are ties).
    Equal pairs are first compressed to (x, y, count).
    """
    pairs = df.select(clean_num(a).alias("_x"), clean_num(b).alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()
    )
    comp = pairs.groupBy("_x", "_y").agg(F.count("*").alias("_c"))
    comp = comp.persist()
    if buckets is None:
        # about 100,000 compressed points per bucket
        buckets = bucket_count(comp.count(), per_bucket=100_000, lo=128)
    bx, by = range_bounds(comp, "_x", buckets), range_bounds(comp, "_y", buckets)
    cb = _apart(_apart(comp, "_x", "_bx", bx), "_y", "_by", by).select("_x", "_y", "_c", "_bx", "_by").persist()
    sides = 2 * max(len(bx), len(by)) + 2

    # ties and n
    n = cb.agg(F.sum("_c").alias("n")).collect()[0]["n"] or 0
    tx = cb.groupBy("_x").agg(F.sum("_c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("v"))
    ty = cb.groupBy("_y").agg(F.sum("_c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("v"))
    n1 = float(tx.collect()[0]["v"] or 0.0)
    n2 = float(ty.collect()[0]["v"] or 0.0)

    s_grid = _grid_sign_sum(cb.groupBy("_bx", "_by").agg(F.sum("_c").cast("double").alias("g")),
                            sides).collect()[0]["s"] or 0.0

    # exact parts per bucket, skipping single-valued buckets
    sch = "s double"
    multi_x = cb.groupBy("_bx").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).where("lo < hi").select("_bx")
    sx = (
        cb.join(multi_x, "_bx", "left_semi")
        .select("_bx", "_x", "_y", "_c")
        .groupBy("_bx")
        .applyInPandas(_group_s("_bx", "_x", "_y"), sch)
        .agg(F.sum("s").alias("s"))
        .collect()[0]["s"]
        or 0.0
    )
    multi_y = cb.groupBy("_by").agg(F.min("_y").alias("lo"), F.max("_y").alias("hi")).where("lo < hi").select("_by")
    sy = (
        cb.join(multi_y, "_by", "left_semi")
        .select("_by", F.col("_bx").cast("double").alias("_u"), "_y", "_c")
        .groupBy("_by")
        .applyInPandas(_group_s("_by", "_u", "_y"), sch)
        .agg(F.sum("s").alias("s"))
        .collect()[0]["s"]
        or 0.0
    )
    cb.unpersist()
    comp.unpersist()
    s = s_grid + sx + sy
    n0 = n * (n - 1) / 2.0
    denom = ((n0 - n1) * (n0 - n2)) ** 0.5
    tau = s / denom if denom > 0 else None
    spark = df.sparkSession
    return spark.createDataFrame(
        [(int(n), float(round(s)), tau)], "n bigint, s double, tau_b double"
    )
