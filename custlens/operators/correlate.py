"""Pearson, Spearman and Kendall correlation; pairwise correlation matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num, direction_label, strength_label
from custlens.plans.ranks import average_rank, kendall_tau_b, value_ranks

METHODS = ("pearson", "spearman", "kendall")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(clean_num(a).alias("_a"), clean_num(b).alias("_b")).where(
        F.col("_a").isNotNull() & F.col("_b").isNotNull()
    )


def corr(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """One row (col_a, col_b, method, n, r) over rows with both values present.

    Spearman = Pearson of average ranks (distributed ranks, no single-task
    window); Kendall = tau-b with tie correction (bucketed inversion count)."""
    p = _pairs(df, a, b)
    if method == "pearson":
        res = p.agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("r"))
    elif method == "spearman":
        # rank tables of the two columns are built side by side from the same
        # pairs, then joined back on value (no rank of a rank's lineage)
        ra = value_ranks(p.select("_a"), "_a").select("_a", F.col("_avg_rank").alias("_ra"))
        rb = value_ranks(p.select("_b"), "_b").select("_b", F.col("_avg_rank").alias("_rb"))
        r = p.join(ra, "_a").join(rb, "_b")
        res = r.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("r"))
    elif method == "kendall":
        res = kendall_tau_b(p, "_a", "_b").select("n", F.col("tau_b").alias("r"))
    else:
        raise ValueError(f"method must be one of {METHODS}")
    return res.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit(method).alias("method"),
                      F.col("n").cast("bigint").alias("n"), "r")


def corr_report(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    """:func:`corr` plus verbal strength and direction."""
    return corr(df, a, b, method).withColumns({"strength": strength_label("r"), "direction": direction_label("r")})


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long-form matrix (col_a, col_b, r) over every ordered pair, pairwise
    deletion of missing values.  Pearson: every pair in one aggregate pass."""
    cols = list(cols)
    if method == "pearson":
        aggs = [F.corr(clean_num(x), clean_num(y)).alias(f"{i}_{j}")
                for i, x in enumerate(cols) for j, y in enumerate(cols)]
        out = _cells(df.agg(*aggs), cols)
        # a column correlates with itself exactly (where defined)
        return out.withColumn("r", F.when((F.col("col_a") == F.col("col_b")) & F.col("r").isNotNull(), 1.0)
                              .otherwise(F.col("r")))
    # the diagonal needs no ranks: 1 where the column varies
    spread = df.agg(*[F.when(F.min(clean_num(x)) < F.max(clean_num(x)), 1.0).alias(f"{i}_{i}")
                      for i, x in enumerate(cols)],
                    *[F.count_if(clean_num(x).isNull()).alias(f"_m{i}") for i, x in enumerate(cols)])
    out = _cells(spread, cols, [(i, i) for i in range(len(cols))])
    whole = []
    if method == "spearman":
        # columns without missing values have the same ranks in every pair: rank each once
        missing = spread.collect()[0]
        whole = [i for i in range(len(cols)) if not missing[f"_m{i}"]]
    ranked = df.select(*[F.col(cols[i]).alias(f"_c{i}") for i in whole])
    for i in whole if len(whole) > 1 else []:
        ranked = average_rank(ranked, f"_c{i}", f"_r{i}")
    both = [(i, j) for i in whole for j in whole if i < j]
    if both:
        out = out.unionByName(_cells(ranked.agg(*[F.corr(f"_r{i}", f"_r{j}").alias(f"{i}_{j}") for i, j in both]), cols,
                                     both, mirrored=True))
    for i, x in enumerate(cols):
        for j in range(i + 1, len(cols)):
            if (i, j) not in both:
                c = corr(df, x, cols[j], method).select("col_a", "col_b", "r")
                out = out.unionByName(c).unionByName(c.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"))
    return out


def _cells(wide: DataFrame, cols: Sequence[str], pairs=None, mirrored: bool = False) -> DataFrame:
    """One row with columns ``i_j`` -> (col_a, col_b, r) rows."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))] if pairs is None else pairs
    cell = lambda i, j, r: F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), r.alias("r"))
    cells = [cell(i, j, F.col(f"{i}_{j}")) for i, j in pairs]
    cells += [cell(j, i, F.col(f"{i}_{j}")) for i, j in pairs] if mirrored else []
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
