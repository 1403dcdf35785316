"""Small plan helpers used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A per-group statistics table is broadcast only when its row count is checked
# to be at most this many rows; beyond it the join is a plain shuffle join
# (AQE may still pick a broadcast at run time from real sizes).
BROADCAST_ROW_LIMIT = 200_000


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Attach per-group statistics to every row of its group.

    ``stats`` holds one row per group (or per group and target).  With no keys
    it is a one-row table and rides along as a broadcast; with keys it is
    broadcast only after its size is checked; ``how`` is the join with keys.
    """
    keys = list(keys)
    if not keys:
        return rows.crossJoin(F.broadcast(stats))
    if stats.count() <= BROADCAST_ROW_LIMIT:
        return rows.join(F.broadcast(stats), keys, how)
    return rows.join(stats, keys, how)


def stat_frame(spark, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small table of statistics; an undefined one (NaN) is NULL."""
    clean = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in rows]
    return spark.createDataFrame(clean, schema)


def judged(p: float | None, alpha: float = 0.05) -> bool | None:
    """p < alpha; NULL where the test is undefined."""
    return None if p is None or p != p else bool(p < alpha)


def one_row(df: DataFrame) -> dict:
    """Collect a single aggregated row (never row-level data) as a dict."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one aggregated row, got {len(rows)}")
    return rows[0].asDict(recursive=True)
