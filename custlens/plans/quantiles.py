"""Exact quantiles without moving the values, and modes.

Spark's exact ``percentile``/``median`` aggregates keep every distinct value of
a group in one hash map, and a sort moves every row.  Here a first pass sketches
each group (``percentile_approx``, merged from partitions) and brackets every
wanted rank between two values; a second pass counts: rows outside the brackets
collapse on the map side into one row per gap, rows inside (a share of about
4 / ``SKETCH`` per probability) are counted by value.  The order statistic is
the value whose running total passes its rank, so the result is exact; a rank
that were to fall into a gap is noticed, and the whole range is then counted.
No switch on the size of a group, and rows are never multiplied by the number of
probabilities.

Modes need every distinct value's count and use that table.

Interpolation is linear between order statistics (type 7, same as pandas,
numpy and SQL ``quantile_cont``).
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.functions.columns import clean_num, clean_value
from custlens.plans.common import BROADCAST_ROW_LIMIT
from custlens.plans.ranks import cumulated, value_counts, with_bucket

SKETCH = 10_000  # a sketched rank is off by at most 1 / SKETCH of the group's rows


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` (NULL/NaN ignored).

    Returns one row per group: ``by`` columns plus one double column per
    probability (``names`` or ``q0, q1, ...``).  Groups with no values are
    absent.
    """
    keys = list(by)
    base = df.select(*keys, clean_num(value).alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        return _ungrouped(base, "_v", [float(p) for p in probs], list(names or [f"q{i}" for i in range(len(probs))]))
    counts = bracket_counts(base, "_v", probs, keys).persist()
    found = quantiles_of_counts(counts, "_v", probs, keys, names, gap="_gap").persist()
    missed = found.where("_gap").limit(1).count()
    counts.unpersist()
    if missed:  # a sketch that is worse than it promises
        return quantiles_of_counts(value_counts(base, "_v", keys), "_v", probs, keys, names)
    return found.drop("_gap")


def _near(p: float) -> tuple[float, float]:
    """Probabilities whose sketched values bracket the exact value at ``p``."""
    return max(0.0, p - 2.0 / SKETCH), min(1.0, p + 2.0 / SKETCH)


def _ungrouped(base: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row of quantiles (none for an empty table).  The driver sees a few
    numbers per probability: the brackets, then the values at the wanted ranks."""
    schema = ", ".join(f"`{n}` double" for n in names)
    near = sorted({q for p in probs for q in _near(p)})
    s = base.agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
                 F.percentile_approx(value, near, SKETCH).alias("b")).first()
    if not s["n"]:
        return base.sparkSession.createDataFrame([], schema)
    at = dict(zip(near, s["b"])) | {0.0: s["lo"], 1.0: s["hi"]}
    ranks = sorted({int(f((s["n"] - 1) * p)) for p in probs for f in (math.floor, math.ceil)})
    for brackets in ([(at[lo], at[hi]) for lo, hi in map(_near, probs)], [(s["lo"], s["hi"])]):
        values = _at_ranks(_bracketed(base, value, brackets), value, ranks)
        if None not in values.values():  # a rank in a gap: a sketch that is worse than it promises
            break
    row = []
    for p in probs:
        h = (s["n"] - 1) * p
        low, high = values[math.floor(h)], values[math.ceil(h)]
        row.append(low if low == high else low + (h - math.floor(h)) * (high - low))
    return base.sparkSession.createDataFrame([tuple(row)], schema)


def _bracketed(base: DataFrame, value: str, brackets: Sequence[tuple[float, float]]) -> DataFrame:
    """:func:`bracket_counts` of an ungrouped table for given brackets; the cell of
    a value is found by binary search."""
    joined: list[list[float]] = []
    for lo, hi in sorted(brackets):
        if joined and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
        else:
            joined.append([lo, hi])
    bounds = [b for lo, hi in joined for b in (lo, math.nextafter(hi, math.inf))]
    inner = [b for b in bounds if -math.inf < b < math.inf]
    first = 1 if bounds[0] == -math.inf else 0
    cells = with_bucket(base.select(value), value, "_g", inner)
    inside = (F.col("_g") + first) % 2 == 1
    cells = cells.select(F.col(value).alias("_x"), F.when(inside, F.col(value)).alias("_at"), F.when(~inside, F.col("_g")).alias("_g"))
    return cells.groupBy("_at", "_g").agg(F.count("*").alias("_cnt"), F.min("_x").alias(value)).select(
        value, "_cnt", F.col("_g").isNotNull().alias("_gap"))


def _at_ranks(counts: DataFrame, value: str, ranks: Sequence[int]) -> dict[int, float | None]:
    """The value at each rank (from 0); None where a gap holds it."""
    counts = counts.persist()
    x = cumulated(counts, value, keep=["_gap"])
    marks = [float(r) for r in ranks]
    x = with_bucket(x.withColumns({"_from": F.col("_before") - 1, "_to": F.col("_before") + F.col("_cnt") - 1}), "_from", "_r0", marks)
    rows = with_bucket(x, "_to", "_r1", marks).where("_r1 > _r0").select(value, "_r0", "_r1", "_gap").collect()
    counts.unpersist()
    return {r: None if row["_gap"] else float(row[value]) for row in rows for r in ranks[row["_r0"]:row["_r1"]]}


def _sum(terms: Sequence[Column]) -> Column:
    """Sum as a balanced tree, so that many terms do not nest deeply."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [functools.reduce(operator.add, terms[i:i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def bracket_counts(base: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by..., value, _cnt, _gap): the non-null numeric ``value`` counted by
    value near the wanted ranks, and by gap elsewhere (``_gap``; the value is
    then the smallest in the gap)."""
    keys = list(by)
    near = sorted({q for p in probs for q in _near(float(p))})
    at = {q: i for i, q in enumerate(near)}
    sketch = base.groupBy(*keys).agg(F.percentile_approx(value, near, SKETCH).alias("_b"), F.min(value).alias("_min"),
                                     F.max(value).alias("_max"))
    low, high = [], []
    for p in sorted({float(p) for p in probs}):
        lo, hi = _near(p)
        # a bracket at the border of the ranks takes the border value itself
        low.append(F.col("_min") if lo <= 0.0 else F.element_at("_b", at[lo] + 1))
        high.append(F.col("_max") if hi >= 1.0 else F.element_at("_b", at[hi] + 1))
    marks = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                          *[c.alias(f"_lo{i}") for i, c in enumerate(low)], *[c.alias(f"_hi{i}") for i, c in enumerate(high)])
    marks = marks.persist()  # one row per group
    on = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    rows = base.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROW_LIMIT else marks, on)
    v = F.col(value)
    opened = _sum([(v >= F.col(f"_lo{i}")).cast("int") for i in range(len(low))])
    closed = _sum([(v > F.col(f"_hi{i}")).cast("int") for i in range(len(low))])
    cells = rows.select(*keys, v, opened.alias("_o"), closed.alias("_c"))
    inside = F.col("_o") > F.col("_c")
    cells = cells.select(*keys, v.alias("_x"), F.when(inside, v).alias("_at"), F.when(~inside, F.col("_o") + F.col("_c")).alias("_g"))
    return cells.groupBy(*keys, "_at", "_g").agg(F.count("*").alias("_cnt"), F.min("_x").alias(value)).select(
        *keys, value, "_cnt", F.col("_g").isNotNull().alias("_gap"))


def quantiles_of_counts(counts: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                        names: Sequence[str] | None = None, gap: str | None = None) -> DataFrame:
    """:func:`exact_quantiles` of a (by..., value, _cnt) table; with ``gap`` also
    whether a wanted rank fell into a row that is marked so."""
    keys, probs = list(by), [float(p) for p in probs]
    names = list(names or [f"q{i}" for i in range(len(probs))])
    x = cumulated(counts, value, keys, total="_n", keep=[gap] if gap else [])
    low = [F.floor((F.col("_n") - 1) * F.lit(p)) for p in probs]
    high = [F.ceil((F.col("_n") - 1) * F.lit(p)) for p in probs]
    holds = lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_cnt"))
    # a value that holds none of the wanted ranks leaves before the aggregate
    wanted = F.lit(False)
    for r in low + high:
        wanted = wanted | holds(r)
    v = F.col(value).cast("double")
    ends = [F.max(F.when(holds(r), v)).alias(f"_{end}{i}") for end, rs in (("lo", low), ("hi", high))
            for i, r in enumerate(rs)]
    found = x.where(wanted).groupBy(*keys).agg(F.max("_n").alias("_n"), *ends, *([F.bool_or(gap).alias(gap)] if gap else []))
    if not keys:
        found = found.where(F.col("_n").isNotNull())
    out = []
    for i, (p, n) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (h - F.floor(h)) * (hi - lo)).alias(n))
    return found.select(*keys, *out, *([gap] if gap else []))


def mode_smallest(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """Most frequent value per group, smallest value among ties, in the
    column's own type."""
    keys = list(by)
    base = df.select(*keys, clean_value(df, value).alias("_v")).where(F.col("_v").isNotNull())
    return mode_of_counts(value_counts(base, "_v", keys), "_v", keys, name)


def mode_of_counts(counts: DataFrame, value: str, by: Sequence[str] = (), name: str = "mode") -> DataFrame:
    """:func:`mode_smallest` of a (by..., value, _cnt) table: one struct minimum."""
    top = counts.groupBy(*by).agg(F.min(F.struct((-F.col("_cnt")).alias("c"), F.col(value).alias("v"))).alias("_top"))
    out = top.select(*by, F.col("_top.v").alias(name))
    return out if by else out.where(F.col(name).isNotNull())
