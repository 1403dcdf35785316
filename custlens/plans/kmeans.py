"""Many k-means runs (restarts, several k) advanced together.

Restarts of k-means are independent, so instead of fitting them one after
another (each restart re-reading the rows for every iteration), each pass
over the rows serves all runs at once.  A pass is a ``mapInPandas`` over
Arrow batches: one matrix product finds every row's nearest centre for every
run, and only per-partition partial sums (runs x k rows per partition) leave
the task, which one ``groupBy(run, cluster)`` adds up.

Seeding takes a fixed number of passes, whatever k and the number of runs:
shared oversampling rounds draw points by their weighted squared distance to
those drawn before (exponential keys from a row hash, so a draw is
reproducible and survives task retries), one pass takes the mean and number
of the rows nearest to each drawn point, and every run starts from its own
k-means++ draw on those weighted means, moved there until it settles.  The table's size depends
on the parameters alone.  Runs that start from the same centres are one run.

Between passes a run goes on stepping on that table, each step corrected by
the difference that the last pass found between all rows and the table; where
the correction holds, both have the same resting place.  A run settles only
when a step over all rows hardly moves it; one whose sum of squares rose goes
back and takes plain steps.  Only drawn points and the k x d centres travel between driver and executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    run: int
    k: int
    seed: int


def assign_expr(cols: Sequence[str], centers: np.ndarray) -> Column:
    """0-based index of the nearest centre (smallest index on ties), as a JVM
    expression for labelling rows once the centres are final; NULL without centres."""
    if not len(centers):
        return F.lit(None).cast("int")
    d = F.array(*[sum(((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cols, ctr)), F.lit(0.0))
                  for ctr in centers])
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def assign_column(cols: Sequence[str], centers: np.ndarray) -> Column:
    """As ``assign_expr`` for many centres, where an expression with a term for
    each would no longer be compiled: Arrow batches."""
    @F.pandas_udf("int")
    def nearest(*xs: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.column_stack([x.to_numpy(float) for x in xs]), centers).astype(np.int32))

    return nearest(*[F.col(c).cast("double") for c in cols])


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform (0, 1) from 64-bit row hashes and a salt (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(2 ** 53)


def _d2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; rounding may leave them slightly
    off, so sums of squares are taken again from the differences."""
    return np.maximum((x ** 2).sum(1)[:, None] - 2.0 * (x @ c.T) + (c ** 2).sum(1)[None, :], 0.0)


def _nearest(x: np.ndarray, c: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
    """Nearest centre (the first of equal ones).  A row's own square adds nothing to the
    order, so one product gives it; chunks are small enough to stay in the processor's cache."""
    out, step = np.empty(len(x), np.int64), max(1, cells // max(1, len(c)))
    one, by = np.column_stack([x, np.ones(len(x))]), np.vstack([-2.0 * c.T, (c ** 2).sum(1)])
    for i in range(0, len(x), step):
        out[i:i + step] = (one[i:i + step] @ by).argmin(1)
    return out


def _draw(data: DataFrame, cols: Sequence[str], drawn: np.ndarray, take: int, seed: int, step: int) -> np.ndarray:
    """The ``take`` points with the smallest exponential keys, at a rate of weight
    times squared distance to the points drawn before (the weight alone at first)."""
    cols = list(cols)
    names = [f"p{i}" for i in range(len(cols))]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.empty((0, len(cols) + 1))
        for pdf in batches:
            x, rate = pdf[cols].to_numpy(float), pdf["_w"].to_numpy(float)
            if len(drawn):
                near = drawn[_nearest(x, drawn)]
                rate = rate * ((x - near) ** 2).sum(1)
            u = _uniform(pdf["_h"].to_numpy().astype(np.int64).view(np.uint64), seed * 1000 + step)
            some = rate > 0
            best = np.vstack([best, np.column_stack([-np.log(u[some]) / rate[some], x[some]])])
            best = best[np.argsort(best[:, 0], kind="stable")[:take]]
        yield pd.DataFrame(best, columns=["key", *names])

    got = data.mapInPandas(pick, "key double, " + ", ".join(f"{n} double" for n in names))
    rows = got.orderBy("key", *names).limit(take).collect()
    return np.array([[r[n] for n in names] for r in rows], float).reshape(-1, len(cols))


def _cells(data: DataFrame, cols: Sequence[str], drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, number) of the rows nearest to each drawn point that has any."""
    cols = list(cols)
    d = len(cols)
    names = ["n"] + [f"s{i}" for i in range(d)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((len(drawn), 1 + d))
        for pdf in batches:
            x, w = pdf[cols].to_numpy(float), pdf["_w"].to_numpy(float)
            near = _nearest(x, drawn)
            for j, v in enumerate([w, *(w * x[:, j] for j in range(d))]):
                acc[:, j] += np.bincount(near, weights=v, minlength=len(drawn))
        used = np.flatnonzero(acc[:, 0])
        yield pd.DataFrame(acc[used], columns=names).assign(i=used.astype(np.int32))

    got = data.mapInPandas(partial, ", ".join(f"{n} double" for n in names) + ", i int")
    rows = got.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).orderBy("i").collect()
    sums = np.array([[r[n] for n in names] for r in rows], float)
    return sums[:, 1:] / sums[:, :1], sums[:, 0]


def _step(points: np.ndarray, w: np.ndarray, lab: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Means of the labelled cells; a centre without any stays."""
    n = np.bincount(lab, weights=w, minlength=len(c))
    out = c.copy()
    for j in range(points.shape[1]):
        s = np.bincount(lab, weights=w * points[:, j], minlength=len(c))
        out[n > 0, j] = s[n > 0] / n[n > 0]
    return out


def _settle(points: np.ndarray, w: np.ndarray, c: np.ndarray, shift: float | np.ndarray = 0.0,
            max_iter: int = 100) -> np.ndarray:
    """Lloyd steps on the cells, each followed by ``shift``, until no cell changes its centre."""
    lab = None
    for _ in range(max_iter):
        new = _d2(points, c).argmin(1)
        if lab is not None and (new == lab).all():
            break
        lab = new
        c = _step(points, w, lab, c) + shift
    return c


def _start(points: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on the weighted cell means, moved there until nothing changes."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=w / w.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(1)
    for _ in range(1, k):
        rate = w * far
        # fewer different points than centres: the last one again
        chosen.append(int(rng.choice(len(points), p=rate / rate.sum())) if rate.sum() > 0 else chosen[-1])
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return _settle(points, w, points[chosen].copy())


def _sample_cells(data: DataFrame, cols: Sequence[str], runs: Sequence[Run], rounds: int):
    seed, take = min(r.seed for r in runs), max(512, 4 * max(r.k for r in runs))
    drawn = np.empty((0, len(cols)))
    for step in range(rounds + 1):
        more = _draw(data, cols, drawn, 1 if step == 0 else take, seed, step)
        drawn = np.vstack([drawn, more])
        if not len(more):
            break
    return _cells(data, cols, drawn)


def _pass(data: DataFrame, cols: Sequence[str], centers: dict[int, np.ndarray]):
    cols = list(cols)
    d = len(cols)
    stacked = np.vstack(list(centers.values()))
    bounds, at = [], 0
    for run, c in centers.items():
        bounds.append((run, at, at + len(c)))
        at += len(c)
    schema = "run int, cl int, n double, sse double, " + ", ".join(f"s{i} double" for i in range(d))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((len(stacked), 2 + d))
        for pdf in batches:
            x, w = pdf[cols].to_numpy(float), pdf["_w"].to_numpy(float)
            for _, lo, hi in bounds:
                lab = _nearest(x, stacked[lo:hi]) + lo
                sq = ((x - stacked[lab]) ** 2).sum(1)
                parts = [w, w * sq, *[w * x[:, j] for j in range(d)]]
                for col, v in enumerate(parts):
                    acc[lo:hi, col] += np.bincount(lab - lo, weights=v, minlength=hi - lo)
        out = pd.DataFrame(acc, columns=["n", "sse", *[f"s{i}" for i in range(d)]])
        out.insert(0, "cl", np.concatenate([np.arange(hi - lo) for _, lo, hi in bounds]).astype(np.int32))
        out.insert(0, "run", np.concatenate([np.full(hi - lo, run) for run, lo, hi in bounds]).astype(np.int32))
        yield out[out["n"] > 0]

    fields = ["n", "sse"] + [f"s{i}" for i in range(d)]
    tab = data.mapInPandas(partial, schema).groupBy("run", "cl").agg(*[F.sum(c).alias(c) for c in fields]).collect()
    sums: dict[int, dict[int, tuple]] = {}
    for r in tab:
        sums.setdefault(int(r["run"]), {})[int(r["cl"])] = (r["n"], r["sse"],
                                                            np.array([r[f"s{i}"] for i in range(d)], float))
    return sums


class Fit(NamedTuple):
    centers: np.ndarray
    inertia: float
    settled: bool  # False: still moving after the last allowed pass
    sizes: np.ndarray  # rows per centre


def fit_many(df: DataFrame, cols: Sequence[str], runs: Sequence[Run], max_iter: int = 300, tol: float = 1e-4,
             first: Mapping[int, np.ndarray] | None = None, rounds: int = 4,
             weight: str | None = None) -> dict[int, Fit]:
    """{run: Fit} for every run.  ``df`` holds the (already scaled) feature
    columns, and ``weight`` how many rows each stands for; ``first`` gives first
    centres by run, in place of the seeding (then for every run).  Equal rows are one weighted point, so repeated rows keep
    their weight; runs that have settled leave the passes.  A run that has not
    settled after ``max_iter`` passes is given as it stands, with ``settled``
    false.  A centre nearest to no row stays where it is.  Without rows there
    are no centres."""
    cols = list(cols)
    many = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = df.select(*[F.col(c).cast("double").alias(c) for c in cols], many.alias("_n")).groupBy(*cols).agg(
        F.sum("_n").alias("_w"))
    data = points.withColumn("_h", F.xxhash64(*cols)).persist(StorageLevel.MEMORY_AND_DISK)
    mean = [F.sum(F.col(c) * F.col("_w")) / F.sum("_w") for c in cols]
    var = data.agg(*[(F.sum(F.col(c) * F.col(c) * F.col("_w")) / F.sum("_w") - m * m).alias(c)
                     for c, m in zip(cols, mean)], F.count("*").alias("_n")).collect()[0]
    if all(var[c] is None for c in cols):
        data.unpersist()
        return {r.run: Fit(np.empty((0, len(cols))), 0.0, True, np.empty(0)) for r in runs}
    want = min(4 * df.sparkSession.sparkContext.defaultParallelism, var["_n"] // 10_000)
    if data.rdd.getNumPartitions() < want:  # few bytes, much work in every pass: tasks by points
        few, data = data, data.repartition(want).persist(StorageLevel.MEMORY_AND_DISK)
        data.count()
        few.unpersist()
    thresh = tol * float(np.mean([var[c] or 0.0 for c in cols]))
    cells = _sample_cells(data, cols, runs, rounds) if first is None else None
    start = first if first is not None else {r.run: _start(*cells, r.k, r.seed) for r in runs}
    # the same set of first centres leads to the same end: such runs go together
    lead: dict[tuple, int] = {}
    follows = {}
    for r in runs:
        c = np.array(start[r.run], float).reshape(r.k, len(cols))
        same = (r.k, *(v for row in sorted(np.round(c, 9).tolist()) for v in row)) if first is None else (r.run,)
        follows[r.run] = lead.setdefault(same, r.run)
    centers = {run: np.array(start[run], float).reshape(-1, len(cols)) for run in lead.values()}
    live, plain, last = set(centers), set(), {}
    for _ in range(max_iter):
        if not live:
            break
        sums = _pass(data, cols, {run: centers[run] for run in centers if run in live})
        for run in sorted(live):
            old, got = centers[run], sums.get(run, {})
            sse = sum(v[1] for v in got.values())
            if run in last and run not in plain and sse > last[run][0]:
                # the steps on the cells led off: on from the last step of all rows
                plain.add(run)
                centers[run] = last[run][1]
                continue
            new = old.copy()
            for cl, (n, _, s) in got.items():
                new[cl] = s / n
            centers[run], last[run] = new, (sse, new)
            if ((new - old) ** 2).sum() <= thresh:
                live.discard(run)
            elif cells is not None and run not in plain:
                off = new - _step(*cells, _d2(cells[0], old).argmin(1), old)
                centers[run] = _settle(*cells, new, off)
    final = _pass(data, cols, centers)
    data.unpersist()
    done = {}
    for run, c in centers.items():
        got = final.get(run, {})
        sizes = np.array([got[i][0] if i in got else 0.0 for i in range(len(c))])
        done[run] = Fit(c, float(sum(v[1] for v in got.values())), run not in live, sizes)
    return {r.run: done[follows[r.run]] for r in runs}


def best_of(df: DataFrame, cols: Sequence[str], k: int, restarts: int = 10, seed: int = 42, **kw) -> Fit:
    """The best of ``restarts`` k-means runs by inertia (the first on a tie)."""
    runs = [Run(i, k, seed + i) for i in range(restarts)]
    return min(fit_many(df, cols, runs, **kw).values(), key=lambda f: f.inertia)
