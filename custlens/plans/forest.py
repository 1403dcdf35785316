"""Random forest grown until every leaf is pure or holds equal rows.

Nodes of more than ``node_rows`` bootstrap rows are split level by level on
Spark: one pass over the rows per level routes them down all trees and counts
classes in equal-width bins of each such node's own value ranges, all trees
together.  Every bin also reports its smallest and largest value, so the next
ranges are tight and thresholds lie between values that occur.  A large node
without spread is a leaf at once, and its rows go nowhere.

The other nodes, at most ``node_rows`` training rows each, are dealt to groups:
nodes of many trees that lie near each other (see ``_dealt``).  A group gets every
row that any of its nodes needs once, not once per tree: which rows a tree uses
follows from its top and its bootstrap, so the task finds them again, and grows
the rest of each tree exactly, from one sort per feature that every split only
deals to its children; the rows to be predicted that fall there are routed at the
same time, so no tree has to be kept.  What is shuffled grows with the rows and
the groups, not with the trees.  Rows travel packed, one record per group of about
100,000 rows, and so do votes, added up over the group's trees.  The rows to be
predicted are the other part of a split: as many as the training rows, or fewer.
Those in a large leaf are answered where they are.

A row's bootstrap weight is Poisson(1) by its hash and the tree, so it is the
same after a task retry.  Only class counts and the tops of the trees travel
through the driver: about rows x trees / node_rows nodes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import exp, factorial
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.plans.kmeans import _uniform
from custlens.session import cut_lineage

BUCKET_BITS = 13  # votes are added up for so many neighbouring rows at once
_POISSON = np.cumsum([exp(-1.0) / factorial(i) for i in range(16)])


@dataclass
class Top:
    """The part of a tree above its small nodes."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    closed: dict[int, np.ndarray] = field(default_factory=dict)  # large leaves: class shares
    small: dict[int, tuple[float, np.ndarray]] = field(default_factory=dict)  # nodes to grow: rows, middle of their ranges

    def route(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            go = np.flatnonzero(feature[at] >= 0)
            if not len(go):
                return at
            n = at[go]
            at[go] = left[n] + (x[go, feature[n]] > cut[n])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for store, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1)):
            store.extend([v, v])
        return self.left[node], self.left[node] + 1


def _bootstrap(h: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return np.searchsorted(_POISSON, _uniform(h, seed * 100_003 + tree + 1)).astype(float)


def _chance(tree: int, node: np.ndarray, feature: int, seed: int) -> np.ndarray:
    """A node's random order of features."""
    return _uniform(node.astype(np.uint64) * np.uint64(1009) + np.uint64(feature), seed * 7919 + tree + 1)


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times weight, of class weights along the last axis."""
    n = counts.sum(-1)
    return n - np.einsum("...i,...i->...", counts, counts) / np.where(n > 0, n, 1.0)


def _impurity_by_class(counts: np.ndarray) -> np.ndarray:
    """The same of class weights along the first axis: long sums go along memory."""
    n = counts.sum(0)
    return n - (counts * counts).sum(0) / np.where(n > 0, n, 1.0)


def _first(can: np.ndarray, rank: np.ndarray, tried: int) -> np.ndarray:
    """Per node (row) the first ``tried`` features in its order that can be split."""
    place = np.argsort(np.argsort(np.where(can, rank, np.inf), axis=1, kind="stable"), axis=1, kind="stable")
    return can & (place < tried)


def _choose(gain: np.ndarray, rank: np.ndarray, tried: int) -> np.ndarray:
    """Per node (row) the best feature among the first ``tried`` in its order
    that can be split at all (gain not NaN); -1 where none can."""
    can = ~np.isnan(gain)
    g = np.where(_first(can, rank, tried), gain, -np.inf)
    return np.where(can.any(1), g.argmax(1), -1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, test: np.ndarray, classes: int, tried: int, tree: int,
         seed: int, root: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(class shares of the leaf of each test row, impurity taken away by each feature)."""
    p = x.shape[1]
    out, won = np.zeros((len(test), classes)), np.zeros(p)
    tnode, trows = np.zeros(len(test), dtype=np.int64), np.arange(len(test))
    # per feature the rows by (node, value): sorted once, then only dealt to the children
    order = [np.argsort(x[:, f], kind="stable") for f in range(p)]
    size = np.array([len(x)])
    level = 0
    while size.sum():
        m = len(size)
        ends = np.cumsum(size)
        starts = ends - size
        node = np.repeat(np.arange(m), size)
        total = np.bincount(node * classes + y[order[0]], weights=w[order[0]], minlength=m * classes).reshape(m, classes)
        impure = (total > 0).sum(1) > 1
        own = _impurity(total)
        can = np.column_stack([impure & (x[o[starts], f] < x[o[ends - 1], f]) for f, o in enumerate(order)])
        ids = np.arange(m, dtype=np.int64) + level * 1_000_003 + root * 15_485_863
        rank = np.column_stack([_chance(tree, ids, f, seed) for f in range(p)])
        use = _first(can, rank, tried)
        gain, cut = np.full((m, p), np.nan), np.zeros((m, p))
        for f in range(p):
            some = use[:, f][node]
            nd, rows = node[some], order[f][some]
            if not len(rows):
                continue
            v = x[rows, f]
            run, wr, yr = np.empty((classes, len(rows))), w[rows], y[rows]
            for i in range(classes):
                np.cumsum(wr * (yr == i), out=run[i])
            first = np.flatnonzero(np.r_[True, nd[1:] != nd[:-1]])
            before = np.zeros((classes, m))
            before[:, nd[first[1:]]] = run[:, first[1:] - 1]
            at = np.flatnonzero((nd[1:] == nd[:-1]) & (v[1:] > v[:-1]))
            n = nd[at]
            lower = run[:, at] - before[:, n]
            g = own[n] - _impurity_by_class(lower) - _impurity_by_class(total.T[:, n] - lower)
            block = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            most = np.full(m, np.nan)
            most[n[block]] = np.maximum.reduceat(g, block)
            top = np.flatnonzero(g == most[n])
            top = top[np.r_[True, n[top][1:] != n[top][:-1]]]
            n, at = n[top], at[top]
            gain[n, f] = g[top]
            mid = (v[at] + v[at + 1]) / 2
            cut[n, f] = np.where(mid < v[at + 1], mid, v[at])
        best = np.where(can.any(1), np.where(use, gain, -np.inf).argmax(1), -1)
        leaf = best < 0
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-300)
        gone = leaf[tnode]
        out[trows[gone]] = share[tnode[gone]]
        trows, tnode = trows[~gone], tnode[~gone]
        split = np.flatnonzero(~leaf)
        np.add.at(won, best[split], gain[split, best[split]])
        child = np.zeros(m, dtype=np.int64)
        child[split] = 2 * np.arange(len(split))
        c = cut[np.arange(m), np.maximum(best, 0)]
        tnode = child[tnode] + (test[trows, best[tnode]] > c[tnode])
        stay = ~leaf[node]
        nd = node[stay]
        up = np.zeros(len(x), dtype=bool)
        rows = order[0][stay]
        up[rows] = x[rows, best[nd]] > c[nd]
        size = np.bincount(child[nd] + up[rows], minlength=2 * len(split))
        low = np.repeat(np.arange(2 * len(split)) % 2 == 0, size)
        for f in range(p):
            rows = order[f][stay]
            right = up[rows]
            dealt = np.empty_like(rows)
            dealt[low], dealt[~low] = rows[~right], rows[right]
            order[f] = dealt
        level += 1
    return out, won


def _summed(cells: list[np.ndarray], votes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The votes added up by cell, cells in order."""
    cell, at = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *cells]), return_inverse=True)
    return [cell], [np.bincount(at, weights=np.concatenate([np.empty(0), *votes]), minlength=len(cell))]


def _gathered(batches: Iterator[pd.DataFrame], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Batches put together: what is added up or packed per batch gets fewer, larger parts."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _levels(train: DataFrame, xs: Sequence[str], tops: list[Top], won: np.ndarray, classes: int, tried: int,
            seed: int, node_rows: int, bins: int, ranges: np.ndarray) -> None:
    """Split every node of more than ``node_rows`` bootstrap rows."""
    xs, p = list(xs), len(xs)
    # (tree, node) -> value ranges to cut into bins
    live = {(t, 0): ranges for t in range(len(tops))}
    names = [f"c{i}" for i in range(classes)]
    schema = "slot int, f int, bin int, lo double, hi double, " + ", ".join(f"{n} double" for n in names)
    while live:
        slots = list(live)
        slot_of = [np.full(len(t.feature), -1) for t in tops]
        for i, (t, n) in enumerate(slots):
            slot_of[t][n] = i
        lows, highs = np.array([live[s][:, 0] for s in slots]), np.array([live[s][:, 1] for s in slots])

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _gathered(batches):
                x, y = pdf[xs].to_numpy(float), pdf["_cls"].to_numpy()
                h = pdf["_h"].to_numpy().astype(np.int64).view(np.uint64)
                order = [np.argsort(x[:, f], kind="stable") for f in range(p)]
                for t, top in enumerate(tops):
                    mine = slot_of[t][slot_of[t] >= 0]
                    if not len(mine):
                        continue
                    w, slot = _bootstrap(h, t, seed), slot_of[t][top.route(x)]
                    base, cells = int(mine.min()), (int(mine.max()) - int(mine.min()) + 1) * bins
                    for f in range(p):
                        use = order[f][((w > 0) & (slot >= 0))[order[f]]]
                        s, v = slot[use], x[use, f]
                        width = np.maximum(highs[s, f] - lows[s, f], 1e-300)
                        b = np.clip(((v - lows[s, f]) / width * bins), 0, bins - 1).astype(np.int64)
                        cell = (s - base) * bins + b
                        sums = np.bincount(cell * classes + y[use], weights=w[use],
                                           minlength=cells * classes).reshape(cells, classes)
                        # rows come by value: the first and the last of a cell are its ends
                        lo, hi = np.zeros(cells), np.zeros(cells)
                        hi[cell], lo[cell[::-1]] = v, v[::-1]
                        some = np.flatnonzero(sums.any(1))
                        yield pd.DataFrame({"slot": (base + some // bins).astype(np.int32), "f": np.int32(f),
                                            "bin": (some % bins).astype(np.int32), "lo": lo[some], "hi": hi[some],
                                            **{n: sums[some, i] for i, n in enumerate(names)}})

        got = train.mapInPandas(count, schema).groupBy("slot", "f", "bin").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(n).alias(n) for n in names]).toPandas()
        found = {s: g for s, g in got.sort_values(["slot", "f", "bin"]).groupby("slot")}
        nxt = {}
        for i, (t, n) in enumerate(slots):
            if i not in found:
                continue
            g = {f: q for f, q in found[i].groupby("f")}
            total = g[0][names].to_numpy().sum(0)
            tight = np.array([[g[f]["lo"].min(), g[f]["hi"].max()] for f in range(p)])
            if total.sum() <= node_rows:
                tops[t].small[n] = float(total.sum()), tight.mean(1)
                continue
            if (total > 0).sum() < 2 or (tight[:, 0] == tight[:, 1]).all():
                tops[t].closed[n] = total / total.sum()
                continue
            gain, cut, side = np.full((1, p), np.nan), np.zeros(p), [0] * p
            for f in range(p):
                lower = np.cumsum(g[f][names].to_numpy(), axis=0)[:-1]
                if len(lower):
                    each = _impurity(total) - _impurity(lower) - _impurity(total - lower)
                    k = int(each.argmax())
                    a, b = g[f]["hi"].iloc[k], g[f]["lo"].iloc[k + 1]
                    gain[0, f], side[f] = each[k], lower[k].sum()
                    cut[f] = (a + b) / 2 if (a + b) / 2 < b else a
            rank = np.array([[_chance(t, np.array([n]), f, seed)[0] for f in range(p)]])
            f = int(_choose(gain, rank, tried)[0])
            if f < 0:  # every value in one bin: finer bins next time
                nxt[(t, n)] = tight
                continue
            won[t, f] += gain[0, f]
            kids = tops[t].split(n, f, float(cut[f]))
            for kid, size in zip(kids, (side[f], total.sum() - side[f])):
                box = tight.copy()
                box[f, 1 if kid == kids[0] else 0] = cut[f]
                if size > node_rows:
                    nxt[(t, kid)] = box
                else:
                    tops[t].small[kid] = float(size), box.mean(1)
        live = nxt


def _dealt(tops: list[Top], ranges: np.ndarray, least: int, most: int, region: int) -> list[list[tuple[int, int]]]:
    """Groups of (tree, node), about ``least`` of them or more, each of about ``most``
    bootstrap rows or fewer.  The space is halved by the middles of the nodes until
    a part holds about ``region`` rows per tree; a group is made of some trees' nodes
    in one part, so its nodes need much the same rows."""
    nodes = [(t, n) for t, top in enumerate(tops) for n in sorted(top.small)]
    if not nodes:
        return []
    size = np.array([tops[t].small[n][0] for t, n in nodes])
    wide = np.maximum(ranges[:, 1] - ranges[:, 0], 1e-300)
    middle = np.array([tops[t].small[n][1] for t, n in nodes]) / wide
    most = max(1.0, min(most, size.sum() / least))
    out, todo = [], [np.arange(len(nodes))]
    while todo:
        at = todo.pop()
        if size[at].sum() > region * len(tops) and len(at) > 1:
            at = at[np.argsort(middle[at, np.ptp(middle[at], axis=0).argmax()], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(size[at]), size[at].sum() / 2), 1, len(at) - 1))
            todo += [at[:half], at[half:]]
            continue
        at = np.sort(at)  # by tree
        parts = max(1, -(-size[at].sum() // most))
        part = ((np.cumsum(size[at]) - size[at] / 2) * parts / max(size[at].sum(), 1.0)).astype(int)
        out += [[nodes[i] for i in at[part == k]] for k in np.unique(part)]
    return out


def fit_predict(data: DataFrame, xs: Sequence[str], label: str, key: str, trees: int = 200, seed: int = 1,
                node_rows: int = 400_000, bins: int = 64, max_classes: int = 1000, group_rows: int = 10_000_000,
                region_rows: int = 1_000_000) -> tuple[DataFrame, np.ndarray]:
    """(predictions (key, truth, pred) of the rows that are not ``_train``,
    importance by feature).  ``data`` holds complete rows.  A prediction is the
    class with the largest mean share over the trees, the smallest on a tie;
    NULL without training rows.  Importance: impurity taken away, as shares per
    tree, averaged; 0 where nothing was split.  Each split tries sqrt(features)
    of those that can be split.  Equal rows share their bootstrap weights.
    ``group_rows`` and ``region_rows`` only deal the work (see ``_dealt``)."""
    xs, p = list(xs), len(xs)
    rows = data.select(F.col(key).alias("_key"), F.col(label).alias("_y"), "_train",
                       *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    cols = [f"_x{i}" for i in range(p)]
    labels = [r[0] for r in rows.where("_train").select("_y").distinct().orderBy("_y").limit(max_classes + 1).collect()]
    if len(labels) > max_classes:
        raise ValueError(f"more than {max_classes} classes")
    if not labels:
        return rows.where(~F.col("_train")).select(F.col("_key").alias(key), F.col("_y").alias("truth"),
                                                   F.lit(None).cast(rows.schema["_y"].dataType).alias("pred")), np.zeros(p)
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("_y")) - 1
    # the row numbers are stored with the rows, so they stay the same
    rows = cut_lineage(rows.withColumn("_cls", number.cast("int")).withColumn("_h", F.xxhash64("_key", "_y", *cols)).withColumn(
        "_id", F.monotonically_increasing_id()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    want = min(4 * cores, 1 + rows.count() // 2000)
    placed_rows = rows.select("_id", "_cls", "_h", "_train", *cols)
    if rows.rdd.getNumPartitions() < want:  # few rows, much work
        placed_rows = placed_rows.repartition(want)
    placed_rows = placed_rows.persist(StorageLevel.MEMORY_AND_DISK)
    train = placed_rows.where("_train")
    size = train.agg(F.count("*").alias("n"), *[f(c) for c in cols for f in (F.min, F.max)]).first()
    tops, won = [Top() for _ in range(trees)], np.zeros((trees, p))
    tried = max(1, int(p ** 0.5))
    ranges = np.array(size[1:], float).reshape(p, 2)
    if size["n"] > node_rows * 0.9:
        _levels(train, cols, tops, won, len(labels), tried, seed, node_rows, bins, ranges)
    else:
        for top in tops:
            top.small[0] = float(size["n"]), ranges.mean(1)

    groups = _dealt(tops, ranges, 2 * cores, group_rows, region_rows)
    group_of = [np.full(len(top.feature), -1) for top in tops]
    for g, nodes in enumerate(groups):
        for t, n in nodes:
            group_of[t][n] = g

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _gathered(batches):
            x, tr = pdf[cols].to_numpy(float), pdf["_train"].to_numpy(bool)
            h = pdf["_h"].to_numpy().astype(np.int64).view(np.uint64)
            y, ident = pdf["_cls"].fillna(-1).to_numpy().astype(np.int32), pdf["_id"].to_numpy()
            need = np.zeros((len(groups), len(x)), dtype=bool)
            for t, top in enumerate(tops):
                to = group_of[t][top.route(x)]
                o = np.flatnonzero((to >= 0) & (~tr | (_bootstrap(h, t, seed) > 0)))
                need[to[o], o] = True
            for g in np.flatnonzero(need.any(1)):
                low, high = np.flatnonzero(need[g] & tr), np.flatnonzero(need[g] & ~tr)
                yield pd.DataFrame([(g, x[low].T.tobytes(), y[low].tobytes(), h[low].tobytes(), x[high].T.tobytes(),
                                     ident[high].tobytes())], columns=["part", "x", "y", "h", "test", "ids"])

    def finish(at: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        y, h, ident = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (
            ("y", np.int32), ("h", np.uint64), ("ids", np.int64)))
        x, test = (np.concatenate([np.frombuffer(b, float).reshape(p, -1) for b in pdf[c]], axis=1).T for c in ("x", "test"))
        by = np.argsort(ident, kind="stable")
        ident, test = ident[by], test[by]
        out, cells, votes, held = [], [], [], 0
        last, node, asked, w = -1, np.empty(0), np.empty(0), np.empty(0)
        for t, n in groups[int(at[0])]:
            if t != last:
                last, node, asked, w = t, tops[t].route(x), tops[t].route(test), _bootstrap(h, t, seed)
            mine, asks = np.flatnonzero((node == n) & (w > 0)), np.flatnonzero(asked == n)
            share, got = grow(x[mine], y[mine].astype(np.int64), w[mine], test[asks], len(labels), tried, t, seed, n)
            out.append((t, None, None, None, None, got.tolist()))
            i, c = np.nonzero(share)  # shares that are not 0
            cells.append(asks[i] * len(labels) + c)
            votes.append(share[i, c])
            held += len(i)
            if held > 4_000_000:
                cells, votes = _summed(cells, votes)
                held = 0
        # sums of shares, packed by the rows they belong to
        (cell,), (share,) = _summed(cells, votes)
        row, cls = ident[cell // len(labels)], cell % len(labels)
        bucket = row >> BUCKET_BITS
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(row) else row
        for a, b in zip(first, [*first[1:], len(row)]):
            out.append((None, bucket[a], (row[a:b] - (bucket[a] << BUCKET_BITS)).astype(np.int32).tobytes(),
                        cls[a:b].astype(np.int32).tobytes(), share[a:b].tobytes(), None))
        return pd.DataFrame(out, columns=["tree", "bucket", "row", "cls", "share", "won"])

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, sums = pdf[cols].to_numpy(float), np.zeros((len(pdf), len(labels)))
            for top in tops:
                if top.closed:
                    node = top.route(x)
                    for n, share in top.closed.items():
                        sums[node == n] += share
            yield pd.DataFrame(sums, columns=names).assign(_id=pdf["_id"].to_numpy())

    def add(at: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        row, cls, share = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (
            ("row", np.int32), ("cls", np.int32), ("share", float)))
        sums = np.bincount(row.astype(np.int64) * len(labels) + cls, weights=share,
                           minlength=len(labels) << BUCKET_BITS).reshape(-1, len(labels))
        seen = np.unique(row).astype(np.int64)
        return pd.DataFrame(sums[seen], columns=names).assign(_id=seen + (int(at[0]) << BUCKET_BITS))

    names = [f"s{i}" for i in range(len(labels))]
    packed = placed_rows.mapInPandas(scatter, "part int, x binary, y binary, h binary, test binary, ids binary")
    # few large groups: with more partitions than groups hardly two of them share a task
    tasks = max(1, len(groups), min(32 * len(groups), 2000))
    done = cut_lineage(packed.repartition(tasks, "part").groupBy("part").applyInPandas(
        finish, "tree int, bucket bigint, row binary, cls binary, share binary, won array<double>"))
    placed_rows.unpersist()
    for r in done.where("tree IS NOT NULL").groupBy("tree").agg(
            *[F.sum(F.col("won")[i]).alias(f"w{i}") for i in range(p)]).collect():
        won[r["tree"]] += [r[f"w{i}"] for i in range(p)]
    total = won.sum(1, keepdims=True)
    shares = np.where(total > 0, won / np.where(total > 0, total, 1.0), 0.0)
    mean = shares.mean(0)
    summed = done.where("bucket IS NOT NULL").groupBy("bucket").applyInPandas(
        add, ", ".join(f"{n} double" for n in names) + ", _id bigint")
    if any(top.closed for top in tops):
        summed = summed.unionByName(rows.where(~F.col("_train")).select("_id", *cols).mapInPandas(closed, summed.schema))
    votes = rows.where(~F.col("_train")).select("_id", "_key").join(summed, "_id").groupBy("_key").agg(
        *[F.round(F.sum(n), 9).alias(n) for n in names])
    v = F.array(*names)
    pred = votes.select(F.col("_key").alias(key), F.element_at(
        F.array(*[F.lit(c) for c in labels]), F.array_position(v, F.array_max(v)).cast("int")).alias("pred"))
    truth = data.where(~F.col("_train")).select(key, F.col(label).alias("truth"))
    return truth.join(pred, key, "left"), mean / (mean.sum() or 1.0)
