"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample: at each node a random direction and
the median of the sample's projections.  Every vector is then indexed, one leaf
per tree.  A query descends all trees through one priority queue, ordered by
the squared distances to the splits that a branch leaves on the other side, and
takes leaves until they hold ``search_share`` of the sample (or about
``least_rows`` vectors, where that is more).  Inside a leaf its
queries meet its vectors and cosines are worked out exactly, in double
precision, on the original vectors; the best of all leaves are merged.

Equal vectors are indexed and searched once: of a group of copies the smallest
ids that could be reported are kept (a bounded number, cut before the shuffle),
and the answer of a searched vector goes back to all its query rows.

Isotropic data of d dimensions has no short cut: near neighbours are little
nearer than other vectors, so recall follows the share of vectors looked at.
The default share is set for that case; clustered data needs far less.

Defined results: vectors that are null, of another length than most, zero, or
with null or non-finite components take no part, as candidates or as queries;
ties go to the smaller id; with fewer candidates than k all are returned;
repeated rows count as one row of that id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.llm.common import cut_lineage

CELLS = 4 << 20  # cosines held at a time inside a leaf


class Tree:
    """Complete binary tree in heap order: directions and split points."""

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth, width = depth, sample.shape[1]
        ways = rng.standard_normal((max(0, 2 ** depth - 1), width)).astype(np.float32)
        self.ways = ways / np.linalg.norm(ways, axis=1, keepdims=True)
        self.splits = np.zeros(len(ways), np.float32)
        node = np.zeros(len(sample), np.int64)
        for n in range(len(ways)):
            inside = np.flatnonzero(node == n)
            side = sample[inside] @ self.ways[n]
            self.splits[n] = np.median(side) if len(inside) else 0
            node[inside] = 2 * n + 1 + (side > self.splits[n])
        self.sample_leaf = node - len(ways)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", unit, self.ways[node]) > self.splits[node])
        return node - len(self.ways)


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.rows = len(sample)
        self.trees = [Tree(sample, depth, rng) for _ in range(trees)]
        self.members = [[np.flatnonzero(t.sample_leaf == n) for n in range(2 ** depth)] for t in self.trees]

    def search(self, unit: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) by the shared queue until the leaves hold ``share`` of the sample."""
        sides = [t.ways @ unit - t.splits for t in self.trees]
        queue = [(0.0, i, 0) for i in range(len(self.trees))]
        seen, out = np.zeros(self.rows, bool), []
        held, want = 0, share * self.rows
        while queue and (held < want or not out):
            cost, i, node = heapq.heappop(queue)
            tree, side = self.trees[i], sides[i]
            while node < len(tree.ways):
                right = bool(side[node] > 0)
                heapq.heappush(queue, (cost + float(side[node]) ** 2, i, 2 * node + 1 + (not right)))
                node = 2 * node + 1 + right
            leaf = node - len(tree.ways)
            new = self.members[i][leaf]
            new = new[~seen[new]]
            seen[new] = True
            held += len(new)
            out.append((i, leaf))
        return out


def _usable(v: Column, width: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return v.isNotNull() & (F.size(v) == width) & finite & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _cosine(q: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 100_000) -> np.ndarray:
    """Cosines of the pairs (i, j), each summed in one order of its own two
    vectors, so a pair has the same score in every leaf and batch; within -1 and 1."""
    long_q, long_y = np.sqrt((q * q).sum(1)), np.sqrt((y * y).sum(1))
    parts = [(q[i[s:s + chunk]] * y[j[s:s + chunk]]).sum(1) / (long_q[i[s:s + chunk]] * long_y[j[s:s + chunk]])
             for s in range(0, len(i), chunk)]
    return np.clip(np.concatenate([np.empty(0), *parts]), -1.0, 1.0)


def nearest(vectors: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = 16, sample_rows: int = 16_384, leaf_rows: int = 2048,
            search_share: float = 0.45, least_rows: int = 4096,
            seed: int = 11) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every query row.

    ``is_query`` marks the query rows (all rows by default).  The index is
    fitted on at most ``sample_rows`` distinct vectors, which with the trees is
    all that reaches the driver or is broadcast; its leaves hold about
    ``leaf_rows`` vectors of the table, as far as the sample allows.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"),
                         (F.lit(True) if is_query is None else F.coalesce(is_query, F.lit(False))).alias("asks"))
    width = src.where("v IS NOT NULL").groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.desc("w")).first()
    width = width["w"] if width else 0
    out_schema = f"query_id {src.schema['id'].dataType.simpleString()}, rank int, {id_col} " \
                 f"{src.schema['id'].dataType.simpleString()}, score double"
    rows = src.where(F.col("id").isNotNull() & _usable(F.col("v"), width)).withColumns(
        {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    few = Window.partitionBy("h1", "h2").orderBy("id")
    distinct = rows.dropDuplicates(["h1", "h2", "id"]).withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    distinct = cut_lineage(distinct.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"),
                                                            F.first("v").alias("v")))
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], out_schema)
    sample = distinct.orderBy(F.xxhash64("h1"), "h2").limit(sample_rows).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks(), width)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    most = max(0, int(np.log2(max(1, len(x) / 8))))
    depth = min(most, max(8, int(np.ceil(np.log2(max(1, n / leaf_rows))))))
    share = min(1.0, max(search_share, least_rows / n))
    # bytes: a worker that cannot import this package still reads them
    forest = spark.sparkContext.broadcast(cloudpickle.dumps(Forest(x, trees, depth, seed)))

    def unit(m: np.ndarray) -> np.ndarray:
        return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(forest.value)
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(_matrix(b.column(1), width))
            for i, t in enumerate(f.trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(u), i, np.int32)), pa.array(t.leaves(u).astype(np.int32)), b.column(0),
                     b.column(1)], names=["tree", "leaf", "ids", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = pickle.loads(forest.value)
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(_matrix(b.column(2), width))
            found = [f.search(y, share) for y in u]
            at = np.repeat(np.arange(len(found)), [len(p) for p in found])
            hits = np.array([p for each in found for p in each], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(hits[:, 0]), pa.array(hits[:, 1]), b.column(0).take(pa.array(at)),
                                              b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))],
                                             names=["tree", "leaf", "h1", "h2", "v"])

    ids, vs = src.schema["id"].dataType.simpleString(), src.schema["v"].dataType.simpleString()
    indexed = distinct.select("ids", "v").mapInArrow(index, f"tree int, leaf int, ids array<{ids}>, v {vs}")
    asked = rows.where("asks").dropDuplicates(["h1", "h2"]).select("h1", "h2", "v")
    probes = asked.mapInArrow(probe, f"tree int, leaf int, h1 long, h2 long, v {vs}")

    def rerank(here: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["h1", "h2", "ids", "score"]
        if not here.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), here.column("ids").slice(0, 0),
                             pa.array([], pa.float64())], names=names)
        y = _matrix(here.column("v").combine_chunks(), width)
        q = _matrix(queries.column("v").combine_chunks(), width)
        long_y, top = np.linalg.norm(y, axis=1), min(len(y), k + 1)
        at_q, at_y, score = [], [], []
        step = max(1, CELLS // len(y))
        for s in range(0, len(q), step):
            part = q[s:s + step]
            cos = (part @ y.T) / (np.linalg.norm(part, axis=1)[:, None] * long_y)
            # every candidate as near as the last one kept, up to the product's rounding:
            # scores are taken again one by one, ties are settled by id later
            least = -np.partition(-cos, top - 1, axis=1)[:, top - 1]
            i, j = np.nonzero(cos >= least[:, None] - 1e-9)
            at_q.append(i + s)
            at_y.append(j)
            score.append(_cosine(part, y, i, j))
        i, j = pa.array(np.concatenate(at_q)), pa.array(np.concatenate(at_y))
        return pa.table([queries.column("h1").take(i), queries.column("h2").take(i),
                         here.column("ids").take(j).combine_chunks(), pa.array(np.concatenate(score))], names=names)

    near = indexed.groupBy("tree", "leaf").cogroup(probes.groupBy("tree", "leaf")).applyInArrow(
        rerank, f"h1 long, h2 long, ids array<{ids}>, score double")
    single = near.select("h1", "h2", F.explode("ids").alias("id"), "score").groupBy("h1", "h2", "id").agg(
        F.max("score").alias("score"))
    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    top = single.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = top.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("far"), "id"))).alias("near"))
    answers = rows.where("asks").select("h1", "h2", F.col("id").alias("query_id")).distinct().join(lists, ["h1", "h2"])
    others = F.slice(F.filter("near", lambda c: c["id"] != F.col("query_id")), 1, k)
    ranked = answers.select("query_id", F.posexplode(others).alias("pos", "c"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("c.id").alias(id_col),
                         (-F.col("c.far")).alias("score"))
