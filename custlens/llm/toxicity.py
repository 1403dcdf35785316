"""Toxicity by weak supervision.

1. Entries.  Words and word beginnings that occur in far more toxic than other
   documents are learnt from a bounded sample of labelled training rows
   (``sample_rows``), near copies counted once.
2. Voters.  The entries are dealt out to lexicon voters (words) and pattern
   voters (beginnings of longer words); further voters look at how many
   entries a document has.  One pass over all texts writes each document's
   entries; everything after works on that narrow table.
3. Label model.  A generative model of the votes with a hidden class: every
   voter has its accuracies, and a tree over the voters (largest conditional
   mutual information) carries their correlations.  EM runs over the vote
   patterns of all documents; training rows keep their labels.
4. Classifier.  A logistic regression over the entries and their number,
   trained by Spark ML on the posterior labels of all documents, scores them.

Defined results: a null or empty text has no entries and gets the score of
that; documents without a label are scored all the same; null labels are
ignored, an id labelled more than once takes its largest label; repeated rows
get equal scores; without training rows of both classes the score is the share
of label 1 among them (0 without any); extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import cut_lineage, sliced
from custlens.llm.quality import fold, training_labels

_WORDS = re.compile(r"[^\W\d_]+").findall
HEADS = range(4, 10)  # lengths of the word beginnings
HELD_ENTRIES = 200_000  # entries that a task counts before it passes them on
LEXICON_VOTERS, PATTERN_VOTERS = 10, 8
COUNTS = (1, 2, 3, 5)  # voters and inputs: at least so many different entries


def _distinct_words(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def _entries_of(words: set[str]) -> set[str]:
    """``w:word`` and, for longer words, ``p:beginning``."""
    out = {"w:" + w for w in words}
    for w in words:
        out.update(["p:" + w[:k] for k in HEADS if len(w) > k])
    return out


def _sketch(text: str) -> int:
    """Smallest hash of the five-word runs: near copies mostly share it."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i:i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1


def learn_entries(docs: DataFrame, train: DataFrame, sample_rows: int, entries: int, least_docs: int,
                  least_g2: float, least_ratio: float) -> list[str]:
    """The ``entries`` entries with the strongest link to label 1 (G2), strongest
    first; both classes of the sample are counted and compared by Spark, and the
    driver reads the sorted result only until it has enough.  ``docs`` has (id,
    text); the sample is broadcast, so only its texts are counted."""
    sample = F.broadcast(train.orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = docs.join(sample, "id").select("label", F.coalesce("text", F.lit("")).alias("text"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys = [_sketch(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())],
                                             names=["label", "text", "sketch"])

    one = cut_lineage(texts.mapInArrow(sketched, "label int, text string, sketch long").dropDuplicates(
        ["label", "sketch"]))
    totals = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            entry = list({**counts[0], **counts[1]})
            out = pa.RecordBatch.from_arrays([pa.array(entry, pa.string()), *(
                pa.array([counts[y][e] for e in entry], pa.int64()) for y in (1, 0))], names=["entry", "a", "b"])
            counts[0].clear(), counts[1].clear()
            return out

        for b in sliced(batches):
            for label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[label].update(_entries_of(_distinct_words(t)))
                if len(counts[0]) + len(counts[1]) > HELD_ENTRIES:
                    yield flush()
        yield flush()

    both = one.where("label IN (0, 1)").select("label", "text").mapInArrow(counted, "entry string, a long, b long")
    both = both.groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= least_docs)
    ratio = ((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1))
    strong = both.withColumn("g2", _g2(F.col("a"), F.col("b"), n1, n0)).where(
        (ratio >= least_ratio) & (F.col("g2") >= least_g2)).orderBy(
        F.desc(F.round("g2", 6)), ~F.col("entry").startswith("w"), F.desc(F.length("entry")), "entry")
    ranked = ((r["entry"], r["a"], r["b"]) for r in strong.toLocalIterator())
    return [e for e, _, _ in itertools.islice(_told_apart(ranked), entries)]


def _g2(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of the two-by-two table (a of n1, b of n0)."""
    def cell(seen: Column, column: Column, n: int) -> Column:
        share = seen * (n1 + n0) / (column * F.lit(float(n)))
        return F.when(seen > 0, seen * F.log(share)).otherwise(0.0)

    with_entry, without = a + b, F.lit(n1 + n0) - a - b
    return 2 * (cell(a, with_entry, n1) + cell(b, with_entry, n0)
                + cell(n1 - a, without, n1) + cell(n0 - b, without, n0))


def _told_apart(ranked: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Drops an entry whose documents are about those of a stronger entry with
    the same beginning, so that one word counts as one entry."""
    by_head: dict[str, list[tuple[str, int, int]]] = {}
    alike = lambda x, y: abs(x - y) <= max(1, 0.1 * max(x, y))
    for e, a, b in ranked:
        word, same = e[2:], by_head.setdefault(e[2:2 + HEADS[0]], [])
        if not any(alike(a, c) and alike(b, d) and (word.startswith(k) or k.startswith(word)) for k, c, d in same):
            same.append((word, a, b))
            yield e, a, b


def entry_finder(entries: list[str]):
    """text -> numbers of the entries in it, in order."""
    words = {e[2:]: i for i, e in enumerate(entries) if e[0] == "w"}
    heads = {e[2:]: i for i, e in enumerate(entries) if e[0] == "p"}
    k = HEADS[0]
    first = {h[:k] for h in heads}

    def hits(text: str) -> list[int]:
        seen = _distinct_words(text)
        out = {words[w] for w in words.keys() & seen}
        for w in seen:
            if w[:k] in first:
                out.update(heads[w[:n]] for n in HEADS if len(w) > n and w[:n] in heads)
        return sorted(out)

    return hits


def find_entries(docs: DataFrame, entries: list[str]) -> DataFrame:
    """(id, hits) per row of (id, text): the entries in the whole text."""
    hits = entry_finder(entries)
    schema = T.StructType([docs.schema["id"], T.StructField("hits", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [hits(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["id", "hits"])

    return docs.select("id", "text").mapInArrow(run, schema)


class LabelModel:
    """Votes given the class as a tree: voter j depends on the class and on one other voter."""

    def __init__(self, entries: list[str]):
        kinds, at = {"w": (0, LEXICON_VOTERS), "p": (LEXICON_VOTERS, PATTERN_VOTERS)}, {"w": 0, "p": 0}
        self.voter = np.zeros(len(entries), np.int64)
        for i, e in enumerate(entries):  # dealt out in turn, strongest entries first
            lo, n = kinds[e[0]]
            self.voter[i] = lo + at[e[0]] % n
            at[e[0]] += 1
        self.width = LEXICON_VOTERS + PATTERN_VOTERS + len(COUNTS)
        self.parent = np.full(self.width, -1)
        self.prior = np.array([0.5, 0.5])
        self.table = np.full((self.width, 2, 2, 2), 0.5)  # [voter, class, parent's vote, vote]

    def votes(self, hits: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(hits), self.width), np.int64)
        for r, h in enumerate(hits):
            out[r, self.voter[h]] = 1
            for c, least in enumerate(COUNTS):
                out[r, LEXICON_VOTERS + PATTERN_VOTERS + c] = len(h) >= least
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        j = np.arange(self.width)
        log = [np.log(self.prior[y]) + np.log(self.table[j, y, above, votes]).sum(axis=1) for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))

    def fit(self, joint: np.ndarray, learn_tree: bool, smooth: float = 1.0) -> None:
        """``joint`` [class, voter j, voter k, vote j, vote k]: expected counts."""
        rows = joint[:, 0, 0].sum(axis=(1, 2))
        self.prior = (rows + smooth) / (rows + smooth).sum()
        if learn_tree:
            self.parent = self._tree(joint)
        for j in range(self.width):
            p = self.parent[j]
            counts = joint[:, p, j] if p >= 0 else np.stack([joint[:, j, j].sum(axis=1)] * 2, axis=1)
            counts = counts + smooth * np.array([0.9, 0.1])  # votes are rare
            self.table[j] = counts / counts.sum(axis=2, keepdims=True)

    def _tree(self, joint: np.ndarray) -> np.ndarray:
        """Largest spanning tree by the voters' mutual information given the class."""
        total = joint[:, 0, 0].sum()
        p = joint / max(total, 1e-12) + 1e-12
        given = p.sum(axis=(3, 4), keepdims=True)
        info = (p * np.log(p * given / (p.sum(axis=4, keepdims=True) * p.sum(axis=3, keepdims=True)))).sum(axis=(0, 3, 4))
        parent, best, link = np.full(self.width, -1), info[0].copy(), np.zeros(self.width, np.int64)
        inside = np.zeros(self.width, bool)
        inside[0] = True
        while not inside.all():
            j = int(np.argmax(np.where(inside, -np.inf, best)))
            parent[j], inside[j] = link[j], True
            better = info[j] > best
            best[better], link[better] = info[j][better], j
        return parent


def _expected(patterns: DataFrame, model: LabelModel, labelled_only: bool) -> np.ndarray:
    """Expected joint counts over all vote patterns (hits, label, n), added up by Spark."""
    shape = (2, model.width, model.width, 2, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            votes = model.votes(b.column(0).to_pylist())
            label, n = b.column(1).to_numpy(), b.column(2).to_numpy().astype(float)
            p1 = np.where(label >= 0, label, 0.0 if labelled_only else model.posterior(votes))
            for y, p in ((0, 1 - p1), (1, p1)):
                weight = (p * n)[:, None]
                both = [1 - votes, votes]
                for a in (0, 1):
                    for c in (0, 1):
                        total[y, :, :, a, c] += (both[a] * weight).T @ both[c]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())],
                                         names=["cell", "v"])

    src = patterns.where("label >= 0") if labelled_only else patterns
    out = np.zeros(int(np.prod(shape)))
    for r in src.select("hits", "label", "n").mapInArrow(run, "cell int, v double").groupBy("cell").agg(
            F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


class Scorer:
    """The fitted classifier over the entries of a text."""

    def __init__(self, entries: list[str], weights: np.ndarray, bias: float, share: float):
        self.entries, self.weights, self.bias, self.share = entries, weights, bias, share
        self.hits = entry_finder(entries)

    def score(self, hits: list[list[int]]) -> np.ndarray:
        if not self.entries:
            return np.full(len(hits), self.share)
        n = len(self.entries)
        z = [self.bias + float(self.weights[h].sum()) + sum(float(self.weights[n + c]) for c, least in enumerate(COUNTS)
                                                            if len(h) >= least) for h in hits]
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        folds: int = 5, held: int = 0, sample_rows: int = 20_000, entries: int = 1024, least_docs: int = 3,
        least_g2: float = 20.0, least_ratio: float = 4.0, rounds: int = 5) -> tuple[Scorer, DataFrame]:
    """(classifier, table (id, hits) of all documents)."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    train = cut_lineage(training_labels(labels, label_col, folds, held))
    found = learn_entries(src, train, sample_rows, entries, least_docs, least_g2, least_ratio)
    if not found:
        share = train.agg(F.avg("label")).first()[0] or 0.0
        return Scorer([], np.empty(0), 0.0, float(share)), src.select("id", F.array().cast("array<int>").alias("hits"))

    table = cut_lineage(find_entries(src, found))
    patterns = cut_lineage(table.join(train, "id", "left").groupBy(
        "hits", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n")))
    model = LabelModel(found)
    model.fit(_expected(patterns, model, labelled_only=True), learn_tree=True)
    for _ in range(rounds):
        model.fit(_expected(patterns, model, labelled_only=False), learn_tree=False)

    def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, n = b.column(0).to_pylist(), b.column(1).to_numpy().astype(float)
            p = np.round(model.posterior(model.votes(hits)), 12)
            x = [sorted({*h, *(len(found) + c for c, least in enumerate(COUNTS) if len(h) >= least)}) for h in hits]
            yield pa.RecordBatch.from_arrays([pa.array([*x, *x], pa.list_(pa.int32())),
                                              pa.array(np.repeat([1.0, 0.0], len(x))),
                                              pa.array(np.concatenate([p * n, (1 - p) * n]))],
                                             names=["on", "y", "weight"])

    soft = patterns.groupBy("hits").agg(F.sum("n").alias("n")).mapInArrow(posterior, "on array<int>, y double, weight double")
    width = len(found) + len(COUNTS)
    vector = F.udf(lambda on: Vectors.sparse(width, on, [1.0] * len(on)), VectorUDT())
    rows = cut_lineage(soft.where("weight > 0")).select(vector("on").alias("features"), "y", "weight")
    line = LogisticRegression(labelCol="y", weightCol="weight", regParam=1e-6, maxIter=60, standardization=False,
                              family="binomial").fit(rows)
    return Scorer(found, line.coefficients.toArray(), float(line.intercept), 0.0), table


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held: int = 0,
                    **options) -> DataFrame:
    """(id, held_out, score, predicted) for every document; ``options`` as in ``fit``."""
    scorer, table = fit(docs, labels, id_col=id_col, folds=folds, held=held, **options)
    schema = T.StructType([table.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(b.column(1).to_pylist()))],
                                             names=["id", "score"])

    return table.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5,
               **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns;
    scored where they are read, so no text is shuffled."""
    scorer, _ = fit(docs, labels, text_col=text_col, **options)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [scorer.score([scorer.hits(t or "") for t in text.slice(at, 256).to_pylist()])
                 for at in range(0, len(text), 256)]
        return pa.array(np.concatenate([np.empty(0), *parts]))

    return docs.where(score(F.col(f"`{text_col}`").cast("string")) < threshold)
