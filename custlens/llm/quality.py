"""Document quality by regularised quadratic discriminant analysis.

One pass over the texts turns each document into a short vector of transformed
statistics (lengths, shares of character classes, repetition).  Class means and
covariances come from sums over all labelled training rows, added up by Spark.
Each covariance is shrunk towards the pooled one and towards its diagonal; its
Cholesky factor is worked out once and sent to the scoring tasks, where a score
is the logistic of the difference of the two Mahalanobis log-densities.

Defined results: a null or empty text is scored like a text of no words; a
document without a label is scored all the same; an id that is labelled more
than once takes its largest label; null labels are ignored; with fewer than two
training rows of a class the score is the share of label 1 (0.5 with no labels
at all); repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import cut_lineage, sliced

_CLASS = np.zeros(256, np.uint8)  # of a byte: 0 other, 1 space, 2 line end, 3 lower, 4 upper, 5 digit, 6 stop, 7 symbol, 8 non-ASCII
for _chars, _k in ((b" \t\x0b\x0c\r", 1), (b"\n", 2), (bytes(range(97, 123)), 3), (bytes(range(65, 91)), 4),
                   (b"0123456789", 5), (b".,;:'\"()-", 6), (b"!?#$%&*+/<=>@[\\]^_`{|}~", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8

FEATURES = ("log_words", "word_length", "word_length_sd", "upper", "digit", "stop", "symbol", "non_ascii",
            "distinct_words", "top_word", "repeated_lines", "line_words", "line_words_sd", "repeated_triples",
            "symbol_ends", "upper_words")


def _share(part: float, whole: float) -> float:
    """A share on the logit scale, kept away from the ends by half a unit."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_words = np.array([x.count(b" ") + 1 for x in lines], np.float64) if lines else np.zeros(1)
    triples = max(0, n - 2)
    distinct = len(set(zip(words, words[1:], words[2:])))
    visible = float(counts.sum() - counts[1] - counts[2])
    return [float(np.log1p(n)), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())),
            _share(counts[4], visible), _share(counts[5], visible), _share(counts[6], visible),
            _share(counts[7], visible), _share(counts[8], visible), _share(len(seen), n),
            _share(max(seen.values(), default=0), n), _share(len(lines) - len(set(lines)), len(lines)),
            float(np.log1p(line_words.mean())), float(np.log1p(line_words.std())), _share(triples - distinct, triples),
            _share(sum(v for w, v in seen.items() if _CLASS[w[-1]] == 7), n),
            _share(sum(v for w, v in seen.items() if len(w) > 1 and w.isupper()), n)]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) per row, x in the order of ``FEATURES``."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = [statistics(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    return src.mapInArrow(run, schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, label_col: str, folds: int, held: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the labelled rows outside the held-out fold."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    return rows.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id"), folds) != held)).groupBy(
        "id").agg(F.max("label").alias("label"))


def class_moments(rows: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """label -> (rows, mean, covariance) from (label, x): partial sums per
    task, added up by Spark, so that a few thousand numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros((width + 1, width + 1)), 1: np.zeros((width + 1, width + 1))}
        for b in batches:
            y = b.column(0).to_numpy()
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, width)
            z = np.hstack([np.ones((len(x), 1)), x])
            for k in sums:
                sums[k] += z[y == k].T @ z[y == k]
        cells = (width + 1) ** 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], cells), pa.int32()), pa.array(np.tile(np.arange(cells), 2), pa.int32()),
             pa.array(np.concatenate([sums[0].ravel(), sums[1].ravel()]))], names=["label", "cell", "v"])

    parts = rows.select("label", "x").mapInArrow(run, "label int, cell int, v double")
    out = {k: np.zeros((width + 1) ** 2) for k in (0, 1)}
    for r in parts.groupBy("label", "cell").agg(F.sum("v").alias("v")).collect():
        out[r["label"]][r["cell"]] = r["v"]
    moments = {}
    for k, flat in out.items():
        s = flat.reshape(width + 1, width + 1)
        n = s[0, 0]
        mean = s[0, 1:] / max(n, 1)
        moments[k] = (n, mean, s[1:, 1:] / max(n, 1) - np.outer(mean, mean))
    return moments


class Discriminant:
    """Two shrunken Gaussians; ``score`` gives the posterior of label 1."""

    def __init__(self, moments: dict, to_pooled: float, to_diagonal: float, floor: float):
        n = {k: m[0] for k, m in moments.items()}
        total = n[0] + n[1]
        self.constant = 0.5 if not total else n[1] / total
        self.parts = None
        if min(n.values()) < 2:
            return
        pooled = sum(m[0] * m[2] for m in moments.values()) / total
        grand = sum(m[0] * m[1] for m in moments.values()) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), floor))
        self.centre = grand
        out = {}
        for k, (rows, mean, cov) in moments.items():
            cov = (1 - to_pooled) * cov + to_pooled * pooled
            cov = cov / np.outer(self.scale, self.scale)
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(len(mean))
            factor = np.linalg.cholesky(cov)
            out[k] = ((mean - grand) / self.scale, np.linalg.inv(factor),
                      np.log(rows / total) - np.log(np.diag(factor)).sum())
        self.parts = out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = {k: c - 0.5 * (((z - mean) @ whiten.T) ** 2).sum(axis=1) for k, (mean, whiten, c) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", folds: int = 3, held: int = 1, to_pooled: float = 0.1,
                   to_diagonal: float = 0.1, floor: float = 1e-3) -> DataFrame:
    """(id, held_out, score, predicted) for every document."""
    stats = cut_lineage(document_statistics(docs, id_col, text_col))
    train = stats.join(training_labels(labels, label_col, folds, held), "id")
    model = Discriminant(class_moments(train, len(FEATURES)), to_pooled, to_diagonal, floor)
    schema = T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["id", "score"])

    scored = stats.mapInArrow(run, schema)
    return scored.select(F.col("id").alias(id_col),
                         F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
