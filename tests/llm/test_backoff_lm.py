"""Backoff automaton against an n-gram model in dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from custlens.llm import backoff_lm, registry

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def _tokens(text):
    return [b" ", *WORD.findall((text or "").encode().lower()), b" "]


class Model:
    def __init__(self, texts, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        for text in texts:
            s = _tokens(text)
            for p in range(1, len(s)):
                for k in range(1, min(order, p + 1) + 1):
                    self.count[k][tuple(s[p - k + 1:p + 1])] += 1
        self.n, self.v = sum(self.count[1].values()), len(self.count[1])
        self.after, self.types, self.discount = defaultdict(int), defaultdict(int), {}
        for k in range(2, order + 1):
            for gram, c in self.count[k].items():
                self.after[gram[:-1]] += c
                self.types[gram[:-1]] += 1
            n1, n2 = (sum(c == i for c in self.count[k].values()) for i in (1, 2))
            self.discount[k] = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(self, context, word):
        if not context:
            return (self.count[1][(word,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        lower = self.p(context[1:], word)
        if not self.after[context]:
            return lower
        d = self.discount[len(context) + 1]
        return (max(self.count[len(context) + 1][(*context, word)] - d, 0) + d * self.types[context] * lower) / self.after[context]

    def score(self, text):
        s = _tokens(text)
        base = sum(math.log10(self.p((), w)) for w in s[1:])
        full = sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1):i]), s[i])) for i in range(1, len(s)))
        return len(s) - 1, sum(self.count[1][(w,)] > 0 for w in s[1:]), self.n, base, full


def _check(df, order, block_bytes):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    model = Model([t for (_, t), h in zip(rows, held) if not h], order)
    want = sorted([(d, h, *model.score(t)) for (d, t), h in zip(rows, held)], key=lambda r: (str(r[0]), r[2], round(r[6], 4)))
    got = sorted((tuple(r) for r in backoff_lm.scores(df, _held(), order=order, block_bytes=block_bytes).collect()),
                 key=lambda r: (str(r[0]), r[2], round(r[6], 4)))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order, block_bytes", [(1, 1 << 20), (2, 1 << 14), (3, 1 << 16)])
def test_scores_equal_a_dictionary_model(tables, order, block_bytes):
    _check(tables("documents").select("doc_id", "text"), order, block_bytes)


def test_edge_rows(edge_docs):
    _check(edge_docs, 3, 1 << 12)


def test_hot_contexts_are_spread(spark, monkeypatch):
    # one word holds a third of the tokens, so its n-grams go to several buckets
    texts = [" ".join(("the" if j % 3 else f"w{(i * 7 + j) % 41}") for j in range(60)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    level = backoff_lm._level

    def spy(*a):
        out = level(*a)
        seen.append(len(out[1]))
        return out

    monkeypatch.setattr(backoff_lm, "_level", spy)
    _check(docs, 3, 256)
    assert seen[0] > 0


def test_probabilities_after_a_context_sum_to_one():
    texts = ["a b a c", "b a b", "c a a b d"]
    model = Model(texts, 3)
    words = [g[0] for g in model.count[1]] + [b"unknown"]
    for context in [(), (b"a",), (b"b", b"a"), (b" ",), (b"zz",)]:
        assert sum(model.p(context, w) for w in words) == pytest.approx(1)


def test_empty_and_untrained(no_docs, spark):
    assert backoff_lm.scores(no_docs, _held()).count() == 0
    alone = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = backoff_lm.scores(alone, F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}


def test_query_beats_unigrams(spark):
    got = registry.queries()["op11_backoff_lm"](spark, "/root/testdata/sf0.001")
    held = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b
