"""Entries of the toxicity model against a brute-force ranking of all entries."""

import math
import random

import pytest

from custlens.llm import toxicity


@pytest.fixture
def texts():
    rnd = random.Random(5)
    common = [a + b for a in "bdfgklmn" for b in ("ala", "ebe", "olo", "uru")]
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        words = rnd.choices(common, k=25) + [f"unik{i:03}"]
        if toxic and rnd.random() < 0.5:
            words.append(rnd.choice(["zorkish", "vexling"]))
        rows.append((i, int(toxic), " ".join(words)))
    return rows


def _brute(rows, least_docs, least_g2, least_ratio):
    n = [sum(1 for _, y, _ in rows if y == c) for c in (0, 1)]
    seen = {}
    for _, y, t in rows:
        for e in toxicity._entries_of(toxicity._distinct_words(t)):
            seen.setdefault(e, [0, 0])[y] += 1
    out = []
    for e, (b, a) in seen.items():
        g2 = 0.0
        for got, col, row in ((a, a + b, n[1]), (b, a + b, n[0]), (n[1] - a, sum(n) - a - b, n[1]),
                              (n[0] - b, sum(n) - a - b, n[0])):
            g2 += 2 * got * math.log(got * sum(n) / (col * row)) if got else 0.0
        ratio = ((a + 0.5) / (n[1] + 1)) / ((b + 0.5) / (n[0] + 1))
        if a >= least_docs and ratio >= least_ratio and g2 >= least_g2:
            out.append((-round(g2, 6), e[0] != "w", -len(e), e, a, b))
    return [e for e, _, _ in toxicity._told_apart((e, a, b) for *_, e, a, b in sorted(out))]


@pytest.mark.parametrize("held", [200_000, 50])
def test_entries_are_the_strongest_however_rare(spark, texts, held, monkeypatch):
    # hundreds of common entries come before the two toxic words by frequency
    monkeypatch.setattr(toxicity, "HELD_ENTRIES", held)
    docs = spark.createDataFrame([(i, t) for i, _, t in texts], "id long, text string")
    train = spark.createDataFrame([(i, y) for i, y, _ in texts], "id long, label int")
    want = _brute(texts, 3, 3.0, 1.5)
    got = toxicity.learn_entries(docs, train, 1_000, 2, 3, 3.0, 1.5)
    assert got == want[:2] and {e[2:6] for e in got} == {"zork", "vexl"}
    assert toxicity.learn_entries(docs, train, 1_000, 500, 3, 3.0, 1.5) == want


def test_no_entries_without_both_classes(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, _, t in texts], "id long, text string")
    train = spark.createDataFrame([(i, 1) for i, _, _ in texts], "id long, label int")
    assert toxicity.learn_entries(docs, train, 1_000, 10, 1, 0.0, 0.0) == []
