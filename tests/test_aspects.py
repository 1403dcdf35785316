"""Aspect sentiment with one automaton over all keywords."""

import random
from collections import defaultdict

import pytest

from custlens.operators import text as T


def _brute(rows, aspects):
    hits = defaultdict(list)
    for text, pol in rows:
        for i, (_, kws) in enumerate(aspects):
            if text is not None and any(k.strip() and k.strip().lower() in text.lower() for k in kws):
                hits[i].append(pol)
    return sorted((aspects[i][0], len(p), round(sum(p) / len(p), 9)) for i, p in hits.items())


def _got(df, aspects, **kw):
    return sorted((r["aspect"], r["n"], round(r["mean_polarity"], 9)) for r in T.aspect_sentiment(df, "t", aspects=aspects, **kw).collect())


def test_ten_thousand_keywords(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 8))) for _ in range(10_000)]
    aspects = [(f"a{i}", words[i::40]) for i in range(40)] + [("a0", ["abc", " ", ""]), ("none", [])]
    rows = [(" ".join(rng.choice(words).upper() for _ in range(12)), rng.random()) for _ in range(60)] + [(None, 0.5), ("", 0.1)]
    df = spark.createDataFrame(rows, "t string, polarity double")
    assert _got(df, aspects) == _brute(rows, aspects)
    table = spark.createDataFrame(aspects, "aspect string, keywords array<string>").coalesce(1)
    assert _got(df, table) == _brute(rows, aspects)


def test_plan_does_not_grow_with_the_dictionary(spark):
    df = spark.createDataFrame([("some text", 0.5)], "t string, polarity double")
    plan = lambda n: T.aspect_sentiment(df, "t", aspects=[("a", [f"k{i}" for i in range(n)])])._jdf.queryExecution().optimizedPlan().toString()
    assert abs(len(plan(5)) - len(plan(5000))) < 50


@pytest.mark.parametrize("text, hit", [("the price, paid", 1), ("overpriced", 0), ("price", 1), ("a_price", 0), ("preis é price", 1)])
def test_whole_words(spark, text, hit):
    df = spark.createDataFrame([(text, 0.5)], "t string, polarity double")
    assert len(_got(df, [("price", ["price"])], whole_word=True)) == hit


def test_without_keywords_and_without_rows(spark):
    df = spark.createDataFrame([("x", 0.5)], "t string, polarity double")
    assert _got(df, []) == _got(df.limit(0), [("a", ["x"])]) == []
