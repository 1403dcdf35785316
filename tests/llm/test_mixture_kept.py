"""The packed sequences follow the mixture that the rows were written in."""

import random

import pytest

import corpus_pipeline
from custlens.llm import mixing, packing

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def two_sources(spark):
    """13 MB of text, 1,440 rows of source a after 160 of source b."""
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfgklmnprst')}a{rng.choice('bdfgklmnprst')}" for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=2_000)), "b" if i < 160 else "a") for i in range(1_600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "doc_id")


def _shares(spark, docs, mix, pack, path):
    """Share of source b in the tokens of each stretch, in order."""
    if mix:
        docs = mix(docs)
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    pieces = pack(docs)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(range(1_600))
    by = pieces.join(docs.select("doc_id", "source"), "doc_id").selectExpr(
        "sequence_id >> 32 AS stretch", "source = 'b' AS b", "length").groupBy("stretch").agg(
        {"length": "sum"}).collect()
    all_ = {r.stretch: r["sum(length)"] for r in by}
    b = {r.stretch: r["sum(length)"] for r in pieces.join(docs.where("source = 'b'").select("doc_id"), "doc_id").selectExpr(
        "sequence_id >> 32 AS stretch", "length").groupBy("stretch").agg({"length": "sum"}).collect()}
    return [b.get(s, 0) / all_[s] for s in sorted(all_)]


def test_pipeline_packs_the_schedule_of_the_mixture(spark, two_sources, tokenizer_path, tmp_path):
    pack = lambda d: STAGES["packing"](spark, d, None)
    mixed = _shares(spark, two_sources, lambda d: STAGES["mixing"](spark, d, None), pack, str(tmp_path / "m"))
    # square roots: 160 ** .5 / (160 ** .5 + 1440 ** .5) = 1/4 until source b ends after 640 rows
    assert len(mixed) >= 3 and abs(mixed[0] - 0.25) < 0.02 and mixed[-1] == 0
    plain = _shares(spark, two_sources, None, pack, str(tmp_path / "p"))
    assert max(plain) < 0.2  # without the stage the raw 10 %


def test_weights_reach_the_stretches(spark, two_sources, tokenizer_path, tmp_path):
    pack = lambda d: packing.pack(d, tokenizer_path, group_bytes=1 << 20, in_order=True)
    even = _shares(spark, two_sources, lambda d: mixing.mixed(d, weights={"a": 1, "b": 1}), pack, str(tmp_path / "e"))
    third = _shares(spark, two_sources, lambda d: mixing.mixed(d, weights={"a": 2, "b": 1}), pack, str(tmp_path / "t"))
    assert all(abs(x - 1 / 2) < 0.03 for x in even[:2]) and not any(even[4:])
    assert all(abs(x - 1 / 3) < 0.03 for x in third[:3]) and not any(third[6:])
