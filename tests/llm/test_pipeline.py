"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
from custlens.llm import simhash

SF = "/root/testdata/sf0.001"


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_on_the_documents(spark, tables, tmp_path):
    docs = tables("documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = held.collect()
        stage(spark, held, SF).write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        after = held.collect()
        assert held.columns == docs.columns and set(after) <= set(before)
        if name == "exact_dedup":
            assert sorted(_fold(r.text) for r in after) == sorted({_fold(r.text) for r in before})
        elif name == "simhash":
            fps = [simhash.fingerprint((r.text or "").encode()) for r in after]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
        elif name == "mixing":
            assert len(after) == len(before)
        else:
            assert len(after) >= 0.8 * len(before)
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in held.collect()}


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    whole = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert whole and all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)


def test_stages_on_edge_rows(spark, edge_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs, SF).count() > 0
        assert stage(spark, no_docs, SF).count() == 0
