import pytest

# columns whose names the operators also use inside
CLASHING = "id long, key long, h binary, sha string, fp long, a long, spans string, score double, label int, _id long, " \
           "_slot int, _stream string, group_size long, hits string, x string, seg string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def row(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text)) + (None,) * len(CLASHING.split(","))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, blank and very long texts, copies, repeated rows, null ids and sources, extra columns."""
    words = [f"w{i % 977}" for i in range(60_000)]
    rows = [row(1, None), row(2, ""), row(3, " \t\n"), row(4, "Same TEXT here"), row(5, "same text HERE"),
            row(5, "same text HERE"), row(6, " ".join(words)), row(7, "same text here", None), row(8, "other É text", "t"),
            row(9, "other é text", "t"), row(None, "no id at all", "t"), row(None, None, None, None),
            row(10, " ".join(words[:30_000]) + " tail"), row(11, "x" * 200_000), row(12, "Same TEXT here", "u")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")
