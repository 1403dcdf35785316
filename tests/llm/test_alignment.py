"""Cross-tokenizer links against plain encoding and a walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from custlens.llm import alignment, registry  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "\n", "x  y", "x \ny", "don't  's", "a▁b", "a b 　c", "x" * 5000, "é é",
       "<s> </s> <|endoftext|>", "a\0b", "\x1cq \x85z", "\U0001F600 \U0001F600‍", "İ x", "end.\n\nNext", None]


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    made = alignment.TokenizerPair(A, B, 100_000)
    made.a = Tokenizer.from_file(A)  # the plain encoder that results are held against
    made.a.encode_special_tokens = True
    return made


def _walk(pair, text):
    """(n_a, n_b, n_groups, links, digest) by the tokenizers themselves."""
    if not text:
        return 0, 0, 0, Counter(), ""
    raw = (" " + text).encode()
    sides = []
    for ids, table in ((pair.a.encode(" " + text, add_special_tokens=False).ids, pair.bytes_a), (pair.b.encode(text), pair.bytes_b)):
        if b"".join(table[i] for i in ids) != raw:
            return 0, 0, 0, Counter(), ""
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        sides.append(list(zip(ids, [0, *ends], ends)))
    a, b = sides
    links = Counter((x, y) for x, s, e in a for y, t, f in b if s < f and t < e) if len(a) * len(b) < 400_000 else None
    if links is None:
        links, j = Counter(), 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links[x, b[k][0]] += 1
                k += 1
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    group = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if lo < e <= hi)
    text = ";".join(f"{group(a, lo, hi)}|{group(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)) if len(cuts) < 3000 else None
    return len(a), len(b), len(cuts), links, text if text is None else hashlib.sha256(text.encode()).hexdigest()


def _expected(pair, texts):
    found = [_walk(pair, t) for t in texts]
    count = Counter(p for f in found for p in f[3])
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [(f[0], f[1], f[2], sum(f[3].values()), sum(t for p, t in f[3].items() if count[p] == most[p[0]]),
             sum(t * count[p] for p, t in f[3].items()), f[4]) for f in found]


@pytest.mark.parametrize("broadcast_pairs", [2_000_000, 0])
def test_links_equal_a_walk(spark, tables, pair, broadcast_pairs):
    texts = ODD + [r.text for r in tables("documents").select("text").collect()][:120] + ["a b", "a b"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs int, id string")
    got = alignment.cross_tokenizer_links(docs, A, B, broadcast_pairs=broadcast_pairs).collect()
    want = _expected(pair, texts)
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6], texts[r.doc_id]
        assert w[6] is None or r.groups_sha256 == w[6]


def test_cuts_by_divide_and_conquer():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, 60)), n)) for _ in range(2)]
        cut, cut_b = alignment.shared_cuts(*ends, np.array([len(ends[0]) - 1]), np.array([len(ends[1]) - 1]))
        both = np.intersect1d(*ends)
        assert ends[0][cut].tolist() == both.tolist() == ends[1][cut_b].tolist()


def test_units_forgotten_and_learnt_again(pair):
    small = alignment.TokenizerPair(A, B, 40)
    texts = pa.array([" ".join(f"w{i * 7 % 53}x{j}" for i in range(30)) for j in range(12)] + ["a▁b c", "ok \n c "])
    for at in range(0, len(texts), 3):
        some = texts.slice(at, 3)
        one, two = alignment.align(small, some), alignment.align(pair, some)
        assert one["groups_sha256"] == two["groups_sha256"] and one["pairs"].tolist() == two["pairs"].tolist()


def test_equal_rows_null_ids_and_empty(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = alignment.cross_tokenizer_links(docs, A, B).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]
    assert {(r.n_a, r.count_sum) for r in got} == {(2, 6), (0, 0)}
    assert alignment.cross_tokenizer_links(no_docs, A, B).count() == 0


def test_query_returns_every_document(spark, tables):
    got = registry.queries()["op13_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == tables("documents").count()
