"""Prefix trie against brute force over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from custlens.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn long, role string, text string, owner int, h1 string, d double"


def _naive(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += not children[p]
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
            for p, m in members.items()}


def _run(df, nodes=8192):
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    rows, convs = prefix_trie.branched(df, head, F.col("conv") - F.pmod("conv", F.lit(5)))
    return [tuple(r) for r in prefix_trie.prefix_trie(rows, convs, nodes).collect()]


def _data(seed, convs=40):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "yy", "é"])) for c in range(convs) for t in range(rng.randrange(1, 24))]
    rows += [(7, None, None, None), (7, None, "u", "q"), (None, 1, "a", "b"), (100, 3, "u", "x"), (100, 3, "u", "x")]
    rows += [(c, t, "u", "same") for c in range(200, 240) for t in range(12)]  # a large group of equal conversations
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


@pytest.mark.parametrize("nodes", [8, 8192])
def test_trie_equals_brute_force(spark, nodes):
    rows = _data(nodes)
    got = _run(_frame(spark, rows), nodes)
    assert len(got) == len(set(got)) and set(got) == _naive(rows)


def test_long_conversations_are_cut_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    rows = [(c, t, "u", f"{t}" if t < 150 else f"{c}-{t}") for c in (0, 5, 10) for t in range(220)]
    got = _run(_frame(spark, rows), 64)
    assert set(got) == _naive(rows)


def test_centroid_recursion_in_a_task():
    rng = random.Random(3)
    for n in (1, 2, 50, 400):
        parent = [-1] + [rng.randrange(max(0, i - 3), i) for i in range(1, n)]
        value = [(rng.randrange(9), 1) for _ in range(n)]
        weight, want = [1] * n, [list(v) for v in value]
        for i in range(n - 1, 0, -1):
            weight[parent[i]] += weight[i]
            want[parent[i]] = [a + b for a, b in zip(want[parent[i]], want[i])]
        assert prefix_trie.Component(parent, weight, value).roll_up() == want


def test_empty_table(spark):
    assert _run(_frame(spark, [])) == []


def test_query_on_a_small_table(spark, tables):
    rows = [tuple(r) for r in tables("conversations").select("conv_id", "turn", "role", "text").collect()]
    got = registry.queries()["op12_prefix_trie"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == _naive(rows)
