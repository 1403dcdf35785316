"""Exact, near and substring duplicates against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from custlens.llm import components, exact_dedup, registry, simhash, substring


def _fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- exact
def test_exact_groups_on_edge_rows(edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[_fold(r.text)].append(r.doc_id)
    got = exact_dedup.exact_duplicates(edge_docs, keep="max").collect()
    assert len(got) == len(rows)
    for r in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256
                       and r.doc_id in m)
        assert r.group_size == len(members)
        assert r.keep_id == max((m for m in members if m is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_keeps_one_row_with_all_columns(edge_docs, keep):
    got = exact_dedup.drop_exact_duplicates(edge_docs, keep=keep)
    assert got.columns == edge_docs.columns
    texts = [_fold(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({_fold(r.text) for r in edge_docs.collect()})


def test_exact_colliding_hashes_stay_apart(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs, hash128=lambda t: b"\0" * 16).collect()
    assert len(got) == 70 and {r.group_size for r in got} == {10}
    assert all(r.keep_id == r.doc_id % 7 for r in got)


def test_exact_empty(no_docs):
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0


# ---------------------------------------------------------------- SimHash
def _naive_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_definition():
    rng = random.Random(4)
    texts = ["", " ", "One", "One Two", "a b c", "É é A b c d", *(
        " ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 60))) for _ in range(60))]
    for t in texts:
        assert simhash.fingerprint(t.encode(), 3) == _naive_fingerprint(t, 3)


def test_fingerprint_of_long_text_in_slices(monkeypatch):
    text = " ".join(f"w{i * i % 1013}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    assert whole == _naive_fingerprint(text, 3)


def _naive_components(fps, bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_links_lose_no_component(spark):
    rng = random.Random(9)
    fps = {0}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):  # chains and dense clusters
            fps.add(f)
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 3)
    got = {r.node: r.root for r in components.components(links).collect()}
    want = _naive_components(sorted(fps), 3)
    to_signed = lambda f: int(np.uint64(f).astype(np.int64))
    classes = defaultdict(set)
    for f, root in want.items():
        classes[root].add(to_signed(f))
    for members in classes.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(to_signed(f), to_signed(f)) for f in fps}) == len(classes)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 1000 for i in range(50))


def test_simhash_edge_rows(edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    fps = [_naive_fingerprint(r.text, 3) for r in rows]
    want = _naive_components(sorted(set(fps)), 3)
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == len(rows)
    ids = defaultdict(list)
    for r, f in zip(rows, fps):
        ids[want[f]].append(r.doc_id)
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == len(ids)
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_simhash_query_against_brute_force(spark, tables):
    docs = tables("documents").select("doc_id", "text").collect()
    fps = {r.doc_id: _naive_fingerprint(r.text, 3) for r in docs}
    want = _naive_components(sorted(set(fps.values())), 3)
    low = {}
    for d, f in fps.items():
        low[want[f]] = min(low.get(want[f], d), d)
    got = registry.q_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (d, f"{f:016x}", low[want[f]]) for d, f in fps.items()}


# ---------------------------------------------------------------- substrings
def _naive_removal(rows, window):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone) if not y).decode()))
    return sorted(out, key=str)


def _passages(seed, rows):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 30))] for _ in range(6)]
    out = []
    for i in range(rows):
        w = []
        for _ in range(rng.randint(0, 10)):
            w += rng.choice(passages) if rng.random() < 0.8 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("shard_segments", [4096, 2])
def test_substring_against_brute_force(spark, shard_segments):
    rows = _passages(5, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.drop_repeated_windows(docs, window=8, gram=3, shard_words=300, shard_segments=shard_segments)
    assert sorted([tuple(r) for r in got.collect()], key=str) == _naive_removal(rows, 8)


def test_automaton_finds_smallest_ids():
    rng = random.Random(2)
    texts = [(i, [rng.randrange(3) for _ in range(rng.randint(1, 40))]) for i in range(30)]
    rng.shuffle(texts)
    automaton = substring.SuffixAutomaton()
    for i, t in texts:
        automaton.add(t, i)
    automaton.close()
    queries = texts + [(None, [rng.randrange(4) for _ in range(50)]) for _ in range(10)]
    for window in (1, 3, 6):
        for _, t in queries:
            want = []
            for k in range(len(t) - window + 1):
                hold = [i for i, s in texts if any(s[j:j + window] == t[k:k + window] for j in range(len(s)))]
                want.append(min(hold, default=None))
            assert automaton.lows(t, window) == want


def test_substring_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    got = substring.drop_repeated_windows(edge_docs, window=50).collect()
    assert sorted([tuple(r) for r in got], key=str) == _naive_removal(rows, 50)
    assert substring.drop_repeated_windows(no_docs).count() == 0


def test_substring_query_against_brute_force(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables("documents").select("doc_id", "text").collect()]
    got = registry.q_substring(spark, "/root/testdata/sf0.001").collect()
    want = {(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in _naive_removal(rows, 50)}
    assert {tuple(r) for r in got} == want


def test_exact_query_contract(spark):
    got = registry.q_exact_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.where(F.col("kept")).select("keep_id").distinct().count() == got.select("text_sha256").distinct().count()
