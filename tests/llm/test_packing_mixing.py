"""Packing round trips; Pfair schedules against a slot-by-slot simulation."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from custlens.llm import mixing, packing, registry


# ---------------------------------------------------------------- packing
@pytest.mark.parametrize("cached_words", [600_000, 40])  # 40: words are dropped all the time
def test_word_tokenizer_equals_whole_text_encoding(tokenizer_path, cached_words):
    words = packing.WordTokenizer(tokenizer_path, cached_words)
    rng = random.Random(3)
    odd = ["", "   ", "<|endoftext|> a<|startoftext|>b", "it's we'll I'd 'tis", "ΣΑΣ Σ. İstanbul İ!!", "é a ́b",
           "a b c\u0085d\x1cf", "x‍y 👍🏽!!", "a.b,c 1234 12a", "½² Ⅷ", "don't.'s!!'re", "\x00 a\x0bb"]
    odd += ["".join(rng.choice("aB .,'!́é sdt1Σİ<|>̈한\n") for _ in range(30)) for _ in range(500)]
    for lo in [*range(0, len(odd), 50), *range(0, len(odd), 100)]:  # unseen, then remembered
        part = odd[lo:lo + 50]
        ids, at = words.encode(pa.array(part), 1)
        for t, i, j in zip(part, at, at[1:]):
            assert [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] == ids[i:j].tolist()


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=60, deadline=None)
def test_tournament_tree_is_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    room, want = [], []
    for i, s in enumerate(sizes):
        b = next((b for b, r in enumerate(room) if r >= s), None)
        if b is None:
            room.append(50)
            want.append([])
            b = len(room) - 1
        room[b] -= s
        want[b].append(i)
    assert packing.first_fit_decreasing(sizes, 50) == want


@given(st.lists(st.integers(0, 300), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_pack_group_covers_every_id_once(lengths):
    seqs = packing.pack_group(lengths, 64, 4)
    assert all(0 < sum(p[2] for p in s) <= 64 for s in seqs)
    pieces = sorted(p for s in seqs for p in s)
    for d, n in enumerate(lengths):
        at = 0
        for doc, start, length in pieces:
            if doc == d:
                assert start == at and length > 0
                at += length
        assert at == n


def _check_pieces(pieces, ids):
    for d, want in ids.items():
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        got = b"".join(p.ids for p in own)
        assert got == np.array(want, "<u4").tobytes() and all(p.doc_tokens == len(want) for p in own)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_packing_edge_rows(edge_docs, no_docs, tokenizer_path):
    tokenizer = packing.WordTokenizer(tokenizer_path).tokenizer
    rows = [r for r in edge_docs.collect() if r.doc_id not in (None, 5)]
    docs = edge_docs.where("doc_id IS NOT NULL AND doc_id <> 5")
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    _check_pieces(packing.pack(docs, tokenizer_path).collect(), ids)
    everything = packing.pack(edge_docs, tokenizer_path, group_bytes=1 << 16)
    tokens = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge_docs.collect())
    assert everything.agg({"length": "sum"}).first()[0] == tokens
    assert packing.pack(no_docs, tokenizer_path).count() == 0


def test_packing_query_round_trip_and_padding(spark, tables, tokenizer_path):
    tokenizer = packing.WordTokenizer(tokenizer_path).tokenizer
    docs = tables("documents")
    pieces = packing.pack(docs, tokenizer_path)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    _check_pieces(pieces.collect(), ids)
    assert packing.padding_share(pieces).first()["share"] < 0.01
    got = registry.q_packing(spark, "/root/testdata/sf0.001").collect()
    for r in got[:300]:
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32


# ---------------------------------------------------------------- mixing
def _slots(weights, blocks):
    out = {}
    for s, segments in mixing.phases(weights, blocks).items():
        for k0, k1, slot0, a, q, _, _, slots in segments:
            for k in range(k0, k1):
                out[slot0 + (k - k0) // a * q + slots[(k - k0) % a]] = (s, k)
    return out


@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 30), st.integers(0, 200)), min_size=1))
@settings(max_examples=80, deadline=None)
def test_every_block_has_one_slot_and_shares_stay_within_a_block(sources):
    weights = {s: w for s, (w, _) in sources.items()}
    blocks = {s: n for s, (_, n) in sources.items()}
    slots = _slots(weights, blocks)
    total = sum(blocks.values())
    assert sorted(slots) == list(range(total))
    assert sorted(slots.values()) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    # slot by slot: each source of a phase is less than one block from its share
    plan = mixing.phases(weights, blocks)
    starts = sorted({seg[6] for segs in plan.values() for seg in segs}) + [total]
    for start, end in zip(starts, starts[1:]):
        share = {s: (seg[3], seg[4], seg[5]) for s, segs in plan.items() for seg in segs if seg[6] == start}
        for s, (a, q, first) in share.items():
            done = 0
            for slot in range(start, end):
                done += slots[slot][0] == s
                assert abs(done * q - (slot + 1 - start) * a) < q
            assert [k for slot in range(start, end) for x, k in [slots[slot]] if x == s] == list(range(first, first + done))


def test_integer_weights_add_up():
    got = mixing.integer_weights({"a": 0.7, "b": 0.2999, "c": 0.0001}, 100)
    assert sum(got.values()) == 100 and min(got.values()) == 1 and got["a"] > got["b"]


@pytest.mark.parametrize("weights", [None, {"s": 3.0, "t": 1.0}])
def test_mixing_edge_rows(edge_docs, no_docs, weights):
    got = mixing.mixed(edge_docs, weights=weights, block_rows=2)
    assert got.columns == edge_docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, edge_docs.collect()))
    assert mixing.mixed(no_docs, weights=weights).count() == 0
    placed = mixing.schedule(edge_docs, weights=weights, block_rows=2).collect()
    assert len(placed) == edge_docs.count() and all(r.release <= r.slot < r.deadline for r in placed)
    assert len({(r.slot, r.position) for r in placed}) == len(placed)


def test_mixing_query_covers_all_documents(spark, tables):
    got = registry.q_mixing(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in tables("documents").collect())
    blocks = {(r.source, r.block): r.slot for r in got}
    assert sorted(blocks.values()) == list(range(len(blocks)))


def test_mixed_files_hold_the_mixture_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", i) for i in range(300)], "doc_id long, source string, _slot int")
    mixing.mixed(docs, weights={"a": 1, "b": 1}, block_rows=2).write.parquet(str(tmp_path / "m"))
    import pyarrow.parquet as pq

    order = "".join(s for f in sorted((tmp_path / "m").glob("part-*")) for s in pq.read_table(f)["source"].to_pylist())
    assert order[:200] == "aabb" * 50 and set(order[200:]) == {"a"}
