"""Every source of a mixture is scheduled, however many there are."""

import pytest
from pyspark.sql import functions as F

from custlens.llm import mixing


def _lots(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    return spark.createDataFrame(rows, "source string, n long").select("source", F.explode(F.sequence(
        F.lit(1), "n"))).select(F.monotonically_increasing_id().alias("doc_id"), "source")


def _slots(docs, **more):
    got = mixing.schedule(docs, block_rows=1, **more).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    return [r.source for r in sorted(got, key=lambda r: r.slot)]


def test_many_equal_sources_keep_their_square_root_share(spark):
    # one source of 2,500 rows (weight 50) and 600 of 4 (weight 2 each, 1,200 in all)
    order = _slots(_lots(spark, {"big": 2_500} | {f"s{i:03}": 4 for i in range(600)}))
    assert abs(order[:1_250].count("big") - 50) < 2
    for rounds in (1, 2, 3):  # each small source is less than one block from its share
        first = order[:rounds * 625]
        assert all(abs(first.count(f"s{i:03}") - rounds) <= 1 for i in range(600))


@pytest.mark.parametrize("weights", [None, {"z": 1.0}])
def test_more_sizes_than_streams(spark, weights):
    sizes = {f"s{n:03}": n for n in range(1, 301)} | {"z": 40}
    order = _slots(_lots(spark, sizes), weights=weights)
    want = {s: n ** 0.5 if weights is None else n / 40 for s, n in sizes.items()}
    for at in (100, 1_000, 2_000) if weights is None else (1_000, 20_000, 40_000):
        done, left = order[:at], dict(sizes)
        time, used = 0.0, 0.0  # the fluid schedule: all by weight until the first ends, and so on
        for s in sorted(sizes, key=lambda s: (sizes[s] / want[s], s)):
            rate, step = sum(want[x] for x in left), sizes[s] / want[s] - time
            step = min(step, (at - used) / rate)
            time, used = time + step, used + step * rate
            if used >= at:
                break
            del left[s]
        from collections import Counter

        got = Counter(done)
        # each phase rounds weights, so the allowance is that of a few blocks
        assert all(abs(got[s] - min(n, want[s] * time)) < 5 for s, n in sizes.items())


def test_together():
    assert [len(r) for r in mixing.together([1, 2, 4, 8], 4)] == [1, 1, 1, 1]
    assert mixing.together([10, 11, 100, 101, 1000], 3) == [range(0, 2), range(2, 4), range(4, 5)]


def test_plan_of_thousands_of_sizes_stays_small():
    kinds = [(f"n:{n}", 1, n) for n in range(1, 6_001)]  # 18 million rows
    table, slots, size = mixing._plan(mixing._streams(kinds, None), 4, mixing.PERIOD)
    assert slots == sum(-(-n // 4) for n in range(1, 6_001)) and len(table) < mixing.MAX_SOURCES
    assert sum(len(peers) for _, _, peers in table) == 6_000
    assert sum(len(s[-1]) for _, segs, _ in table for s in segs) <= 2 * mixing.PLANNED and size < 10 << 20


@pytest.mark.parametrize("weights", [{"a": 0.9995, "b": 0.0005}, {"a": 7.0, "b": 0.25, "c": 1 / 3}])
def test_ratios_of_whole_numbers_are_exact_at_any_length(weights):
    kinds = [(f"s:{s}", 1, int(w * 80_000_000)) for s, w in weights.items()]
    table, slots, _ = mixing._plan(mixing._streams(kinds, weights), 4, mixing.PERIOD)
    assert slots > 5_000_000
    total = sum(weights.values())
    for name, segs, _ in table:
        share = weights[name[2:]] / total
        for k0, k1, slot0, a, q, phase_k, _, at in segs:
            if phase_k:  # the first phase, up to the first source that ends
                continue
            for k in {*range(k0, min(k1, k0 + 500)), *range(max(k0, k1 - 500), k1)}:
                slot = slot0 + (k - k0) // a * q + at[(k - k0) % a]
                assert abs(k - slot * share) < 1 and abs(k + 1 - (slot + 1) * share) < 1


def test_whole_weights():
    assert mixing.whole_weights({"a": 0.7, "b": 0.3}, 100) == {"a": 7, "b": 3}
    assert mixing.whole_weights({"a": 2 ** 0.5, "b": 1.0}, 10 ** 9) is None
    assert mixing.whole_weights({"a": 0.999, "b": 0.001}, 999) is None
