"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in hash order, are cut into blocks.  With integer weights
``a`` out of a period of ``q`` slots, block j (from 1) of a source is released
at slot floor((j - 1) q / a) and due by slot ceil(j q / a); the earliest
deadline among released blocks gets the slot.  At every slot each source is
then less than one block away from its share.  The schedule repeats after
``q`` slots, so one period is worked out for the (bounded) list of sources and
each block reads its slot from it by arithmetic.

When a source runs out its weight goes to the others and a new phase starts;
every row gets exactly one place, none is dropped or repeated.

Every source is scheduled, at any number of sources, by at most ``MAX_SOURCES``
streams.  Sources of one size (their weight is a function of it) take turns in
one stream that has the sum of their weights: the stream's block j n + i is
block j of source i of n, whose slot is inside that block's own window, so each
source stays less than one block from its share.  A source named by weights
is a stream of its own.  Only when there are more sizes than streams, nearby
sizes (the least ratio that will do) share a stream; its blocks are in order of
(k + 1) / weight, and a source is then less than 2 + r blocks from its share of
the stream, r being the ratio of the weights in it.  That order is worked out
by arithmetic over the stream's sizes, so no block is sorted for it.

The plan has one row per stream: its slots once (at most 2 * PLANNED numbers
over all streams) and its sizes once; it is broadcast up to ``BROADCAST_BYTES``
and joined beyond.  What a source has of its own reaches its rows with the
distributed table of sources.  Weights whose ratio is one of whole numbers that
fit the planned slots are taken exactly, at any number of slots; others are
rounded to 1/period, with a period as long as the schedule up to PLANNED /
streams slots.

Defined results: a null source counts as the empty name; ties in the hash are
ordered by id and row hash; repeated rows take places of their own; an empty
table gives an empty result; extra columns are kept by ``mixed``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custlens.llm.common import fresh, row_key, shuffle_partitions

MAX_SOURCES = 256
PERIOD = 840
PLANNED = 1 << 20  # slots that the driver works out at most, over all phases
BUCKET_ROWS = 1 << 12  # rows that one rank window holds on average
BROADCAST_BYTES = 32 << 20  # a larger plan of the streams is joined, not broadcast
_SEGMENT = ("array<struct<k0:bigint,k1:bigint,slot0:bigint,a:bigint,q:bigint,phase_k:bigint,phase_slot:bigint,"
            "slots:array<int>>>")
_PEER = "struct<i:int,m:bigint,b:bigint,w:double>"  # a kind of sources: its place, sources, blocks and weight of each


def integer_weights(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole weights of at least 1 that add up to the period (largest remainders)."""
    total = sum(weights.values())
    period = max(period, 4 * len(weights))
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(out, key=lambda s: (out[s] - exact[s], s))
    gap = period - sum(out.values())
    while gap:
        for s in order if gap > 0 else order[::-1]:
            if gap and (gap > 0 or out[s] > 1):
                out[s] += 1 if gap > 0 else -1
                gap -= 1 if gap > 0 else -1
    return out


def whole_weights(weights: Mapping[str, float], most: int) -> dict[str, int] | None:
    """Whole numbers in exactly the ratio of the weights, where their sum is at
    most ``most``; else None."""
    ratios = {s: Fraction(w).limit_denominator(10 ** 6) for s, w in weights.items()}
    if any(float(r) != w or r <= 0 for r, w in zip(ratios.values(), weights.values())):
        return None
    scale = math.lcm(*(r.denominator for r in ratios.values()))
    out = {s: int(r * scale) for s, r in ratios.items()}
    least = math.gcd(*out.values())
    out = {s: a // least for s, a in out.items()}
    return out if sum(out.values()) <= most else None


def earliest_deadlines(weights: Mapping[str, int], slots: int) -> list[str]:
    """The source of each of the first ``slots`` slots of a phase."""
    q = sum(weights.values())
    waiting = [(0, s, 1) for s in sorted(weights)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * q // weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        heapq.heappush(waiting, (j * q // weights[s], s, j + 1))
    return out


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, list[tuple]]:
    """Per source the segments (k0, k1, slot0, a, q, phase_k, phase_slot, slots):
    block k of [k0, k1) has slot slot0 + (k - k0) // a * q + slots[(k - k0) % a]."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(blocks, 0)
    out: dict[str, list[tuple]] = {s: [] for s in blocks}
    slot = 0
    while left:
        active = {s: weights[s] for s in left}
        q = sum(active.values())
        start, first = slot, dict(done)
        # by its last deadline the first source is used up
        order = earliest_deadlines(active, min(q, min(-(-left[s] * q // a) for s, a in active.items())))
        at: dict[str, list[int]] = {s: [] for s in active}
        for t, s in enumerate(order):
            at[s].append(t)
        whole = min(left[s] // active[s] for s in left)
        if whole:
            for s, a in active.items():
                out[s].append((done[s], done[s] + whole * a, slot, a, q, first[s], start, at[s]))
                done[s] += whole * a
                left[s] -= whole * a
            slot += whole * q
        if all(left.values()):  # the rest of the phase: until the first source is used up
            used: dict[str, list[int]] = {s: [] for s in active}
            for t, s in enumerate(order):
                used[s].append(t)
                left[s] -= 1
                if not left[s]:
                    break
            for s, ts in used.items():
                if ts:
                    out[s].append((done[s], done[s] + len(ts), slot, active[s], q, first[s], start, ts))
                    done[s] += len(ts)
            slot += t + 1
        left = {s: n for s, n in left.items() if n}
    return out


def tempered(sizes: Mapping[str, int], exponent: float = 0.5) -> dict[str, float]:
    """Weights that grow with a power of a source's rows."""
    return {s: n ** exponent for s, n in sizes.items()}


def _placed(docs: DataFrame, id_col: str, source_col: str, weights: Mapping[str, float] | None, block_rows: int,
            period: int) -> tuple[DataFrame, dict[str, str], int]:
    """All columns of ``docs`` with its place; the names of the added columns; the number of slots."""
    names = ["source", "h", "bucket", "rank", "before", "block", "turn", "slot", "release", "deadline", "part", "seg",
             "low", "stream", "member", "peers", "self"]
    c = dict(zip(names, fresh(docs, *[f"_{n}" for n in names])))
    src = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    rows, kinds, sources = _sources(docs.select(src.alias("s")), weights)
    streams = _streams(kinds, weights)

    bits = max(0, (rows // BUCKET_ROWS).bit_length())
    h = F.xxhash64(F.lit("mix"), F.col(f"`{id_col}`"))
    bucket = F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")
    keys = [c["source"], c["bucket"]]
    counted = docs.select(src.alias(c["source"]), bucket.alias(c["bucket"])).groupBy(*keys).agg(
        F.count("*").alias("n"))
    of_kind = docs.sparkSession.createDataFrame(
        [(kind, name, (i, m, -(-n // block_rows), w)) for name, own in streams.items()
         for i, (kind, m, n, w) in enumerate(own)], f"kind string, {c['stream']} string, {c['self']} {_PEER}")
    before = counted.withColumn(c["before"], F.sum("n").over(
        _window([c["source"]], [c["bucket"]]).rowsBetween(Window.unboundedPreceding, -1))).drop("n").join(
        sources.join(of_kind, "kind").select(F.col("s").alias(c["source"]), F.col("member").alias(c["member"]),
                                             c["stream"], c["self"]), c["source"])
    marked = docs.withColumns({c["source"]: src, c["bucket"]: bucket, c["h"]: h, c["low"]: row_key(docs)})
    ranked = marked.withColumn(c["rank"], F.row_number().over(_window(keys, [c["h"], f"`{id_col}`", c["low"]])))
    ranked = ranked.join(before, keys).withColumn(
        c["rank"], F.col(c["rank"]) - 1 + F.coalesce(c["before"], F.lit(0)))

    table, slots, size = _plan(streams, block_rows, period)
    table = docs.sparkSession.createDataFrame(
        table, f"{c['stream']} string, {c['seg']} {_SEGMENT}, {c['peers']} array<{_PEER}>")
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    block = F.floor(F.col(c["rank"]) / block_rows)
    placed = ranked.join(table, c["stream"]).withColumn(c["block"], block).withColumn(
        c["turn"], _turn(F.col(c["block"]), F.col(c["self"]), F.col(c["peers"]), F.col(c["member"]))).withColumn(
        c["seg"], F.filter(c["seg"], lambda s: (s["k0"] <= F.col(c["turn"])) & (F.col(c["turn"]) < s["k1"]))[0])
    seg, k = F.col(c["seg"]), F.col(c["turn"])
    i = k - seg["k0"]
    j = k - seg["phase_k"]
    placed = placed.withColumns({
        c["slot"]: seg["slot0"] + F.floor(i / seg["a"]) * seg["q"] + F.element_at(
            seg["slots"], (i % seg["a"] + 1).cast("int")),
        c["release"]: seg["phase_slot"] + _div(j * seg["q"], seg["a"]).cast("long"),
        c["deadline"]: seg["phase_slot"] + _div((j + 1) * seg["q"] + seg["a"] - 1, seg["a"]).cast("long"),
    })
    return placed, c, slots


def _plan(streams: dict[str, list[tuple]], block_rows: int, period: int) -> tuple[list[tuple], int, int]:
    """Per stream (name, segments, peers); the number of slots; about how many bytes the rows take."""
    blocks = {name: sum(m * -(-n // block_rows) for _, m, n, _ in own) for name, own in streams.items()}
    target = {name: sum(m * w for _, m, _, w in own) for name, own in streams.items()}
    if not target:
        return [], 0, 0
    # a period as long as all slots rounds by less than a block; bounded by what the driver works out
    planned = PLANNED // len(target)
    plan = phases(whole_weights(target, planned) or integer_weights(
        target, max(period, min(planned, sum(blocks.values())))), blocks)
    table = [(name, plan[name], [(i, m, -(-n // block_rows), w) for i, (_, m, n, w) in enumerate(own)])
             for name, own in streams.items()]
    size = sum(64 * len(segs) + 4 * sum(len(s[-1]) for s in segs) + 48 * len(peers) for _, segs, peers in table)
    return table, sum(blocks.values()), size


def _sources(src: DataFrame, weights: Mapping[str, float] | None) -> tuple[int, list[tuple], DataFrame]:
    """Number of rows; the kinds of sources (kind, sources, rows of each),
    collected: one per name in ``weights`` and one per size (sizes that differ
    add up to the rows, so there are at most the root of twice the rows); all
    sources (s, kind, member): ``member`` counts the sources of a kind from 0."""
    kind = F.concat(F.lit("n:"), F.col("n").cast("string"))
    if weights:
        kind = F.when(F.col("s").isin(*weights), F.concat(F.lit("s:"), F.col("s"))).otherwise(kind)
    sized = src.groupBy("s").agg(F.count("*").alias("n")).withColumn("kind", kind)
    kinds = [tuple(r) for r in sized.groupBy("kind").agg(F.count("*").alias("m"), F.max("n").alias("n")).collect()]
    # numbered bucket by bucket: most sources may be of one size
    bits = max(0, (sum(m for _, m, _ in kinds) // BUCKET_ROWS).bit_length())
    h = F.xxhash64(F.lit("member"), F.col("s"))
    sized = sized.withColumn("b", F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long"))
    before = sized.groupBy("kind", "b").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(
        _window(["kind"], ["b"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    numbered = sized.withColumn("i", F.row_number().over(_window(["kind", "b"], ["s"]))).join(before, ["kind", "b"])
    return sum(m * n for _, m, n in kinds), kinds, numbered.select(
        "s", "kind", (F.col("i") - 1 + F.col("before")).alias("member"))


def _streams(kinds: list[tuple], weights: Mapping[str, float] | None) -> dict[str, list[tuple]]:
    """Per stream its kinds (kind, sources, rows of each, weight of each)."""
    named = sorted(k for k in kinds if k[0].startswith("s:"))
    if len(named) >= MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES - 1} weighted sources; the others need no weight")
    sized = sorted((k for k in kinds if not k[0].startswith("s:")), key=lambda k: k[2])
    given = {k[0]: float(weights[k[0][2:]]) for k in named}
    if weights is None:
        of = tempered({k: n for k, _, n in sized})
    else:  # unnamed sources get their share of the rows
        rows = sum(n for _, _, n in named)
        of = {k: sum(given.values()) * n / rows if rows else float(n) for k, _, n in sized}
    out = {k: [(k, m, n, given[k])] for k, m, n in named}
    # unnamed sources end together, so near sizes lose nothing by sharing a stream
    most = MAX_SOURCES - 1 if weights is None else max(1, min(64, MAX_SOURCES - 1 - len(named)))
    for part in together([n for _, _, n in sized], most):
        own = [(k, m, n, of[k]) for k, m, n in (sized[i] for i in part)]
        out[own[0][0]] = own
    return out


def together(sizes: list[int], most: int) -> list[range]:
    """Increasing sizes in at most ``most`` stretches with the least ratio of
    their ends; each size by itself where that is few enough."""
    def cut(ratio: float) -> list[range]:
        out, at = [], 0
        for i in range(1, len(sizes) + 1):
            if i == len(sizes) or sizes[i] > sizes[at] * ratio:
                out.append(range(at, i))
                at = i
        return out

    if len(sizes) <= most:
        return cut(1)
    low, high = 1.0, sizes[-1] / sizes[0]
    for _ in range(60):
        mid = (low * high) ** 0.5
        low, high = (low, mid) if len(cut(mid)) <= most else (mid, high)
    return cut(high)


def _turn(block: Column, own: Column, peers: Column, member: Column) -> Column:
    """The block's number in its stream: the blocks before it in the order of
    ((k + 1) / weight, kind, k, source), counted kind by kind."""
    due = (block + 1) / own["w"]

    def before(p: Column) -> Column:
        first = lambda x: (x / p["w"] < due) | ((x / p["w"] == due) & (p["i"] < own["i"]))
        near = F.floor(due * p["w"])  # right but for rounding: looked at again
        n = near - 1 + first(near).cast("long") + first(near + 1).cast("long")
        return F.when(p["i"] == own["i"], block).otherwise(F.greatest(F.lit(0), F.least(n, p["b"]))) * p["m"]

    return F.aggregate(peers, F.lit(0).cast("long"), lambda acc, p: acc + before(p)) + member


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of non-negative numbers."""
    return (a - a % b) / b


def _window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
             weights: Mapping[str, float] | None = None, block_rows: int = 4, period: int = PERIOD) -> DataFrame:
    """(id, source, block, release, deadline, slot, position): a block sits in
    one slot of the mixture, ``position`` is the row's place in its block.
    Without ``weights`` the target is the square root of a source's size."""
    narrow = docs.select(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"))
    placed, c, _ = _placed(narrow, id_col, source_col, weights, block_rows, period)
    return placed.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source"),
                         F.col(c["block"]).alias("block"), F.col(c["release"]).alias("release"),
                         F.col(c["deadline"]).alias("deadline"), F.col(c["slot"]).alias("slot"),
                         (F.col(c["rank"]) % block_rows).cast("int").alias("position"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
          weights: Mapping[str, float] | None = None, block_rows: int = 4, period: int = PERIOD) -> DataFrame:
    """All rows and columns of ``docs`` in mixture order: partition by
    partition, and by slot inside a partition, so files written from it hold
    consecutive stretches of the mixture."""
    placed, c, slots = _placed(docs, id_col, source_col, weights, block_rows, period)
    parts = shuffle_partitions(docs)
    part = F.floor(F.col(c["slot"]) * parts / F.lit(max(1, slots))).cast("int")
    dealt = placed.withColumn(c["part"], part).repartitionById(parts, F.col(c["part"]))
    return dealt.sortWithinPartitions(c["slot"], c["rank"]).select(*[f"`{x}`" for x in docs.columns])
