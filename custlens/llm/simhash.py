"""SimHash near duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into ``d + 3`` blocks.  Two fingerprints that
differ in at most ``d`` bits agree on at least three whole blocks, so they meet
under one of the C(d + 3, 3) keys made of three blocks (over 30 bits: unrelated
fingerprints rarely meet, at any corpus size).  Under a key only distinct
fingerprints are compared, exactly, by Hamming distance, and a breadth-first
walk writes one link per reached fingerprint, not all pairs.

Copies share a fingerprint and never enter the join more than once; rows of a
key arrive sorted and are read as a stream of 8-byte numbers.

Defined results: a null or empty text has fingerprint 0, linked like any other;
fewer words than the shingle length make one shingle of all words; repeated
rows share a component; an empty table gives an empty result; extra columns are
ignored by the table of components and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import cut_lineage, only_keys, row_key, shuffle_partitions, sliced
from custlens.llm.components import components

SEED = 42
SLICE = 1 << 16  # shingles hashed at a time: bounds the memory of a very long text
SMALL = 8  # keys of at most so many fingerprints are compared by shifted arrays


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit b is set when it is set in over half of the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = words[at:at + min(SLICE, n - at) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, key, fp) per row; fp is the unsigned fingerprint held in a signed long."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(docs).alias("key"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["id", "key", "fp"])

    return src.mapInArrow(run, schema)


def _block_keys(bits: int) -> F.Column:
    """Array of the keys of a fingerprint: three whole blocks and the key's number."""
    n = bits + 3
    cuts = [64 * i // n for i in range(n + 1)]
    fp = F.col("fp")
    block = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*(F.xxhash64(F.lit(i), block[a], block[b], block[c])
                     for i, (a, b, c) in enumerate(combinations(range(n), 3))))


def _walk(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links from the first fingerprint of each component inside one key."""
    rest = fps
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        frontier = [seed]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= bits
            if near.any():
                found = rest[near]
                yield np.full(len(found), seed), found
                frontier.extend(found)
                rest = rest[~near]


def _links_of(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole keys; ``keys`` is sorted, fingerprints are distinct within a key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, SMALL):
        hit = (keys[shift:] == keys[:-shift]) & small[shift:]
        i = np.flatnonzero(hit)
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        a.append(fps[i])
        b.append(fps[i + shift])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for x, y in _walk(fps[s:s + n], bits):
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def fingerprint_links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> spanning links (a, b) at ``bits`` or fewer differing bits."""
    keyed = distinct.select(F.explode(_block_keys(bits)).alias("k"), "fp")
    dealt = keyed.repartition(shuffle_partitions(distinct), "k").sortWithinPartitions("k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

        def out(k, f):
            x, y = _links_of(k, f, bits)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy()
            f = batch.column(1).to_numpy().view(np.uint64)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if cut or (len(held_k[0]) and held_k[0][0] != k[0]):
                head_k = np.concatenate([*held_k, k[:cut]])
                if len(head_k):
                    yield out(head_k, np.concatenate([*held_f, f[:cut]]))
                held_k, held_f = [k[cut:]], [f[cut:]]
            else:
                held_k.append(k)
                held_f.append(f)
        if sum(map(len, held_k)):
            yield out(np.concatenate(held_k), np.concatenate(held_f))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    bits: int = 3) -> DataFrame:
    """(id, key, fp, component_id, component_key): the component is named by
    its smallest (id, row key)."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min(F.struct("id", "key")).alias("low")))
    comp = components(fingerprint_links(distinct.select("fp"), bits))
    rooted = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = rooted.groupBy("root").agg(F.min("low").alias("top"))
    named = rooted.join(lows, "root").select("fp", F.col("top.id").alias("component_id"),
                                             F.col("top.key").alias("component_key"))
    return fps.join(named, "fp")


def fingerprint_hex(fp: str | F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         bits: int = 3) -> DataFrame:
    """One document of each component, the smallest id, with all its columns."""
    found = near_duplicates(docs, id_col, text_col, shingle, bits)
    top = found.where(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key")))
    return only_keys(docs, id_col, top.select("id", "key"))
