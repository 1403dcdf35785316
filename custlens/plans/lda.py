"""LDA topics of any number of texts and terms.

The same estimate as ``pyspark.ml.clustering.LDA`` with its online optimizer
over whole batches (its learning rate, estimated document prior, inner
threshold), with no table of all terms in one place:

* texts are packed into blocks of about ``BLOCK_WORDS`` words that count their
  own terms, terms are dealt to shards by hash, and a shard keeps its terms and
  their rows of the word-topic table;
* in a round, a shard sends each block the rows of the block's own terms, the
  block infers its texts' topics and sends back one sum per own term.

A task holds a block or a shard; the driver holds a few numbers per topic.
Blocks and shards stay where they are; only their messages are shuffled, one
row per block and shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.session import checkpoint_dir

# fixed values: learning rate (TAU0 + round) ** -KAPPA, shape of the first draws, and the
# mean change at which a text has settled
TAU0, KAPPA, SHAPE, SETTLED = 1024.0, 0.51, 100.0, 1e-3
BLOCK_WORDS, LEAST_WORDS = 2_000_000, 250_000
ROW_PAIRS = 65_536  # (text, term) pairs in a row of a block
LOT_PAIRS = 131_072  # pairs that are inferred at once
LOT_LEFT = (0.5, 0.25, 0.1)  # share of a lot's texts, the slowest, that go on in lots of their own
SHARD_CHARS = 40_000_000  # characters of all texts per shard of terms
LEAST_SHARDS = 16

PACKED = "shard int, block long, a binary, b binary, c binary, terms array<string>"
LINKS = "shard int, block long, pos binary, loc binary, terms array<string>"
BLOCKS = "block long, a binary, b binary, c binary"
MESSAGES = "shard int, block long, data binary"
STATE, TOTALS, TEXTS = -1, -2, -1  # numbers that stand for no block, no block, no shard


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 8
    y = 1 / (z * z)
    tail = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    p = x * (x + 7)  # 1 / x + ... + 1 / (x + 7), in pairs from the ends
    return np.log(z) - 0.5 / z - tail - (x + z - 1) * (1 / p + 1 / (p + 6) + 1 / (p + 10) + 1 / (p + 12))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 8
    y = 1 / (z * z)
    tail = y / z * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return 1 / z + 0.5 * y + tail + sum(1 / (x + i) ** 2 for i in range(8))


def infer(ptr: np.ndarray, idx: np.ndarray, cnt: np.ndarray, beta: np.ndarray, alpha: np.ndarray,
          rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Topics of texts, given as counts of terms in compressed rows, none empty, and
    exp E[log beta] (topic, term): the texts' gamma (text, topic), and the sums per
    term that the word-topic table is updated from."""
    size = np.diff(ptr)
    gamma = rng.gamma(SHAPE, 1 / SHAPE, (len(size), len(beta)))
    late = np.arange(len(size))
    for least in (*LOT_LEFT, 0):  # the texts that take long go on together
        late = _joined([_settle(lot, ptr, size, idx, cnt, beta, alpha, gamma, least) for lot in _lots(late, size)], np.int64)
    stat, theta = np.zeros_like(beta), _theta(gamma)
    for lot in np.array_split(np.arange(len(size)), len(idx) // ROW_PAIRS + 1):
        if len(lot):
            own = slice(ptr[lot[0]], ptr[lot[-1] + 1])
            shown = np.repeat(theta[lot].T, size[lot], axis=1)
            ratio = cnt[own] / ((beta[:, idx[own]] * shown).sum(0) + 1e-100)
            for x, t in zip(stat, shown, strict=True):
                np.add.at(x, idx[own], ratio * t)
    return gamma, stat


def _lots(texts: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The texts, in lots of about the same number of terms that fit the processor's cache."""
    texts = texts[np.argsort(size[texts], kind="stable")]
    width = size[texts]
    at = 0
    while at < len(texts):
        cells = np.searchsorted(width[at:] * np.arange(1, len(texts) - at + 1), LOT_PAIRS, "right")
        near = np.searchsorted(width[at:], 1.5 * width[at] + 8, "right")
        end = at + max(1, min(cells, near))
        yield texts[at:end]
        at = end


def _settle(lot: np.ndarray, ptr: np.ndarray, size: np.ndarray, idx: np.ndarray, cnt: np.ndarray, beta: np.ndarray,
            alpha: np.ndarray, gamma: np.ndarray, least: float) -> np.ndarray:
    """Moves the gamma of the lot's texts until they have settled, or until no more
    than the share ``least`` of them is left: these are returned."""
    column = np.arange(size[lot].max())
    inside = column < size[lot][:, None]
    at = np.where(inside, ptr[lot][:, None] + column, ptr[lot][:, None])
    c = np.where(inside, cnt[at], 0.0)
    b = np.ascontiguousarray(beta[:, idx[at]].transpose(1, 0, 2))
    g, few = gamma[lot], least * len(lot)
    theta, live = _theta(g), np.ones(len(lot), bool)
    while len(lot) > few:
        ratio = c / ((theta[:, None, :] @ b)[:, 0] + 1e-100)
        new = alpha + theta * (b @ ratio[:, :, None])[:, :, 0]
        new[~live] = g[~live]
        live &= np.abs(new - g).mean(1) > SETTLED
        g, theta = new, _theta(new)
        if live.sum() < 0.8 * len(lot):  # go on with the others alone
            gamma[lot] = g
            lot, g, theta, b, c = lot[live], g[live], theta[live], b[live], c[live]
            live = np.ones(len(lot), bool)
    gamma[lot] = g
    return lot[live]


def _theta(gamma: np.ndarray) -> np.ndarray:
    return np.exp(_log_share(gamma))


def _log_share(gamma: np.ndarray) -> np.ndarray:
    of = digamma(np.concatenate([gamma, gamma.sum(1, keepdims=True)], axis=1))
    return of[:, :-1] - of[:, -1:]


def next_alpha(alpha: np.ndarray, logphat: np.ndarray, n: float, weight: float) -> np.ndarray:
    """One Newton step for the document prior; the old one where it would leave the positive numbers."""
    gradient = n * (digamma(alpha.sum()) - digamma(alpha) + logphat)
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - weight * (gradient - b) / q
    return new if (new > 0).all() else alpha


def _ints(x) -> bytes:
    return np.asarray(x, np.int32).tobytes()


def _arrays(column, dtype=np.int32) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _joined(arrays: list[np.ndarray], dtype=np.int32) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, dtype)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()),
          "string": pa.string(), "double": pa.float64()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])


def _packer(shards: int, block_words: int):
    """Texts of words with single spaces, to the rows of their blocks (shard -1: the
    pairs, by text) and of the blocks' terms by shard (numbers in the block, texts)."""
    schema = _arrow(PACKED)

    def rows(block: int, values: list[pa.Array], sizes: list[np.ndarray]) -> pa.Table:
        coded = pa.concat_arrays(values).dictionary_encode()
        names = coded.dictionary
        words = coded.indices.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(sum(map(len, sizes))), np.concatenate(sizes))
        real = words != pc.index(names, "").as_py()  # a text without words
        key, cnt = np.unique(doc[real] * len(names) + words[real], return_counts=True)
        doc, idx = np.divmod(key, max(len(names), 1))
        out = []
        start = np.flatnonzero(np.diff(doc, prepend=-1))
        ptr = np.append(start, len(doc))
        for lot in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start // ROW_PAIRS)) + 1):
            if len(lot):
                lo, hi = ptr[lot[0]], ptr[lot[-1] + 1]
                out.append((-1, block, _ints(ptr[lot[0]:lot[-1] + 2] - lo), _ints(idx[lo:hi]), _ints(cnt[lo:hi]), None))
        found = np.bincount(idx, minlength=len(names))
        shard = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) % shards
        shard = np.where(found > 0, shard.astype(np.int64), shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            if len(loc := order[cuts[s]:cuts[s + 1]]):
                out.append((s, block, _ints(loc), _ints(found[loc]), None, names.take(pa.array(loc)).to_pylist()))
        return _rows(schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, values, sizes, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                lists = pc.split_pattern(b.column(0).slice(at, 256), " ")
                values.append(lists.flatten())
                sizes.append(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                held += len(values[-1])
                if held >= block_words:
                    yield from rows(block, values, sizes).to_batches()
                    block, values, sizes, held = block + 1, [], [], 0
        if held:
            yield from rows(block, values, sizes).to_batches()

    return run


def _vocabulary(least: float):
    """Terms of one shard that enough texts hold, and for each block which of them it has."""
    schema = _arrow(LINKS)

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        lists = table["terms"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words = coded.indices.to_numpy(zero_copy_only=False)
        total = np.bincount(words, _joined(_arrays(table["b"])), minlength=len(coded.dictionary))
        order = pc.sort_indices(coded.dictionary).to_numpy()
        kept = order[total[order] >= least]
        pos = np.full(len(total), -1)
        pos[kept] = np.arange(len(kept))
        out = [(shard, STATE, _ints([len(kept)]), None, coded.dictionary.take(pa.array(kept)).to_pylist())]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        for block, loc, own in zip(table["block"].to_pylist(), _arrays(table["a"]), np.split(words, ends[:-1]), strict=True):
            p = pos[own]
            known = np.flatnonzero(p >= 0)
            known = known[np.argsort(p[known])]
            if len(known):
                out.append((shard, block, _ints(p[known]), _ints(loc[known]), None))
        return _rows(schema, out if len(kept) else [])

    return run


def _renumbered(pairs: pa.Table, links: pa.Table) -> pa.Table:
    """A block's rows with its terms numbered by shard and place there, the others left out."""
    loc = _joined([_arrays(links["loc"])[i] for i in np.argsort(links["shard"].to_numpy())])
    out = []
    for block, ptr, idx, cnt in zip(pairs["block"].to_pylist(), *(_arrays(pairs[c]) for c in "abc"), strict=True):
        number = np.full(max(idx.max(), loc.max(initial=0)) + 1, -1)
        number[loc] = np.arange(len(loc))
        new = number[idx]
        size = np.add.reduceat(new >= 0, ptr[:-1], dtype=np.int64)
        known = new >= 0
        if known.any():
            out.append((block, _ints(np.append(0, np.cumsum(size[size > 0]))), _ints(new[known]), _ints(cnt[known])))
    return _rows(_arrow(BLOCKS), out)


def _table_step(k: int, seed: int, weight: float, totals: np.ndarray | None):
    """A shard's rows of the word-topic table after a round (the first: drawn), and
    exp(digamma) of them for each block that has the terms."""
    schema = _arrow(MESSAGES)

    def run(links: pa.Table, inbox: pa.Table) -> pa.Table:
        if not links.num_rows:
            return _rows(schema, [])
        shard = links["shard"][0].as_py()
        pos = dict(zip(links["block"].to_pylist(), _arrays(links["pos"]), strict=True))
        n = int(pos.pop(STATE)[0])
        if totals is None:
            table = np.random.default_rng([seed, shard]).gamma(SHAPE, 1 / SHAPE, (k, n))
        else:
            stat = np.zeros((k, n))
            for block, data in sorted(zip(inbox["block"].to_pylist(), _arrays(inbox["data"], np.float64), strict=True),
                                      key=lambda x: x[0]):
                if block == STATE:
                    table = data.reshape(k, n)
                else:
                    stat[:, pos[block]] += data.reshape(k, -1)
            stat *= np.exp(digamma(table) - digamma(totals)[:, None])
            table = (1 - weight) * table + weight * (stat + 1 / k)
        sent = np.exp(digamma(table))
        return _rows(schema, [(shard, STATE, table.tobytes()), (shard, TOTALS, table.sum(1).tobytes()),
                              *((shard, b, sent[:, p].tobytes()) for b, p in pos.items())])

    return run


def _text_step(k: int, seed: int, turn: int, alpha: np.ndarray, totals: np.ndarray):
    """A block's sums for the terms of each shard, and of its texts' expected log topics."""
    schema = _arrow(MESSAGES)
    scale = np.exp(-digamma(totals))[:, None]

    def run(pairs: pa.Table, inbox: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return _rows(schema, [])
        block = pairs["block"][0].as_py()
        inbox = inbox.sort_by("shard")
        parts = [x.reshape(k, -1) for x in _arrays(inbox["data"], np.float64)]
        beta = np.concatenate(parts, axis=1) * scale
        # rows come in any order, draws in one
        rows = sorted(zip(*(_arrays(pairs[c]) for c in "abc"), strict=True), key=lambda x: x[1].tobytes())
        size, idx, cnt = (np.concatenate(x) for x in zip(*((np.diff(a), b, c) for a, b, c in rows), strict=True))
        gamma, stat = infer(np.append(0, np.cumsum(size)), idx, cnt, beta, alpha, np.random.default_rng([seed, turn, block]))
        cuts = np.cumsum([p.shape[1] for p in parts])[:-1]
        return _rows(schema, [(TEXTS, block, np.append(_log_share(gamma).sum(0), len(gamma)).tobytes()),
                              *((s, block, np.ascontiguousarray(x).tobytes())
                                for s, x in zip(inbox["shard"].to_pylist(), np.split(stat, cuts, axis=1), strict=True))])

    return run


def _top_step(k: int, top: int, totals: np.ndarray):
    schema = _arrow("topic int, term string, weight double")

    def run(terms: pa.Table, state: pa.Table) -> pa.Table:
        names = terms["terms"].combine_chunks().flatten()
        share = _arrays(state["data"], np.float64)[0].reshape(k, -1) / totals[:, None]
        best = [(t, i) for t in range(k) for i in np.argsort(-share[t], kind="stable")[:top]]
        return _rows(schema, [(t + 1, names[int(i)].as_py(), float(share[t, i])) for t, i in best])

    return run


class _Kept:
    """Tables of a round in the shared checkpoint folder; a round's are deleted when the next has read them."""

    def __init__(self, spark):
        self.spark, self.top, self.n = spark, f"{checkpoint_dir(spark)}/lda-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame, compression: str = "none") -> tuple[DataFrame, str]:
        self.n += 1
        place = f"{self.top}/{self.n}"
        # large rows: writers look often whether a row group is full
        df.write.options(**{"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1,
                            "parquet.page.size.row.check.max": 16, "compression": compression}).parquet(place)
        return self.spark.read.schema(df.schema).parquet(place), place

    def delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Kept on disk by key, so that joining messages moves the messages alone."""
    return df.repartition(tasks, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)


def _numbers(df: DataFrame, where: str, k: int) -> np.ndarray:
    """Sum of the few numbers in the rows ``where``: one row per block or shard, ordered so that sums repeat."""
    rows = sorted((r[0], r[1], bytes(r[2])) for r in df.where(where).collect())
    return np.sum([np.frombuffer(r[2]) for r in rows], axis=0) if rows else np.zeros(k)


def topics(words: DataFrame, least: float, chars: int, k: int, top: int, seed: int, max_iter: int,
           block_words: int | None = None) -> DataFrame:
    """(topic, rank, term, weight) of LDA over texts given as one column of words
    with single spaces: terms in at least ``least`` texts; ``chars`` is about the
    texts' length in all."""
    spark = words.sparkSession
    cores = spark.sparkContext.defaultParallelism
    shards = max(LEAST_SHARDS, -(-chars // SHARD_CHARS))
    # a few blocks per core at least, at about 7 characters a word
    block_words = block_words or min(BLOCK_WORDS, max(LEAST_WORDS, chars // (28 * cores)))
    result = "topic int, rank int, term string, weight double"
    kept = _Kept(spark)
    packed, packed_at = kept.written(words.mapInArrow(_packer(shards, block_words), PACKED), "zstd")
    links = _dealt(packed.where("shard >= 0").groupBy("shard").applyInArrow(_vocabulary(least), LINKS),
                   "shard", min(shards, 4 * cores))
    own = links.where(F.col("block") != STATE).select("shard", "block", "loc")
    blocks = _dealt(packed.where("shard < 0").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        _renumbered, BLOCKS), "block", 8 * cores)
    places = links.select("shard", "block", "pos")
    try:
        if not links.count():
            return spark.createDataFrame([], result)
        blocks.count()
        kept.delete(packed_at)
        alpha, totals, weight = np.full(k, 1 / k), None, 0.0
        inbox, old = spark.createDataFrame([], MESSAGES), []
        for turn in range(max_iter + 1):
            table, table_at = kept.written(places.groupBy("shard").cogroup(inbox.groupBy("shard")).applyInArrow(
                _table_step(k, seed, weight, totals), MESSAGES))
            totals = _numbers(table, f"block = {TOTALS}", k)
            for place in old:
                kept.delete(place)
            if turn % 2 == 0:  # the shuffles go when the driver collects its garbage
                spark._jvm.System.gc()
            old = [table_at]
            if turn == max_iter:
                break
            sums, sums_at = kept.written(blocks.groupBy("block").cogroup(
                table.where("block >= 0").groupBy("block")).applyInArrow(
                _text_step(k, seed, turn, alpha, totals), MESSAGES))
            *logphat, n = _numbers(sums, f"shard = {TEXTS}", k + 1)
            weight = (TAU0 + turn + 1) ** -KAPPA
            if n:
                alpha = next_alpha(alpha, np.array(logphat) / n, n, weight)
            inbox = table.where(f"block = {STATE}").unionAll(sums.where(f"shard <> {TEXTS}"))
            old = [table_at, sums_at]
        best = links.where(f"block = {STATE}").select("shard", "terms").groupBy("shard").cogroup(
            table.where(f"block = {STATE}").groupBy("shard")).applyInArrow(
            _top_step(k, top, totals), "topic int, term string, weight double")
        order = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
        # k x top rows, made here: the tables of the rounds are deleted after
        rows = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
            "topic", "rank", "term", "weight").collect()
        return spark.createDataFrame(rows, result)
    finally:
        links.unpersist()
        blocks.unpersist()
        kept.delete(kept.top)
