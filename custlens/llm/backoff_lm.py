"""Language-model scores by a weighted backoff automaton.

An n-gram model is counted over the training documents: unigrams have additive
smoothing, (c + 0.5) / (N + 0.5 (V + 1)), and every higher order takes off an
absolute discount D = n1 / (n1 + 2 n2) (n1, n2: n-grams seen once, twice) and
gives what it took off to the next shorter context:

    P(w | u) = max(c(uw) - D, 0) / c(u) + D T(u) / c(u) P(w | u'),

T(u): distinct words after u, u': u without its first word.  All probabilities
after a context sum to one with the unknown word.  As an automaton: contexts are
states, an arc per seen n-gram carries its probability and leads to the longest
context that ends in it, and a failure arc, weighing log10(D T(u) / c(u)), leads
from u to u'.  A text is scored in one traversal from left to right that carries
a state and adds up the weights; the documents of a block take each step together.

Scale: documents are packed into blocks of tokens once (shared folder).  A block
asks for the counts of its distinct n-grams, order by order; requests meet in
buckets drawn from the context's hash (or the n-gram's, for contexts that hold
more than a bucket's share), whose number follows the corpus.  The answers come
back to the block, which then holds the part of the automaton that its texts can
reach.  No count is cut off, and nothing that grows with the vocabulary is
collected or broadcast: the driver sees the contexts above four buckets' shares,
of which there are at most a quarter as many as buckets.

Words and n-grams are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; texts with a null
id are trained on; without training documents every probability is that of the
unknown word; every row is scored, also rows that share an id or are equal; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import written

END = xxhash.xxh64_intdigest(b" ")  # no word holds a space


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context's hash and the word after it (0: the empty context)."""
    h = (context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Block:
    """Documents as one run of tokens; every text stands between two end tokens."""

    words: np.ndarray  # hashes of the distinct words, the end token first
    tokens: np.ndarray  # their numbers, text after text
    size: np.ndarray  # tokens of each text, its end included
    held: np.ndarray
    hashes: list[np.ndarray] = field(default_factory=list)  # by length, of the n-gram that ends at a token

    def __post_init__(self):
        n = self.size + 1  # with the end token before the text
        start = np.cumsum(n) - n
        self.at = np.arange(int(n.sum())) - np.repeat(start, n)  # place in the text
        self.run = np.zeros(len(self.at), np.int64)
        self.run[self.at > 0] = self.tokens
        self.first = start + 1
        self.train = np.repeat(~self.held, n)
        self.hashes = [np.zeros(len(self.run), np.uint64)]

    def hash_of(self, length: int) -> np.ndarray:
        while len(self.hashes) <= length:
            before = np.concatenate([[np.uint64(0)], self.hashes[-1][:-1]]) if len(self.run) else self.hashes[-1]
            self.hashes.append(mix(before, self.words[self.run]))
        return self.hashes[length]


@dataclass
class Grams:
    """Distinct n-grams of a block by bucket and context."""

    gram: np.ndarray
    context: np.ndarray
    bucket: np.ndarray
    place: np.ndarray  # of the last word of an occurrence
    count: np.ndarray  # in training documents of the block
    run_start: np.ndarray  # first n-gram of each stretch with one context
    which: np.ndarray  # number of the n-gram that ends at a token (-1: none)


def grams_of(block: Block, order: int, hot: np.ndarray, buckets: int) -> Grams:
    place = np.flatnonzero(block.at >= max(1, order - 1))
    hashes = block.hash_of(order)[place]
    rank = np.argsort(hashes)
    place, hashes = place[rank], hashes[rank]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[:len(hashes)]
    first = np.flatnonzero(new)
    count = np.add.reduceat(block.train[place].astype(np.int64), first) if len(first) else first
    gram, one = hashes[first], place[first]
    context = block.hash_of(order - 1)[one - 1]
    bucket = (np.where(np.isin(context, hot), gram, context) % np.uint64(buckets)).astype(np.int64)
    rank = np.argsort(context)
    small = bucket[rank].astype(np.uint16) if buckets <= 1 << 16 else bucket[rank]
    rank = rank[np.argsort(small, kind="stable")]
    number = np.empty(len(rank), np.int32)
    number[rank] = np.arange(len(rank), dtype=np.int32)
    which = np.full(len(block.run), -1, np.int32)
    which[place] = number[np.cumsum(new) - 1]
    context, bucket = context[rank], bucket[rank]
    starts = np.concatenate([[True], (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])])[:len(gram)]
    return Grams(gram[rank], context, bucket, one[rank], count[rank], np.flatnonzero(starts), which)


# ---------------------------------------------------------------- blocks
BLOCK = [T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("size", T.ArrayType(T.LongType())),
         T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
         T.StructField("n_tokens", T.LongType()), T.StructField("n_train", T.LongType())]


def _block_row(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    texts = table.column(2).combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(full)).dictionary_encode()
    size = np.bincount(of[full], minlength=len(texts)) + 1
    ends = np.cumsum(size) - 1
    tokens = np.zeros(int(size.sum()), np.uint32)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    ids = coded.indices.to_numpy().astype(np.int64)
    # frequent words get small numbers, which compress
    rank = np.argsort(-np.bincount(ids, minlength=len(coded.dictionary)), kind="stable")
    number = np.empty(len(rank), np.uint32)
    number[rank] = np.arange(1, len(rank) + 1)
    tokens[inner] = number[ids]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64,
                         len(coded.dictionary))
    held = table.column(1).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    one = pa.array([0, len(texts)], pa.int32())
    as_list = lambda a: pa.ListArray.from_arrays(one, a)
    return pa.RecordBatch.from_arrays(
        [as_list(table.column(0).combine_chunks()), as_list(pa.array(held)), as_list(pa.array(size.astype(np.int64))),
         pa.array([np.concatenate([[np.uint64(END)], hashes[rank]]).tobytes()], pa.binary()),
         pa.array([pa.compress(tokens.tobytes(), "zstd", asbytes=True)], pa.binary()),
         pa.array([len(tokens)], pa.int64()), pa.array([int(size[~held].sum())], pa.int64())],
        names=["ids", "held", "size", "words", "tokens", "n_tokens", "n_train"])


def blocks_of(docs: DataFrame, id_col: str, text_col: str, held: Column, block_bytes: int) -> DataFrame:
    """One row per block of consecutive documents with about ``block_bytes`` of text."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held, F.lit(False)).alias("held"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(src.schema["id"].dataType)), *BLOCK])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            sizes = size + np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, int(np.searchsorted(sizes, block_bytes)) + 1)
                held_back.append(b.slice(at, to - at))
                size = int(sizes[to - 1])
                if size >= block_bytes:
                    yield _block_row(held_back)
                    held_back, sizes, size = [], sizes - size, 0
                at = to
        if held_back:
            yield _block_row(held_back)

    return src.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _read_block(row: dict) -> Block:
    raw = pa.decompress(row["tokens"], 4 * row["n_tokens"], "zstd", asbytes=True)
    return Block(np.frombuffer(row["words"], np.uint64), np.frombuffer(raw, np.uint32).astype(np.int64),
                 np.array(row["size"], np.int64), np.array(row["held"], bool))


# ---------------------------------------------------------------- counts
REQUEST = "bucket long, block long, contexts binary, runs binary, grams binary, counts binary"
ANSWER = "block long, bucket long, totals binary, context_totals binary, context_types binary, n1 long, n2 long, " \
         "types long, hot array<struct<context: long, n: long, types: long>>, frequent array<long>"


def requests(blocks: DataFrame, order: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """The counts of each block's n-grams, a row per block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = grams_of(_read_block(row), order, hot, buckets)
                cut = np.flatnonzero(np.diff(g.bucket, prepend=-1))
                runs = np.diff(g.run_start, append=len(g.gram)).astype(np.uint32)
                of = np.searchsorted(g.run_start, [*cut, len(g.gram)])
                context, count = g.context[g.run_start], g.count.astype(np.uint32)
                out = [(int(g.bucket[x]), row["block"], context[s:t].tobytes(), runs[s:t].tobytes(), g.gram[x:y].tobytes(),
                        count[x:y].tobytes()) for x, y, s, t in zip(cut, [*cut[1:], len(g.gram)], of, of[1:])]
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW_REQUEST.names, r)) for r in out], schema=_ARROW_REQUEST)

    return blocks.select("block", "held", "size", "words", "tokens", "n_tokens").mapInArrow(run, REQUEST)


_ARROW_REQUEST = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in (
    "contexts", "runs", "grams", "counts"))])
_HOT = pa.list_(pa.struct([("context", pa.int64()), ("n", pa.int64()), ("types", pa.int64())]))
_ARROW_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), *((n, pa.binary()) for n in (
    "totals", "context_totals", "context_types")), ("n1", pa.int64()), ("n2", pa.int64()), ("types", pa.int64()),
    ("hot", _HOT), ("frequent", pa.list_(pa.int64()))])


def answers(asked: DataFrame, hot: np.ndarray, frequent: int) -> DataFrame:
    """Per request the totals of its n-grams and contexts, in their order, and
    per bucket a row (block -1) with the statistics that the driver needs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        raw = {n: table.column(n).to_pylist() for n in ("block", "contexts", "runs", "grams", "counts")}
        grams = np.frombuffer(b"".join(raw["grams"]), np.uint64)
        counts = np.frombuffer(b"".join(raw["counts"]), np.uint32)
        contexts = np.frombuffer(b"".join(raw["contexts"]), np.uint64)
        context_of = np.repeat(contexts, np.frombuffer(b"".join(raw["runs"]), np.uint32))
        distinct, first, which = np.unique(grams, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        known, of = np.unique(context_of[first], return_inverse=True)
        n = np.bincount(of, weights=total, minlength=len(known)).astype(np.int64)
        types = np.bincount(of, weights=total > 0, minlength=len(known)).astype(np.int64)
        rows, at, cat = [], 0, 0
        totals, place = total[which], np.searchsorted(known, contexts)
        for block, g, c in zip(raw["block"], raw["grams"], raw["contexts"]):
            to, cto = at + len(g) // 8, cat + len(c) // 8
            rows.append({"block": block, "bucket": bucket, "totals": totals[at:to].tobytes(),
                         "context_totals": n[place[cat:cto]].tobytes(), "context_types": types[place[cat:cto]].tobytes()})
            at, cat = to, cto
        split = np.flatnonzero(np.isin(known, hot))
        rows.append({"block": -1, "bucket": bucket, "n1": int((total == 1).sum()), "n2": int((total == 2).sum()),
                     "types": int((total > 0).sum()),
                     "hot": [{"context": int(known[i].view(np.int64)), "n": int(n[i]), "types": int(types[i])} for i in split],
                     "frequent": distinct[total >= frequent].view(np.int64).tolist()})
        return pa.Table.from_pylist(rows, schema=_ARROW_ANSWER)

    return asked.groupBy("bucket").applyInArrow(run, ANSWER)


@dataclass
class Level:
    """What the driver knows of one order: bounded by the number of buckets."""

    hot: np.ndarray  # contexts whose n-grams are spread over the buckets, sorted
    hot_n: np.ndarray
    hot_types: np.ndarray
    types: int
    discount: float


def _level(got: DataFrame, hot: np.ndarray) -> tuple[Level, np.ndarray]:
    stats = got.where("block = -1")
    s = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "types"))).first()
    rows = stats.select(F.explode("hot").alias("h")).groupBy("h.context").agg(
        F.sum("h.n").alias("n"), F.sum("h.types").alias("types")).collect()
    rows = sorted((np.array(r["context"], np.int64).view(np.uint64).item(), r["n"], r["types"]) for r in rows)
    found, n, types = (np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
    frequent = [r[0] for r in stats.select(F.explode("frequent")).collect()]
    discount = s["n1"] / (s["n1"] + 2 * s["n2"]) if s["n1"] else 0.5
    return Level(found, n, types, s["types"], discount), np.sort(np.array(frequent, np.int64).view(np.uint64))


# ---------------------------------------------------------------- automaton
class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    State 0 is the empty context; the others are the contexts seen in training.
    Arcs are numbered as the block's n-grams are: ``weight[k][g]`` and
    ``next[k][g]`` belong to n-gram g of order k, where ``seen[k][g]``.
    """

    def __init__(self, block: Block, levels: list[Level], counts: list[tuple], n_train: int):
        order = len(levels)
        grams, total, _, _ = counts[0]
        grams.which[block.at == 0] = grams.which[block.first[0] + block.size[0] - 1]  # end tokens are one word
        self.which = [None, *(c[0].which for c in counts)]
        self.seen = [None, *(c[1] > 0 for c in counts)]
        prob = (total + 0.5) / (n_train + 0.5 * (levels[0].types + 1))
        self.weight, self.base, self.known = [None, np.log10(prob)], np.log10(prob), total
        state_of = [None, np.zeros(len(total), np.int64)]  # of the context that is this n-gram
        fail, back, depth = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int8)]
        states = 1
        for k in range(2, order + 1):
            grams, total, n, types = counts[k - 1]
            runs = np.flatnonzero(n > 0)
            before = grams.place[grams.run_start[runs]] - 1  # where a context ends
            context, pick = np.unique(self.which[k - 1][before], return_index=True)
            state_of[k - 1][context] = states + np.arange(len(context))
            left = levels[k - 1].discount * types / np.maximum(n, 1)
            back.append(np.log10(left[runs[pick]]))
            fail.append(state_of[k - 2][self.which[k - 2][before[pick]]] if k > 2 else np.zeros(len(context), np.int64))
            depth.append(np.full(len(context), k - 1, np.int8))
            states += len(context)
            of = np.repeat(np.arange(len(n)), np.diff(grams.run_start, append=len(total)))
            lower = prob[self.which[k - 1][grams.place]]
            prob = np.maximum(total - levels[k - 1].discount, 0) / np.maximum(n[of], 1) + left[of] * lower
            with np.errstate(divide="ignore"):  # n-grams not seen in training have no arc
                self.weight.append(np.log10(prob))
            state_of.append(np.zeros(len(total), np.int64))
        self.fail, self.back, self.depth = (np.concatenate(x) for x in (fail, back, depth))
        # an arc leads to the longest context that ends in its word
        self.next = [None, *state_of[1:]]
        if order > 1:
            self.next[order] = state_of[order - 1][self.which[order - 1][counts[-1][0].place]]
        self.start = state_of[1][self.which[1][block.first[0] - 1]] if order > 1 else 0

    def traverse(self, block: Block) -> np.ndarray:
        """log10 probability of each text: all texts read their next word
        together, the longest first, so those still running are a prefix."""
        rank = np.argsort(-block.size, kind="stable")
        first, size = block.first[rank], block.size[rank]
        state, score = np.full(len(rank), self.start), np.zeros(len(rank))
        running = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        for t, n in enumerate(running.tolist()):
            at, now, gained = first[:n] + t, state[:n], np.zeros(n)
            then = np.full(n, -1)
            for k in range(len(self.which) - 1, 1, -1):  # follow failure arcs until the word has an arc
                todo = np.flatnonzero((then < 0) & (self.depth[now] == k - 1))
                if not len(todo):
                    continue
                gram = self.which[k][at[todo]]
                hit = self.seen[k][gram]
                took, gram = todo[hit], gram[hit]
                gained[took] += self.weight[k][gram]
                then[took] = self.next[k][gram]
                failed = todo[~hit]
                gained[failed] += self.back[now[failed]]
                now[failed] = self.fail[now[failed]]
            rest = np.flatnonzero(then < 0)
            word = self.which[1][at[rest]]
            gained[rest] += self.weight[1][word]
            then[rest] = self.next[1][word]
            state[:n] = then
            score[:n] += gained
        out = np.empty(len(rank))
        out[rank] = score
        return out


def _counts(block: Block, levels: list[Level], rows: dict, buckets: int) -> list[tuple]:
    """Per order (n-grams, totals, totals of their contexts, types of their contexts)."""
    out = []
    for k, level in enumerate(levels, 1):
        grams = grams_of(block, k, level.hot, buckets)
        mine = sorted((b, i) for i, (b, o) in enumerate(zip(rows["bucket"], rows["k"])) if o == k)
        total, n, types = (np.frombuffer(b"".join(rows[c][i] for _, i in mine), np.int64).copy()
                           for c in ("totals", "context_totals", "context_types"))
        context = grams.context[grams.run_start]
        spread = np.flatnonzero(np.isin(context, level.hot))
        at = np.searchsorted(level.hot, context[spread])
        n[spread], types[spread] = level.hot_n[at], level.hot_types[at]
        out.append((grams, total, n, types))
    return out


def scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3,
           block_bytes: int = 8 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per
    row; the model learns from the rows where ``held`` (a Column over the
    documents) is not true.  ``base_score`` is the unigram part alone.

    ``block_bytes``: text that a task holds at a time.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    blocks = written(blocks_of(docs, id_col, text_col, held, block_bytes), "blocks")
    size = blocks.agg(F.sum("n_train").alias("n"), F.count("*").alias("blocks")).first()
    n_train, buckets = int(size["n"] or 0), max(1, size["blocks"])
    share = max(2, -(-4 * n_train // buckets))
    levels, got = [], []
    hot = np.zeros(1, np.uint64)  # the empty context holds all
    for k in range(1, order + 1):
        found = written(answers(requests(blocks, k, hot, buckets), hot, share), "answers", compression="zstd")
        level, frequent = _level(found, hot)
        levels.append(level)
        got.append(found.where("block >= 0").select("block", "bucket", "totals", "context_totals", "context_types",
                                                    F.lit(k).alias("k")))
        hot = frequent
        level.hot = np.unique(level.hot)
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["block", "held", "size", "words", "tokens", "n_tokens"]
        block = _read_block(left.select(names).to_pylist()[0])
        counts = _counts(block, levels, right.to_pydict(), buckets)
        automaton = Automaton(block, levels, counts, n_train)
        word, at = automaton.which[1][block.at > 0], np.cumsum(block.size) - block.size
        base = np.add.reduceat(automaton.base[word], at)
        known = np.add.reduceat((automaton.known[word] > 0).astype(np.int64), at)
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(block.held), pa.array(block.size), pa.array(known),
                         pa.array(np.full(len(at), n_train)), pa.array(base), pa.array(automaton.traverse(block))],
                        names=schema.names)

    every = got[0]
    for more in got[1:]:
        every = every.unionByName(more)
    left = blocks.select("block", "ids", "held", "size", "words", "tokens", "n_tokens")
    return left.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("id", id_col)
