"""Packing documents into fixed-length training sequences.

A document becomes its token ids and one end mark.  Whole sequences' worth of
ids are cut off its front; what is left goes to a group, drawn from a hash of
the row or (``in_order``) from the row's place in the input, and each group is
packed by itself: first-fit decreasing, where the first bin with room is found
in a tournament tree of bin capacities.  The
emptiest bins are then cut into the gaps that first-fit left, and the last bin
of a group is cut into sequences whose lengths are powers of two, which need
no padding.

The number of groups follows from the bytes of text, so a group stays of one
size at any corpus size, and no key of the data decides where a row goes.

With ``in_order`` a group is a consecutive stretch of the rows as they lie in
the files (part by part, row by row), and sequence ids count up from stretch to
stretch, so sequences follow an order that was given to the rows before; inside
a stretch rows are in hash order.

Defined results: a null or empty text is the end mark alone; ties in length are
ordered by the row hash; repeated rows are packed once each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import row_key

TAIL = ".,!?;:|$%&*#"  # punctuation that ends a word as one token run of its own


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that never joins across white
    space: distinct words are encoded once per worker and looked up after."""

    def __init__(self, path: str, cached_words: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        # distinct words remembered before the rare ones are dropped, words that
        # one call encodes, and text that is tokenised at a time: what a worker holds
        self.cached_words, self.call_words, self.slice_bytes = cached_words, max(256, cached_words // 18), 7 * cached_words
        self.slot: dict[str, int] = {"": 0}
        self.start, self.size, self.uses = (np.zeros(1, np.int64) for _ in range(3))
        self.pool = np.empty(0, self.dtype)

    def _forget(self) -> None:
        """Keeps the words used again since they were learnt, at most half of
        ``cached_words``; the many words of one use go."""
        half = min(len(self.uses), max(1, self.cached_words // 2))
        keep = np.flatnonzero(self.uses > max(1, np.partition(self.uses, -half)[-half]))
        word_of = {n: w for w, n in self.slot.items()}  # a word learnt twice has a slot without a name
        keep = np.array([0, *(n for n in keep.tolist() if n and n in word_of)])  # slot 0 is the empty word
        ids, _ = self._gather(keep)
        self.slot = {word_of[i]: n for n, i in enumerate(keep.tolist())}
        self.size, self.uses, self.pool = self.size[keep], self.uses[keep] // 2, ids
        self.start = np.cumsum(self.size) - self.size

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        first = len(self.size)
        self.slot.update(zip(words, range(first, first + len(words))))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.pool = np.concatenate([self.pool, ids.astype(self.dtype)])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in these slots, and their running total."""
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.arange(total[-1]) + np.repeat(self.start[at] - total[:-1], size)], total

    def _learn(self, words: list[str]) -> None:
        """Encodes unseen words.  A run of letters is one token run; ASCII
        letters are lower-cased as the tokenizer does, and a tail of common
        punctuation is a token run of its own, so both are looked up apart."""
        split, plain, other = [], {}, []
        for w in words:
            core = w.rstrip(TAIL)
            if core.isalpha() and "\u0130" not in core:  # the one letter whose lower case holds a mark
                stem = core.lower() if core.isascii() else core
                if stem not in self.slot:
                    plain[stem] = None
                if stem != w:
                    tail = w[len(core):]
                    if tail not in self.slot:
                        plain[tail] = None
                    split.append((w, stem, tail))
            else:
                other.append(w)
        plain = list(plain)
        for part in (plain[i:i + self.call_words] for i in range(0, len(plain), self.call_words)):
            # one call for many words: the last token of each run is an end-of-word token
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.ends[got])
            if len(ends) == len(part):
                self._add(part, got, np.diff(ends, prepend=-1))
            else:
                other += part
        for part in (other[i:i + self.call_words] for i in range(0, len(other), self.call_words)):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.fromiter(itertools.chain.from_iterable(each), np.int64),
                      np.array([len(x) for x in each], np.int64))
        if split:
            at = np.array([(self.slot[s], self.slot[t]) for _, s, t in split], np.int64)
            ids, _ = self._gather(at.ravel())
            self.uses += np.bincount(at.ravel(), minlength=len(self.uses))
            self._add([w for w, _, _ in split], ids, self.size[at].sum(axis=1))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end``; offsets of the texts in them)."""
        if len(self.slot) > self.cached_words:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = self.slot.get
        unseen = [w for w in distinct if known(w) is None]
        if unseen:
            self._learn(unseen)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))
        at = slots[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        self.uses += np.bincount(at, minlength=len(self.uses))
        n_words = np.diff(split.offsets.to_numpy())
        ids, total = self._gather(at)
        bounds = total[np.concatenate([[0], np.cumsum(n_words)])]
        ids = np.insert(ids, bounds[1:], end)
        return ids, bounds + np.arange(len(bounds))


def _worker_tokenizer(path: str, cached_words: int) -> WordTokenizer:
    """One per Python worker: its words stay known from task to task.  This
    code travels by value, so the worker's process holds what is to stay."""
    held = sys.modules.setdefault("custlens_worker", types.ModuleType("custlens_worker")).__dict__
    key = f"{path}:{cached_words}"
    if key not in held:
        held[key] = WordTokenizer(path, cached_words)
    return held[key]


class Capacities:
    """Tournament tree over the room left in the bins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts ``size`` into the first bin with room for it."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        room[i] -= size
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; ``sizes`` is in decreasing order."""
    tree, bins = Capacities(max(1, len(sizes)), capacity), []
    for i, size in enumerate(sizes):
        b = tree.place(size)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Cuts the emptiest bin's pieces (document, start, length) into the gaps
    of at least ``least`` of the other bins, as long as they take it whole."""
    fill = lambda b: sum(p[2] for p in b)
    bins = sorted(bins, key=fill, reverse=True)
    room = [capacity - fill(b) for b in bins]
    while len(bins) > 1:
        last = capacity - room[-1]
        gaps = [i for i in range(len(bins) - 1) if room[i] >= least]
        if sum(room[i] for i in gaps) < last:
            break
        gaps.sort(key=lambda i: room[i])
        todo = bins.pop()
        room.pop()
        while todo:
            doc, start, length = todo.pop()
            i = gaps[-1]
            cut = min(length, room[i])
            bins[i].append((doc, start, cut))
            room[i] -= cut
            if not room[i]:
                gaps.pop()
            if cut < length:
                todo.append((doc, start + cut, length - cut))
    return bins


def power_of_two_sequences(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one bin, in order, as sequences of 2^k ids each, largest first."""
    left = sum(p[2] for p in pieces)
    out, todo = [], pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, length = todo.pop()
            cut = min(length, room)
            out[-1].append((doc, start, cut))
            room -= cut
            if cut < length:
                todo.append((doc, start + cut, length - cut))
    return out


def pack_group(lengths: list[int], capacity: int, least_gap: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths."""
    full = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    rest.sort(key=lambda p: -p[2])
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([p[2] for p in rest], capacity)]
    bins = fill_gaps(bins, capacity, least_gap)
    tail = power_of_two_sequences(bins.pop()) if bins else []
    return full + bins + tail


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         end: int = 1, group_bytes: int = 4 << 20, least_gap: int = 32, cached_words: int = 600_000,
         in_order: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id,
    offset); ``ids`` holds little-endian unsigned 32-bit numbers.

    ``cached_words``: words whose ids a worker remembers; fewer need less memory
    and more time.  ``group_bytes``: text bytes that a group holds on average.  Ids travel to
    their group once, two bytes each for vocabularies of up to 65,536 entries.
    ``in_order``: groups are consecutive stretches of the rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(docs).alias("key"), text.alias("text"),
                      *(_place(docs) if in_order else []))
    src = _stretches(src, group_bytes) if in_order else _drawn(src, group_bytes)
    id_type = src.schema["id"].dataType
    ided = T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()),
                         T.StructField("ids", T.BinaryType()), T.StructField("grp", T.LongType())])
    out = T.StructType([T.StructField("id", id_type), T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_tokenizer(tokenizer_path, cached_words)
        for b in batches:
            sizes = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False)
            slices = np.flatnonzero(np.diff(np.cumsum(sizes) // words.slice_bytes, prepend=-1))
            for at, to in zip(slices, [*slices[1:], b.num_rows]):
                part = b.slice(at, to - at)
                ids, offsets = words.encode(part.column(2), end)
                raw = np.ascontiguousarray(ids, words.dtype).tobytes()
                w = words.dtype.itemsize
                texts = [raw[w * i:w * j] for i, j in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary()),
                                                  part.column(3)], names=["id", "key", "ids", "grp"])

    width = 2 if _vocabulary(tokenizer_path) <= 1 << 16 else 4

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        table = table.sort_by([("key", "ascending"), ("id", "ascending")])
        ids = [np.frombuffer(x, f"<u{width}") for x in table.column("ids").to_pylist()]
        rows = [(d, s, n, q, o) for q, seq in enumerate(pack_group([len(x) for x in ids], capacity, least_gap))
                for (d, s, n), o in zip(seq, itertools.accumulate((p[2] for p in seq), initial=0))]
        doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*rows))
        pieces = [ids[d][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in rows]
        tokens = np.array([len(x) for x in ids], np.int64)
        return pa.table([table.column("id").take(pa.array(doc)), pa.array(start), pa.array(length),
                         pa.array(pieces, pa.binary()), pa.array(tokens[doc]), pa.array((group << 32) + seq),
                         pa.array(offset)], names=[f.name for f in out])

    packed_rows = src.mapInArrow(tokenise, ided).groupBy("grp").applyInArrow(packed, out)
    return packed_rows.withColumnRenamed("id", id_col)


def _row_bytes() -> Column:
    return F.octet_length("text") + F.lit(16)


def _drawn(src: DataFrame, group_bytes: int) -> DataFrame:
    """(id, key, text, grp): groups drawn from a hash of the row."""
    size = src.agg(F.sum(_row_bytes())).first()[0] or 0
    groups = max(1, -(-int(size) // group_bytes))
    return src.withColumn("grp", F.pmod(F.xxhash64("id", "key"), F.lit(groups)))


def _place(docs: DataFrame) -> list[Column]:
    """File and row in it, or partition and row in it where no file is read."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        docs.select(*at).schema  # noqa: B018  only files have the column
    except AnalysisException:
        at = [F.format_string("part-%05d", F.spark_partition_id()).alias("file"),
              F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")]
    return at


def _stretches(src: DataFrame, group_bytes: int) -> DataFrame:
    """(id, key, text, grp): groups are consecutive stretches of about
    ``group_bytes``.  A row's place in bytes is that of its file and, inside
    it, its share of the file's rows, so only one row per file is worked out."""
    files = src.groupBy("file").agg(F.sum(_row_bytes()).alias("bytes"), F.max("row").alias("last")).collect()
    part = lambda path: int((re.findall(r"part-(\d+)", path) or ["0"])[-1])
    files = sorted(files, key=lambda f: (part(f["file"]), f["file"]))
    before = itertools.accumulate((f["bytes"] for f in files), initial=0)
    total = sum(f["bytes"] for f in files)
    groups = max(1, -(-total // group_bytes))
    table = src.sparkSession.createDataFrame([(f["file"], b, f["bytes"] / (f["last"] + 1)) for f, b in zip(files, before)],
                                             "file string, before long, each double")
    at = F.col("before") + F.col("row") * F.col("each")
    grp = F.least(F.floor(at * groups / max(1, total)), F.lit(groups - 1).cast("long"))
    return src.join(F.broadcast(table), "file", "left").select(
        "id", "key", "text", F.coalesce(grp, F.lit(0).cast("long")).alias("grp"))


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def padding_share(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequences, tokens, padded, share): a sequence is padded to ``capacity``
    unless its length is a power of two."""
    seqs = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    two = F.bit_count("n") == 1
    pad = F.when(two, 0).otherwise(F.lit(capacity) - F.col("n"))
    return seqs.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padded")).withColumn(
        "share", F.col("padded") / (F.col("tokens") + F.col("padded")))
