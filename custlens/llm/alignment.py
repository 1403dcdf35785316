"""Alignment of two tokenizers' tokens over the same text.

A text, with a space before it, is encoded by a byte-level BPE (A) and by a
sentence-piece BPE (B).  Byte offsets where a token of both ends are shared cuts;
they are found by divide and conquer: an interval's A ends are probed outwards
from its middle, each by a bisect into the B ends, until one is shared; the
interval is split there and both sides are treated alike; an interval without a
shared cut is a leaf group.  All intervals of a slice of texts take each step
together, and no end is probed twice.

Links are the pairs of an A and a B token whose byte ranges overlap.  A pair of
ids counts the documents that hold it linked; every document then gets the sums
of these counts over its links and the links that are its A id's best.

Texts are cut into units that neither tokenizer's tokens cross (at single spaces
between non-blank characters); a worker remembers the ids of units it has seen.

Scale: a document's distinct pairs are written once (shared folder), counted by a
partially aggregated group-by, and the pair table, bounded by the two
vocabularies, is broadcast only if it is counted to be small; else it is joined
by a shuffle whose hot pairs are salted.

Defined results: null and empty texts, and texts whose tokens' bytes do not give
back the text (such as those with a literal U+2581), have no tokens: zeros and an
empty digest; they add nothing to the counts.  Every row has its own result, also
rows that share an id or are equal; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import written

BOUNDARY = re.compile(r"(?<=\S) (?=\S)")  # no token of either tokenizer crosses it
SALTS = 64  # shares of a hot pair's rows where the pair table is joined by a shuffle


def _byte_level() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(other)}


def _ranked(spec: dict, bytes_of: list[bytes]):
    """A function text -> ids by tiktoken (three times as fast) for a byte-level
    tokenizer whose merges are in the order of their ids and whose texts are
    split by the usual pattern; any other is refused."""
    import public_tokenizers
    import tiktoken

    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merged = [model["vocab"].get("".join(m if not isinstance(m, str) else m.split(" "))) for m in model.get("merges", [])]
    if (spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex")
            or model.get("ignore_merges") or merged != [*range(256, 256 + len(merged))]):
        raise ValueError("tokenizer A must be a byte-level BPE that splits texts by the usual pattern")
    ranks = {bytes_of[i]: i for i in model["vocab"].values() if i < 256 + len(merged)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class TokenizerPair:
    """Ids of both tokenizers for whole texts; units are encoded once and looked up after."""

    def __init__(self, path_a: str, path_b: str, cached_units: int):
        import sentencepiece

        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = _byte_level()
        vocab = spec["model"]["vocab"]
        added = [t["id"] for t in spec.get("added_tokens", [])]  # their strings in a text are plain text
        self.bytes_a = [b""] * (max([*vocab.values(), *added]) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(chars[c] for c in piece if c in chars)
        self.encode_a = _ranked(spec, self.bytes_a)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in piece):
            raise ValueError("tokenizer B must have no piece that goes on after a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(piece)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cached_units = cached_units
        # texts of groups: an id with the mark that follows it; A ids first
        self.marks = [f"{i}{m}".encode() for i in range(len(self.bytes_a)) for m in ",|"]
        self.marks += [f"{i}{m}".encode() for i in range(len(self.bytes_b)) for m in ",;"]
        self._forget(np.empty(0, np.int64))

    def _forget(self, keep: np.ndarray) -> None:
        names = list(self.slot) if len(keep) else []
        self.slot = {names[i]: n for n, i in enumerate(keep.tolist())}
        for side in "ab":
            pool, start, size = (getattr(self, f"{x}_{side}", np.empty(0, np.int32)) for x in ("pool", "start", "n"))
            setattr(self, f"pool_{side}", _gather(pool, start, size, keep)[0] if len(keep) else np.empty(0, np.int32))
            size = size[keep].astype(np.int64)
            setattr(self, f"n_{side}", size)
            setattr(self, f"start_{side}", np.cumsum(size) - size)
        self.good = self.good[keep] if len(keep) else np.empty(0, bool)
        self.uses = np.zeros(len(keep), np.int64)

    def _learn(self, units: list[str]) -> None:
        """Encodes unseen units: clean ones many in a call, as words of one text."""
        clean, other = [], []
        for u in units:
            (other if not u or u[0].isspace() or u[-1].isspace() or "▁" in u else clean).append(u)
        for part in (clean[i:i + 4096] for i in range(0, len(clean), 4096)):
            text = " ".join(part)
            raw = (" " + text).encode()
            found = [np.array(self.encode_a(" " + text), np.int32),
                     np.array(self.b.encode(text), np.int32)]
            if all(b"".join(map(table.__getitem__, ids.tolist())) == raw
                   for table, ids in zip((self.bytes_a, self.bytes_b), found)):
                ends = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in part), np.int64,
                                             len(part)) + 1)
                self._add(part, *((ids, np.diff(np.searchsorted(np.cumsum(size[ids]), ends, "right"), prepend=0))
                                  for size, ids in zip((self.size_a, self.size_b), found)), np.ones(len(part), bool))
            else:
                other += part
        for part in (other[i:i + 4096] for i in range(0, len(other), 4096)):
            self._learn_singly(part)

    def _learn_singly(self, units: list[str]) -> None:
        ids = [[self.encode_a(" " + u) for u in units],
               self.b.encode(units, num_threads=1)]
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == (raw := (" " + u).encode())
                and b"".join(map(self.bytes_b.__getitem__, y)) == raw for u, x, y in zip(units, *ids)]
        sizes = [np.array([len(x) for x in side], np.int64) for side in ids]
        self._add(units, *((np.fromiter(itertools.chain.from_iterable(side), np.int32, int(n.sum())), n)
                           for side, n in zip(ids, sizes)), np.array(good, bool))

    def _add(self, units: list[str], a: tuple, b: tuple, good: np.ndarray) -> None:
        self.slot.update(zip(units, range(len(self.slot), len(self.slot) + len(units))))
        for side, (ids, n) in (("a", a), ("b", b)):
            pool = getattr(self, f"pool_{side}")
            setattr(self, f"start_{side}", np.concatenate([getattr(self, f"start_{side}"), len(pool) + np.cumsum(n) - n]))
            setattr(self, f"n_{side}", np.concatenate([getattr(self, f"n_{side}"), n]))
            setattr(self, f"pool_{side}", np.concatenate([pool, ids]))
        self.good = np.concatenate([self.good, good])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(units, offsets of the texts in them)."""
        split = pc.split_pattern(texts, " ")
        words = split.flatten()
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        blank = pc.match_substring_regex(words, r"^$|^[\s\x0B\x1C-\x1F]|[\s\x0B\x1C-\x1F]$|^[^\x00-\x7F]|[^\x00-\x7F]$")
        rough = np.flatnonzero(blank.to_numpy(zero_copy_only=False))
        if not len(rough):
            return words, offsets
        # a blank, or a letter that may be one, beside a space: these texts are cut by the rule itself
        docs = np.unique(np.searchsorted(offsets, rough, "right") - 1)
        parts, at, sizes = [], 0, np.diff(offsets)
        for d in docs.tolist():
            units = BOUNDARY.split(texts[d].as_py())
            parts += [words.slice(at, offsets[d] - at), pa.array(units, words.type)]
            at, sizes[d] = offsets[d + 1], len(units)
        parts.append(words.slice(at))
        return pa.concat_arrays(parts), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, their offsets by text, B ids, their offsets); texts that do
        not come back from the tokens' bytes have none."""
        units, offsets = self._units(texts)
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.slot) + len(names) > self.cached_units and len(self.slot):
            self._forget(np.flatnonzero(self.uses > 1)[-self.cached_units // 2:])
        unseen = [u for u in names if u not in self.slot]
        if unseen:
            self._learn(unseen)
        slots = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))
        at = slots[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        self.uses += np.bincount(at, minlength=len(self.uses))
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        good = np.ones(len(offsets) - 1, bool)
        doubtful = np.unique(text_of[~self.good[at]]).tolist()
        for d in doubtful:  # bytes of the whole text decide
            raw = (" " + texts[d].as_py()).encode()
            part = at[offsets[d]:offsets[d + 1]]
            good[d] = all(b"".join(map(table.__getitem__, _gather(pool, start, n, part)[0].tolist())) == raw
                          for table, pool, start, n in ((self.bytes_a, self.pool_a, self.start_a, self.n_a),
                                                        (self.bytes_b, self.pool_b, self.start_b, self.n_b)))
        good &= pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        kept = good[text_of]
        units_of = np.concatenate([[0], np.cumsum(np.bincount(text_of[kept], minlength=len(good)))])
        at = at[kept]
        ids_a, total_a = _gather(self.pool_a, self.start_a, self.n_a, at)
        ids_b, total_b = _gather(self.pool_b, self.start_b, self.n_b, at)
        return ids_a, total_a[units_of], ids_b, total_b[units_of]


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's stretches number ``at``, joined, and their running total."""
    n = size[at].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    return pool[np.arange(total[-1]) + np.repeat(start[at] - total[:-1], n)], total


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A tokens end where a B token ends, and the same for the B tokens;
    ``last``, ``last_b``: the tokens that end a text.

    ``lo``..``hi`` are the ends of an interval that may be cuts, ``left``..``right``
    those already probed around its middle.
    """
    cut, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    cut[last] = cut_b[last_b] = True
    lo, hi = np.concatenate([[0], last[:-1] + 1]) if len(last) else last, last
    lo, hi = lo[lo < hi], hi[lo < hi]
    middle = (lo + hi) // 2
    left, right = middle, middle
    while len(lo):
        down = (left > lo) & ((right >= hi) | (middle - left < right - middle))
        at = np.where(down, left - 1, right)
        value = ends_a[at]
        place = np.searchsorted(ends_b, value)  # the last B end is never below
        found = ends_b[place] == value
        cut_b[place[found]] = True
        left, right = np.where(down, at, left), np.where(down, right, at + 1)
        cut[at[found]] = True
        on = ~found & ((left > lo) | (right < hi))
        new_lo, new_hi = np.concatenate([lo[found], right[found]]), np.concatenate([left[found], hi[found]])
        new_lo, new_hi = new_lo[new_lo < new_hi], new_hi[new_lo < new_hi]
        new_middle = (new_lo + new_hi) // 2
        lo, hi, middle = (np.concatenate([x[on], y]) for x, y in ((lo, new_lo), (hi, new_hi), (middle, new_middle)))
        left, right = np.concatenate([left[on], new_middle]), np.concatenate([right[on], new_middle])
    return cut, cut_b


def align(pair: TokenizerPair, texts: pa.Array) -> dict[str, list | np.ndarray]:
    """Columns of the per-document result for a slice of texts."""
    ids_a, off_a, ids_b, off_b = pair.encode(texts)
    n_a, n_b = np.diff(off_a), np.diff(off_b)
    ends_a, ends_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    full = np.flatnonzero(n_a)
    cut, cut_b = shared_cuts(ends_a, ends_b, off_a[1:][full] - 1, off_b[1:][full] - 1)
    groups = np.concatenate([[0], np.cumsum(cut)])
    n_groups = np.diff(groups[off_a])
    # the tokens in the order of the groups' texts: a group's A ids, then its B ids
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    until_a, until_b = np.flatnonzero(cut) + 1, np.concatenate([[0], np.flatnonzero(cut_b) + 1])
    order[np.arange(len(ids_a)) + until_b[groups[:-1]]] = 2 * ids_a.astype(np.int64) + cut
    order[np.arange(len(ids_b)) + until_a[np.cumsum(cut_b) - cut_b]] = (
        2 * (len(pair.bytes_a) + ids_b.astype(np.int64)) + cut_b)
    marks, digests = pair.marks, []
    for at, to in zip((off_a + off_b)[:-1].tolist(), (off_a + off_b)[1:].tolist()):
        text = b"".join([marks[i] for i in order[at:to].tolist()])
        digests.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
    # between two neighbouring ends of either side lies one link
    ends = np.concatenate([ends_a, ends_b])
    rank = np.argsort(ends, kind="stable")  # two sorted runs
    of_a = rank < len(ends_a)
    first = np.diff(ends[rank], prepend=0) > 0
    before_a = np.cumsum(of_a) - of_a
    at_a, at_b = before_a[first], (np.arange(len(rank)) - before_a)[first]
    n_links = n_a + n_b - n_groups
    span = len(pair.bytes_a) * len(pair.bytes_b)
    link = ids_a[at_a].astype(np.int64) * len(pair.bytes_b) + ids_b[at_b] + np.repeat(np.arange(len(n_a)) * span, n_links)
    distinct, times = np.unique(link, return_counts=True)
    of = np.searchsorted(distinct, np.arange(len(n_a) + 1) * span)
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests,
            "pairs": distinct % span, "times": times, "of": of}


def _worker_pair(path_a: str, path_b: str, cached_units: int) -> TokenizerPair:
    """One per Python worker: this code travels by value, so the process holds what is to stay."""
    held = sys.modules.setdefault("custlens_worker", types.ModuleType("custlens_worker")).__dict__
    key = f"{path_a}:{path_b}:{cached_units}"
    if key not in held:
        held[key] = TokenizerPair(path_a, path_b, cached_units)
    return held[key]


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    starts = np.flatnonzero(np.diff(sizes // most, prepend=-1))
    for at, to in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(at, to - at)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
            cached_units: int = 200_000, slice_bytes: int = 1 << 20) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) per row:
    its distinct linked pairs (A id x size of B + B id) and how often each is linked."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *(T.StructField(n, long) for n in (
        "n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(long)), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _worker_pair(path_a, path_b, cached_units)
        for b in batches:
            for part in _slices(b, 1, slice_bytes) if b.num_rows else ():
                got = align(pair, part.column(1))
                of = pa.array(got["of"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(np.asarray(got[n], np.int64)) for n in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(got["groups_sha256"], pa.string()), pa.ListArray.from_arrays(of, pa.array(got["pairs"])),
                     pa.ListArray.from_arrays(of, pa.array(got["times"].astype(np.int32)))], names=schema.names)

    return src.mapInArrow(run, schema)


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether no pair of its A id has more."""
    n = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a = F.expr(f"pair div {b_size}")
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return n.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def cross_tokenizer_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                          cached_units: int = 200_000, broadcast_pairs: int = 2_000_000) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    ``broadcast_pairs``: the pair table is broadcast if it has at most so many rows (about 50 bytes each).
    """
    import sentencepiece

    b_size = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    # sorted numbers and small counts: a columnar file holds them in a third of the bytes
    found = aligned(docs, path_a, path_b, id_col, text_col, cached_units).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "aligned", compression="zstd")
    pairs = written(pair_counts(found, b_size), "pairs")
    kept = [F.first(c).alias(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    links = found.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                         F.explode_outer(F.arrays_zip("pairs", "times")).alias("link")).select("*", "link.pairs", "link.times")
    if pairs.count() <= broadcast_pairs:
        hit = links.join(F.broadcast(pairs), links["pairs"] == pairs["pair"], "left")
    else:
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        links = links.withColumn("share", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
        hit = links.join(salted, (links["pairs"] == salted["pair"]) & (links["share"] == salted["salt"]), "left")
    sums = hit.groupBy("row").agg(*kept, F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("count_sum"))
    return sums.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.col("n_best").cast("long"),
                       F.col("count_sum").cast("long"), "groups_sha256")
