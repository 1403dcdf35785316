"""Substring duplicates by suffix automata of reference shards.

A window is ``window`` consecutive words of one document.  Each word covered by
a window that also occurs in a document with a smaller id is removed.

1. Every window has an anchor: the run of ``gram`` words in it with the smallest
   hash.  Neighbouring windows mostly share it, so a document falls into
   segments (stretches of windows with one anchor), and equal windows have equal
   anchors wherever they stand.  Anchors of one document only are dropped.
2. Equal segments are one segment (128-bit hash of their words), with the
   smallest id that holds it.  An anchor with a single segment is decided by
   that; the other anchors' segments are dealt to reference shards.
3. A shard builds a suffix automaton per anchor over its segments, each state
   with the smallest id of its occurrences, and streams the segments through it:
   matching statistics tell for each window the smallest id that holds it.
4. Windows of a larger id are joined to maximal spans, and a last pass over the
   texts removes the words they cover.

Shards are not broadcast: the reference is the corpus itself, which has no size
bound, and an anchor tells which shard a segment needs.  An anchor with more
than ``shard_segments`` different segments is not built as one automaton: its
windows are dealt out singly, by their own 128-bit hashes, which gives the same
answer without one task holding them all.

Defined results: a null or empty text has no words; texts shorter than the
window stay whole; rows that share an id never remove each other's words, rows
with a null id neither remove nor lose any; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import cut_lineage, row_key, sliced

SIEVE_BITS = 1 << 23  # of the broadcast sieve of ids: 131,072 words at most, whatever the corpus
STEP = 1 << 16  # windows whose anchors are worked out at a time


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def segments_of(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the segments of a text's word hashes."""
    n = len(h)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j:n - gram + 1 + j]
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    span, least = window - gram + 1, np.empty(n - window + 1, np.int64)
    for at in range(0, len(least), STEP):
        part = sliding_window_view(grams[at:at + STEP + span - 1], span)
        least[at:at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    first = np.flatnonzero(np.diff(least, prepend=-1))
    return grams[least[first]], first, np.diff(first, append=len(least))


def _digests(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128-bit hashes of stretches of word hashes, as pairs of longs."""
    raw = np.ascontiguousarray(h).tobytes()
    out = b"".join(xxhash.xxh3_128_digest(raw[8 * a:8 * (a + n)]) for a, n in zip(first.tolist(), length.tolist()))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def segments(src: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, key, a, s1, s2, at, n) per segment of (id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            row, cols = [], [[], [], [], []]
            for r, t in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                h = word_hashes((t or b"").split())
                a, first, n = segments_of(h, window, gram)
                row.append(np.full(len(a), r))
                for c, x in zip(cols, (a.view(np.int64), _digests(h, first, n + window - 1), first, n)):
                    c.append(x)
            at = pa.array(np.concatenate(row))
            a, s, first, n = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(a), pa.array(s[:, 0]), pa.array(s[:, 1]),
                 pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["id", "key", "a", "s1", "s2", "at", "n"])

    return src.where("id IS NOT NULL").mapInArrow(run, "id long, key long, a long, s1 long, s2 long, at int, n int")


def _sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_may`` = false where no id of ``wanted`` is equal to the
    row's: a bitmap of id hashes of a fixed size is broadcast, so that most
    texts without a partner need not be shuffled to find that out."""
    bit = F.pmod(F.xxhash64("id"), F.lit(SIEVE_BITS))
    word, mask = F.shiftright(bit, 6).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {SIEVE_BITS}) & 63 as int))")
    sieve = wanted.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    hit = rows.withColumn("_at", word).join(F.broadcast(sieve), F.col("_at") == F.col("_word"), "left")
    return hit.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))).drop(
        "_at", "_word", "_bits")


class SuffixAutomaton:
    """Of several word sequences, each with an id; ``low`` is the smallest id of a state's occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.low = [-1], [0], [None]

    def _new(self, size: int, link: int, edges: dict[int, int], low) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.low.append(low)
        return len(self.size) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of state q for the strings that end as p's plus ``word``."""
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]), None)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], id_: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:  # known from another sequence
                state = q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
            else:
                state, p = self._new(self.size[last] + 1, 0, {}, None), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = state
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
            last = state
            if self.low[last] is None or id_ < self.low[last]:
                self.low[last] = id_

    def close(self) -> None:
        """Hands the smallest ids down the suffix links, longest states first."""
        low = self.low
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if low[v] is not None and (low[p] is None or low[v] < low[p]):
                low[p] = low[v]

    def lows(self, words: list[int], window: int) -> list[int | None]:
        """For each window of ``words`` the smallest id that holds it, by
        matching statistics cut at the window length (None: no match)."""
        state, length, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            while state and self.size[self.link[state]] >= window:
                state = self.link[state]
            length = min(length, self.size[state])
            if i >= window - 1:
                out.append(self.low[state] if length >= window else None)
        return out


def _fetched(src: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """(a, s1, s2, first, words) with the word hashes of the distinct segments,
    read from the document each was first seen in."""
    want = cut_lineage(distinct.groupBy(F.col("top.id").alias("id"), F.col("top.key").alias("key")).agg(
        F.collect_list(F.struct("a", "s1", "s2", F.col("top.at").alias("at"), "n")).alias("want")))
    rows = _sieved(src, want).where("_may").drop("_may").join(want, ["id", "key"]).dropDuplicates(["id", "key"]).select("id", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h = word_hashes(b.column(1).slice(i, 1).cast(pa.binary())[0].as_py().split())
                raw = np.ascontiguousarray(h).tobytes()
                want = b.column(2).slice(i, 1).flatten()
                at, n = want.field("at").to_pylist(), want.field("n").to_pylist()
                words = [raw[8 * x:8 * (x + m + window - 1)] for x, m in zip(at, n)]
                first = np.full(len(at), b.column(0)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([want.field("a"), want.field("s1"), want.field("s2"), pa.array(first),
                                                  pa.array(words, pa.binary())], names=["a", "s1", "s2", "first", "words"])

    return rows.mapInArrow(run, "a long, s1 long, s2 long, first long, words binary")


def _by_automata(fetched: DataFrame, shards: int, window: int) -> DataFrame:
    """(a, s1, s2, firsts): per window of a segment the smallest id that holds it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("s1", "ascending"), ("s2", "ascending")])
        anchor = table.column("a").to_numpy()
        words = [np.frombuffer(w, np.uint64).tolist() for w in table.column("words").to_pylist()]
        ids, firsts = table.column("first").to_pylist(), []
        bounds = [*np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]).tolist(), len(anchor)]
        for lo, hi in zip(bounds, bounds[1:]):
            automaton = SuffixAutomaton()
            for i in range(lo, hi):
                automaton.add(words[i], ids[i])
            automaton.close()
            firsts.extend(automaton.lows(words[i], window) for i in range(lo, hi))
        return pa.table([table.column("a"), table.column("s1"), table.column("s2"),
                         pa.array(firsts, pa.list_(pa.int64()))], names=["a", "s1", "s2", "firsts"])

    dealt = fetched.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(lambda t: run(t.drop_columns(["shard"])),
                                               "a long, s1 long, s2 long, firsts array<long>")


def _by_windows(fetched: DataFrame, window: int) -> DataFrame:
    """The same for segments of hot anchors: each window is dealt out by its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in enumerate(b.column(4).to_pylist()):
                h = np.frombuffer(w, np.uint64)
                n = len(h) - window + 1
                d = _digests(h, np.arange(n), np.full(n, window))
                same = [b.column(c).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(d[:, 0]),
                                                  pa.array(d[:, 1])], names=["a", "s1", "s2", "first", "j", "w1", "w2"])

    singles = cut_lineage(fetched.mapInArrow(run, "a long, s1 long, s2 long, first long, j int, w1 long, w2 long"))
    low = singles.groupBy("w1", "w2").agg(F.min("first").alias("low"))
    return singles.join(low, ["w1", "w2"]).groupBy("a", "s1", "s2").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("j", "low"))), lambda x: x["low"]).alias("firsts"))


def _spans(found: DataFrame, window: int) -> DataFrame:
    """(id, key, spans): word ranges [lo, hi) covered by windows of a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, lo, hi = [], [], []
            ids, at, n = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for r, (first, firsts) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                if firsts is None:
                    if first < ids[r]:
                        row.append(r)
                        lo.append(at[r])
                        hi.append(at[r] + n[r] + window - 1)
                    continue
                hit = np.r_[False, np.array(firsts, np.int64) < ids[r], False]
                edges = np.flatnonzero(hit[1:] != hit[:-1])
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    row.append(r)
                    lo.append(at[r] + s)
                    hi.append(at[r] + e + window - 1)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(lo, pa.int32()),
                                              pa.array(hi, pa.int32())], names=["id", "key", "lo", "hi"])

    ranges = found.select("id", "key", "at", "n", "first", "firsts").mapInArrow(run, "id long, key long, lo int, hi int")
    return ranges.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                          gram: int = 12, shard_words: int = 1 << 18, shard_segments: int = 4096) -> DataFrame:
    """One row per document: (id, n_words, n_removed, kept), kept words joined by one space.

    ``shard_words``: words that a reference shard holds on average."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(docs).alias("key"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    seg = segments(src, window, gram)
    shared = seg.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a")
    rows = cut_lineage(seg.join(shared, "a", "left_semi"))
    distinct = rows.groupBy("a", "s1", "s2").agg(F.min(F.struct("id", "key", "at")).alias("top"), F.max("n").alias("n"))
    distinct = cut_lineage(distinct)
    sizes = distinct.groupBy("a").agg(F.count("*").alias("segments"))
    several = distinct.join(sizes.where("segments > 1"), "a")
    single = distinct.join(sizes.where("segments = 1"), "a", "left_semi").select(
        "a", "s1", "s2", F.col("top.id").alias("first"), F.lit(None).cast("array<long>").alias("firsts"))
    total = several.agg(F.sum(F.col("n") + window).alias("words"),
                        F.max("segments").alias("most")).first()  # two numbers
    shards = max(1, -(-(total["words"] or 0) // shard_words))
    few = _fetched(src, several.where(F.col("segments") <= shard_segments), window)
    firsts = _by_automata(few, shards, window)
    if (total["most"] or 0) > shard_segments:
        hot = _fetched(src, several.where(F.col("segments") > shard_segments), window)
        firsts = firsts.unionByName(_by_windows(hot, window))
    decided = single.unionByName(firsts.withColumn("first", F.lit(None).cast("long")))
    spans = cut_lineage(_spans(rows.join(decided, ["a", "s1", "s2"]), window))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n_words, n_removed, out = [], [], []
            for t, ranges in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = (t or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in ranges or ():
                    edge[r["lo"]] += 1
                    edge[r["hi"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                out.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()] if n_removed[-1] else words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(out, pa.binary()).cast(pa.string())],
                                             names=["id", "n_words", "n_removed", "kept"])

    marked = _sieved(src, spans)
    renamed = spans.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "spans")
    on = (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key"))
    touched = marked.where("_may").join(renamed, on, "left").select("id", "text", "spans")
    whole = marked.where("NOT _may").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    out = touched.unionByName(whole).mapInArrow(kept, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
