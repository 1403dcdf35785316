"""Exact duplicate documents.

Rows are grouped by a 128-bit content hash; inside a group the bytes
themselves are part of the grouping key, so two texts that collide on the hash
stay apart.  The aggregate combines on the map side: a group of copies, however
large, sends one row per task into the shuffle.

Defined results: a null text counts as an empty one; null, empty and copied
texts form groups like any others; of rows with the same id and text the one
with the largest row hash stays, and rows equal in every column stay once; an
empty table gives an empty result; extra columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.llm.common import only_keys, row_key, sliced


def ascii_lower(text: bytes) -> bytes:
    """Lower-cases A-Z only (``bytes.lower`` leaves every other byte alone)."""
    return text.lower()


def md5_128(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def _hashed(docs: DataFrame, id_col: str, text_col: str, normal: Callable[[bytes], bytes],
            hash128: Callable[[bytes], bytes], with_text: bool) -> DataFrame:
    """(id, key, h, sha[, body]) per row: one Arrow pass over the text."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), row_key(docs).alias("key"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("key", T.LongType()),
                           T.StructField("h", T.BinaryType()), T.StructField("sha", T.StringType())]
                          + ([T.StructField("body", T.BinaryType())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            body = [normal(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([hash128(t) for t in body], pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in body], pa.string())]
            if with_text:
                cols.append(pa.array(body, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                   normal: Callable[[bytes], bytes] = ascii_lower,
                   hash128: Callable[[bytes], bytes] = md5_128) -> DataFrame:
    """One row per distinct normalised text: (h, sha, keep_id, keep_key, group_size)."""
    pick = {"min": F.min, "max": F.max}[keep]
    hashed = _hashed(docs, id_col, text_col, normal, hash128, with_text=True)
    groups = hashed.groupBy("h", "sha", "body").agg(pick(F.struct("id", "key")).alias("top"),
                                                    F.count("*").alias("group_size"))
    return groups.select("h", "sha", F.col("top.id").alias("keep_id"), F.col("top.key").alias("keep_key"),
                         "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                     normal: Callable[[bytes], bytes] = ascii_lower,
                     hash128: Callable[[bytes], bytes] = md5_128) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    The second pass carries ids and digests only; a hot group is one key of
    this join and is split by the skew join.
    """
    rows = _hashed(docs, id_col, text_col, normal, hash128, with_text=False)
    groups = content_groups(docs, id_col, text_col, keep, normal, hash128)
    out = rows.join(groups, ["h", "sha"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                          normal: Callable[[bytes], bytes] = ascii_lower,
                          hash128: Callable[[bytes], bytes] = md5_128) -> DataFrame:
    """The documents that stay, one per distinct normalised text, with all their columns."""
    groups = content_groups(docs, id_col, text_col, keep, normal, hash128)
    return only_keys(docs, id_col, groups.select(F.col("keep_id").alias("id"), F.col("keep_key").alias("key")))
