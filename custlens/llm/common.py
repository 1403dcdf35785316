"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custlens.session import checkpoint_dir, cut_lineage

__all__ = ["cut_lineage", "fresh", "only_keys", "read", "row_key", "shuffle_partitions", "sliced",
           "written"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The wished names, with underscores added until none clashes with a
    column of ``df`` (compared without case, as Spark resolves them)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_key(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row: tells apart rows that share an id."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.MapType):
        return True
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.VariantType)


def only_keys(docs: DataFrame, id_col: str, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (id, row_key) is in ``keys`` (columns ``id``,
    ``key``), with all their columns; rows equal in every column stay once.

    One shuffle of the documents on a key that no hot group shares; the
    semi-join leaves them partitioned and sorted for the final distinct.
    """
    i, k, wanted_id, wanted_key = fresh(docs, "_id", "_key", "_wanted_id", "_wanted_key")
    marked = docs.withColumns({i: F.col(f"`{id_col}`"), k: row_key(docs)})
    keys = keys.select(F.col("id").alias(wanted_id), F.col("key").alias(wanted_key))
    on = F.col(i).eqNullSafe(F.col(wanted_id)) & (F.col(k) == F.col(wanted_key))
    return marked.join(keys, on, "left_semi").dropDuplicates([i, k]).drop(i, k)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that a worker holds few texts as Python
    objects at a time, however many rows Spark puts into a batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def written(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """The rows, written as Parquet into the shared checkpoint folder and reread:
    cuts the lineage as ``cut_lineage`` does, and with it what the optimizer has
    derived about the columns, which grows from round to round in a loop."""
    place = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def shuffle_partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session (the launcher sizes them)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
