"""Table readers and the named-dataset catalogue."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None, **options
) -> DataFrame:
    """Read a table lazily.  ``fmt`` defaults from the file suffix.

    CSV is read with a header, quoted fields that may span lines and doubled
    quotes as escapes; without an explicit schema the types are inferred
    (an extra pass - give a schema in production).
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        opts = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}
        if schema is None:
            opts["inferSchema"] = "true"
        opts.update(options)
        reader = reader.options(**opts)
    else:
        reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


@dataclass
class Catalog:
    """Named datasets -> paths, with a default name used as fallback."""

    paths: Mapping[str, str]
    default: str | None = None
    formats: Mapping[str, str] = field(default_factory=dict)

    def names(self) -> list[str]:
        return list(self.paths)

    def load(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        key = name if name in self.paths else self.default
        if key is None:
            raise KeyError(f"unknown dataset {name!r} and no default")
        return read_table(spark, self.paths[key], self.formats.get(key))

    def register(self, spark: SparkSession) -> None:
        """Expose every dataset as a temporary view of the same name."""
        for n in self.paths:
            self.load(spark, n).createOrReplaceTempView(n)


class Pipeline:
    """Wrangling steps applied to the untouched raw table; 'reset' is simply
    re-applying fewer steps, since DataFrames are immutable."""

    def __init__(self, steps: Sequence[Callable[[DataFrame], DataFrame]] = ()):
        self.steps = list(steps)

    def then(self, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline([*self.steps, step])

    def apply(self, raw: DataFrame) -> DataFrame:
        out = raw
        for step in self.steps:
            out = out.transform(step)
        return out


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (Spark tables have no row order)."""
    order = list(order_by or df.columns[:1])
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and number of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))
