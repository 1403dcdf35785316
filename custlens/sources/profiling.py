"""Column profile and the role rules derived from it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from custlens.functions.columns import clean_value

# fixed values: role thresholds
CAT_MAX_STRING_LEVELS = 25
CAT_MAX_NUMERIC_LEVELS = 10
TEXT_MIN_MEAN_LENGTH = 30


def profile(df: DataFrame, exact_distinct: bool = True, rsd: float = 0.01) -> DataFrame:
    """(column, dtype, missing, unique, mean_len, min_value, max_value, role) per column.

    One ``agg`` computes every column's missing count, range and mean text
    length (and the HyperLogLog++ distinct count with ``exact_distinct=False``);
    exact distinct counts are one ``groupBy`` per column.
    """
    aggs, apart = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, NumericType):
            c = clean_value(df, f.name)  # whole numbers keep all their digits
        # exact distinct counts come from a groupBy per column: each reads its
        # own column and combines on the map side, no row is multiplied
        if exact_distinct:
            apart.append(df.select(c.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.lit(1).alias("one")).agg(
                F.count("*").alias("n")).select(F.lit(f.name).alias("_name"), "n"))
        dist = F.lit(None) if exact_distinct else F.approx_count_distinct(c, rsd)
        mlen = F.avg(F.length(c)) if isinstance(f.dataType, StringType) else F.lit(None).cast("double")
        num = isinstance(f.dataType, NumericType)
        lo = F.min(c).cast("double") if num else F.lit(None).cast("double")
        hi = F.max(c).cast("double") if num else F.lit(None).cast("double")
        aggs.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.count(F.lit(1)) - F.count(c)).alias("missing"),
                dist.cast("bigint").alias("unique"),
                mlen.alias("mean_len"),
                lo.alias("min_value"),
                hi.alias("max_value"),
            )
        )
    wide = df.agg(F.array(*aggs).alias("_p"))
    prof = wide.select(F.explode("_p").alias("p")).select("p.*")
    if apart:
        order = prof.columns
        counts = functools.reduce(DataFrame.unionByName, apart)
        prof = prof.drop("unique").join(counts, F.col("column") == F.col("_name")).withColumnRenamed("n", "unique").select(
            *order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    is_num = F.col("column").isin([n for n, t in kinds.items() if isinstance(t, NumericType)])
    is_str = F.col("column").isin([n for n, t in kinds.items() if isinstance(t, StringType)])
    is_date = F.lower(F.col("column")).contains("date") | F.col("column").isin(
        [n for n, t in kinds.items() if isinstance(t, (DateType, TimestampType, TimestampNTZType))]
    )
    is_bool = F.col("column").isin([n for n, t in kinds.items() if isinstance(t, BooleanType)])
    _zero_one = (F.col("unique") == 2) & (F.col("min_value") == 0) & (F.col("max_value") == 1)
    role = (
        F.when(is_date, "date")
        .when(is_bool | (is_num & _zero_one), "binary")
        .when(is_num & (F.col("unique") <= CAT_MAX_NUMERIC_LEVELS), "numeric, few values")
        .when(is_num, "numeric")
        .when(is_str & (F.col("mean_len") > TEXT_MIN_MEAN_LENGTH), "text")
        .when(is_str & (F.col("unique") <= CAT_MAX_STRING_LEVELS), "categorical")
        .when(is_str, "categorical, many levels")
        .otherwise("other")
    )
    return prof.withColumn("role", role)


def roles(profile_df: DataFrame) -> DataFrame:
    """Role flags per column from a profile (independent tests, a column can be
    both text and categorical): (column, is_numeric, is_categorical, is_text,
    is_date, is_binary)."""
    num = F.col("dtype").isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col("dtype").startswith(
        "decimal"
    )
    s = F.col("dtype") == "string"
    return profile_df.select(
        "column",
        num.alias("is_numeric"),
        ((s & (F.col("unique") <= CAT_MAX_STRING_LEVELS)) | (num & (F.col("unique") <= CAT_MAX_NUMERIC_LEVELS))).alias(
            "is_categorical"
        ),
        (s & (F.col("mean_len") > TEXT_MIN_MEAN_LENGTH)).alias("is_text"),
        (F.lower(F.col("column")).contains("date") | F.col("dtype").isin("date", "timestamp", "timestamp_ntz")).alias("is_date"),
        (
            (num & (F.col("unique") == 2) & (F.col("min_value") == 0) & (F.col("max_value") == 1))
            | (F.col("dtype") == "boolean")
        ).alias("is_binary"),
    )
