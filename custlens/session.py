"""Session helpers: a tuned local session for tests/bench and checkpoint handling."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "custlens", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Return (or create) a session configured for this library.

    On a cluster the session is normally created by the launcher; this helper
    only fills in settings the library relies on (AQE, skew join, UTC).
    """
    parts = shuffle_partitions or (os.cpu_count() or 8 if cpus == "*" else int(cpus))
    builder = (
        (SparkSession.builder if SparkConf().contains("spark.master") else SparkSession.builder.master(f"local[{cpus}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only a local session without one gets a
    fresh private folder (of the context, since the option is fixed once a
    session runs); on a cluster its absence is an error, since other nodes
    cannot read the driver's disk.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="custlens-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
