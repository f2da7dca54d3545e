"""Access to the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Lazy DataFrames per path, kept on the session object itself.  A DataFrame is an
# immutable plan, so reusing it costs nothing and saves the driver-side listing and
# footer read that every spark.read.parquet call repeats.
_ATTR = "_tessera_reads"


def table(spark: SparkSession, sf_dir: str, name: str, fresh: bool = False) -> DataFrame:
    """Read one parquet table; column pruning and filters reach the scan.

    ``fresh`` re-lists the files (for folders that change during a session).
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reads = getattr(spark, _ATTR, None)
    if reads is None:
        reads = {}
        setattr(spark, _ATTR, reads)
    if fresh or path not in reads:
        reads[path] = spark.read.parquet(path)
    return reads[path]
