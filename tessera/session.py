"""Spark session defaults and the shared checkpoint folder.

The library never creates executors or schedules work itself; it only asks
for adaptive execution (runtime re-planning, skew-join splitting, partition
coalescing) and reads the checkpoint folder the cluster names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # rounds of iterative jobs leave the shared folder once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, broadcast_limit_bytes: int = 64 << 20,
               shuffled_bytes: int | None = None) -> dict[str, str]:
    """Settings for a job reading about ``input_bytes`` (e.g. 100 TB on a large cluster).

    - input splits of ``target_partition_bytes`` (a task reads 256 MB, not a whole file);
    - initial shuffle partitions from the bytes that are shuffled (a tenth of the input unless
      given: most operators shuffle keys and hashes, not texts), at most 40,000, so that the
      map-output bookkeeping (tasks x partitions) stays within the driver; AQE coalesces small
      partitions and splits skewed ones;
    - broadcasts only under ``broadcast_limit_bytes`` as measured at runtime by AQE.
    """
    shuffled = input_bytes // 10 if shuffled_bytes is None else shuffled_bytes
    parts = min(40_000, max(200, int(shuffled // target_partition_bytes) + 1))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(16 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_limit_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_limit_bytes),
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera", input_bytes: int | None = None) -> SparkSession:
    """Build (or reuse) a session with adaptive execution switched on.

    ``master`` and ``shuffle_partitions`` are only applied when given; on a
    cluster both come from the submit configuration.  ``input_bytes`` applies
    ``scale_conf`` for the expected input size.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    for k, v in ADAPTIVE_CONF.items():
        b = b.config(k, v)
    if input_bytes:
        for k, v in scale_conf(input_bytes).items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting one only for local sessions.

    On a cluster the folder must be shared storage named by
    ``spark.checkpoint.dir``; a machine-local temporary folder would be lost
    with the executor, so it is refused there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        try:
            named = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            named = None
    if named:
        sc.setCheckpointDir(named)
        return sc.getCheckpointDir() or named
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("spark.checkpoint.dir is unset: name a shared folder for iterative jobs")


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """The shuffle files of a table written inside are deleted once it is written.

    Otherwise they stay on the executors' disks until the driver happens to collect its garbage, and jobs of many
    rounds fill the disk with files that nothing reads again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: no lineage, and its true size for the planner.

    For rounds of joins.  ``checkpoint()`` keeps the estimated size, which a join squares; after a dozen rounds
    the estimate has millions of digits and planning takes longer than the work.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``settled`` tables of earlier rounds that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
