"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import gridhazard

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: let AQE split a skewed shuffle partition even when the split
    # costs an extra exchange further up the plan.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # An operator whose join should stay dealt by one of its keys turns this off for its query.
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    # Keyed state with timers needs several column families.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Bytes a task reads, from files and from a shuffle. Rows grow inside tasks (explode, hash tables of partial sums, sorts
#: on both sides of a join), so with the defaults of 128 and 64 MB a task's memory grows with the input for long.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 32 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}

#: Bytes of a table that a join sends to all executors. They are counted as written, where ids and repeated values take few
#: bytes; in the driver, which builds the hash table, rows take ten times as much and more, once for each join of a plan.
BROADCAST_BYTES = {"spark.sql.autoBroadcastJoinThreshold": 2 << 20}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    # Functions that run inside tasks travel with the job, so executors need no install.
    cloudpickle.register_pickle_by_value(gridhazard)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (TASK_BYTES | BROADCAST_BYTES).items():  # smaller values of a cluster stay, also -1 for none
        given = spark.conf.get(key)
        spark.conf.set(key, given if given.startswith("-") else str(min(most, size(given))))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridhazard-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write to the shared folder and read back: survives the loss of any executor.

    ``replaces``: an earlier result of this function that nothing reads any more once
    this one is written, as in a loop; its files are deleted.

    A written table also carries its true size. A checkpoint inside a loop keeps
    the size estimate of the plan before it, which every further join multiplies
    until planning itself fails.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if replaces is not None:
        drop_scratch(replaces)
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a result of :func:`cut_lineage`."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table a job writes and reads back."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridhazard-{name}-{uuid.uuid4().hex}"
