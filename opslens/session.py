"""Session construction and the shared checkpoint location.

Library code never creates its own session; it works on the one it is handed.
``local_session`` exists for tests, the bench and the examples only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here is written against. AQE is what turns an oversized
# sort-merge join into a broadcast at run time, splits skewed join partitions
# and coalesces small shuffle partitions, so the operators declare joins and
# leave the strategy to it.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # scan splits and post-shuffle partitions sized for executor memory
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
}


def shuffle_partitions_for(input_bytes: int, cores: int,
                           target_bytes: int = 256 * 1024 * 1024) -> int:
    """Initial ``spark.sql.shuffle.partitions`` for a job reading
    ``input_bytes``: enough partitions that each holds about ``target_bytes``
    before AQE coalesces the small ones, and at least two waves of tasks."""
    return max(2 * cores, -(-input_bytes // target_bytes))


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "opslens", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, no servers opened)."""
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n)))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names (``spark.checkpoint.dir``),
    or the one set on the context, or None when neither is set. The configured
    root is preferred: the context's folder gets a fresh sub-folder per
    application, while stream checkpoints must survive a driver restart."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return d or spark.sparkContext.getCheckpointDir() or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the configured checkpoint folder; create a scratch one only when
    none is configured and the master is local (tests, the bench). On a
    cluster the setting must come from the cluster: a machine-local folder
    would not survive the loss of the executor or driver that wrote it."""
    d = checkpoint_dir(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) "
                               "before running streams or lineage cuts on a cluster")
        d = tempfile.mkdtemp(prefix="opslens-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def input_bytes(spark: SparkSession, path: str) -> int | None:
    """Total size of the files under ``path`` through the Hadoop FileSystem of
    the session (works for local, HDFS and object-store paths); None when the
    size cannot be read."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(p).getLength())
    except Exception:  # noqa: BLE001 - sizing is advisory
        return None


def landing_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table or files written on the way, under the shared
    checkpoint folder. It stays there, like checkpoints, for the operator of the
    cluster to clear."""
    return os.path.join(ensure_checkpoint_dir(spark), "landed", f"{name}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the session's Hadoop FileSystem."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_shuffles(spark: SparkSession, path: str) -> int | None:
    """Set ``spark.sql.shuffle.partitions`` for a job reading ``path`` (see
    ``shuffle_partitions_for``); AQE coalesces from there. Returns the value
    set, or None when the input size is unknown (setting left as is)."""
    size = input_bytes(spark, path)
    if size is None:
        return None
    n = shuffle_partitions_for(size, spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n

