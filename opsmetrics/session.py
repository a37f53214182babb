"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the operators are written for. All are runtime SQL confs except the
# UI switch, so they can also be applied to a session someone else built.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # pre-merge session windows inside each map partition before the shuffle,
    # so a user holding a large share of the events does not reach one reducer
    # as raw rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "opsmetrics",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect.

    ``master`` is left to spark-submit when None. ``shuffle_partitions`` should
    be sized so one post-shuffle partition holds roughly 128-256 MB at the
    target scale; AQE coalesces small ones at runtime.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cluster_settings(
    total_cores: int,
    shuffle_bytes: int | None = None,
    target_partition_bytes: int = 256 * 1024 * 1024,
    max_partition_bytes: int = 512 * 1024 * 1024,
) -> dict[str, str]:
    """Settings for a large cluster run, to pass as ``extra_conf``.

    The initial shuffle partition count is the larger of 3 tasks per core and
    the expected shuffle volume over the target partition size. AQE then
    coalesces small partitions to about ``target_partition_bytes`` and splits
    skewed ones. Scans read up to ``max_partition_bytes`` per split, so a task
    holds a few hundred MB at most. For example, 1,000 executors x 8 cores with
    about 20 TB of shuffle (pruned columns, after partial aggregation) start at
    about 80,000 partitions.
    """
    by_volume = (shuffle_bytes or 0) // target_partition_bytes
    partitions = max(3 * total_cores, by_volume, 1)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(max_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    given; without it there is an error, as executors would not see a folder of
    the driver. Only a session on a local master gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="opsmetrics-ckpt-")
    sc.setCheckpointDir(local)
    return local
