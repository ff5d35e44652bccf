"""SparkSession construction and the few settings the operators rely on.

On a cluster the session normally exists already; ``configure`` only fills in
settings that are still unset, so a platform's own choices win.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

# Settings every plan in this package assumes.  AQE re-plans joins from real
# shuffle sizes (a broadcast only happens once a side is measured under
# ``spark.sql.adaptive.autoBroadcastJoinThreshold``), coalesces small
# partitions and splits skewed ones.  UTC keeps ``to_date`` stable.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}

# Per-task shuffle volume to aim for at scale.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024
# Largest measured shuffle output AQE may turn into a broadcast.
ADAPTIVE_BROADCAST_BYTES = 10 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, total_cores: int) -> int:
    """Initial shuffle partition count for ``input_bytes`` of scanned data.

    Aims at ~256 MB per task and at least two waves over the cluster's cores;
    AQE coalesces the partitions the real data leaves small.
    """
    by_size = math.ceil(max(input_bytes, 1) / TARGET_PARTITION_BYTES)
    return max(by_size, 2 * max(total_cores, 1))


def cluster_conf(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Settings sized for a cluster run over ``input_bytes`` of input."""
    parts = shuffle_partitions_for(input_bytes, total_cores)
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES // 2),
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES // 2),
        # No broadcast from file-size estimates: a join side is broadcast only
        # once AQE has measured its shuffle output under the adaptive
        # threshold; otherwise the join stays sort-merge.  The adaptive value
        # must be explicit, as it defaults to the static one.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(ADAPTIVE_BROADCAST_BYTES),
        # Let the runtime bloom filter from a selective loan side (a monthly
        # report's six months of loans) prune the payments scan before any
        # shuffle even when that side is far above the 10 MB default; the
        # filter itself stays capped at 32 MB.  The cap only tunes: a filter
        # that is full or left out prunes less, and no result changes.
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(TARGET_PARTITION_BYTES),
        "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": str(30_000_000),
        "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(256 * 1024 * 1024),
    }


def configure(spark: SparkSession, conf: dict[str, str] | None = None) -> SparkSession:
    """Apply ``BASE_CONF`` (and ``conf``) to settings that are still unset."""
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        if spark.conf.get(key, None) is None or key in (conf or {}):
            spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    checkpoint_dir: str | None = None,
    app_name: str = "loanlag",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A local-mode session for tests and benchmarks (UI off, no ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Skip recording the Python call site of every DataFrame call (used
        # only to enrich error messages): it costs several py4j round trips
        # per call and about a third of plan-building time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if checkpoint_dir and not _active_checkpoint_dir():
        # Only where none is set: a session that already names a shared
        # checkpoint folder keeps it.
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _active_checkpoint_dir() -> str | None:
    active = SparkSession.getActiveSession()
    if active is None:
        return None
    return active.sparkContext.getConf().get("spark.checkpoint.dir", None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for reliable checkpoints.

    Raises when it is unset: lineage must be cut in shared storage that
    survives the loss of an executor, never in a machine-local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage "
            "before asking for a checkpointed plan"
        )
    return path
