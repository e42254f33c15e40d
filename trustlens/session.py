"""Spark session settings for the jobs, and the shared checkpoint folder.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a shared
folder; ``checkpoint_dir`` only reads it. Tests and the bench, which own their
session, set a scratch folder only when the setting is missing.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (broadcast only
# when the built side is measured small), coalesces small shuffle partitions and
# splits skewed ones.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed intermediates are deleted once no DataFrame references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Cluster settings for the 100 TB target (apply on top of the cluster's own config).
# The widest shuffle is the review side of the reply join: review key and business
# only (~20 bytes per review with row overhead; the review text is never read), about
# 4 TB for 2e11 reviews. At 256 MB per partition that is ~16k shuffle partitions
# (``shuffle_partitions_for``); AQE then coalesces the small per-business and
# per-industry stages and splits skewed join partitions.
CLUSTER_CONF = {
    **{k: v for k, v in JOB_CONF.items() if k != "spark.ui.enabled"},
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.files.maxPartitionBytes": str(512 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    # O8 joins the replies of all time with the reviews of 60 days: let Spark build its
    # runtime bloom filter from a review scan of any size. 64 MB of filter hold 4e7 ids;
    # with more recent reviews than that it passes ever more replies, and the bucketed
    # layout (``save_bucketed``), which shuffles neither side, is the way.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(1 << 50),
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "40000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "40000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 29),
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 29),
}


def shuffle_partitions_for(shuffle_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Shuffle partitions so each holds about ``target_bytes`` (a power of two)."""
    need = max(1, -(-shuffle_bytes // target_bytes))
    return 1 << (need - 1).bit_length()


def build_session(
    master: str = "local[*]", shuffle_partitions: int = 8, app: str = "trustlens", extra: dict | None = None
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(JOB_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the session's checkpoint folder.

    ``spark.checkpoint.dir`` (or a folder already set on the context) wins. Only a
    local-mode session without one (tests, the bench) gets a scratch folder; a cluster
    session without a shared folder is an error, never a machine-local default."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; the cluster must name a shared folder")
    path = fallback or tempfile.mkdtemp(prefix="trustlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables (never a machine-local default on a cluster)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise RuntimeError("spark.checkpoint.dir is not set; the cluster must name a shared folder")
    return path
