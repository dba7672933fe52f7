"""Session settings the operators rely on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that change results, so they are set on any session we are given.
RESULT_CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
}

# Settings that only affect how a plan runs.  AQE measures shuffles at run time:
# it turns a join whose side proved small into a broadcast and splits partitions
# that a hot key made large.  The checksum pair makes Spark rerun a whole stage
# when a recomputed map task (lost executor) produced different rows.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enabled": "true",
    "spark.sql.shuffle.orderIndependentChecksum.enableFullRetryOnMismatch": "true",
}

INITIAL_PARTITIONS = 2_000
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Set the result-relevant options on a session made elsewhere."""
    for key, value in {**RESULT_CONF, **PLAN_CONF}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shuffle_partitions_for(input_bytes: int, cores: int) -> int:
    """Shuffle width that keeps one partition near 128 MiB, at least one per core."""
    return max(cores, -(-input_bytes // TARGET_PARTITION_BYTES))


def build_session(
    app: str = "weftline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the options above; `master` only for local work."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:  # start wide: AQE merges what proves small, but splits only the inputs of joins
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(INITIAL_PARTITIONS))
    for key, value in {**RESULT_CONF, **PLAN_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder every executor can reach, private to this application.

    The cluster names the root in `spark.checkpoint.dir`; a temporary folder
    stands in only on a local master, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "weftline-shared")
    return "/".join([root.rstrip("/"), "weftline", spark.sparkContext.applicationId, name])
