"""Session helpers.

Library functions never create a session; they take DataFrames. ``get_session`` is for
tests and the bench, ``submitted_session`` for the command-line rebuild. ``ensure_conf`` applies the setting
the semantics depend on (UTC rendering of timestamps) and the one that keeps wide projections
compiled, without overriding what a cluster already configured.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every query relies on. Timestamps are parsed and rendered in UTC.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# The JVM never compiles a method of more than 8000 bytes of bytecode. Whole-stage code of a wide
# projection (the cleaning step's 28 columns) is above it and would run interpreted; with this
# limit Spark generates such a projection in small methods instead. Spark's default is 65535.
CODEGEN_CONF = {"spark.sql.codegen.hugeMethodLimit": "8000"}
_CODEGEN_DEFAULT = "65535"

# Scale settings: AQE re-plans joins and partition counts from runtime statistics, splits
# skewed join partitions and coalesces tiny shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    **CODEGEN_CONF,
}


def cluster_conf(input_bytes: int, advisory_mb: int = 256) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume (e.g. 100 TB of raw data).

    Scan splits and post-shuffle partitions target ``advisory_mb``; the initial shuffle
    partition count is input / advisory (at least 200) and AQE coalesces what turns
    out small, so no task holds more than a few hundred MB of a shuffle. Output files are
    capped by rows so a busy month is written as many files, not one huge file.
    """
    advisory = advisory_mb * 1024 * 1024
    partitions = max(200, -(-input_bytes // advisory))
    return {
        **SCALE_CONF,
        **SEMANTIC_CONF,
        "spark.sql.files.maxPartitionBytes": f"{advisory_mb}m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{advisory_mb}m",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{advisory_mb * 4}m",
        "spark.sql.files.maxRecordsPerFile": "5000000",
        "spark.sql.sources.partitionOverwriteMode": "static",
    }


def path_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in any store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength()


def submitted_session(input_path: str | None = None, app_name: str = "trendscope") -> SparkSession:
    """The session of a submitted job: master, memory and every setting come from
    ``spark-submit``; SQL settings that it leaves open are sized from the input."""
    spark = SparkSession.builder.appName(app_name).getOrCreate()
    given = {key for key, _ in spark.sparkContext.getConf().getAll()}
    for key, value in cluster_conf(path_bytes(spark, input_path) if input_path else 0).items():
        if key not in given:
            spark.conf.set(key, value)
    return ensure_conf(spark)


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Pin the session time zone to UTC (the reference stores TIMESTAMPTZ rendered as UTC), and set
    the code size limit where it was left at Spark's default."""
    for key, value in SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in CODEGEN_CONF.items():
        if spark.conf.get(key, _CODEGEN_DEFAULT) == _CODEGEN_DEFAULT:
            spark.conf.set(key, value)
    return spark


# Registered queries: an exchange begins with a partition for so many bytes of input, and AQE joins partitions
# up to this size. Short keys in order compress so well that a MB of a shuffle is 25 MB of a hash table and more.
INPUT_PER_PARTITION = 16 << 20
MERGED_PARTITION = "16m"


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Keep the memory of one task from growing with the input: raise the number of partitions that
    exchanges begin with, and set the size of merged ones where it was left at Spark's default."""
    key, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = -(-input_bytes // INPUT_PER_PARTITION)
    if wanted > int(spark.conf.get(key, spark.conf.get("spark.sql.shuffle.partitions"))):
        spark.conf.set(key, str(wanted))
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, MERGED_PARTITION)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must name shared storage; a local temporary
    folder is only made for single-machine runs (tests, bench) where nothing is set.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="trendscope-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def get_session(master: str | None = None, app_name: str = "trendscope",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a single-machine session for tests and the bench."""
    master = master or os.environ.get("TRENDSCOPE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("TRENDSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_conf(spark)
