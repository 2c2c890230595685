"""File sources and sinks.

* ``read_raw``: the raw CSV with a declared all-text schema (no inference pass; quoted
  newlines and doubled quotes handled). A file that may hold quoted newlines is not
  splittable and is one task, so large inputs must come as many files (or, known to hold none,
  be read with ``multi_line=False``); it is read once and converted to Parquet.
* ``materialize``: write a DataFrame as a Parquet table, optionally partitioned (the fact
  by month) and clustered (S6), replacing what was there.
* ``register_views`` / ``load_marts``: expose stored tables to SQL and read them back.
* ``monthly_source``: S8's choice of the clean monthly mart over the legacy one.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendscope.schema import RAW_SCHEMA


def raw_options(mode: str = "FAILFAST", multi_line: bool = True) -> dict[str, str]:
    """CSV options of the raw input, the same for batch and stream."""
    return {"header": "true", "multiLine": str(multi_line).lower(), "quote": '"', "escape": '"',
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": mode,
            "enforceSchema": "false"}


def read_raw(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", multi_line: bool = True) -> DataFrame:
    """Raw CSV with header; every column read as text (types come from ``clean``).

    ``mode='FAILFAST'`` stops on a structurally malformed line, as the reference's loader
    does (bad values are not malformed: they are text and the cleaning rules count and drop
    them); ``'PERMISSIVE'`` keeps such lines as NULL-padded rows instead.
    ``multi_line=False`` splits large files, for input known to hold no quoted newlines.
    """
    return spark.read.schema(RAW_SCHEMA).options(**raw_options(mode, multi_line)).csv(path)


# Columns that identify a version of an input file.
LISTED = ["source_file", "n_bytes", "modified"]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` with its size and time of modification. A Spark job that lists and
    doesn't read: the files' content isn't among the columns."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("length").alias("n_bytes"),
        F.col("modificationTime").alias("modified"))


def scan_state(spark: SparkSession, df: DataFrame) -> tuple[int, int, int]:
    """Count, total size and a digest of path, size and time of modification of all files that the
    scan ``df`` reads, as Spark's own file index has listed them. The digest is taken in the JVM:
    the calls don't follow the number of files. Times of access, which reading changes, are left out."""
    jvm = spark.sparkContext._jvm
    index = df._jdf.queryExecution().analyzed().relation().location()
    found = index.allFiles()
    text = jvm.java.lang.StringBuilder()
    text.append(found)
    parts = jvm.java.util.regex.Pattern.compile("access_time=[0-9]+").splitAsStream(text)
    return found.size(), index.sizeInBytes(), parts.toList().hashCode()


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None, range_by: list[str] | None = None,
                rebalance_by: list[str] | None = None) -> None:
    """S3 (+S6): write ``df`` as Parquet at ``path``, replacing the previous content.

    ``rebalance_by`` (for partitioned writes) hash-distributes rows by the partition
    columns with Spark's REBALANCE: each task writes one folder, and AQE splits an
    oversized partition (a busy month, even a single hot key) and merges small ones, with no
    sampling pass. ``range_by`` + ``sort_by`` cluster the rows (range partitioning, then a
    sort inside each task) so Parquet row groups carry narrow min/max statistics.
    """
    out = df
    if rebalance_by:
        out = out.hint("rebalance", *rebalance_by)
    if range_by:
        out = out.repartitionByRange(*range_by)
    if sort_by:
        out = out.sortWithinPartitions(*sort_by)
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def bucket_table(path: str) -> str:
    """Catalogue name of the bucketed table at ``path``: the catalogue holds the bucket count, which
    Parquet files don't."""
    run, name = path.rstrip("/").split("/")[-2:]
    return f"trendscope_{zlib.crc32(path.encode()):08x}_{run}_{name}".replace("-", "_")


def materialize_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """S3: write ``df`` as one file per bucket of ``key``, sorted by it, as an external table. A join or
    aggregation on the key reads it without a shuffle of this side, whatever its size; a join sorts
    each bucket, which is in order already."""
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(bucket_table(path)))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A bucketed table, registered in the session's catalogue where it isn't yet."""
    name = bucket_table(path)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(path).schema.toDDL()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read-only scan of a stored table."""
    return spark.read.parquet(path)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Create or replace a session view per table."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Case-insensitive catalogue test (views and tables)."""
    wanted = name.lower()
    return any(t.name.lower() == wanted for t in spark.catalog.listTables())


def monthly_source(spark: SparkSession, clean_name: str = "us_tag_monthly_clean",
                   legacy_name: str = "us_tag_monthly") -> DataFrame:
    """The clean monthly tag table when it is registered, else the legacy one, both
    projected to (month, tag, video_share, distinct_videos, total_videos)."""
    if table_exists(spark, clean_name):
        return spark.table(clean_name).select(
            "month", "tag", "video_share", "distinct_videos",
            F.col("total_videos_tagged").alias("total_videos"))
    return spark.table(legacy_name).select("month", "tag", "video_share", "distinct_videos", "total_videos")
