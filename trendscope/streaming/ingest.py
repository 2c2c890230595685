"""Load-and-clean (S1 + C6) as a Structured Streaming job over a folder of raw CSV files.

The reference has no streaming semantics: its refresh is a full batch rebuild (S10). This
module runs exactly the same operators incrementally, for a deployment where new daily CSV
files land in a folder: each new file is read with the batch reader's schema and options
(a malformed line or a header in another order fails the run, as it fails the batch),
cleaned, and appended to the fact table partitioned by month. The file sink plus the checkpoint give
exactly-once output across restarts and lost executors; the checkpoint belongs to one input
and one fact, so the caller names it. Marts are rebuilt in batch from
the fact (``plans.rebuild``); no aggregation state is kept here.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendscope.functions import exprs as X
from trendscope.operators.ingest import clean
from trendscope.schema import FACT_PARTITION, RAW_SCHEMA
from trendscope.sources.files import raw_options

FILES_PER_MONTH = 8  # tasks, and files, that a batch's rows of one month are dealt to


def clean_stream(spark: SparkSession, csv_dir: str, max_files_per_trigger: int | None = None):
    """Streaming DataFrame of cleaned fact rows from CSV files arriving in ``csv_dir``."""
    reader = spark.readStream.schema(RAW_SCHEMA).options(**raw_options())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return clean(reader.csv(csv_dir)).withColumn(FACT_PARTITION, X.month_of("video_trending_date"))


def start_ingest(spark: SparkSession, csv_dir: str, fact_path: str, checkpoint: str,
                 available_now: bool = True, files_per_month: int = FILES_PER_MONTH) -> StreamingQuery:
    """Append newly arrived raw files to the fact at ``fact_path``, a few files per month and
    batch. ``available_now=True`` processes everything present and stops (a scheduled
    refresh); ``False`` keeps running."""
    rows = clean_stream(spark, csv_dir)
    rows = rows.repartition(F.col(FACT_PARTITION), F.pmod(F.xxhash64("video_id"), F.lit(files_per_month)))
    writer = (rows.writeStream
              .format("parquet")
              .option("checkpointLocation", checkpoint)
              .partitionBy(FACT_PARTITION)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(fact_path)
