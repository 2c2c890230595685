"""Raw and typed schemas of the trending fact."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw column names in file order. The raw date column really has two
# underscores.
RAW_COLUMNS = [
    "video_id",
    "video_published_at",
    "video_trending__date",
    "video_trending_country",
    "channel_id",
    "video_title",
    "video_description",
    "video_default_thumbnail",
    "video_category_id",
    "video_tags",
    "video_duration",
    "video_dimension",
    "video_definition",
    "video_licensed_content",
    "video_view_count",
    "video_like_count",
    "video_comment_count",
    "channel_title",
    "channel_description",
    "channel_custom_url",
    "channel_published_at",
    "channel_country",
    "channel_view_count",
    "channel_subscriber_count",
    "channel_have_hidden_subscribers",
    "channel_video_count",
    "channel_localized_title",
    "channel_localized_description",
]

# Every raw column is read as text; types are applied by ``operators.ingest.clean`` with
# safe casts, so a malformed cell becomes NULL instead of failing the load.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Typed fact: column name -> how the clean step derives it.
#   "text"  pass-through string      "int"   safe integer cast
#   "long"  safe bigint cast         "ts"    safe timestamp cast
#   "bool"  safe boolean cast        "date"  parsed trending date
TRENDING_TYPES = {
    "video_id": "text",
    "video_published_at": "ts",
    "video_trending_date": "date",
    "video_trending_country": "text",
    "channel_id": "text",
    "video_title": "text",
    "video_description": "text",
    "video_default_thumbnail": "text",
    "video_category_id": "int",
    "video_tags": "text",
    "video_duration": "text",
    "video_dimension": "text",
    "video_definition": "text",
    "video_licensed_content": "bool",
    "video_view_count": "long",
    "video_like_count": "long",
    "video_comment_count": "long",
    "channel_title": "text",
    "channel_description": "text",
    "channel_custom_url": "text",
    "channel_published_at": "ts",
    "channel_country": "text",
    "channel_view_count": "long",
    "channel_subscriber_count": "long",
    "channel_have_hidden_subscribers": "bool",
    "channel_video_count": "long",
    "channel_localized_title": "text",
    "channel_localized_description": "text",
}

TRENDING_COLUMNS = list(TRENDING_TYPES)

# Default country; the reference hard-codes it.
DEFAULT_COUNTRY = "United States"

# Partition column added to the stored fact (first day of the trending month).
FACT_PARTITION = "trending_month"

# Sort order of the stored fact inside each month partition: day first, so a day predicate
# skips row groups by their min/max; country next, so one country's rows of a day are
# contiguous; then the video id.
FACT_CLUSTER = [FACT_PARTITION, "video_trending_date", "video_trending_country", "video_id"]
