"""Cleaning and quality checks.

``clean`` turns the all-text raw table into the typed fact ``trending``: keep rows whose
trending date parses and whose id is valid, apply safe casts, project 28 columns. Row-wise
only, so it runs map-side with no shuffle. The quality reports are single aggregations
(partial aggregation per task, one tiny final merge) over the raw table.

The date is parsed once per row: it is generated (exploded from an array of one), and what is
generated isn't copied into the filters and columns that use it, as a projected expression is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendscope.functions import exprs as X
from trendscope.schema import TRENDING_TYPES

_CASTS = {
    "text": lambda c: F.col(c),
    "int": X.to_int,
    "long": X.to_long,
    "ts": X.to_ts,
    "bool": X.to_bool,
}

PARSED_DATE = "_parsed_trending_date"
_VALID = "_is_valid_video_id"


def _with_checks(raw: DataFrame) -> DataFrame:
    return raw.withColumn(_VALID, X.valid_video_id("video_id")).select(
        "*", F.explode(F.array(X.parse_trending_date("video_trending__date"))).alias(PARSED_DATE))


def _typed_columns():
    out = []
    for name, kind in TRENDING_TYPES.items():
        if kind == "date":
            out.append(F.col(PARSED_DATE).alias(name))
        else:
            out.append(_CASTS[kind](name).alias(name))
    return out


def dated(raw: DataFrame) -> DataFrame:
    """The rows that C6 keeps, with their parsed date.

    A NULL id makes the id check NULL, and a NULL filter condition drops the row (G19). A row whose
    date doesn't parse has no date to generate.
    """
    return raw.filter(X.valid_video_id("video_id")).select(
        "*", F.explode(F.array_compact(F.array(X.parse_trending_date("video_trending__date")))).alias(PARSED_DATE))


def typed(kept: DataFrame, *more: str) -> DataFrame:
    """The 28 typed columns of ``dated`` rows, and ``more`` of theirs."""
    return kept.select(*_typed_columns(), *more)


def clean(raw: DataFrame) -> DataFrame:
    """Typed ``trending`` fact. Repeated (video, country, day) rows are kept."""
    return typed(dated(raw))


def raw_quality(raw: DataFrame) -> DataFrame:
    """Total rows, rows whose date does not parse, rows whose non-NULL id is invalid.

    ``null_video_id_rows`` is added so that the counts reconcile (SURVEY §5).
    """
    checked = _with_checks(raw)
    return checked.agg(
        F.count(F.lit(1)).alias("total_raw"),
        F.sum(F.col(PARSED_DATE).isNull().cast("int")).alias("bad_date_rows"),
        F.sum((~F.col(_VALID)).cast("int")).alias("invalid_video_id_rows"),
        F.sum(F.col("video_id").isNull().cast("int")).alias("null_video_id_rows"),
    )


def clean_quality(raw: DataFrame) -> DataFrame:
    """Clean rows, distinct countries, NULL-date rows in the clean table (always 0) and
    dropped = raw - clean, computed in one pass over the raw table instead of two scans."""
    checked = _with_checks(raw)
    keep = F.col(PARSED_DATE).isNotNull() & F.col(_VALID)
    keep = F.coalesce(keep, F.lit(False))
    return checked.agg(
        F.sum(keep.cast("long")).alias("total_clean"),
        F.count(F.lit(1)).alias("total_raw"),
        F.count_distinct(F.when(keep, F.col("video_trending_country"))).alias("distinct_countries"),
        F.sum((keep & F.col(PARSED_DATE).isNull()).cast("long")).alias("null_date_clean"),
    ).select(
        F.coalesce(F.col("total_clean"), F.lit(0)).alias("total_clean"),
        (F.col("total_raw") - F.coalesce(F.col("total_clean"), F.lit(0))).alias("dropped"),
        "distinct_countries",
        F.coalesce(F.col("null_date_clean"), F.lit(0)).alias("null_date_clean"),
    )


def quality_by(raw: DataFrame, key: str) -> DataFrame:
    """C7 and C8 per value of ``key`` (an input file), so that they add up over any set of keys: counts, and
    the months and countries of the clean rows (a few hundred values of each at most)."""
    checked = _with_checks(raw)
    keep = F.coalesce(F.col(PARSED_DATE).isNotNull() & F.col(_VALID), F.lit(False))
    count = lambda test: F.count(F.when(test, 1))
    return checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_raw"),
        count(F.col(PARSED_DATE).isNull()).alias("bad_date_rows"),
        count(~F.col(_VALID)).alias("invalid_video_id_rows"),
        count(F.col("video_id").isNull()).alias("null_video_id_rows"),
        count(keep).alias("total_clean"),
        F.collect_set(F.when(keep, X.month_of(PARSED_DATE))).alias("months"),
        F.collect_set(F.when(keep, F.col("video_trending_country"))).alias("countries"))


def rejects(raw: DataFrame, n: int | None = None) -> DataFrame:
    """Rows failing either rule (5 columns). The whole reject set by default; ``n``
    takes a sample of that size like the reference's debugging print."""
    checked = _with_checks(raw)
    out = checked.filter(F.col(PARSED_DATE).isNull() | ~F.col(_VALID)).select(
        "video_id", "video_trending__date", "video_trending_country",
        "video_category_id", "video_default_thumbnail")
    return out.limit(n) if n is not None else out
