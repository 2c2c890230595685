"""Tag pipelines.

Tags arrive as one delimited string per fact row. ``explode(split(...))`` turns them into
events; the normalisation chains live in ``functions.exprs``. Everything is column
expressions plus ``groupBy``; the country predicate sits before the explode and reaches
the scan.

Scale notes
* The DISTINCT of T1 shuffles on (video, day, month, tag): no single hot key.
* Distinct counts per (month, tag) de-duplicate (month, tag, video) first, so a tag on a
  third of all videos still reaches its final merge as one partial count per task.
* Month totals have one row per calendar month, a size fixed by the date range and not by
  the data volume, so they are broadcast.
* The previous-month pairing (T10) partitions by tag; each tag has at most one row per
  month, so a window partition is bounded by the number of months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendscope.functions import exprs as X
from trendscope.operators.marts import DATE, in_country
from trendscope.schema import DEFAULT_COUNTRY, FACT_PARTITION


# Fixed values ---------------------------------------------------------------------------
LATEST_TOP_N = 10        # rows of the latest-month tag lists
LATEST_SHARE_DIGITS = 6  # share rounding of the clean latest-month list
MART_SHARE_DIGITS = 8    # share rounding of the legacy monthly mart
# ----------------------------------------------------------------------------------------


def fact_month(trending: DataFrame) -> Column:
    """The month of a fact row: the stored fact's partition value, so that a predicate on a
    month of tags reads that month's folder only, else derived from the date."""
    return F.col(FACT_PARTITION) if FACT_PARTITION in trending.columns else X.month_of(DATE)


# --- T1-T5: clean pipeline ------------------------------------------------------------------

def tag_events_clean(trending: DataFrame, country: str = DEFAULT_COUNTRY,
                     mode: str = "parity") -> DataFrame:
    """One row per (video, day, month, normalised tag).

    ``mode="parity"`` reproduces the reference exactly (comma split only, none-like strings
    kept, first whitespace run collapsed, quotes stripped on one side). ``mode="strict"``
    applies the lookup normaliser (T13) and also splits on '|' and drops none-like strings,
    so that stored tags and user lookups use the same rules.
    """
    if mode not in ("parity", "strict"):
        raise ValueError("mode must be parity or strict")
    strict = mode == "strict"
    base = in_country(trending, country).filter(
        F.col(DATE).isNotNull() & F.col("video_tags").isNotNull())
    if strict:
        base = base.filter(X.has_usable_tags("video_tags"))
    norm = X.lookup_tag if strict else X.clean_tag
    # Normalise and filter inside the array, then explode: each piece's regex chain is
    # evaluated once (a filter over an exploded alias would inline the chain into every
    # reference of the tag).
    tags = F.filter(F.transform(X.split_tags("video_tags", pipe_too=strict), norm), X.clean_tag_keep)
    return (base.select("video_id", DATE, fact_month(trending).alias("month"), F.explode(tags).alias("tag"))
            .distinct())


def month_totals_all(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Distinct videos per month over all rows of the country, tagged or not."""
    return (in_country(trending, country).filter(F.col(DATE).isNotNull())
            .groupBy(fact_month(trending).alias("month"))
            .agg(F.count_distinct("video_id").alias("total_videos_all")))


def tag_monthly_clean(events: DataFrame, trending: DataFrame,
                      country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Per (month, tag): distinct videos, event rows, month totals and two shares."""
    totals_tagged = events.groupBy("month").agg(
        F.count_distinct("video_id").alias("total_videos_tagged"))
    totals_all = month_totals_all(trending, country)
    counts = events.groupBy("month", "tag").agg(
        F.count_distinct("video_id").alias("distinct_videos"),
        F.count(F.lit(1)).alias("tag_rows"))
    joined = (counts.join(F.broadcast(totals_tagged), "month", "left")
              .join(F.broadcast(totals_all), "month", "left"))
    dv = F.col("distinct_videos").cast("double")
    return joined.select(
        "month", "tag", "distinct_videos", "tag_rows", "total_videos_tagged", "total_videos_all",
        (dv / F.nullif(F.col("total_videos_tagged"), F.lit(0))).alias("video_share"),
        (dv / F.nullif(F.col("total_videos_all"), F.lit(0))).alias("video_share_all"),
    )


def tag_months(monthly: DataFrame) -> DataFrame:
    """Distinct months as 'YYYY-MM-DD' text, newest first."""
    return (monthly.select(F.date_format("month", "yyyy-MM-dd").alias("month")).distinct()
            .orderBy(F.col("month").desc()))


def tag_clean_stats(events: DataFrame) -> DataFrame:
    """T4: event rows, unique tags, month count and month range, in one pass over the
    events (the monthly mart has exactly the events' months)."""
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("tag").alias("n_tags"),
        F.count_distinct("month").alias("months"),
        F.date_format(F.min("month"), "yyyy-MM-dd").alias("min_month"),
        F.date_format(F.max("month"), "yyyy-MM-dd").alias("max_month"),
    )


def latest_month_value(monthly: DataFrame) -> Column:
    """Scalar subquery: the newest month in a monthly mart (never relies on view order)."""
    return monthly.agg(F.max("month")).scalar()


def latest_month_of_events(events: DataFrame) -> DataFrame:
    """The newest month with a tag event (one row): the same as the monthly mart's, without
    its counts and joins."""
    return events.agg(F.max("month").alias("month"))


def top_tags_latest(monthly: DataFrame, n: int = LATEST_TOP_N, month: DataFrame | None = None) -> DataFrame:
    """T5: top ``n`` tags of the latest month by share, share rounded to 6 places."""
    latest = monthly.filter(F.col("month") == (month.scalar() if month is not None else latest_month_value(monthly)))
    out = latest.select(
        "tag", "distinct_videos", "total_videos_tagged",
        F.round("video_share", LATEST_SHARE_DIGITS).alias("share"), "video_share")
    return (out.orderBy(F.col("video_share").desc_nulls_last(), F.col("tag").asc_nulls_last())
            .limit(n).drop("video_share"))


# --- T6-T12: legacy pipeline ------------------------------------------------------------------

def tag_events_legacy(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Comma and pipe split, none-like strings dropped, '#'s stripped before the
    trim, one quote char stripped, no DISTINCT and no junk or length filter."""
    base = in_country(trending, country).filter(
        F.col(DATE).isNotNull() & X.has_usable_tags("video_tags"))
    pieces = F.filter(X.split_tags("video_tags", pipe_too=True), X.has_text)
    tags = F.filter(F.transform(pieces, X.legacy_tag), lambda t: t != "")
    return base.select("video_id", DATE, fact_month(trending).alias("month"), F.explode(tags).alias("tag"))


def tag_events_clustered(events: DataFrame) -> DataFrame:
    """Events range-partitioned by (month, tag) and sorted by (month, tag, video) inside
    each partition, so written files carry tight min/max statistics for pruning."""
    return (events.repartitionByRange("month", "tag", "video_id")
            .sortWithinPartitions("month", "tag", "video_id"))


def month_totals_legacy(events: DataFrame) -> DataFrame:
    """Distinct tagged videos per month."""
    return events.groupBy("month").agg(F.count_distinct("video_id").alias("total_videos"))


def tag_monthly_legacy(events: DataFrame, totals: DataFrame | None = None,
                       digits: int = MART_SHARE_DIGITS) -> DataFrame:
    """Per (month, tag): distinct videos, raw appearances, month total and the share
    rounded to ``digits`` places (8 in the mart, 6 in the notebook)."""
    totals = totals if totals is not None else month_totals_legacy(events)
    counts = events.groupBy("month", "tag").agg(
        F.count(F.lit(1)).alias("tag_appearances"),
        F.count_distinct("video_id").alias("distinct_videos"))
    joined = counts.join(F.broadcast(totals), "month", "inner")
    share = F.col("distinct_videos").cast("double") / F.col("total_videos")
    return joined.select("month", "tag", "distinct_videos", "tag_appearances", "total_videos",
                         F.round(share, digits).alias("video_share"))


def with_previous_month(df: DataFrame, key: str, value: str, out: str,
                        month: str = "month") -> DataFrame:
    """Add ``out`` = ``value`` of the same ``key`` in the calendar-previous month.

    A range frame over 12*year+month looks back exactly one calendar month, so a gap in a
    tag's months gives NULL, as the reference's self-join on ``month - 1 month`` does
    (a plain ``lag`` would pair across the gap). Requires one row per (key, month).
    """
    w = Window.partitionBy(key).orderBy(X.month_index(month)).rangeBetween(-1, -1)
    return df.withColumn(out, F.max(F.col(value)).over(w))


def lift_col(now: Column, prev: Column) -> Column:
    """NULL when the previous share is NULL or 0, otherwise now / prev."""
    return F.when(prev.isNull() | (prev == 0), F.lit(None).cast("double")).otherwise(now / prev)


def tag_movers(monthly: DataFrame) -> DataFrame:
    """Every (month, tag) with its calendar-previous share, delta and lift."""
    paired = with_previous_month(monthly, "tag", "video_share", "share_prev")
    now, prev = F.col("video_share"), F.col("share_prev")
    return paired.select(
        "month", "tag", now.alias("share_now"), prev.alias("share_prev"),
        (now - prev).alias("delta"), lift_col(now, prev).alias("lift"))


def tag_legacy_stats(events: DataFrame) -> DataFrame:
    """Event rows, unique tags, month count and range (one pass over the events)."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("tag").alias("unique_tags"),
        F.count_distinct("month").alias("months"),
        F.date_format(F.min("month"), "yyyy-MM-dd").alias("min_month"),
        F.date_format(F.max("month"), "yyyy-MM-dd").alias("max_month"),
    )


def top_tags_latest_legacy(monthly: DataFrame, n: int = LATEST_TOP_N, month: DataFrame | None = None) -> DataFrame:
    """Top ``n`` tags of the latest month by distinct videos."""
    latest = monthly.filter(F.col("month") == (month.scalar() if month is not None else latest_month_value(monthly)))
    return (latest.select("tag", "distinct_videos", "total_videos", "video_share")
            .orderBy(F.col("distinct_videos").desc_nulls_last(), F.col("tag").asc_nulls_last())
            .limit(n))
