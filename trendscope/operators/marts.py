"""Video and channel marts (V1-V5, H1-H3): one ``groupBy`` each.

All of them aggregate with map-side partial aggregation, so a hot key (one video or one
channel holding a third of the rows) reaches the final merge as one partial row per task,
not as raw rows. Distinct counts are planned by Catalyst as (key, value) de-duplication
first, then a count per key, so the same holds for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.schema import DEFAULT_COUNTRY

DATE = "video_trending_date"
COUNTRY = "video_trending_country"


def latest_non_null(col: str, order_col: str = DATE) -> Column:
    """Deterministic stand-in for ANY_VALUE (G8): the value on the latest date among the
    non-NULL values, ties broken by the value itself; NULL only if every value is NULL."""
    c = F.col(col)
    return F.max_by(c, F.when(c.isNotNull(), F.struct(F.col(order_col), c)))


def in_country(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    return trending.filter(F.col(COUNTRY) == F.lit(country))


def available_dates(trending: DataFrame) -> DataFrame:
    """V1: coverage per country."""
    return trending.groupBy(COUNTRY).agg(
        F.min(DATE).alias("min_date"),
        F.max(DATE).alias("max_date"),
        F.count(F.lit(1)).alias("rows"),
    )


VIDEO_DIM_ATTRS = ["video_title", "channel_id", "channel_title", "video_default_thumbnail",
                   "video_category_id", "video_duration", "video_definition"]


def latest_attributes(trending: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Per key, each attribute's latest non-NULL value. First the rows collapse to distinct
    (key, attributes) with their latest date, a hash aggregate that a task does before the
    shuffle; the picks then run over what is left, a few versions per key."""
    versions = trending.groupBy(*keys, *attrs).agg(F.max(DATE).alias(DATE))
    return versions.groupBy(*keys).agg(*[latest_non_null(c).alias(c) for c in attrs])


def video_dim(trending: DataFrame) -> DataFrame:
    """V2: one row per video with 7 attributes."""
    return latest_attributes(trending, ["video_id"], VIDEO_DIM_ATTRS)


def video_reach(trending: DataFrame) -> DataFrame:
    """V3: distinct countries per video (all countries)."""
    return trending.groupBy("video_id").agg(F.count_distinct(COUNTRY).alias("countries_count"))


def video_stickiness(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """V4: distinct trending days, first and last day per video in one country."""
    return in_country(trending, country).groupBy("video_id").agg(
        F.count_distinct(DATE).alias("days_trended_us"),
        F.min(DATE).alias("first_trending_us"),
        F.max(DATE).alias("last_trending_us"),
    )


def video_profile(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """V2 + V3 + V4 in one table per video. The distinct figures come from distinct (video,
    country, day) triples, counted per (video, country) and then per video: hash aggregates
    over three short columns, with no expanded copies of the rows.

    A video without rows in ``country`` has ``country_rows = 0`` and NULL stickiness;
    ``video_stickiness_of`` drops those rows, which gives exactly V4's set."""
    places = (trending.groupBy("video_id", COUNTRY, DATE).agg(F.count(F.lit(1)).alias("rows"))
              .groupBy("video_id", COUNTRY).agg(F.count(DATE).alias("days"), F.min(DATE).alias("first"),
                                                F.max(DATE).alias("last"), F.sum("rows").alias("rows")))
    return profile_of(places, video_dim(trending), country)


def profile_of(places: DataFrame, dim: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """The profile from V2 and one row per (video, country): days, first, last, rows."""
    here = F.col(COUNTRY) == F.lit(country)
    figures = places.groupBy("video_id").agg(
        F.count(COUNTRY).alias("countries_count"),
        F.coalesce(F.sum(F.when(here, F.col("days"))), F.lit(0)).alias("days_trended_us"),
        F.min(F.when(here, F.col("first"))).alias("first_trending_us"),
        F.max(F.when(here, F.col("last"))).alias("last_trending_us"),
        F.coalesce(F.sum(F.when(here, F.col("rows"))), F.lit(0)).alias("country_rows"))
    return dim.join(figures, "video_id")


def video_dim_of(profile: DataFrame) -> DataFrame:
    return profile.select("video_id", *VIDEO_DIM_ATTRS)


def video_reach_of(profile: DataFrame) -> DataFrame:
    return profile.select("video_id", "countries_count")


def video_stickiness_of(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("country_rows") > 0).select(
        "video_id", "days_trended_us", "first_trending_us", "last_trending_us")


def country_dates(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """V5: distinct dates of a country, newest first."""
    return (in_country(trending, country).select(F.col(DATE).alias("date")).distinct()
            .orderBy(F.col("date").desc()))


CHANNEL_DIM_ATTRS = ["channel_title", "channel_custom_url", "channel_country"]


def channel_dim(trending: DataFrame) -> DataFrame:
    """H1: one row per channel; a NULL channel id forms its own group."""
    return latest_attributes(trending, ["channel_id"], CHANNEL_DIM_ATTRS)


def channel_daily(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """H2: per (date, channel): distinct videos, appearances and summed counters."""
    return in_country(trending, country).groupBy(F.col(DATE).alias("date"), "channel_id").agg(
        F.count_distinct("video_id").alias("distinct_videos"),
        F.count(F.lit(1)).alias("appearances"),
        F.sum("video_view_count").alias("sum_views"),
        F.sum("video_like_count").alias("sum_likes"),
        F.sum("video_comment_count").alias("sum_comments"),
    )


def channel_alltime(trending: DataFrame, country: str = DEFAULT_COUNTRY, daily: DataFrame | None = None,
                    videos: DataFrame | None = None) -> DataFrame:
    """H3: per channel over all days. The sums add daily cumulative counters (as the
    reference does), so they are not unique views.

    Derived from H2 (``daily``, one row per channel and day) and from the distinct (channel,
    video) pairs (``videos``, e.g. the stored ``channel_video_stats``): each distinct figure is
    a row count there. NULL channels join null-safely."""
    daily = daily if daily is not None else channel_daily(trending, country)
    videos = videos if videos is not None else in_country(trending, country).select("channel_id", "video_id").distinct()
    seen = videos.groupBy(F.col("channel_id").alias("of_channel")).agg(
        F.count("video_id").alias("distinct_videos_alltime"))
    days = daily.groupBy("channel_id").agg(
        F.count("date").alias("days_active"),
        F.sum("appearances").alias("appearances_alltime"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("sum_views").alias("sum_views_alltime"),
        F.sum("sum_likes").alias("sum_likes_alltime"))
    return days.join(seen, F.col("channel_id").eqNullSafe(F.col("of_channel"))).select(
        "channel_id", "distinct_videos_alltime", "days_active", "appearances_alltime", "first_date", "last_date",
        "sum_views_alltime", "sum_likes_alltime")


def channel_video_stats(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Per (channel, video) in one country: distinct days, first/last day and the largest
    counters -- the per-video figures of the channel page (A13b), pre-aggregated. Stored
    clustered by channel, so a channel page reads its own rows instead of the fact."""
    return in_country(trending, country).groupBy("channel_id", "video_id").agg(
        F.count_distinct(DATE).alias("days_trended_us"),
        F.min(DATE).alias("first_trending_us"),
        F.max(DATE).alias("last_trending_us"),
        F.max("video_view_count").alias("video_view_count"),
        F.max("video_like_count").alias("video_like_count"),
        F.max("video_comment_count").alias("video_comment_count"),
    )


def video_month_stats(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Per (month, video) in one country: largest counters, distinct days, first/last day --
    the per-video figures of a tag's videos in a month (A17), pre-aggregated. Stored
    partitioned by month, so the tag page reads one month of per-video rows."""
    from trendscope.functions.exprs import month_of
    return in_country(trending, country).groupBy(month_of(DATE).alias("month"), "video_id").agg(
        F.max("video_view_count").alias("max_views"),
        F.max("video_like_count").alias("max_likes"),
        F.max("video_comment_count").alias("max_comments"),
        F.count_distinct(DATE).alias("days_trended_in_month"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
    )


VIDEO_DAY_COLS = ["video_id", "video_trending_country", "video_trending_date",
                  "video_view_count", "video_like_count", "video_comment_count"]


def video_days(trending: DataFrame) -> DataFrame:
    """A narrow, video-major projection of the fact (the columns of the video page: A10b,
    A10c, K4, K5). Stored range-partitioned and sorted by video, so a one-video lookup reads
    the few row groups whose min/max cover that id instead of scanning the day-ordered fact.
    The read functions accept it in place of the fact."""
    return trending.select(*VIDEO_DAY_COLS)
