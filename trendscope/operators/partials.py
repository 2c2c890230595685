"""Month partials: per calendar month, what the marts over all months are merged from.

A month has at most 31 days, so the distinct days of a key in a month are one whole number of 31 bits,
put together by ``bit_or`` in a hash aggregate before the shuffle; distinct days over months
are sums of bit counts, exactly. Countries, versions of attributes and (channel, video) pairs merge by
their keys. A refresh makes the partials of the touched months and merges, without reading
the fact's other months: V1-V5, H1-H3, E2, E3, E6-E8 come from here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.functions.exprs import month_of
from trendscope.operators import marts as M
from trendscope.operators.explore import _P, TOP_N, discrete_quantiles
from trendscope.operators.marts import COUNTRY, DATE, in_country
from trendscope.operators.reads import top_k
from trendscope.schema import DEFAULT_COUNTRY, FACT_PARTITION

MONTH = "month"


def _with_month(trending: DataFrame) -> DataFrame:
    stored = F.col(FACT_PARTITION) if FACT_PARTITION in trending.columns else month_of(DATE)
    return trending.withColumn(MONTH, stored)


def day_mask(col: str = DATE) -> Column:
    """Aggregate: the distinct days of a month's dates, bit n - 1 for day n."""
    return F.bit_or(F.expr(f"shiftleft(1, day({col}) - 1)"))


# --- partials, from the rows of any months ----------------------------------------------------------

def video_places(trending: DataFrame) -> DataFrame:
    """Per (month, video, country): rows, days, first and last day."""
    return _with_month(trending).groupBy(MONTH, "video_id", COUNTRY).agg(
        F.count(F.lit(1)).alias("rows"), day_mask().alias("days"), F.min(DATE).alias("first"), F.max(DATE).alias("last"))


def video_versions(trending: DataFrame) -> DataFrame:
    """Per (month, video): its attributes' versions with their latest day."""
    return _with_month(trending).groupBy(MONTH, "video_id", *M.VIDEO_DIM_ATTRS).agg(F.max(DATE).alias(DATE))


def channel_versions(trending: DataFrame) -> DataFrame:
    """Per (month, channel): its attributes' versions with their latest day."""
    return _with_month(trending).groupBy(MONTH, "channel_id", *M.CHANNEL_DIM_ATTRS).agg(F.max(DATE).alias(DATE))


def channel_video_months(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Per (month, channel, video) in one country: days, first and last day, largest counters."""
    return _with_month(in_country(trending, country)).groupBy(MONTH, "channel_id", "video_id").agg(
        day_mask().alias("days"), F.min(DATE).alias("first_trending_us"), F.max(DATE).alias("last_trending_us"),
        *[F.max(c).alias(c) for c in ("video_view_count", "video_like_count", "video_comment_count")])


def country_days(trending: DataFrame) -> DataFrame:
    """Per (month, country, day): rows. A few hundred countries a day."""
    return _with_month(trending).groupBy(MONTH, COUNTRY, DATE).agg(F.count(F.lit(1)).alias("rows"))


def channel_days(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """H2 with its month."""
    return M.channel_daily(trending, country).withColumn(MONTH, month_of("date"))


# --- marts, from the partials of all months ---------------------------------------------------------

def _per_place(places: DataFrame) -> DataFrame:
    return places.groupBy("video_id", COUNTRY).agg(
        F.sum(F.bit_count("days")).alias("days"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("rows").alias("rows"))


def video_profile(places: DataFrame, versions: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """V2, V3 and V4 in one table per video, as ``marts.video_profile`` of the fact."""
    return M.profile_of(_per_place(places), M.latest_attributes(versions, ["video_id"], M.VIDEO_DIM_ATTRS), country)


def channel_dim(versions: DataFrame) -> DataFrame:
    """H1."""
    return M.latest_attributes(versions, ["channel_id"], M.CHANNEL_DIM_ATTRS)


def channel_video_stats(months: DataFrame) -> DataFrame:
    """The per-video figures of the channel page, as ``marts.channel_video_stats`` of the fact."""
    return months.groupBy("channel_id", "video_id").agg(
        F.sum(F.bit_count("days")).alias("days_trended_us"), F.min("first_trending_us").alias("first_trending_us"),
        F.max("last_trending_us").alias("last_trending_us"),
        *[F.max(c).alias(c) for c in ("video_view_count", "video_like_count", "video_comment_count")])


def available_dates(days: DataFrame) -> DataFrame:
    """V1 (A3 sorted by country)."""
    return days.groupBy(COUNTRY).agg(F.min(DATE).alias("min_date"), F.max(DATE).alias("max_date"), F.sum("rows").alias("rows"))


def country_dates(days: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """V5 (A5; A1 is its first row)."""
    return in_country(days, country).select(F.col(DATE).alias("date")).orderBy(F.col("date").desc())


def country_coverage(days: DataFrame, n: int = TOP_N) -> DataFrame:
    """E3; E2 is its country and rows."""
    return top_k(available_dates(days), [F.col("rows").desc_nulls_last()], n)


def daily_volume(days: DataFrame, n: int = TOP_N) -> DataFrame:
    """E6."""
    return top_k(days.select(COUNTRY, DATE, F.col("rows").alias("rows_that_day")), [F.col("rows_that_day").desc_nulls_last()], n)


def stickiness_dist(places: DataFrame) -> DataFrame:
    """E7."""
    return discrete_quantiles(_per_place(places).withColumnRenamed("days", "days_trended"), "days_trended", _P, "max_days")


def reach_dist(places: DataFrame) -> DataFrame:
    """E8."""
    per = _per_place(places).groupBy("video_id").agg(F.count(COUNTRY).alias("countries"))
    return discrete_quantiles(per, "countries", _P, "max_countries")
