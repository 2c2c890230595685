"""KPI rows (K1-K8), computed in the reference's browser code from the first row and the
row count of a ranked list; here as small aggregates over the same (unlimited) rows.

"First row of the ranked list" is ``min_by(value, ordering key)`` where the key encodes the
list's order (descending numbers negated, NULLs last via an is-null flag, the entity key
last), so no ranked list has to be materialised or ordered globally. "Rows shown" is
``least(count, page limit)``, as the reference's pages show it; the exact count stands beside it
as ``rows_total``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.operators import reads as R
from trendscope.operators.marts import DATE, in_country
from trendscope.schema import DEFAULT_COUNTRY


def desc_key(col: str) -> list[Column]:
    """Ordering components for ``col DESC NULLS LAST`` inside a min_by key."""
    c = F.col(col)
    return [c.isNull(), -c]


def asc_key(col: str) -> list[Column]:
    """Ordering components for ``col ASC NULLS LAST`` inside a min_by key."""
    c = F.col(col)
    return [c.isNull(), c]


def first_by(value: str, *key: Column) -> Column:
    return F.min_by(F.col(value), F.struct(*key))


def kpi_dashboard(trending: DataFrame, dim: DataFrame, reach: DataFrame, stickiness: DataFrame,
                  date=None, country: str = DEFAULT_COUNTRY, cap: int = R.PAGE["day_trending"][0]) -> DataFrame:
    """K1: the day, its row count (capped at 200 like the list), top views, top likes,
    max US stickiness and max reach among the day's videos."""
    dv = R.day_value(trending, date, country)
    day = R._day_rows(trending, dv, country).join(dim.select("video_id"), "video_id", "inner")
    day = day.join(stickiness.select("video_id", "days_trended_us"), "video_id", "left").join(reach, "video_id", "left")
    return day.agg(
        F.least(F.count(F.lit(1)), F.lit(cap)).alias("trending_rows"),
        F.count(F.lit(1)).alias("rows_total"),
        F.max("video_view_count").alias("top_views"),
        F.max("video_like_count").alias("top_likes"),
        F.max("days_trended_us").alias("max_stickiness"),
        F.max("countries_count").alias("max_reach"),
    ).select(dv.alias("date"), "trending_rows", "rows_total", "top_views", "top_likes", "max_stickiness", "max_reach")


def kpi_channels(daily: DataFrame, alltime: DataFrame, cdim: DataFrame, date=None,
                 shown: int = R.PAGE["channels_daily"][0]) -> DataFrame:
    """K2: one row per board ('daily', 'alltime'): channels shown, the leading channel
    (title, else id), its distinct videos and (all-time) days active."""
    titles = cdim.select("channel_id", "channel_title")
    d = daily.filter(F.col("date") == R.daily_date(daily, date))
    d = d.join(titles, "channel_id", "left")
    a = alltime.join(titles, "channel_id", "left")
    name = F.coalesce(F.col("channel_title"), F.col("channel_id"))
    d_key = [*desc_key("distinct_videos"), *desc_key("sum_views"), *asc_key("channel_id")]
    a_key = [*desc_key("distinct_videos_alltime"), *desc_key("days_active"), *asc_key("channel_id")]
    d_row = d.withColumn("_name", name).agg(
        F.lit("daily").alias("board"),
        F.least(F.count(F.lit(1)), F.lit(shown)).alias("channels_shown"),
        F.count(F.lit(1)).alias("rows_total"),
        first_by("_name", *d_key).alias("top_channel"),
        first_by("distinct_videos", *d_key).alias("top_distinct_videos"),
        F.lit(None).cast("bigint").alias("top_days_active"))
    a_row = a.withColumn("_name", name).agg(
        F.lit("alltime").alias("board"),
        F.least(F.count(F.lit(1)), F.lit(shown)).alias("channels_shown"),
        F.count(F.lit(1)).alias("rows_total"),
        first_by("_name", *a_key).alias("top_channel"),
        first_by("distinct_videos_alltime", *a_key).alias("top_distinct_videos"),
        first_by("days_active", *a_key).alias("top_days_active"))
    return d_row.unionByName(a_row)


def kpi_channel_videos(trending: DataFrame, dim: DataFrame, reach: DataFrame, channel_id: str,
                       country: str = DEFAULT_COUNTRY, shown: int = R.PAGE["channel_videos"][0],
                       stats: DataFrame | None = None) -> DataFrame:
    """K3: videos shown, and the first video's US days and max views."""
    rows = R.channel_videos_all(trending, dim, reach, channel_id, country, stats)
    key = [*desc_key("days_trended_us"), *desc_key("video_view_count"), *asc_key("video_id")]
    return rows.agg(
        F.least(F.count(F.lit(1)), F.lit(shown)).alias("videos_shown"),
        F.count(F.lit(1)).alias("rows_total"),
        first_by("days_trended_us", *key).alias("top_days_trended_us"),
        first_by("video_view_count", *key).alias("top_max_views"))


def kpi_video_history(trending: DataFrame, video_id: str, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """K4: trending rows, first and last date, and the views on the last date (the largest
    when the last date repeats)."""
    rows = in_country(trending, country).filter(F.col("video_id") == F.lit(video_id))
    return rows.agg(
        F.count(F.lit(1)).alias("trending_days"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        F.max_by(F.col("video_view_count"), F.struct(F.col(DATE), F.col("video_view_count")))
        .alias("latest_views"))


def kpi_video_spread(trending: DataFrame, video_id: str, shown: int = R.SPREAD_TOP) -> DataFrame:
    """K5: countries shown, the top country and its days."""
    per = R.video_spread(trending, video_id, n=None)
    key = [*desc_key("days"), *asc_key("country")]
    return per.agg(
        F.least(F.count(F.lit(1)), F.lit(shown)).alias("countries_shown"),
        F.count(F.lit(1)).alias("rows_total"),
        first_by("country", *key).alias("top_country"),
        first_by("days", *key).alias("top_country_days"))


def kpi_tags(monthly: DataFrame, month=None) -> DataFrame:
    """K6: one row per panel: leader by share ('top'), fastest rising, fastest falling. All
    three are picked in one aggregate over the month's pairs."""
    fell = F.col("share_prev").isNotNull()

    def leader(value: str, key: list[Column], keep: Column | None = None) -> Column:
        row = F.struct("tag", F.col(value).alias("value"), "lift", "distinct_videos")
        rank = F.struct(*key)
        return F.min_by(row, rank if keep is None else F.when(keep, rank))

    best = R.tag_pairs(monthly, month).agg(
        leader("share_now", [*desc_key("share_now"), *asc_key("tag")]).alias("top"),
        leader("delta", [*desc_key("delta"), *asc_key("tag")]).alias("rising"),
        leader("delta", [*asc_key("delta"), *asc_key("tag")], fell).alias("falling"))

    def panel(name: str) -> Column:
        lift = F.lit(None).cast("double") if name == "top" else F.col(f"{name}.lift")
        videos = F.col("top.distinct_videos") if name == "top" else F.lit(None).cast("bigint")
        return F.struct(F.lit(name).alias("panel"), F.col(f"{name}.tag").alias("tag"), F.col(f"{name}.value").alias("value"),
                        lift.alias("lift"), videos.alias("distinct_videos"))

    return best.select(F.explode(F.array(*map(panel, ("top", "rising", "falling")))).alias("p")).select("p.*")


def kpi_tag_series(monthly: DataFrame, tag: str) -> DataFrame:
    """K7: first and last month of a tag's series, latest share and latest distinct videos."""
    rows = R.tag_series(tag, monthly_clean=monthly)
    return rows.agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.max_by("video_share", "month").alias("latest_share"),
        F.max_by("distinct_videos", "month").alias("latest_distinct_videos"))


def kpi_tag_videos(events: DataFrame, trending: DataFrame, dim: DataFrame, tag: str, month=None,
                   metric: str = "views", monthly: DataFrame | None = None,
                   country: str = DEFAULT_COUNTRY, shown: int = R.PAGE["tag_videos"][0],
                   stats: DataFrame | None = None) -> DataFrame:
    """K8: videos shown, and the first video's days in the month and its ranked metric."""
    order = {"views": "max_views", "likes": "max_likes"}
    if metric not in order:
        raise ValueError(f"unknown metric {metric!r}: views or likes")
    rows = R.tag_videos_all(events, trending, dim, tag, month, monthly, country, stats)
    key = [*desc_key(order[metric]), *asc_key("video_id")]
    return rows.agg(
        F.least(F.count(F.lit(1)), F.lit(shown)).alias("videos_shown"),
        F.count(F.lit(1)).alias("rows_total"),
        first_by("days_trended_in_month", *key).alias("top_days_trended_in_month"),
        first_by(order[metric], *key).alias("top_metric"))
