"""Read queries (A1-A20): parameterised functions over the fact and the marts.

Each returns a DataFrame. Parameters follow the reference's contract: ``limit`` is clamped
to ``[1, cap]``, ``metric``/``scope`` are whitelisted, user text is bound as a literal and
never spliced into SQL. Bad arguments raise ``ValueError``; "no data" is an empty result.

A date or month argument may be
* ``None``: resolve the latest day/month as a scalar subquery (one job, not two),
* text ``'YYYY-MM-DD'``: a literal, so the predicate reaches the Parquet scan,
* a one-column ``DataFrame`` or a ``Column``: any other derived choice (e.g. the busiest day).

Every top-k orders by the reference's keys and then by every output column, so ties
resolve the same way in any engine. Top-k is planned as ``TakeOrderedAndProject``: each
task keeps only its best ``limit`` rows, so no shuffle of the candidates is needed.

Building a query starts no job: the small side (a day, a channel, a month's videos) is
filtered first, and Spark picks each join from the sizes it knows or measures at run time.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendscope.functions import exprs as X
from trendscope.operators import search as S
from trendscope.operators.marts import COUNTRY, DATE, available_dates, country_dates, in_country
from trendscope.operators.tags import latest_month_value
from trendscope.schema import DEFAULT_COUNTRY, FACT_PARTITION
from trendscope.sources.files import monthly_source


# Fixed values ---------------------------------------------------------------------------
# Page-size contract of the read queries: ``limit`` -> (default, cap), clamped to [1, cap].
PAGE = {
    "country_trending": (50, 200),
    "day_trending": (200, 200),
    "top": (20, 50),
    "top_advanced": (20, 50),
    "channels_daily": (20, 100),
    "channels_alltime": (20, 100),
    "channel_videos": (200, 500),
    "search": (20, 50),
    "tags_top": (50, 200),
    "tags_rising": (50, 200),
    "tags_falling": (50, 200),
    "tag_videos": (20, 200),
}
SPREAD_TOP = 20      # countries in a video's spread
# ----------------------------------------------------------------------------------------


# --- helpers --------------------------------------------------------------------------------

def top_k(df: DataFrame, keys: list[Column], limit: int | None) -> DataFrame:
    """Order by ``keys`` then by all output columns (ascending, NULLs last, by column name);
    keep ``limit``."""
    order = list(keys) + [F.col(c).asc_nulls_last() for c in sorted(df.columns)]
    out = df.orderBy(*order)
    return out.limit(limit) if limit is not None else out


_DAY_TEXT = re.compile(X.DATE_PATTERN.replace(r"\z", r"\Z"))


def parse_day(text: str) -> _dt.date:
    """A day argument, as whole text: what a date of the raw file may look like."""
    m = _DAY_TEXT.match(str(text))
    try:
        return _dt.date(int(m[1]), int(m[3]), int(m[4]))
    except (TypeError, ValueError) as exc:
        raise ValueError(f"bad date: {text!r}") from exc


def parse_month(text: str) -> _dt.date:
    """A month argument: its first 10 characters are a day (A2)."""
    return parse_day(str(text)[:10])


def latest_date(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """A1: the latest trending day of a country (one row, NULL when the country is absent)."""
    return in_country(trending, country).agg(F.max(DATE).alias("latest_date"))


def latest_in(dates: DataFrame, col: str = "date") -> DataFrame:
    """The newest day of a stored date list (V5), as a one-row DataFrame for ``date=``."""
    return dates.agg(F.max(col).alias("date"))


def busiest_date(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """The day with the most rows for a country, latest day on ties (one row)."""
    per_day = in_country(trending, country).groupBy(F.col(DATE).alias("date")).agg(
        F.count(F.lit(1)).alias("rows"))
    return per_day.orderBy(F.col("rows").desc(), F.col("date").desc()).limit(1).select("date")


def day_value(trending: DataFrame, date, country: str = DEFAULT_COUNTRY) -> Column:
    """Resolve a date argument to a Column (literal, scalar subquery or given column)."""
    if date is None:
        return latest_date(trending, country).scalar()
    if isinstance(date, DataFrame):
        return date.scalar()
    if isinstance(date, Column):
        return date
    return F.lit(parse_day(date))


def month_value(monthly: DataFrame, month) -> Column:
    """A2 semantics: an explicit month (cut to 10 characters, not snapped to day 1) wins,
    otherwise the newest month of the mart."""
    if month is None:
        return latest_month_value(monthly)
    if isinstance(month, DataFrame):
        return month.scalar()
    if isinstance(month, Column):
        return month
    return F.lit(parse_month(month))


def latest_month(monthly: DataFrame, month=None) -> DataFrame:
    """A2 as a one-row DataFrame."""
    if month is None:
        return monthly.agg(F.max("month").alias("month"))
    return monthly.limit(1).select(month_value(monthly, month).alias("month"))


def _day(trending: DataFrame, date, country: str) -> DataFrame:
    dv = day_value(trending, date, country)
    out = in_country(trending, country).filter(F.col(DATE) == dv)
    if FACT_PARTITION in trending.columns:
        # Stored fact: the same day also names its month folder, so only it is listed and read.
        out = out.filter(F.col(FACT_PARTITION) == F.trunc(dv, "MM"))
    return out


def _ts_text(col: str) -> Column:
    """TIMESTAMPTZ rendered as text the way the reference returns it (UTC, '+00')."""
    return F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))


# --- A3-A9: dashboard ----------------------------------------------------------------------------

def countries(trending: DataFrame) -> DataFrame:
    """A3: coverage per country, sorted by country."""
    return (available_dates(trending).withColumnRenamed(COUNTRY, "country")
            .orderBy(F.col("country").asc_nulls_last()))


# Output columns of the read queries are the *_COLS lists below.
COUNTRY_TRENDING_COLS = ["video_id", "video_title", "channel_title", "video_default_thumbnail",
                         "video_category_id", "video_published_at", "video_trending_date",
                         "video_view_count", "video_like_count", "video_comment_count"]


def country_trending(trending: DataFrame, country: str, date=None, limit=None) -> DataFrame:
    """A4: one country's day straight from the fact, views desc (default 50, cap 200)."""
    if not country:
        raise ValueError("country must not be empty")
    n = X.clamp_limit(limit, *PAGE["country_trending"])
    day = _day(trending, date, country).select(
        "video_id", "video_title", "channel_title", "video_default_thumbnail", "video_category_id",
        _ts_text("video_published_at").alias("video_published_at"), DATE,
        "video_view_count", "video_like_count", "video_comment_count")
    return top_k(day, [F.col("video_view_count").desc_nulls_last()], n)


def dates(trending: DataFrame, country: str = DEFAULT_COUNTRY, limit: int | None = None) -> DataFrame:
    """A5: all of the country's dates, newest first; the reference stops after 4,000, which
    ``limit`` can do."""
    rows = country_dates(trending, country)
    return rows if limit is None else rows.limit(limit)


DAY_COLS = ["video_id", "video_title", "channel_title", "video_default_thumbnail",
            "video_view_count", "video_like_count", "video_comment_count", "video_trending_date"]

_METRICS = {"views": "video_view_count", "likes": "video_like_count"}


def _day_rows(trending: DataFrame, date, country: str) -> DataFrame:
    return _day(trending, date, country).select(
        "video_id", "video_view_count", "video_like_count", "video_comment_count", DATE)


def _day_with_dim(trending: DataFrame, dim: DataFrame, date, country: str) -> DataFrame:
    return _day_rows(trending, date, country).join(
        dim.select("video_id", "video_title", "channel_title", "video_default_thumbnail"), "video_id", "inner")


def day_trending(trending: DataFrame, dim: DataFrame, date=None, limit=None,
                 country: str = DEFAULT_COUNTRY) -> DataFrame:
    """The day's rows with dimension attributes, views desc (default 200, cap 200)."""
    n = X.clamp_limit(limit, *PAGE["day_trending"])
    rows = _day_with_dim(trending, dim, date, country)
    return top_k(rows.select(*DAY_COLS), [F.col("video_view_count").desc_nulls_last()], n)


def top(trending: DataFrame, dim: DataFrame, metric: str = "views", date=None, limit=None,
        country: str = DEFAULT_COUNTRY) -> DataFrame:
    """The day's top videos by views or likes (default 20, cap 50)."""
    if metric not in _METRICS:
        raise ValueError(f"unknown metric {metric!r}: views or likes")
    n = X.clamp_limit(limit, *PAGE["top"])
    rows = _day_with_dim(trending, dim, date, country)
    return top_k(rows.select(*DAY_COLS), [F.col(_METRICS[metric]).desc_nulls_last()], n)


def top_advanced(trending: DataFrame, dim: DataFrame, side: DataFrame, metric: str = "stickiness",
                 date=None, limit=None, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """The day's videos ranked by US stickiness (``side`` = V4) or by reach
    (``side`` = V3), then views (default 20, cap 50)."""
    extra = {"stickiness": "days_trended_us", "reach": "countries_count"}
    if metric not in extra:
        raise ValueError(f"unknown metric {metric!r}: stickiness or reach")
    n = X.clamp_limit(limit, *PAGE["top_advanced"])
    col = extra[metric]
    rows = _day_with_dim(trending, dim, date, country).join(side.select("video_id", col), "video_id", "left")
    rows = rows.select("video_id", "video_title", "channel_title", "video_default_thumbnail", col,
                       "video_view_count", "video_like_count", "video_comment_count", DATE)
    return top_k(rows, [F.col(col).desc_nulls_last(), F.col("video_view_count").desc_nulls_last()], n)


# --- A10: video detail ------------------------------------------------------------------------------

def video_card(dim: DataFrame, reach: DataFrame, stickiness: DataFrame, video_id: str) -> DataFrame:
    """Dimension row with reach and US stickiness for one video (empty if unknown)."""
    vid = F.lit(video_id)
    d = dim.filter(F.col("video_id") == vid)
    r = reach.filter(F.col("video_id") == vid)
    s = stickiness.filter(F.col("video_id") == vid)
    return d.join(r, "video_id", "left").join(s, "video_id", "left").select(
        "video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail",
        "video_category_id", "video_duration", "video_definition", "countries_count",
        "days_trended_us", "first_trending_us", "last_trending_us")


def video_history(trending: DataFrame, video_id: str, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """The video's rows in one country by date (duplicates kept)."""
    rows = in_country(trending, country).filter(F.col("video_id") == F.lit(video_id)).select(
        F.col(DATE).alias("date"), "video_view_count", "video_like_count", "video_comment_count")
    return top_k(rows, [F.col("date").asc_nulls_last()], None)


def video_spread(trending: DataFrame, video_id: str, n: int = SPREAD_TOP) -> DataFrame:
    """Distinct trending days per country for one video, top ``n``."""
    per = (trending.filter(F.col("video_id") == F.lit(video_id))
           .groupBy(F.col(COUNTRY).alias("country"))
           .agg(F.count_distinct(DATE).alias("days")))
    return top_k(per, [F.col("days").desc_nulls_last()], n)


# --- A11-A13: channels ------------------------------------------------------------------------------

def daily_date(daily: DataFrame, date) -> Column:
    """Resolve the day of a channel board: literal, Column, one-row DataFrame, or (None)
    the newest day of the daily mart, which covers every row of its country."""
    if date is None:
        return daily.agg(F.max("date")).scalar()
    if isinstance(date, DataFrame):
        return date.scalar()
    if isinstance(date, Column):
        return date
    return F.lit(parse_day(date))


CHANNEL_DAILY_COLS = ["channel_id", "channel_title", "distinct_videos", "appearances", "sum_views",
                      "sum_likes", "sum_comments", "date"]


def channels_daily(daily: DataFrame, cdim: DataFrame, date, limit=None) -> DataFrame:
    """Channel board of one day (H2 + H1), distinct videos then views (default 20, cap 100).

    ``date`` is a literal, a Column or a one-row DataFrame (resolve the latest day with
    ``latest_date(trending)``: the reference reads it from the fact)."""
    n = X.clamp_limit(limit, *PAGE["channels_daily"])
    day = daily.filter(F.col("date") == daily_date(daily, date))
    rows = day.join(cdim.select("channel_id", "channel_title"), "channel_id", "left").select(*CHANNEL_DAILY_COLS)
    return top_k(rows, [F.col("distinct_videos").desc_nulls_last(),
                        F.col("sum_views").desc_nulls_last()], n)


CHANNEL_ALLTIME_COLS = ["channel_id", "channel_title", "distinct_videos_alltime", "days_active",
                        "appearances_alltime", "sum_views_alltime", "sum_likes_alltime",
                        "first_date", "last_date"]


def channels_alltime(alltime: DataFrame, cdim: DataFrame, limit=None) -> DataFrame:
    """All-time channel board (H3 + H1) (default 20, cap 100)."""
    n = X.clamp_limit(limit, *PAGE["channels_alltime"])
    rows = (alltime.join(cdim.select("channel_id", "channel_title"), "channel_id", "left")
            .select(*CHANNEL_ALLTIME_COLS))
    return top_k(rows, [F.col("distinct_videos_alltime").desc_nulls_last(),
                        F.col("days_active").desc_nulls_last()], n)


def channel_card(cdim: DataFrame, alltime: DataFrame, channel_id: str) -> DataFrame:
    """Channel dimension row with its all-time US figures (empty if unknown)."""
    cid = F.lit(channel_id)
    return (cdim.filter(F.col("channel_id") == cid)
            .join(alltime.filter(F.col("channel_id") == cid), "channel_id", "left")
            .select("channel_id", "channel_title", "channel_custom_url", "channel_country",
                    "distinct_videos_alltime", "days_active", "appearances_alltime",
                    "first_date", "last_date", "sum_views_alltime", "sum_likes_alltime"))


CHANNEL_VIDEO_COLS = ["video_id", "video_title", "video_default_thumbnail", "days_trended_us",
                      "first_trending_us", "last_trending_us", "video_view_count",
                      "video_like_count", "video_comment_count", "countries_count"]


def channel_videos_all(trending: DataFrame, dim: DataFrame, reach: DataFrame, channel_id: str,
                       country: str = DEFAULT_COUNTRY, stats: DataFrame | None = None) -> DataFrame:
    """A13b without the limit: per video of the channel in the country.

    ``stats`` (``marts.channel_video_stats``, stored by the rebuild) replaces the per-request
    aggregation of the fact."""
    cid = F.lit(channel_id)
    if stats is not None:
        vids = stats.filter(F.col("channel_id") == cid).drop("channel_id")
    else:
        vids = (in_country(trending, country).filter(F.col("channel_id") == cid)
                .groupBy("video_id").agg(
                    F.count_distinct(DATE).alias("days_trended_us"),
                    F.min(DATE).alias("first_trending_us"),
                    F.max(DATE).alias("last_trending_us"),
                    F.max("video_view_count").alias("video_view_count"),
                    F.max("video_like_count").alias("video_like_count"),
                    F.max("video_comment_count").alias("video_comment_count")))
    with_dim = vids.join(dim.select("video_id", "video_title", "video_default_thumbnail"), "video_id", "inner")
    return with_dim.join(reach, "video_id", "left").select(*CHANNEL_VIDEO_COLS)


def channel_videos(trending: DataFrame, dim: DataFrame, reach: DataFrame, channel_id: str,
                   limit=None, country: str = DEFAULT_COUNTRY, stats: DataFrame | None = None) -> DataFrame:
    """The channel's videos by US days then max views (default 200, cap 500)."""
    n = X.clamp_limit(limit, *PAGE["channel_videos"])
    rows = channel_videos_all(trending, dim, reach, channel_id, country, stats)
    return top_k(rows, [F.col("days_trended_us").desc_nulls_last(),
                        F.col("video_view_count").desc_nulls_last()], n)


# --- A14: search ---------------------------------------------------------------------------------------

SEARCH_DAY_COLS = ["video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail",
                   "video_view_count", "video_like_count", "video_comment_count", "video_trending_date"]
SEARCH_ALL_COLS = ["video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail",
                   "days_trended_us", "first_trending_us", "last_trending_us", "countries_count"]


def _scope(scope: str | None) -> str:
    s = (scope or "day").lower()
    if s not in ("day", "all"):
        raise ValueError(f"unknown scope {scope!r}: day or all")
    return s


def search_videos(trending: DataFrame, dim: DataFrame, stickiness: DataFrame, reach: DataFrame,
                  q: str, scope: str = "day", date=None, limit=None,
                  country: str = DEFAULT_COUNTRY, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """A14a/b: title search, in one day (views desc) or over all US days (days desc). With the stored
    trigram ``index``, a selective text reads its candidates' rows instead of the dimension."""
    text = X.clean_query_text(q)
    n = X.clamp_limit(limit, *PAGE["search"])
    scope = _scope(scope)
    if index:
        dim = S.title_dim(index, dim, text)
    if scope == "day":
        day = _day_rows(trending, date, country)
        hits = dim.filter(X.contains_ci("video_title", text)).select(
            "video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail")
        rows = day.join(hits, "video_id", "inner").select(*SEARCH_DAY_COLS)
        return top_k(rows, [F.col("video_view_count").desc_nulls_last()], n)
    hits = dim.filter(X.contains_ci("video_title", text))
    rows = hits.join(stickiness, "video_id", "inner").join(reach, "video_id", "left").select(*SEARCH_ALL_COLS)
    return top_k(rows, [F.col("days_trended_us").desc_nulls_last(),
                        F.col("last_trending_us").desc_nulls_last()], n)


def search_channels(trending: DataFrame, dim: DataFrame, stickiness: DataFrame, q: str,
                    scope: str = "day", date=None, limit=None,
                    country: str = DEFAULT_COUNTRY, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """A14c/d: channel search on title OR id, per channel, in one day or over all days; ``index`` as above."""
    text = X.clean_query_text(q)
    n = X.clamp_limit(limit, *PAGE["search"])
    scope = _scope(scope)
    if index:
        dim = S.channel_dim(index, dim, text)
    match = X.contains_ci("channel_title", text) | X.contains_ci("channel_id", text)
    hits = dim.filter(match).select("video_id", "channel_id", "channel_title")
    if scope == "day":
        day = _day_rows(trending, date, country)
        rows = day.join(hits, "video_id", "inner").groupBy("channel_id").agg(
            F.max("channel_title").alias("channel_title"),
            F.count_distinct("video_id").alias("distinct_videos"),
            F.sum("video_view_count").alias("sum_views"),
            F.sum("video_like_count").alias("sum_likes"),
            F.sum("video_comment_count").alias("sum_comments"))
        return top_k(rows, [F.col("distinct_videos").desc_nulls_last(),
                            F.col("sum_views").desc_nulls_last()], n)
    rows = hits.join(stickiness, "video_id", "inner").groupBy("channel_id").agg(
        F.max("channel_title").alias("channel_title"),
        F.count(F.lit(1)).alias("distinct_videos_alltime"),
        F.sum("days_trended_us").alias("total_days_trended_us"),
        F.min("first_trending_us").alias("first_trending_us"),
        F.max("last_trending_us").alias("last_trending_us"))
    return top_k(rows, [F.col("distinct_videos_alltime").desc_nulls_last(),
                        F.col("total_days_trended_us").desc_nulls_last()], n)


# --- A15-A20: tags -----------------------------------------------------------------------------------------

def tag_pairs(monthly: DataFrame, month=None) -> DataFrame:
    """Tags of a month with their calendar-previous-month share.

    Both months are read together (partition-pruned when the mart or the fact below it is
    stored by month) and laid side by side per tag; a tag has at most one row a month. Tags
    that vanished do not appear."""
    m = month_value(monthly, month)
    is_now = F.col("month") == m
    paired = (monthly.filter(is_now | (F.col("month") == F.add_months(m, -1)))
              .groupBy("tag").agg(F.max(F.when(is_now, F.col("video_share"))).alias("share_now"),
                                  F.max(F.when(~is_now, F.col("video_share"))).alias("share_prev"),
                                  F.max(F.when(is_now, F.col("distinct_videos"))).alias("distinct_videos"),
                                  F.bool_or(is_now).alias("now"))
              .filter("now"))
    now_c, prev_c = F.col("share_now"), F.col("share_prev")
    return paired.select(
        "tag", "share_prev", "share_now",
        (now_c - F.coalesce(prev_c, F.lit(0.0))).alias("delta"),
        F.when(prev_c.isNull() | (prev_c == 0), F.lit(None).cast("double"))
        .otherwise(now_c / prev_c).alias("lift"), "distinct_videos")


def tags_rising(monthly: DataFrame, month=None, limit=None) -> DataFrame:
    """Tags by share gain over the previous month, new tags included (default 50, cap 200)."""
    n = X.clamp_limit(limit, *PAGE["tags_rising"])
    return top_k(tag_pairs(monthly, month).drop("distinct_videos"), [F.col("delta").desc_nulls_last()], n)


def tags_falling(monthly: DataFrame, month=None, limit=None) -> DataFrame:
    """Tags present in both months by share loss (default 50, cap 200)."""
    n = X.clamp_limit(limit, *PAGE["tags_falling"])
    rows = tag_pairs(monthly, month).filter(F.col("share_prev").isNotNull()).drop("distinct_videos")
    return top_k(rows, [F.col("delta").asc_nulls_last()], n)


TAG_VIDEO_COLS = ["video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail",
                  "max_views", "max_likes", "max_comments", "days_trended_in_month",
                  "first_date", "last_date"]


def tag_videos_all(events: DataFrame, trending: DataFrame, dim: DataFrame, tag: str, month=None,
                   monthly: DataFrame | None = None, country: str = DEFAULT_COUNTRY,
                   stats: DataFrame | None = None) -> DataFrame:
    """A17 without order/limit: the videos carrying ``tag`` in ``month``, their rows in that
    month aggregated. The tag is normalised with the lookup rules (T13).

    ``stats`` (``marts.video_month_stats``, stored by the rebuild) replaces the aggregation
    of the month's fact rows with a read of one month of per-video rows."""
    if not tag:
        raise ValueError("tag must not be empty")
    key = X.lookup_tag(F.lit(tag))
    m = month_value(monthly if monthly is not None else events, month)
    vids = events.filter((F.col("month") == m) & (F.col("tag") == key)).select("video_id")
    dim_cols = dim.select("video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail")
    if stats is not None:
        # the dimension first: in buckets of the video id it stays where it is, and what is left
        # of it meets the month's rows in the same partitions
        tagged = dim_cols.join(vids, "video_id", "left_semi")
        return stats.filter(F.col("month") == m).drop("month").join(tagged, "video_id", "inner").select(*TAG_VIDEO_COLS)
    # The month as a date range (pushed to the scan), not trunc(date) = month; on the
    # stored fact also as the partition value, so only that month's folder is read.
    fact = in_country(trending, country)
    if FACT_PARTITION in trending.columns:
        fact = fact.filter(F.col(FACT_PARTITION) == m)
    rows = (fact.filter((F.col(DATE) >= m) & (F.col(DATE) < F.add_months(m, 1)))
            .select("video_id", DATE, "video_view_count", "video_like_count", "video_comment_count")
            .join(vids, "video_id", "left_semi"))
    per_video = rows.groupBy("video_id").agg(
        F.max("video_view_count").alias("max_views"),
        F.max("video_like_count").alias("max_likes"),
        F.max("video_comment_count").alias("max_comments"),
        F.count_distinct(DATE).alias("days_trended_in_month"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"))
    return per_video.join(dim_cols, "video_id", "inner").select(*TAG_VIDEO_COLS)


def tag_videos(events: DataFrame, trending: DataFrame, dim: DataFrame, tag: str, month=None,
               metric: str = "views", limit=None, monthly: DataFrame | None = None,
               country: str = DEFAULT_COUNTRY, stats: DataFrame | None = None) -> DataFrame:
    """Videos of a tag in a month ordered by max views or max likes (default 20, cap 200)."""
    order = {"views": "max_views", "likes": "max_likes"}
    if metric not in order:
        raise ValueError(f"unknown metric {metric!r}: views or likes")
    n = X.clamp_limit(limit, *PAGE["tag_videos"])
    rows = tag_videos_all(events, trending, dim, tag, month, monthly, country, stats)
    return top_k(rows, [F.col(order[metric]).desc_nulls_last()], n)


def tag_series(tag: str, monthly_clean: DataFrame | None = None,
               monthly_legacy: DataFrame | None = None) -> DataFrame:
    """Monthly series of a tag. S8: the clean mart when given, else the legacy one; when
    neither is, the clean table if the catalogue has one, else the legacy table. One output
    schema in every case."""
    if not tag:
        raise ValueError("tag must not be empty")
    key = X.lookup_tag(F.lit(tag))
    if monthly_clean is not None:
        src = monthly_clean.select("month", "tag", "video_share", "distinct_videos",
                                   F.col("total_videos_tagged").alias("total_videos"))
    elif monthly_legacy is not None:
        src = monthly_legacy.select("month", "tag", "video_share", "distinct_videos", "total_videos")
    else:
        src = monthly_source(SparkSession.active())
    rows = src.filter(F.col("tag") == key).select(
        F.date_format("month", "yyyy-MM-dd").alias("month"),
        "video_share", "distinct_videos", "total_videos")
    return rows.orderBy(F.col("month").asc())


def tags_top(monthly: DataFrame, month=None, limit=None) -> DataFrame:
    """Top tags of a month by share (default 50, cap 200)."""
    n = X.clamp_limit(limit, *PAGE["tags_top"])
    rows = monthly.filter(F.col("month") == month_value(monthly, month)).select(
        "tag", "distinct_videos", F.col("total_videos_tagged").alias("total_videos"), "video_share")
    return top_k(rows, [F.col("video_share").desc_nulls_last()], n)
