"""DuckDB text of the same computations, used as the independent oracle.

Written in DuckDB's own dialect and semantics (first-match ``regexp_replace``, rounding
text-to-integer casts, list functions, ``quantile_disc``), so a match against
the Spark plans checks the G-recipes of SURVEY §1.5 rather than re-running the same code.

Each building block is a named CTE with its dependencies; ``sql(body, *needs)`` emits one
``WITH`` clause holding exactly the blocks the query needs, in dependency order.
"""

from __future__ import annotations

from trendscope.sources.bridge import BRIDGE_SQL

# The reference's rules as DuckDB literals (patterns replace the first match
# only in DuckDB). ---------------------------------------------------------------------
US = "'United States'"
VIDEO_ID_RE = "'^[A-Za-z0-9_-]{11}$'"
WHITESPACE_RUN_RE = r"'\s+'"
NONE_LIKE = "('[none]', 'none', 'nan', 'null')"
# ----------------------------------------------------------------------------------------

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, deps: tuple[str, ...], text: str) -> None:
    _CTES[name] = (deps, text)


def _pick(col: str, order: str = "video_trending_date") -> str:
    """Latest non-NULL value, ties broken by the value (the Spark side's deterministic pick)."""
    return f"arg_max({col}, {{'d': {order}, 'v': {col}}}) FILTER (WHERE {col} IS NOT NULL) AS {col}"


_cte("raw", (), BRIDGE_SQL)

_cte("parsed", ("raw",), f"""
SELECT *,
       TRY_CAST(replace(video_trending__date, '.', '-') AS DATE) AS parsed_date,
       regexp_matches(video_id, {VIDEO_ID_RE}) AS valid_id
FROM raw""")

_cte("trending", ("parsed",), """
SELECT video_id,
       TRY_CAST(video_published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS video_published_at,
       parsed_date AS video_trending_date,
       video_trending_country, channel_id, video_title, video_description, video_default_thumbnail,
       TRY_CAST(video_category_id AS INTEGER) AS video_category_id,
       video_tags, video_duration, video_dimension, video_definition,
       TRY_CAST(video_licensed_content AS BOOLEAN) AS video_licensed_content,
       TRY_CAST(video_view_count AS BIGINT) AS video_view_count,
       TRY_CAST(video_like_count AS BIGINT) AS video_like_count,
       TRY_CAST(video_comment_count AS BIGINT) AS video_comment_count,
       channel_title, channel_description, channel_custom_url,
       TRY_CAST(channel_published_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS channel_published_at,
       channel_country,
       TRY_CAST(channel_view_count AS BIGINT) AS channel_view_count,
       TRY_CAST(channel_subscriber_count AS BIGINT) AS channel_subscriber_count,
       TRY_CAST(channel_have_hidden_subscribers AS BOOLEAN) AS channel_have_hidden_subscribers,
       TRY_CAST(channel_video_count AS BIGINT) AS channel_video_count,
       channel_localized_title, channel_localized_description
FROM parsed
WHERE parsed_date IS NOT NULL AND valid_id""")

_cte("us", ("trending",), f"SELECT * FROM trending WHERE video_trending_country = {US}")

_cte("video_dim", ("trending",), "SELECT video_id, " + ", ".join(_pick(c) for c in [
    "video_title", "channel_id", "channel_title", "video_default_thumbnail", "video_category_id",
    "video_duration", "video_definition"]) + " FROM trending GROUP BY video_id")

_cte("video_reach", ("trending",), """
SELECT video_id, count(DISTINCT video_trending_country) AS countries_count
FROM trending GROUP BY video_id""")

_cte("video_stick", ("us",), """
SELECT video_id, count(DISTINCT video_trending_date) AS days_trended_us,
       min(video_trending_date) AS first_trending_us, max(video_trending_date) AS last_trending_us
FROM us GROUP BY video_id""")

_cte("channel_dim", ("trending",), "SELECT channel_id, " + ", ".join(_pick(c) for c in [
    "channel_title", "channel_custom_url", "channel_country"]) + " FROM trending GROUP BY channel_id")

_cte("channel_daily", ("us",), """
SELECT video_trending_date AS date, channel_id,
       count(DISTINCT video_id) AS distinct_videos, count(*) AS appearances,
       CAST(sum(video_view_count) AS BIGINT) AS sum_views,
       CAST(sum(video_like_count) AS BIGINT) AS sum_likes,
       CAST(sum(video_comment_count) AS BIGINT) AS sum_comments
FROM us GROUP BY 1, 2""")

_cte("channel_alltime", ("us",), """
SELECT channel_id,
       count(DISTINCT video_id) AS distinct_videos_alltime,
       count(DISTINCT video_trending_date) AS days_active,
       count(*) AS appearances_alltime,
       min(video_trending_date) AS first_date, max(video_trending_date) AS last_date,
       CAST(sum(video_view_count) AS BIGINT) AS sum_views_alltime,
       CAST(sum(video_like_count) AS BIGINT) AS sum_likes_alltime
FROM us GROUP BY 1""")

_cte("latest_day", ("us",), "SELECT max(video_trending_date) AS d FROM us")

_cte("busy_day", ("us",), """
SELECT video_trending_date AS d FROM us
GROUP BY 1 ORDER BY count(*) DESC, video_trending_date DESC LIMIT 1""")

# Each row's tags as one list: normalised, then filtered. ltrim/rtrim take the leading '#'s
# and the quotes of one side away; only the first white-space run becomes one space.
_cte("tag_events_clean", ("us",), f"""
SELECT DISTINCT video_id, video_trending_date, month, unnest(tags) AS tag
FROM (
  SELECT video_id, video_trending_date, CAST(date_trunc('month', video_trending_date) AS DATE) AS month,
         [t FOR t IN [CASE WHEN starts_with(s, '"') THEN ltrim(s, '"') ELSE rtrim(s, '"') END
                      FOR s IN [regexp_replace(ltrim(lower(trim(x)), '#'), {WHITESPACE_RUN_RE}, ' ')
                                FOR x IN str_split(video_tags, ',')]]
          IF len(t) >= 2 AND len(t) <= 80 AND NOT (starts_with(t, 'yt:') OR contains(t, 'http')
                                                   OR contains(t, 'www.') OR contains(t, '@'))] AS tags
  FROM us)""")

# Both month totals in one pass over the country's rows, told apart by whether the video has
# a tag event in that month.
_cte("tag_monthly_clean", ("tag_events_clean", "us"), """
SELECT month, tag, distinct_videos, tag_rows, total_videos_tagged, total_videos_all,
       distinct_videos / total_videos_tagged AS video_share, distinct_videos / total_videos_all AS video_share_all
FROM (SELECT month, tag, len(list_distinct(list(video_id))) AS distinct_videos, count(*) AS tag_rows
      FROM tag_events_clean GROUP BY ALL)
JOIN (SELECT month, count(*) FILTER (tagged) AS total_videos_tagged, count(*) AS total_videos_all
      FROM (SELECT video_id, CAST(date_trunc('month', video_trending_date) AS DATE) AS month,
                   bool_or((video_id, date_trunc('month', video_trending_date)) IN (SELECT (video_id, month) FROM tag_events_clean))
                     AS tagged
            FROM us GROUP BY ALL)
      GROUP BY month) USING (month)""")

_cte("latest_month", ("tag_monthly_clean",), "SELECT max(month) AS m FROM tag_monthly_clean")

# Pieces between ',' and '|'; '#'s, then one quote, then outer spaces go.
_cte("tag_events_legacy", ("us",), f"""
SELECT video_id, video_trending_date, month, unnest(tags) AS tag
FROM (
  SELECT video_id, video_trending_date, CAST(date_trunc('month', video_trending_date) AS DATE) AS month,
         [t FOR t IN [lower(trim(CASE WHEN starts_with(p, '"') THEN p[2:] WHEN ends_with(p, '"') THEN p[:len(p) - 1] ELSE p END))
                      FOR p IN [ltrim(x, '#') FOR x IN str_split_regex(video_tags, '[,|]') IF trim(x) <> '']]
          IF t <> ''] AS tags
  FROM us
  WHERE coalesce(lower(trim(video_tags)), '') NOT IN ('', {NONE_LIKE[1:-1]}))""")

_cte("month_totals_legacy", ("tag_events_legacy",), """
SELECT month, count(DISTINCT video_id) AS total_videos FROM tag_events_legacy GROUP BY 1""")

# T8 at any rounding: the events of a (month, tag) as a list, its length and distinct length.
_cte("legacy_counts", ("tag_events_legacy", "month_totals_legacy"), """
SELECT month, tag, len(list_distinct(v)) AS distinct_videos, len(v) AS tag_appearances, total_videos,
       len(list_distinct(v)) / total_videos AS share
FROM (SELECT month, tag, list(video_id) AS v FROM tag_events_legacy GROUP BY ALL)
JOIN month_totals_legacy USING (month)""")

_cte("tag_monthly_legacy", ("legacy_counts",), """
SELECT month, tag, distinct_videos, tag_appearances, total_videos, round(share, 8) AS video_share FROM legacy_counts""")

# As T6 but for the pieces (between '|' only) and without their '#'s.
_cte("pipe_tags", ("us",), f"""
SELECT video_id, video_trending_date, unnest(tags) AS tag
FROM (
  SELECT video_id, video_trending_date,
         [t FOR t IN [lower(trim(CASE WHEN starts_with(p, '"') THEN p[2:] WHEN ends_with(p, '"') THEN p[:len(p) - 1] ELSE p END))
                      FOR p IN string_split(video_tags, '|')] IF t <> ''] AS tags
  FROM us
  WHERE coalesce(lower(trim(video_tags)), '') NOT IN ('', {NONE_LIKE[1:-1]}))""")


def movers(table: str, share: str) -> str:
    """Every (month, tag) of ``table`` with the share of the calendar month before: the row
    before it in the tag's months, where that is exactly one month back."""
    return f"""
SELECT month, tag, share_now, share_prev, share_now - share_prev AS delta,
       CASE WHEN share_prev <> 0 THEN share_now / share_prev END AS lift
FROM (SELECT month, tag, {share} AS share_now,
             CASE WHEN lag(12 * year(month) + month(month)) OVER w = 12 * year(month) + month(month) - 1
                  THEN lag({share}) OVER w END AS share_prev
      FROM {table} WINDOW w AS (PARTITION BY tag ORDER BY month))"""


def share_of(condition: str, digits: int) -> str:
    """Percentage of rows that meet the condition."""
    return f"round(100.0 * (count(*) FILTER (WHERE {condition}) / count(*)), {digits})"


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in _CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *needs: str) -> str:
    """``WITH`` the needed blocks (and their dependencies), then ``body``."""
    names = _order(list(needs))
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({_CTES[n][1]}\n)" for n in names)
    return f"WITH {ctes}\n{body}"


def top_k(inner: str, cols: list[str], keys: list[str], limit: int | None) -> str:
    """Order by ``keys`` then by every output column (ascending, NULLs last, by name) and
    keep ``limit`` rows: the same total order as the Spark side's ``reads.top_k``."""
    order = ", ".join(keys + [f"{c} ASC NULLS LAST" for c in sorted(cols)])
    lim = f"\nLIMIT {limit}" if limit is not None else ""
    return f"SELECT * FROM (\n{inner}\n) q\nORDER BY {order}{lim}"


def column_types(table: str, columns: list[str]) -> str:
    """The narrowest type that TRY_CAST takes for every value of a text column, one row per column."""
    tests = {
        "bigint": "TRY_CAST({c} AS BIGINT) IS NOT NULL AND NOT contains({c}, '.') AND NOT contains(lower({c}), 'e')",
        "double": "TRY_CAST({c} AS DOUBLE) IS NOT NULL",
        "boolean": "TRY_CAST({c} AS BOOLEAN) IS NOT NULL",
        "date": "TRY_CAST(replace({c}, '.', '-') AS DATE) IS NOT NULL AND NOT contains({c}, ':')",
        "timestamp": "TRY_CAST({c} AS TIMESTAMPTZ) IS NOT NULL",
    }

    def one(c: str) -> str:
        cases = "\n".join(f"       WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({test.format(c=c)})) = 0 THEN '{kind}'"
                          for kind, test in tests.items())
        return (f"SELECT '{c}' AS column_name,\n  CASE WHEN count({c}) = 0 THEN 'void'\n{cases}\n       ELSE 'string' END AS column_type,\n"
                f"  count({c}) AS n_values FROM {table}")

    return "\nUNION ALL\n".join(one(c) for c in columns)
