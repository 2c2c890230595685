"""Exploratory queries of the notebook (E1-E22) and the table profile.

Quantiles (E7, E8, E15, E20) follow the discrete rule (smallest value whose cumulative count
reaches q * n) with the built-in exact aggregate, whose state is a count per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.functions import exprs as X
from trendscope.operators.marts import COUNTRY, DATE, available_dates, in_country, latest_attributes
from trendscope.operators.reads import top_k
from trendscope.schema import DEFAULT_COUNTRY


# Fixed values ---------------------------------------------------------------------------
TOP_N = 20            # rows of the country / video lists
TAG_TOP_N = 50        # rows of the tag boards and the monthly tag list
RISING_TOP_N = 30     # rows of the rising-with-floor list
RISING_FLOOR = 0.002  # minimum current share of a rising tag
EDA_SHARE_DIGITS = 6  # share rounding of the monthly tag list
PROFILE_TOP_N = 15    # worst columns in the missing-value profile
LONG_TAG = 40         # a tag this long or longer counts as long
# ----------------------------------------------------------------------------------------


def _pct(cond: Column, digits: int) -> Column:
    """round(100 * share of rows where ``cond``, digits) as DOUBLE."""
    return F.round(F.lit(100.0) * F.avg(F.when(cond, 1).otherwise(0)), digits)


def discrete_quantiles(df: DataFrame, col: str, qs: dict[str, float], max_name: str) -> DataFrame:
    """One row: for each name -> q, the smallest value v with count(x <= v) >= q * n;
    plus max. NULL values are ignored, as by the quantile aggregates."""
    return df.agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{col}`)").cast(df.schema[col].dataType).alias(name)
                    for name, q in qs.items()], F.max(col).alias(max_name))


_P = {"p50": 0.50, "p90": 0.90, "p99": 0.99}


# --- E1-E11: fact overview -------------------------------------------------------------------------

def overview(trending: DataFrame, country: str | None = None) -> DataFrame:
    """Rows, distinct videos / channels / countries and the date range; with a
    ``country``, E11's one-country overview."""
    if country is not None:
        return country_overview(trending, country)
    t = trending.filter(F.col(DATE).isNotNull())
    return t.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("video_id").alias("distinct_videos"),
        F.count_distinct("channel_id").alias("distinct_channels"),
        F.count_distinct(COUNTRY).alias("countries"),
        F.min(DATE).alias("min_date"),
        F.max(DATE).alias("max_date"))


def country_volume(trending: DataFrame, n: int = TOP_N) -> DataFrame:
    """Top countries by rows."""
    per = trending.filter(F.col(DATE).isNotNull()).groupBy(COUNTRY).agg(
        F.count(F.lit(1)).alias("rows"))
    return top_k(per, [F.col("rows").desc_nulls_last()], n)


def country_coverage(trending: DataFrame, n: int = TOP_N) -> DataFrame:
    """Coverage view ordered by rows."""
    return top_k(available_dates(trending), [F.col("rows").desc_nulls_last()], n)


# Output names of the missing-value percentages.
MISSINGNESS_COLS = {
    "pct_video_tags_null": "video_tags",
    "pct_video_desc_null": "video_description",
    "pct_channel_country_null": "channel_country",
    "pct_like_null": "video_like_count",
    "pct_comment_null": "video_comment_count",
}


def missingness(trending: DataFrame, cols: dict[str, str] | None = None) -> DataFrame:
    """Percentage of NULLs per column, 2 decimals."""
    cols = cols or MISSINGNESS_COLS
    return trending.agg(*[_pct(F.col(c).isNull(), 2).alias(name) for name, c in cols.items()])


def null_dates(trending: DataFrame, by: str | None = None) -> DataFrame:
    """E5: rows and NULL-date rows (expected 0 after cleaning); ``by="country"`` lists the
    countries having NULL dates instead."""
    if by is not None:
        if by != "country":
            raise ValueError("by must be None or 'country'")
        return null_dates_by_country(trending)
    return trending.agg(F.count(F.lit(1)).alias("rows"),
                        F.sum(F.col(DATE).isNull().cast("int")).alias("null_trending_date_rows"))


def null_dates_by_country(trending: DataFrame) -> DataFrame:
    """E5: countries having NULL dates, by rows."""
    per = trending.filter(F.col(DATE).isNull()).groupBy(COUNTRY).agg(F.count(F.lit(1)).alias("rows"))
    return top_k(per, [F.col("rows").desc_nulls_last()], None)


def daily_volume(trending: DataFrame, n: int = TOP_N) -> DataFrame:
    """Busiest (country, day) pairs."""
    per = trending.groupBy(COUNTRY, DATE).agg(F.count(F.lit(1)).alias("rows_that_day"))
    return top_k(per, [F.col("rows_that_day").desc_nulls_last()], n)


def stickiness_dist(trending: DataFrame) -> DataFrame:
    """Distribution of distinct days per (video, country)."""
    per = trending.groupBy("video_id", COUNTRY).agg(F.count_distinct(DATE).alias("days_trended"))
    return discrete_quantiles(per, "days_trended", _P, "max_days")


def reach_dist(trending: DataFrame) -> DataFrame:
    """Distribution of distinct countries per video."""
    per = trending.groupBy("video_id").agg(F.count_distinct(COUNTRY).alias("countries"))
    return discrete_quantiles(per, "countries", _P, "max_countries")


def most_global(trending: DataFrame, n: int = TOP_N) -> DataFrame:
    """Videos trending in the most countries."""
    # distinct (video, titles, country) first: a hash aggregate before the shuffle
    seen = trending.select("video_id", "video_title", "channel_title", COUNTRY).distinct()
    per = seen.groupBy("video_id").agg(
        F.max("video_title").alias("video_title"),
        F.max("channel_title").alias("channel_title"),
        F.count_distinct(COUNTRY).alias("countries"))
    return top_k(per, [F.col("countries").desc_nulls_last()], n)


def stickiest_by_country(trending: DataFrame, n: int = TOP_N) -> DataFrame:
    """Longest-trending (country, video) pairs with their latest non-NULL titles. Rows
    without a country have no pair."""
    keys = [COUNTRY, "video_id"]
    titles = latest_attributes(trending, keys, ["video_title", "channel_title"])
    days = (trending.filter(F.col(COUNTRY).isNotNull()).select(*keys, DATE).distinct()
            .groupBy(*keys).agg(F.count(DATE).alias("days_trended")))
    per = titles.join(days, keys).select(*keys, "video_title", "channel_title", "days_trended")
    return top_k(per, [F.col("days_trended").desc_nulls_last()], n)


def country_overview(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Rows, distinct videos and date range of one country."""
    return in_country(trending, country).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("video_id").alias("distinct_videos"),
        F.min(DATE).alias("min_date"),
        F.max(DATE).alias("max_date"))


# --- E12-E18: raw tag strings ----------------------------------------------------------------------

def tag_availability(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """% of rows with NULL, blank, none-like and usable tag strings."""
    tags = F.col("video_tags")
    return in_country(trending, country).agg(
        _pct(tags.isNull(), 2).alias("pct_null"),
        _pct(tags.isNotNull() & (X.trim_zs(tags) == ""), 2).alias("pct_empty_string"),
        _pct(X.is_none_like(F.coalesce(tags, F.lit(""))), 2).alias("pct_none_like"),
        _pct(X.has_usable_tags(tags), 2).alias("pct_usable"))


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows (LIMIT without order)."""
    return df.limit(n)


def tag_strings(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """E13 source: non-blank raw tag strings of a country."""
    tags = F.col("video_tags")
    return in_country(trending, country).filter(tags.isNotNull() & (X.trim_zs(tags) != "")).select(
        "video_tags")


def tag_format(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """% of tag strings with '|' and with '#', average and max length."""
    tags = F.col("video_tags")
    return tag_strings(trending, country).agg(
        _pct(tags.contains("|"), 2).alias("pct_contains_pipe"),
        _pct(tags.contains("#"), 2).alias("pct_contains_hashtag"),
        F.round(F.avg(F.length(tags)), 1).alias("avg_len"),
        F.max(F.length(tags)).cast("bigint").alias("max_len"))


def _check_sep(sep: str) -> None:
    if sep not in ("pipe", "both"):
        raise ValueError("sep must be pipe or both")


def tags_per_row(trending: DataFrame, country: str = DEFAULT_COUNTRY, sep: str = "pipe") -> DataFrame:
    """Pieces per usable tag string when split on '|' (``sep="pipe"``, the notebook's
    cell) or on ',' and '|' (``sep="both"``): quantiles and max."""
    _check_sep(sep)
    tags = F.col("video_tags")
    pieces = F.split(tags, r"\|", -1) if sep == "pipe" else X.split_tags(tags, pipe_too=True)
    counts = in_country(trending, country).select(
        F.when(X.has_usable_tags(tags), F.size(pieces).cast("bigint")).alias("tag_count"))
    return discrete_quantiles(counts, "tag_count", _P, "max_tags")


def pipe_tags(trending: DataFrame, country: str = DEFAULT_COUNTRY) -> DataFrame:
    """Notebook explode on '|' only (E16-E18): quote stripped on one side, trimmed, lowered."""
    base = in_country(trending, country).filter(X.has_usable_tags("video_tags"))
    tags = F.filter(F.transform(F.split("video_tags", r"\|", -1), X.notebook_tag), lambda t: t != "")
    return base.select("video_id", DATE, F.explode(tags).alias("tag"))


def _tag_board(events: DataFrame, n: int) -> DataFrame:
    per = events.groupBy("tag").agg(
        F.count(F.lit(1)).alias("appearances"),
        F.count_distinct("video_id").alias("distinct_videos"),
        F.count_distinct(DATE).alias("distinct_days"))
    return top_k(per, [F.col("distinct_videos").desc_nulls_last()], n)


def _events(trending: DataFrame, country: str, sep: str) -> DataFrame:
    """Notebook tag events: '|' split with its own chain, or the legacy comma+pipe events."""
    from trendscope.operators.tags import tag_events_legacy
    _check_sep(sep)
    return pipe_tags(trending, country) if sep == "pipe" else tag_events_legacy(trending, country)


def top_tags(trending: DataFrame, country: str = DEFAULT_COUNTRY, sep: str = "both",
             n: int = TAG_TOP_N) -> DataFrame:
    """E16 (``sep='pipe'``) / E21a (``sep='both'``): top tags by distinct videos."""
    return _tag_board(_events(trending, country, sep), n)


def tag_diversity(trending: DataFrame, country: str = DEFAULT_COUNTRY, sep: str = "pipe") -> DataFrame:
    """Exploded rows and unique tags ('|' split by default)."""
    return _events(trending, country, sep).agg(F.count(F.lit(1)).alias("exploded_rows"),
                                               F.count_distinct("tag").alias("unique_tags"))


def tag_spam(trending: DataFrame, country: str = DEFAULT_COUNTRY, sep: str = "pipe") -> DataFrame:
    """Long tags, tags with 'http', tags with '@' ('|' split by default)."""
    t = F.col("tag")
    return _events(trending, country, sep).agg(
        F.sum(F.when(F.length(t) >= LONG_TAG, 1).otherwise(0)).alias("tags_len_ge_40"),
        F.sum(F.when(t.contains("http"), 1).otherwise(0)).alias("tags_with_http"),
        F.sum(F.when(t.contains("@"), 1).otherwise(0)).alias("tags_with_at"))


# --- E20-E22: legacy tag events ------------------------------------------------------------------------

def tags_per_video_day(events: DataFrame) -> DataFrame:
    """Tags per (video, day): quantiles and max."""
    per = events.groupBy("video_id", DATE).agg(F.count(F.lit(1)).alias("tag_count"))
    return discrete_quantiles(per, "tag_count", _P, "max_tags")


def tag_quality(events: DataFrame) -> DataFrame:
    """Totals and % of long, URL-like, mention-like and multi-word tags."""
    t = F.col("tag")
    return events.agg(
        F.count(F.lit(1)).alias("total_tags"),
        F.count_distinct("tag").alias("unique_tags"),
        _pct(F.length(t) >= LONG_TAG, 2).alias("pct_len_ge_40"),
        _pct(t.contains("http"), 4).alias("pct_has_http"),
        _pct(t.contains("@"), 4).alias("pct_has_at"),
        _pct(F.instr(t, " ") > 0, 2).alias("pct_has_spaces"))


def tag_view_stats(events: DataFrame, view_name: str | None = None) -> DataFrame:
    """Register the events as a session view (S5) and count rows and unique tags."""
    if view_name:
        events.createOrReplaceTempView(view_name)
        events = events.sparkSession.table(view_name)
    return events.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("tag").alias("unique_tags"))


def tag_monthly_eda(events: DataFrame, digits: int = EDA_SHARE_DIGITS, n: int = TAG_TOP_N) -> DataFrame:
    """E21d: monthly tag counts with share rounded to ``digits``, newest month first."""
    from trendscope.operators.tags import tag_monthly_legacy
    monthly = tag_monthly_legacy(events, digits=digits)
    return top_k(monthly, [F.col("month").desc_nulls_last(),
                           F.col("distinct_videos").desc_nulls_last()], n)


def rising_floor(events: DataFrame, floor: float = RISING_FLOOR, n: int = RISING_TOP_N) -> DataFrame:
    """Over all months, tags whose unrounded share rose against the calendar-previous
    month, with a noise floor on the current share."""
    from trendscope.operators.tags import lift_col, month_totals_legacy, with_previous_month
    totals = month_totals_legacy(events)
    counts = events.groupBy("month", "tag").agg(F.count_distinct("video_id").alias("distinct_videos"))
    shares = counts.join(F.broadcast(totals), "month", "inner").select(
        "month", "tag", (F.col("distinct_videos").cast("double") / F.col("total_videos")).alias("share"))
    paired = with_previous_month(shares, "tag", "share", "share_prev")
    now, prev = F.col("share"), F.col("share_prev")
    rows = paired.filter(prev.isNotNull() & (now >= F.lit(floor))).select(
        "month", "tag", now.alias("share_now"), prev.alias("share_prev"),
        (now - prev).alias("delta"), lift_col(now, prev).alias("lift"))
    return top_k(rows, [F.col("delta").desc_nulls_last()], n)


# --- S11: profile ---------------------------------------------------------------------------------------

def profile_missing(df: DataFrame, n: int = PROFILE_TOP_N) -> DataFrame:
    """S11 (re-aimed): % missing per column over all rows in one pass, worst ``n``."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = rates.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, rate)")
    out = long.select("column_name", F.round(F.col("rate") * 100.0, 2).alias("pct_missing"))
    return top_k(out, [F.col("pct_missing").desc_nulls_last()], n)


def type_masks(df: DataFrame) -> DataFrame:
    """Per text column the types that the safe casts of all its non-NULL values allow, as a bit
    mask (``exprs.TYPE_BITS``), and the count of these values. All rows, one pass. Masks of
    parts of a table (months, files) merge: ``types_of`` takes their union."""
    # one cell a row; the casts judge the distinct texts that no plain test decides, as the mask of a text is the same
    # wherever it stands
    cells = df.select(F.posexplode(F.array(*[F.col(c) for c in df.columns])).alias("at", "value"))
    tested = cells.withColumn("plain", X.plain_mask("value"))
    texts = (tested.withColumn("text", F.when(F.col("plain").isNull(), F.col("value")))
             .groupBy("at", "plain", "text").agg(F.count("value").alias("n")))
    masks = texts.select("at", "n", F.explode(F.array(F.coalesce("plain", X.type_mask("text")))).alias("mask"))
    per = masks.groupBy("at").agg(F.bit_and("mask").alias("mask"), F.sum("n").alias("n_values"))
    # a table without rows has no cells, but its columns are listed
    found = per.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("mask", "n_values")))).alias("found"))
    named = F.posexplode(F.array(*[F.lit(c) for c in df.columns])).alias("at", "column_name")
    return found.select("found", named).select(
        "column_name", F.col("found")[F.col("at")]["mask"].alias("mask"),
        F.coalesce(F.col("found")[F.col("at")]["n_values"], F.lit(0)).alias("n_values"))


def types_of(masks: DataFrame) -> DataFrame:
    """The narrowest type that is left of the masks of a column: 'double' also where some values
    are whole, 'string' where no type takes all, 'void' without values."""
    merged = masks.groupBy("column_name").agg(F.bit_and("mask").alias("mask"), F.sum("n_values").alias("n_values"))
    kind = F.when(F.col("n_values") == 0, F.lit("void"))
    for name, bit in X.TYPE_BITS.items():
        kind = kind.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, F.lit(name))
    return merged.select("column_name", kind.otherwise(F.lit("string")).alias("column_type"), "n_values")


def profile_types(df: DataFrame) -> DataFrame:
    """The type of every text column by all its values."""
    return types_of(type_masks(df))


def schema_listing(df: DataFrame) -> list[tuple[str, str]]:
    """S11 (notebook form): column names and types of a table; plan metadata only."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def profile(df: DataFrame, head: int = 5, worst: int = PROFILE_TOP_N) -> dict:
    """Columns and types (plan metadata), a ``head`` sample (LIMIT is the feature) and
    the ``worst`` missing-value rates over all rows, each missing rate from one pass."""
    return {
        "columns": schema_listing(df),
        "head": sample_rows(df, head),
        "missing": profile_missing(df, worst),
        "types": profile_types(df.select([F.col(c).cast("string").alias(c) for c in df.columns])),
    }
