"""The known mismatches between the clean (T1), legacy (T6) and lookup (T13) tag rules are
kept in parity mode (SURVEY §2.5); each one is pinned here on a tiny inline fact."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendscope.functions.exprs import lookup_tag
from trendscope.operators import tags as T

US = "United States"


@pytest.fixture(scope="module")
def fact(spark):
    rows = [
        ("v1", dt.date(2020, 1, 5), US, 'a",[none] x,1 | urgent, #b,"foo ",https://z,#ok'),
        ("v2", dt.date(2020, 1, 6), US, "[none]"),
    ]
    return spark.createDataFrame(
        rows, "video_id string, video_trending_date date, video_trending_country string, video_tags string")


def _tags(df):
    return {r.tag for r in df.select("tag").collect()}


def test_lookup_cannot_reach_a_stored_trailing_quote(spark, fact):
    """Mismatch 1: T1 keeps 'a"'-style tags only on one side; T13 strips quotes, so the
    lookup key of 'a"' is 'a' (and a 1-character tag is not stored at all)."""
    clean = _tags(T.tag_events_clean(fact))
    key = spark.range(1).select(lookup_tag(F.lit('a"'))).first()[0]
    assert key == "a" and key not in clean


def test_none_like_kept_by_clean_dropped_by_legacy(fact):
    """Mismatch 2: '[none]' survives T1 as a tag; T6 drops the whole none-like string."""
    assert "[none]" in _tags(T.tag_events_clean(fact))
    legacy = T.tag_events_legacy(fact)
    assert legacy.filter(F.col("video_id") == "v2").count() == 0


def test_pipe_split_only_in_legacy(fact):
    """Mismatch 3: T1 does not split on '|', T6 does."""
    assert "1 | urgent" in _tags(T.tag_events_clean(fact))
    legacy = _tags(T.tag_events_legacy(fact))
    assert "urgent" in legacy and "1 | urgent" not in legacy


def test_hash_strip_before_trim_in_legacy(fact):
    """Mismatch 4: T6 strips '#' before trimming, so ' #b' keeps its '#'; T1 trims first."""
    assert "#b" in _tags(T.tag_events_legacy(fact))
    assert "#b" not in _tags(T.tag_events_clean(fact))   # T1: trim, strip '#', then 'b' is too short
    assert "ok" in _tags(T.tag_events_clean(fact))


def test_no_retrim_after_quote_strip(fact):
    """Mismatch 5: T1 strips the leading quote run of '"foo "' and does not re-trim."""
    assert 'foo "' in _tags(T.tag_events_clean(fact))


def test_url_tags_dropped_by_clean_kept_by_legacy(fact):
    """Mismatch 6 (http implies https) and the junk filter exists only in T1."""
    assert not any("http" in t for t in _tags(T.tag_events_clean(fact)))
    assert "https://z" in _tags(T.tag_events_legacy(fact))
