"""Invariants of SURVEY §5 (layer 3) and the fixture's verified shape (FIXTURES.md)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendscope.operators import explore as E
from trendscope.operators import ingest as I
from trendscope.operators import reads as R
from trendscope.operators import tags as T


def test_fixture_shape_sf001(tables_mid):
    t = tables_mid
    q = I.raw_quality(t.raw).first()
    assert (q.total_raw, q.bad_date_rows, q.invalid_video_id_rows, q.null_video_id_rows) == (60000, 1205, 578, 573)
    assert t.trending.count() == 57665
    assert I.rejects(t.raw).count() == 1775
    assert t.events.count() == 34448
    assert t.events_legacy.count() == 52456


def test_rows_reconcile(tables_small):
    """rejects + clean + (NULL id with a good date) = raw."""
    t = tables_small
    raw = t.raw.count()
    clean = t.trending.count()
    rejects = I.rejects(t.raw).count()
    null_good = (t.raw.filter(F.col("video_id").isNull())
                 .filter(~F.translate("video_trending__date", ".", "-").rlike("^[a-z]")).count())
    q = I.clean_quality(t.raw).first()
    assert q.null_date_clean == 0
    assert q.dropped == raw - clean
    assert raw == clean + rejects + null_good


def test_share_bounds(tables_small):
    m = tables_small.monthly
    bad = m.filter((F.col("video_share") <= 0) | (F.col("video_share") > 1)
                   | (F.col("video_share_all") > F.col("video_share"))
                   | (F.col("distinct_videos") > F.col("tag_rows")))
    assert bad.count() == 0


def test_stickiness_bounded_by_dates(tables_small):
    t = tables_small
    n_dates = R.dates(t.trending).count()
    assert t.video_stick.agg(F.max("days_trended_us")).first()[0] <= n_dates


def test_rising_lift_null_without_previous(tables_small):
    rows = R.tags_rising(tables_small.monthly, limit=200)
    assert rows.filter(F.col("share_prev").isNull() & F.col("lift").isNotNull()).count() == 0
    falling = R.tags_falling(tables_small.monthly, limit=200)
    assert falling.filter(F.col("share_prev").isNull()).count() == 0


def test_previous_month_is_calendar_not_lag(spark):
    """A gap month gives NULL; January pairs with December; plain lag would differ."""
    rows = [("2020-01-01", "a", 0.1), ("2020-02-01", "a", 0.2), ("2020-04-01", "a", 0.4),
            ("2019-12-01", "b", 0.5), ("2020-01-01", "b", 0.0), ("2020-02-01", "b", 0.3)]
    df = spark.createDataFrame(rows, "month string, tag string, video_share double").withColumn(
        "month", F.to_date("month"))
    got = {(str(r.month), r.tag): (r.share_prev, r.lift)
           for r in T.tag_movers(df).collect()}
    assert got[("2020-02-01", "a")] == (0.1, 2.0)
    assert got[("2020-04-01", "a")] == (None, None)        # March missing
    assert got[("2020-01-01", "b")] == (0.5, 0.0)          # January <- December
    assert got[("2020-02-01", "b")] == (0.0, None)         # previous share 0 -> lift NULL
    lagged = df.withColumn("p", F.lag("video_share").over(Window.partitionBy("tag").orderBy("month")))
    assert lagged.filter((F.col("tag") == "a") & (F.col("month") == "2020-04-01")).first().p == 0.2


def test_discrete_quantiles_rule(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    r = E.discrete_quantiles(df, "x", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "mx").first()
    assert (r.p50, r.p90, r.p99, r.mx) == (4, 8, 9, 9)
    df7 = spark.range(7).withColumnRenamed("id", "x")
    r = E.discrete_quantiles(df7, "x", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "mx").first()
    assert (r.p50, r.p90, r.p99) == (3, 6, 6)


def test_strict_mode_uses_lookup_rules(tables_small):
    strict = T.tag_events_clean(tables_small.trending, mode="strict")
    tags = {r.tag for r in strict.select("tag").distinct().collect()}
    assert "[none]" not in tags                      # none-like strings dropped
    assert "urgent" in tags and "1" not in tags      # '|' splits; 1-char piece filtered
    assert not any(t.endswith('"') or t.startswith('"') for t in tags)
