"""Argument contract and plan shape: the predicates and strategies that make
the queries scale (pushdown to the scans, top-k without a global sort, no cartesian join)."""

import pytest

from trendscope.operators import kpis as K
from trendscope.operators import reads as R
from trendscope.plans.catalog import CATALOG, Tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bad_arguments_raise(tables_small):
    t = tables_small
    with pytest.raises(ValueError):
        R.top(t.trending, t.video_dim, metric="comments")
    with pytest.raises(ValueError):
        R.top(t.trending, t.video_dim, limit="many")
    with pytest.raises(ValueError):
        R.top_advanced(t.trending, t.video_dim, t.video_stick, metric="views")
    with pytest.raises(ValueError):
        R.search_videos(t.trending, t.video_dim, t.video_stick, t.video_reach, "a")
    with pytest.raises(ValueError):
        R.search_channels(t.trending, t.video_dim, t.video_stick, "abc", scope="week")
    with pytest.raises(ValueError):
        R.tag_videos(t.events, t.trending, t.video_dim, "", None)
    with pytest.raises(ValueError):
        R.country_trending(t.trending, "")
    with pytest.raises(ValueError):
        R.top(t.trending, t.video_dim, date="2024-13-45")


def test_limits_are_clamped(tables_small):
    t = tables_small
    assert R.top(t.trending, t.video_dim, limit=1000).count() <= 50
    assert R.top(t.trending, t.video_dim, limit=0, date=t.busy_day).count() == 1


def test_unknown_ids_give_empty_results(tables_small):
    t = tables_small
    assert R.video_card(t.video_dim, t.video_reach, t.video_stick, "nope").count() == 0
    assert R.channel_card(t.channel_dim, t.channel_alltime, "nope").count() == 0
    assert K.kpi_video_history(t.trending, "nope").first().trending_days == 0


def test_day_text_is_whole(tables_small):
    assert R.parse_day(" 2024/1/5 ").isoformat() == "2024-01-05"
    for bad in ("2024-01-05junk", "2024", "x", None):
        with pytest.raises(ValueError):
            R.parse_day(bad)
    assert R.parse_month("2024-01-05junk").isoformat() == "2024-01-05"   # months are cut to 10 characters


def test_building_a_query_starts_no_job(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.trending.count()                                   # the stored fact is there
    for name, entry in CATALOG.items():
        spark.sparkContext.setJobGroup("build", name)
        entry.build(Tables(spark, "/root/testdata/sf0.001"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("build")
        assert not jobs, name


def test_month_queries_prune_partitions(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for name in ("tags_top_month", "tags_rising_month", "tag_videos_views"):
        scans = [x for x in _plan(CATALOG[name].build(t)).splitlines() if "FileScan" in x and "video_tags" in x]
        assert scans and all("PartitionFilters: [" in x and "trending_month" in x.split("PartitionFilters: ")[1].split("]")[0]
                             for x in scans), (name, scans)


def test_kpi_tags_scans(spark):
    """Distinct scans of the fact; the plan's text repeats the month's subquery in each filter."""
    import re
    plan = _plan(CATALOG["kpi_tags"].build(Tables(spark, "/root/testdata/sf0.001")))
    scans = {re.search(r"video_trending_date#(\d+)", x)[1] for x in plan.splitlines() if "FileScan" in x}
    assert len(scans) <= 4, plan


def test_dimension_marts_hash_before_the_shuffle(spark):
    from trendscope.operators import marts as M
    t = Tables(spark, "/root/testdata/sf0.001")
    profile = M.video_profile(t.trending)
    for df in (t.video_dim, t.channel_dim, t.channel_alltime, CATALOG["most_global"].build(t),
               CATALOG["stickiest_by_country"].build(t), profile):
        plan = _plan(df)
        assert "Expand" not in plan
        above = [a for a, b in zip(plan.splitlines(), plan.splitlines()[1:]) if "Project" in b or "FileScan" in b]
        assert not any("SortAggregate" in a for a in above), plan


def test_country_filter_reaches_nation_scan(tables_small):
    from trendscope.operators import ingest as I
    plan = _plan(R.latest_date(I.clean(tables_small.raw)))
    nation_scan = [line for line in plan.splitlines() if "nation" in line and "FileScan" in line]
    assert nation_scan, plan
    # the raw video-id and date rules are pushed below the joins, into the lineitem side
    assert "RLIKE" in plan.split("FileScan")[0] or "rlike" in plan.lower()


def test_cleaning_parses_each_value_once(tables_small, tmp_path):
    """Pattern calls of the cleaning plan: the id, the date and two timestamps at most once each (two
    replacements for ISO text), seven numbers; none of them in a plain text's path."""
    from trendscope.operators import ingest as I
    path = str(tmp_path / "raw")
    tables_small.raw.limit(10).write.parquet(path)
    plan = I.clean(tables_small.spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 0
    assert plan.count("RLIKE") <= 8 and plan.count("regexp_replace") <= 2 * 3 + 7
    assert plan.count("video_trending__date") and "Generate explode" in plan
    assert tables_small.spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_topk_is_take_ordered(tables_small):
    t = tables_small
    plan = _plan(R.top(t.trending, t.video_dim, "views", date=t.busy_day))
    assert "TakeOrderedAndProject" in plan


def test_no_cartesian_products(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    for name, entry in CATALOG.items():
        plan = _plan(entry.build(t))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_literal_date_is_pushed_to_scan(spark, tmp_path, tables_small):
    path = str(tmp_path / "fact")
    tables_small.trending.write.parquet(path)
    fact = spark.read.parquet(path)
    plan = _plan(R.country_trending(fact, "United States", date="1998-12-01"))
    assert "PushedFilters" in plan and "video_trending_date" in plan.split("PushedFilters")[1][:400]


def test_cluster_conf_sizes_from_input():
    from trendscope.session import cluster_conf
    big = cluster_conf(100 * 1024 ** 4)            # 100 TB
    assert big["spark.sql.shuffle.partitions"] == "409600"   # 256 MB each
    assert big["spark.sql.adaptive.enabled"] == "true"
    assert big["spark.sql.session.timeZone"] == "UTC"
    small = cluster_conf(10 * 1024 ** 3)           # 10 GB
    assert small["spark.sql.shuffle.partitions"] == "200"
    mid = cluster_conf(10 * 1024 ** 4)             # 10 TB -> 40960 partitions of 256 MB
    assert mid["spark.sql.shuffle.partitions"] == "40960"



def test_signature_conveniences(tables_small):
    from trendscope.operators import explore as E
    t = tables_small.trending
    assert E.overview(t, "United States").collect() == E.country_overview(t).collect()
    assert E.null_dates(t, by="country").count() == 0
    with pytest.raises(ValueError):
        E.null_dates(t, by="channel")
    with pytest.raises(ValueError):
        E.tags_per_row(t, sep="tab")
    both = E.tags_per_row(t, sep="both").first()
    pipe = E.tags_per_row(t, sep="pipe").first()
    assert both.max_tags > pipe.max_tags      # commas also separate
    assert E.tag_diversity(t, sep="both").first().exploded_rows == tables_small.events_legacy.count()



def test_profile_of_raw(tables_small):
    from trendscope.operators import explore as E
    from trendscope.schema import RAW_COLUMNS
    prof = E.profile(tables_small.raw)
    assert [c for c, _ in prof["columns"]] == RAW_COLUMNS
    assert prof["head"].count() == 5
    worst = prof["missing"].collect()
    assert len(worst) == 15 and worst[0].pct_missing >= worst[-1].pct_missing
