"""Per-video marts in buckets: joined on the video id without shuffling them."""

import re

import pytest
from pyspark.sql import functions as F

from trendscope.operators import reads as R
from trendscope.plans import rebuild as B
from trendscope.plans.catalog import CHANNEL, CHANNEL_Q, TAG_INPUT, TAG_MONTH, VIDEO_Q


@pytest.fixture(scope="module")
def marts(spark, tables_small, tmp_path_factory):
    old, B.BUCKET_BYTES = B.BUCKET_BYTES, 4 << 10     # several buckets of a small table
    out = str(tmp_path_factory.mktemp("buckets"))
    try:
        B.build_all(spark, tables_small.raw, out)
    finally:
        B.BUCKET_BYTES = old
    return B.load_marts(spark, out)


@pytest.fixture(scope="module")
def read(marts):
    fact, dim, reach, stick = (marts[n] for n in ("trending", "video_dim", "video_reach", "video_us_stickiness"))
    latest = R.latest_in(marts["us_dates"])
    return {
        "A6": lambda: R.day_trending(fact, dim, date=latest),
        "A7": lambda: R.top(fact, dim, "views", date=latest),
        "A8": lambda: R.top_advanced(fact, dim, stick, "stickiness", date=latest),
        "A9": lambda: R.top_advanced(fact, dim, reach, "reach", date=latest),
        "A13b": lambda: R.channel_videos(fact, dim, reach, CHANNEL, stats=marts["channel_video_us"]),
        "A14b": lambda: R.search_videos(fact, dim, stick, reach, VIDEO_Q, "all"),
        "A14d": lambda: R.search_channels(fact, dim, stick, CHANNEL_Q, "all"),
        "A17": lambda: R.tag_videos(marts["us_tag_events_clean"], fact, dim, TAG_INPUT, TAG_MONTH,
                                    monthly=marts["us_tag_monthly_clean"], stats=marts["video_month_us"]),
    }


def _above_marts(plan: str) -> list[str]:
    """Operators between each bucketed scan and the first join above it."""
    lines = plan.splitlines()
    depth = [len(re.match(r"(?:[: ]  )*", line)[0]) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "FileScan" in line and "Bucketed: true" in line:
            at, level = i, depth[i]
            while at >= 0 and "Join" not in lines[at]:
                at -= 1
                if depth[at] < level:
                    level = depth[at]
                    out.append(lines[at].strip(" :+-*"))
                    if "Join" in lines[at]:
                        break
    return out


@pytest.mark.parametrize("name", ["A6", "A7", "A8", "A9", "A13b", "A14b", "A14d", "A17"])
def test_no_shuffle_above_a_bucketed_mart(spark, read, name):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        df = read[name]()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan, plan
        above = _above_marts(plan)
        assert not any("Exchange" in x for x in above), plan
        if name == "A14b":
            assert "Exchange" not in plan, plan   # three marts joined with no shuffle at all
        got = sorted(map(str, df.collect()))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert got == sorted(map(str, read[name]().collect())) and (got or name in ("A13b", "A17"))


def test_buckets_hold_every_video_once(spark, marts, tables_small):
    from trendscope.operators import marts as M
    for name, want in (("video_dim", M.video_dim(tables_small.trending)), ("video_reach", M.video_reach(tables_small.trending)),
                       ("video_us_stickiness", M.video_stickiness(tables_small.trending))):
        assert len(set(marts[name].inputFiles())) > 1, name
        assert sorted(map(str, marts[name].collect())) == sorted(map(str, want.collect())), name


def test_bucket_count_follows_the_size():
    assert [B.bucket_count(n) for n in (0, 1, B.BUCKET_BYTES, B.BUCKET_BYTES + 1, 100 * B.BUCKET_BYTES)] == [1, 1, 1, 2, 128]
