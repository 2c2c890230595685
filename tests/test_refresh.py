"""S10 by month: a refresh equals a full build and writes the touched months only."""

import os
import time

import pytest
from pyspark.sql import functions as F

from trendscope.plans import rebuild as B
from trendscope.sources import files
from trendscope.sources.bridge import table_path


def _drop(raw, landing, name):
    """One CSV file of the rows."""
    folder = f"{landing}-parts/{name}"
    (raw.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder))
    os.makedirs(landing, exist_ok=True)
    part = next(f for f in os.listdir(folder) if f.endswith(".csv"))
    os.link(f"{folder}/{part}", f"{landing}/{name}.csv")


def _rows(df, name):
    df = df.select(sorted(c for c in df.columns))
    return sorted(map(str, df.collect())) if name != "rejects" else None


def _same_as_full(spark, landing, out, tmp_path, legacy=False):
    full = str(tmp_path / f"full-{time.time_ns()}")
    report = B.build_all(spark, landing, full, legacy=legacy)
    want, got = B.load_marts(spark, full), B.load_marts(spark, out)
    assert set(want) == set(got)
    for name in want:
        assert _rows(got[name], name) == _rows(want[name], name), name
    return report


def _written(out, run, table):
    path = f"{out}/{run}/{table}"
    return sorted(d.split("=")[1] for d in os.listdir(path) if "=" in d) if os.path.isdir(path) else []


@pytest.fixture(scope="module")
def raw(spark, tables_small):
    return tables_small.raw.filter(F.col("video_trending__date").rlike("^1996|^1997|^not") & (F.expr("hash(video_title) % 4") == 0)).cache()


def _month(m):
    return F.col("video_trending__date").startswith(m.replace("-", ".")) | F.col("video_trending__date").startswith(m.replace("-", "/"))


def test_refresh_by_month(spark, raw, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    new = _month("1997-03")
    _drop(raw.filter(~new & F.col("video_trending__date").startswith("1996")), landing, "early")
    _drop(raw.filter(~new & ~F.col("video_trending__date").startswith("1996")), landing, "late")
    first = B.build_all(spark, landing, out, legacy=True)
    assert first["raw_quality"]["total_raw"] == raw.filter(~new).count() and first["raw_quality"]["bad_date_rows"] > 0

    # nothing changed: the run stays
    assert B.refresh(spark, landing, out)["run"] == first["run"]

    # a month appended: that month is written, the others stay where they are
    _drop(raw.filter(new), landing, "appended")
    second = B.refresh(spark, landing, out, legacy=True)
    assert [str(m) for m in second["months"]] == ["1997-03-01"]
    for table in sorted(B.PARTITIONS):
        assert _written(out, second["run"], table) == ["1997-03-01"], table
    report = _same_as_full(spark, landing, out, tmp_path, legacy=True)
    assert {k: report[k] for k in ("raw_quality", "clean_quality")} == {k: second[k] for k in ("raw_quality", "clean_quality")}
    old = B.load_marts(spark, out, first["run"])["trending"]     # readers of the run before keep it
    assert old.count() == first["clean_quality"]["total_clean"]

    # rows that repeat, more of a month that is there: both runs' months join
    _drop(raw.filter(_month("1997-03") | _month("1997-05")), landing, "again")
    third = B.refresh(spark, landing, out, legacy=True)
    assert [str(m) for m in third["months"]] == ["1997-03-01", "1997-05-01"]
    _same_as_full(spark, landing, out, tmp_path, legacy=True)
    assert third["clean_quality"]["total_clean"] == B.load_marts(spark, out)["trending"].count()

    # a file removed and one changed: their months come from the files that are left
    os.unlink(f"{landing}/appended.csv")
    os.unlink(f"{landing}/early.csv")
    _drop(raw.filter(_month("1996-07") | _month("1996-08")), landing, "early2")
    os.rename(f"{landing}/early2.csv", f"{landing}/early.csv")
    fourth = B.refresh(spark, landing, out, legacy=True)
    assert {str(m)[:4] for m in fourth["months"]} == {"1996", "1997"}
    _same_as_full(spark, landing, out, tmp_path, legacy=True)
    assert _written(out, fourth["run"], "trending") == ["1996-07-01", "1996-08-01", "1997-03-01"]

    names = B.create_views(spark, out)
    try:
        marts = B.load_marts(spark, out)
        for name in ("trending", "us_tag_monthly_clean", "trending_raw", "video_dim"):
            view = spark.table(name)
            assert _rows(view, name) == _rows(marts[name].select(view.columns), name), name
        assert spark.table("v_available_dates").count() > 0
    finally:
        for name in names:
            spark.sql(f"DROP VIEW IF EXISTS `{name}`")


def test_refresh_prunes_months(spark, raw, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    _drop(raw.filter(_month("1996-07") | _month("1996-08")), landing, "a")
    B.build_all(spark, landing, out)
    _drop(raw.filter(_month("1996-09")), landing, "b")
    B.refresh(spark, landing, out)
    fact = B.load_marts(spark, out)["trending"]
    plan = fact.filter("trending_month = date'1996-09-01'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(trending_month") + plan.count("LocalTableScan") >= 1
    assert fact.filter("trending_month = date'1996-09-01'").count() == raw.filter(_month("1996-09")).filter(
        "video_id is not null and video_id not like 'bad id%'").count()


def test_refresh_needs_a_manifest(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        B.refresh(spark, str(tmp_path), out)
    B.build_all(spark, raw, out)
    with pytest.raises(ValueError):
        B.refresh(spark, str(tmp_path), out)


def test_scan_state_follows_files_and_not_reads(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).repartition(2).write.parquet(path)
    read = lambda: spark.read.schema("id long").parquet(path)
    state = files.scan_state(spark, read())
    assert state[0] == 2
    read().collect()
    part = next(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet"))
    os.utime(part, (1, os.stat(part).st_mtime))                  # a time of access
    assert files.scan_state(spark, read()) == state
    os.utime(part, (1, os.stat(part).st_mtime + 5))              # a file of equal size, written later
    assert files.scan_state(spark, read()) != state
    assert len(files.scan_state(spark, spark.read.parquet(table_path("/root/testdata/sf0.001", "part")))) == 3


def test_partials_merge_to_the_marts(spark, tables_small):
    """Marts and figures from month partials equal those of the fact."""
    from trendscope.operators import explore as E
    from trendscope.operators import marts as M
    from trendscope.operators import partials as P
    from trendscope.operators import reads as R
    t = tables_small.trending
    odd = F.month("video_trending_date") % 2 == 1
    both = lambda f, *a: f(t.filter(odd), *a).unionByName(f(t.filter(~odd), *a))
    places, days = both(P.video_places), both(P.country_days)
    for got, want in (
            (P.video_profile(places, both(P.video_versions)), M.video_profile(t)),
            (P.channel_dim(both(P.channel_versions)), M.channel_dim(t)),
            (P.channel_video_stats(both(P.channel_video_months)), M.channel_video_stats(t)),
            (both(P.channel_days).drop("month"), M.channel_daily(t)),
            (P.available_dates(days), M.available_dates(t)), (P.country_dates(days), M.country_dates(t)),
            (P.country_coverage(days), E.country_coverage(t)), (P.daily_volume(days), E.daily_volume(t)),
            (P.stickiness_dist(places), E.stickiness_dist(t)), (P.reach_dist(places), E.reach_dist(t)),
            (P.country_dates(days).limit(1).select(F.col("date").alias("latest_date")), R.latest_date(t))):
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert [d for _, d in got.select(want.columns).dtypes] == [d for _, d in want.dtypes]


def test_partials_hash_before_the_shuffle(tables_small):
    from trendscope.operators import partials as P
    plan = P.video_places(tables_small.trending)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and plan.count("Exchange") == 1 and "Expand" not in plan and "SortAggregate" not in plan
