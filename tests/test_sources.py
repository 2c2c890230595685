"""Sources and sinks: CSV reader (S1/S2), rebuild (S3, S6, S7, S10), views (S4/S5), S8."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from trendscope.operators import ingest as I
from trendscope.operators import reads as R
from trendscope.plans.rebuild import build_all, current_run, load_marts
from trendscope.schema import RAW_COLUMNS
from trendscope.sources import files


def _csv_line(values):
    out = []
    for v in values:
        if v is None:
            out.append("")
        else:
            out.append('"' + v.replace('"', '""') + '"')
    return ",".join(out)


def test_read_raw_csv(spark):
    folder = tempfile.mkdtemp(prefix="trendscope-csv-")
    base = {c: None for c in RAW_COLUMNS}
    r1 = dict(base, video_id="abcdefghijk", video_trending__date="2024.01.05",
              video_title='line one\nline "two"', video_view_count="NaN", video_tags="",
              video_trending_country="United States")
    r2 = dict(base, video_id="bad", video_trending__date="2024", video_view_count="3.7",
              video_trending_country="United States")
    with open(os.path.join(folder, "raw.csv"), "w") as fh:
        fh.write(",".join(RAW_COLUMNS) + "\n")
        for r in (r1, r2):
            fh.write(_csv_line([r[c] for c in RAW_COLUMNS]) + "\n")
    raw = files.read_raw(spark, folder)
    rows = raw.orderBy("video_id").collect()
    assert len(rows) == 2
    first = [r for r in rows if r.video_id == "abcdefghijk"][0]
    assert first.video_title == 'line one\nline "two"'
    assert first.video_tags is None                   # empty quoted field reads as NULL
    assert first.video_description is None
    clean = I.clean(raw).collect()
    assert len(clean) == 1 and clean[0].video_view_count is None   # 'NaN' -> NULL
    q = I.raw_quality(raw).first()
    assert (q.total_raw, q.bad_date_rows, q.invalid_video_id_rows) == (2, 1, 1)


@pytest.fixture(scope="module")
def built(spark, tables_small):
    out = tempfile.mkdtemp(prefix="trendscope-build-")
    report = build_all(spark, tables_small.raw, out, legacy=True)
    return out, report


def test_rebuild_matches_direct_plans(spark, tables_small, built):
    out, report = built
    assert report["raw_quality"]["total_raw"] == 6000
    assert current_run(spark, out) == report["run"]
    m = load_marts(spark, out)
    t = tables_small
    cols = [c for c in t.trending.columns]
    assert m["trending"].select(cols).exceptAll(t.trending).count() == 0
    assert m["trending"].count() == t.trending.count()
    for name, direct in [("video_dim", t.video_dim), ("video_reach", t.video_reach),
                         ("video_us_stickiness", t.video_stick), ("channel_us_alltime", t.channel_alltime),
                         ("us_tag_events_clean", t.events), ("us_tag_monthly_clean", t.monthly),
                         ("us_tag_monthly", t.monthly_legacy)]:
        stored = m[name].select(direct.columns)
        assert stored.exceptAll(direct).count() == 0 and direct.exceptAll(stored).count() == 0, name


def test_reads_on_stored_marts_prune_partitions(spark, tables_small, built):
    out, _ = built
    m = load_marts(spark, out)
    day = R.busiest_date(tables_small.trending).first()[0].isoformat()
    stored = R.top(m["trending"], m["video_dim"], "views", date=day)
    direct = R.top(tables_small.trending, tables_small.video_dim, "views", date=day)
    assert stored.collect() == direct.collect()
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "trending_month" in plan


def test_page_marts_give_the_same_answers(spark, tables_small, built):
    """A13b/A17/K3/K8 from the stored per-video marts equal the per-request aggregation."""
    from trendscope.operators import kpis as K
    from trendscope.plans.catalog import CHANNEL, TAG_INPUT
    out, _ = built
    m = load_marts(spark, out)
    f, dim, reach = m["trending"], m["video_dim"], m["video_reach"]
    ev, monthly = m["us_tag_events_clean"], m["us_tag_monthly_clean"]
    for channel in [CHANNEL, "UC_Brand#13", "no such channel"]:
        a = R.channel_videos(f, dim, reach, channel, limit=500)
        b = R.channel_videos(f, dim, reach, channel, limit=500, stats=m["channel_video_us"])
        assert a.collect() == b.collect()
        assert (K.kpi_channel_videos(f, dim, reach, channel).collect()
                == K.kpi_channel_videos(f, dim, reach, channel, stats=m["channel_video_us"]).collect())
    for month in [None, "1998-12-01"]:
        a = R.tag_videos(ev, f, dim, TAG_INPUT, month, limit=200, monthly=monthly)
        b = R.tag_videos(ev, f, dim, TAG_INPUT, month, limit=200, monthly=monthly, stats=m["video_month_us"])
        assert a.collect() == b.collect()
        assert (K.kpi_tag_videos(ev, f, dim, TAG_INPUT, month, monthly=monthly).collect()
                == K.kpi_tag_videos(ev, f, dim, TAG_INPUT, month, monthly=monthly,
                                    stats=m["video_month_us"]).collect())


def test_video_page_from_video_major_projection(spark, tables_small, built):
    """A10b/A10c/K4/K5 read the stored video-major projection and give the fact's answers."""
    from trendscope.operators import kpis as K
    from trendscope.plans.catalog import VIDEO
    out, _ = built
    m = load_marts(spark, out)
    vd, f = m["video_days"], m["trending"]
    for vid in ["vid00000001", "vid00000150", VIDEO, "nope"]:
        assert R.video_history(vd, vid).collect() == R.video_history(f, vid).collect()
        assert R.video_spread(vd, vid).collect() == R.video_spread(f, vid).collect()
        assert K.kpi_video_history(vd, vid).collect() == K.kpi_video_history(f, vid).collect()
        assert K.kpi_video_spread(vd, vid).collect() == K.kpi_video_spread(f, vid).collect()
    df = R.video_history(vd, VIDEO)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(video_id," in plan.split("PushedFilters")[1].split("\n")[0]


def test_registered_marts_answer_sql(spark, tables_small, built):
    """Stored tables and the derived views are queryable by name with spark.sql."""
    from trendscope.plans.rebuild import register_marts
    out, _ = built
    names = register_marts(spark, load_marts(spark, out))
    assert {"trending", "video_dim", "v_available_dates", "v_us_dates", "v_us_tag_months_clean"} <= set(names)
    got = spark.sql("SELECT video_trending_date FROM v_us_dates ORDER BY video_trending_date DESC LIMIT 1").first()[0]
    assert got == R.latest_date(tables_small.trending).first()[0]
    assert spark.sql("SELECT count(*) FROM v_available_dates").first()[0] == \
        tables_small.trending.select("video_trending_country").distinct().count()
    assert spark.sql("SELECT count(*) FROM v_us_tag_months_clean").first()[0] == \
        tables_small.monthly.select("month").distinct().count()
    assert "trending_month" not in spark.table("trending").columns
    assert files.monthly_source(spark).count() == tables_small.monthly.count()


def test_rebuild_switches_only_after_success(spark, tables_small, built, monkeypatch):
    """A failure after the third table leaves readers on the previous run."""
    out, report = built
    written, real = [], files.materialize

    def failing(df, path, **kw):
        if len(written) >= 3:
            raise RuntimeError("lost")
        written.append(path)
        real(df, path, **kw)

    monkeypatch.setattr(files, "materialize", failing)
    with pytest.raises(RuntimeError):
        build_all(spark, tables_small.raw, out)
    assert len(written) == 3
    assert current_run(spark, out) == report["run"]
    assert load_marts(spark, out)["trending"].count() == tables_small.trending.count()


def test_missing_core_tables_are_not_hidden(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        current_run(spark, str(tmp_path))
    with pytest.raises(Exception):
        load_marts(spark, str(tmp_path), "run-x")


def test_views_of_the_catalogue(spark, tables_small, built):
    """Views by CREATE OR REPLACE VIEW, not bound to a session's frames."""
    from trendscope.plans.rebuild import create_views
    out, _ = built
    spark.sql("CREATE DATABASE IF NOT EXISTS marts_test")
    old = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase("marts_test")
    try:
        names = create_views(spark, out)
        assert {"trending", "video_dim", "v_us_dates", "v_us_tag_months_clean"} <= set(names)
        other = spark.newSession()
        assert other.sql("SELECT count(*) FROM marts_test.trending").first()[0] == tables_small.trending.count()
        assert "trending_month" not in other.table("marts_test.trending").columns
    finally:
        spark.catalog.setCurrentDatabase(old)
        spark.sql("DROP DATABASE marts_test CASCADE")


def test_tag_series_falls_back_by_catalogue(spark, tables_small):
    """S8 in A18: the clean table if the catalogue has one, else the legacy table."""
    from trendscope.plans.catalog import LEGACY_TAG_INPUT
    for view in ("us_tag_monthly_clean", "us_tag_monthly"):
        spark.catalog.dropTempView(view)
    files.register_views({"us_tag_monthly": tables_small.monthly_legacy})
    legacy = R.tag_series(LEGACY_TAG_INPUT)
    assert legacy.collect() == R.tag_series(LEGACY_TAG_INPUT, monthly_legacy=tables_small.monthly_legacy).collect()
    files.register_views({"us_tag_monthly_clean": tables_small.monthly})
    clean = R.tag_series(LEGACY_TAG_INPUT)
    assert clean.columns == legacy.columns
    assert clean.collect() == R.tag_series(LEGACY_TAG_INPUT, monthly_clean=tables_small.monthly).collect()


def test_appended_input_is_read(spark, tmp_path):
    """A query after an append reads the new rows: the stored fact follows the input's files."""
    import shutil
    from trendscope.plans.catalog import CATALOG, Tables, stored_fact
    sf = str(tmp_path)
    for name in ("orders", "customer", "nation", "part"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", f"{sf}/{name}.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    half = F.col("l_orderkey") % 2
    lines.filter(half == 0).write.parquet(f"{sf}/lineitem.parquet")

    def rows():
        t = Tables(spark, sf)
        return (CATALOG["overview"].build(t).first()["rows"],
                CATALOG["clean_quality"].build(t).first()["total_clean"])

    first = rows()
    assert first[0] == first[1]
    assert Tables(spark, sf).trending is Tables(spark, sf).trending          # kept while nothing changes
    lines.filter(half == 1).write.mode("append").parquet(f"{sf}/lineitem.parquet")
    second = rows()
    assert second[0] == second[1] > first[0]


def test_checkpoint_folder_must_be_shared_on_a_cluster(monkeypatch):
    from trendscope import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_dir(Cluster())


def test_views_and_monthly_source(spark, tables_small):
    files.register_views({"us_tag_monthly": tables_small.monthly_legacy})
    assert files.table_exists(spark, "US_TAG_MONTHLY")
    legacy = files.monthly_source(spark, clean_name="us_tag_monthly_clean_absent")
    assert legacy.columns == ["month", "tag", "video_share", "distinct_videos", "total_videos"]
    files.register_views({"us_tag_monthly_clean": tables_small.monthly})
    clean = files.monthly_source(spark)
    assert clean.count() == tables_small.monthly.count()


def test_streaming_ingest_equals_batch_clean(spark, tables_small):
    """S1 + C6 as a file stream: two CSV drops, two availableNow runs, same rows as batch."""
    from trendscope.streaming import start_ingest
    from trendscope.schema import TRENDING_COLUMNS
    root = tempfile.mkdtemp(prefix="trendscope-stream-")
    raw = tables_small.raw
    early = F.coalesce(F.col("video_trending__date"), F.lit("")) < F.lit("1998")
    part1, part2 = raw.filter(early), raw.filter(~early)
    for i, part in enumerate([part1, part2]):
        (part.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .csv(f"{root}/drop{i}"))
    landing = f"{root}/landing"
    os.makedirs(landing)
    fact = f"{root}/fact"
    for i in range(2):
        for f in os.listdir(f"{root}/drop{i}"):
            if f.endswith(".csv"):
                os.link(f"{root}/drop{i}/{f}", f"{landing}/drop{i}-{f}")
        q = start_ingest(spark, landing, fact, checkpoint=f"{root}/ckpt")
        q.awaitTermination(120)
    got = spark.read.parquet(fact).select(TRENDING_COLUMNS)
    want = I.clean(tables_small.raw)
    assert (got.count(), want.count()) == (want.count(), got.count())
    assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("defect", ["truncated line", "other header order"])
def test_stream_fails_where_the_batch_fails(spark, tables_small, tmp_path, defect):
    from trendscope.streaming import start_ingest
    landing = tmp_path / "landing"
    landing.mkdir()
    names = list(RAW_COLUMNS)
    if defect == "other header order":
        names[0], names[5] = names[5], names[0]
    lines = [",".join(names), ",".join(["x"] * len(names))] + (["abc,def"] if defect == "truncated line" else [])
    (landing / "a.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(Exception):
        files.read_raw(spark, str(landing)).collect()
    with pytest.raises(Exception):
        start_ingest(spark, str(landing), str(tmp_path / "fact"), str(tmp_path / "ckpt")).awaitTermination(120)


def test_rebalanced_write_splits_large_partitions(spark, tables_small):
    """REBALANCE on the partition column: a partition larger than the advisory size is
    split across tasks (files), small ones are merged; one folder per month."""
    from trendscope.schema import FACT_CLUSTER, FACT_PARTITION
    from trendscope.functions import exprs as X
    out = tempfile.mkdtemp(prefix="trendscope-rebalance-") + "/fact"
    # every row in one month: the worst case of a hot partition; several map tasks, as any
    # large input has (AQE splits a rebalance partition at map-output granularity)
    fact = (I.clean(tables_small.raw).repartition(8)
            .withColumn(FACT_PARTITION, F.lit("2000-01-01").cast("date")))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        files.materialize(fact, out, partition_by=[FACT_PARTITION], rebalance_by=[FACT_PARTITION],
                          sort_by=FACT_CLUSTER)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    folders = [d for d in os.listdir(out) if d.startswith(FACT_PARTITION)]
    parts = [f for f in os.listdir(os.path.join(out, folders[0])) if f.endswith(".parquet")]
    assert len(folders) == 1 and len(parts) > 1
    assert spark.read.parquet(out).count() == I.clean(tables_small.raw).count()


def test_stored_fact_shuffles_source_rows(spark):
    """The fact is dealt and sorted before its 28 columns are written out: no wide row is shuffled, and no
    second sort stands before the write."""
    from trendscope.plans.catalog import clustered_fact
    from trendscope.sources.bridge import source_rows, trending_raw
    fact = clustered_fact(spark, "/root/testdata/sf0.001")
    plan = fact._jdf.queryExecution().optimizedPlan()
    below = plan.toString().partition("RebalancePartitions")[2]
    assert below and "video_description" not in below and "channel_localized_title" not in below
    want = I.clean(trending_raw(spark, "/root/testdata/sf0.001"))
    assert fact.columns == [*want.columns, "trending_month"]
    assert fact.drop("trending_month").exceptAll(want).count() == 0 == want.exceptAll(fact.drop("trending_month")).count()
    assert fact.filter(F.col("trending_month") != F.trunc("video_trending_date", "MM")).count() == 0
    assert len(source_rows(spark, "/root/testdata/sf0.001").columns) == 19
