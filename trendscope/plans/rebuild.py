"""Full rebuild of every table, in order, inside one Spark application.

1. raw input (CSV via S1, or the bridge tables) -> ``trending_raw`` Parquet, converted once
   (a multi-line CSV is one task per file; every later pass reads the Parquet copy);
2. quality reports (C7, C8) from that copy;
3. ``trending`` (C6) -> Parquet partitioned by ``trending_month``;
4. video and channel marts (V2-V5, H1-H3) from the stored fact;
5. clean tag events (T1, partitioned by month) and the monthly mart (T2);
6. optionally the legacy tag tables (T6 clustered as in S6, T7, T8, T9) and the trigram index of the searches (A14).

Steps 4-6 only read the stored fact and are submitted as concurrent Spark jobs.

Each stage reads what the previous one wrote, so lineage is cut at every table: a lost
executor recomputes one stage's tasks, never the chain from the raw file. Everything is
written under a fresh ``run-<time>`` folder, and only then is a marker of that run created in
``_complete``; readers take the newest marker. Nothing is overwritten, so a rebuild that fails
or is read half-way leaves the previous tables in place (the reference drops first).

A rebuild from files also keeps a manifest: every input file with its size, time, row counts and months.
``refresh`` compares it with the files there are now, writes the touched months of the
month-partitioned tables into a new run, and leaves all other months where they are: the run's
``_months`` says which run holds each month, and readers take the months from there. So an
appended month costs that month, while readers of earlier runs keep what they read.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendscope.functions import exprs as X
from trendscope.operators import ingest as I
from trendscope.operators import marts as M
from trendscope.operators import partials as P
from trendscope.operators import search as S
from trendscope.operators import tags as T
from trendscope.schema import DEFAULT_COUNTRY, FACT_CLUSTER, FACT_PARTITION
from trendscope.session import path_bytes
from trendscope.sources import files

# Stored table name -> partition columns (tables absent here are small and unpartitioned).
PARTITIONS = {
    "trending": [FACT_PARTITION],
    "us_tag_events_clean": ["month"],
    "us_tag_monthly_clean": ["month"],
    "video_month_us": ["month"],
    "video_days": ["month"],
    "channel_us_daily": ["month"],
    # month partials, from which the tables over all months are merged
    "video_places": ["month"],
    "video_versions": ["month"],
    "channel_versions": ["month"],
    "channel_video_months": ["month"],
    "country_days": ["month"],
}
# Tables whose partition column is for storage only.
HIDDEN_MONTH = ("video_days", "channel_us_daily")

# Per-video marts, stored in buckets of the video id: read queries join them with each other and with
# rows of the fact on that id, and the marts' side is not shuffled for it.
BUCKETED = {"video_dim": "video_id", "video_reach": "video_id", "video_us_stickiness": "video_id"}
BUCKET_BYTES = 128 << 20   # of the profile that the per-video marts are taken from, in a bucket

MANIFEST, MONTHS = "_manifest", "_months"   # stored beside a run's tables, by runs from files
BUCKETS = "_buckets"                        # the bucket count of a run's bucketed marts
SOURCE_FILE = "source_file"

CORE_TABLES = ["trending_raw", "trending", "video_profile", "video_dim", "video_reach", "video_us_stickiness",
               "us_dates", "channel_dim", "channel_us_daily", "channel_us_alltime", "channel_video_us",
               "video_month_us", "video_days", "video_places", "video_versions", "channel_versions",
               "channel_video_months", "country_days", "us_tag_events_clean", "us_tag_monthly_clean"]
LEGACY_TABLES = ["us_tag_events", "us_month_totals", "us_tag_monthly", "us_tag_movers_monthly"]
OPTIONAL_TABLES = [*LEGACY_TABLES, *S.STORED]


def _markers(spark: SparkSession, out_dir: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir.rstrip('/')}/_complete")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def complete_run(spark: SparkSession, out_dir: str, run: str) -> None:
    """Mark a run as complete: one empty file, created in one step."""
    fs, folder = _markers(spark, out_dir)
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, run), False).close()


def current_run(spark: SparkSession, out_dir: str) -> str:
    """The newest complete run (run names sort by time)."""
    fs, folder = _markers(spark, out_dir)
    runs = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    if not runs:
        raise FileNotFoundError(f"no complete rebuild under {out_dir}")
    return max(runs)


def _stored(spark: SparkSession, base: str, name: str) -> DataFrame | None:
    try:
        return files.read_table(spark, f"{base}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _month_runs(spark: SparkSession, out_dir: str, run: str) -> dict[str, list]:
    """Which months of the month-partitioned tables each run holds, for a refreshed run (one row per
    calendar month); empty for a full rebuild, which holds them all itself."""
    stored = _stored(spark, f"{out_dir.rstrip('/')}/{run}", MONTHS)
    out: dict[str, list] = {}
    for r in stored.orderBy("month").collect() if stored is not None else []:
        out.setdefault(r["run"], []).append(r["month"])
    return out


def table_parts(spark: SparkSession, out_dir: str, run: str | None = None) -> dict[str, list[tuple[str, list | None]]]:
    """Where the tables of a run lie: for each name (folder, months or None for all of it)."""
    run = run or current_run(spark, out_dir)
    out_dir = out_dir.rstrip("/")
    held = _month_runs(spark, out_dir, run)
    files_of = sorted(_file_runs(spark, out_dir, run))
    parts = {}
    for name in CORE_TABLES + OPTIONAL_TABLES:
        if held and name in PARTITIONS:
            parts[name] = [(f"{out_dir}/{r}/{name}", months) for r, months in held.items()]
        elif held and name == "trending_raw":
            parts[name] = [(f"{out_dir}/{r}/{name}", None) for r in files_of]
        else:
            parts[name] = [(f"{out_dir}/{run}/{name}", None)]
    return parts


def _file_runs(spark: SparkSession, out_dir: str, run: str) -> list[str]:
    """The runs that hold rows of a run's input files."""
    manifest = _stored(spark, f"{out_dir}/{run}", MANIFEST)
    return [r["run"] for r in manifest.select("run").distinct().collect()] if manifest is not None else []


def _parts_of(spark: SparkSession, out_dir: str, run: str) -> Callable[[str], DataFrame]:
    """The month-partitioned tables of a run, with their partition column."""
    places = table_parts(spark, out_dir, run)

    def read(name: str) -> DataFrame:
        out = None
        for path, months in places[name]:
            df = _stored(spark, *path.rsplit("/", 1))
            if df is not None:
                df = df if months is None else df.filter(F.col(PARTITIONS[name][0]).isin(months))
                out = df if out is None else out.unionByName(df)
        return out

    return read


def load_marts(spark: SparkSession, out_dir: str, run: str | None = None) -> dict[str, DataFrame]:
    """Every stored table of the current (or given) run, by name."""
    run = run or current_run(spark, out_dir)
    counted = _stored(spark, f"{out_dir.rstrip('/')}/{run}", BUCKETS)
    buckets = counted.first()[0] if counted is not None else None
    out = {}
    for name, parts in table_parts(spark, out_dir, run).items():
        found = []
        for path, months in parts:
            try:
                if name in BUCKETED and buckets:
                    df = files.read_bucketed(spark, path, BUCKETED[name], buckets)
                else:
                    df = files.read_table(spark, path)
            except AnalysisException as missing:
                # some tables are optional, and a run may hold no row of a month's table
                if missing.getCondition() == "PATH_NOT_FOUND" and name in OPTIONAL_TABLES:
                    continue
                if missing.getCondition() == "UNABLE_TO_INFER_SCHEMA" and len(parts) > 1:
                    continue
                raise
            found.append(df if months is None else df.filter(F.col(PARTITIONS[name][0]).isin(months)))
        if found:
            out[name] = found[0]
            for df in found[1:]:
                out[name] = out[name].unionByName(df)
            if name in HIDDEN_MONTH:
                out[name] = out[name].drop(*PARTITIONS[name])
    if SOURCE_FILE in out["trending_raw"].columns and len(table_parts(spark, out_dir, run)["trending_raw"]) > 1:
        live = files.read_table(spark, f"{out_dir.rstrip('/')}/{run}/{MANIFEST}")
        out["trending_raw"] = _live_rows(spark, out_dir, live)
    return out


def _live_rows(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """Raw rows of the manifest's files: of each run that holds some, the rows of the files listed."""
    out = None
    for r in sorted(x["run"] for x in manifest.select("run").distinct().collect()):
        listed = manifest.filter(F.col("run") == r).select(SOURCE_FILE)
        rows = files.read_table(spark, f"{out_dir.rstrip('/')}/{r}/trending_raw").join(listed, SOURCE_FILE, "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out


def register_marts(spark: SparkSession, marts: dict[str, DataFrame],
                   country: str = DEFAULT_COUNTRY) -> list[str]:
    """Expose every stored table as a session view under its table name, plus the
    three derived views (coverage per country, the country's dates, the tag months), so SQL
    written against those names runs with ``spark.sql`` and S8 finds the tag marts in the
    catalogue. The views carry no ORDER BY: order at query time. Returns the view names."""
    views = dict(marts)
    fact = marts["trending"].drop(FACT_PARTITION)
    views["trending"] = fact
    views["v_available_dates"] = P.available_dates(marts["country_days"])
    views["v_us_dates"] = marts["us_dates"].select(F.col("date").alias("video_trending_date"))
    views["v_us_tag_months_clean"] = marts["us_tag_monthly_clean"].select(
        F.date_format("month", "yyyy-MM-dd").alias("month")).distinct()
    files.register_views(views)
    return sorted(views)


def create_views(spark: SparkSession, out_dir: str, run: str | None = None) -> list[str]:
    """Every stored table of the current (or given) run as a view of the session's catalogue,
    made with CREATE OR REPLACE VIEW over its files. With a metastore the views outlast the
    application; call it again after a rebuild. Returns the view names."""
    run = run or current_run(spark, out_dir)
    marts, places = load_marts(spark, out_dir, run), table_parts(spark, out_dir, run)
    manifest = f"{out_dir.rstrip('/')}/{run}/{MANIFEST}"

    def one(name: str, path: str, months: list | None, columns: str, among: int) -> str:
        text = f"SELECT {columns} FROM parquet.`{path}`"
        if months is not None:
            listed = ", ".join(f"DATE'{m}'" for m in months)
            text += f" WHERE `{PARTITIONS[name][0]}` IN ({listed})"
        elif among > 1:  # raw rows of files that are still there
            text += (f" WHERE `{SOURCE_FILE}` IN (SELECT `{SOURCE_FILE}` FROM parquet.`{manifest}` "
                     f"WHERE run = '{path.split('/')[-2]}')")
        return text

    def all_of(name: str, columns: list[str]) -> str:
        listed = ", ".join(f"`{c}`" for c in columns)
        held = [p for p in places[name] if len(places[name]) == 1 or _stored(spark, *p[0].rsplit("/", 1)) is not None]
        return " UNION ALL ".join(one(name, path, months, listed, len(held)) for path, months in held)

    selects = {name: all_of(name, [c for c in df.columns if (name, c) != ("trending", FACT_PARTITION)])
               for name, df in marts.items()}
    selects["v_available_dates"] = (
        "SELECT video_trending_country, min(video_trending_date) AS min_date, max(video_trending_date) AS max_date, "
        f"sum(rows) AS rows FROM ({selects['country_days']}) GROUP BY video_trending_country")
    selects["v_us_dates"] = f"SELECT date AS video_trending_date FROM ({selects['us_dates']})"
    selects["v_us_tag_months_clean"] = (
        f"SELECT DISTINCT date_format(month, 'yyyy-MM-dd') AS month FROM ({selects['us_tag_monthly_clean']})")
    for name, text in selects.items():
        spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS {text}")
    return sorted(selects)


def _new_run() -> str:
    now = time.time()
    return time.strftime("run-%Y%m%d-%H%M%S", time.gmtime(now)) + f"-{int(now * 1000) % 1000:03d}"


def _writer(spark: SparkSession, base: str, timings: dict) -> Callable[..., DataFrame]:
    def write(name: str, df: DataFrame, **kw) -> DataFrame:
        t0 = time.time()
        files.materialize(df, f"{base}/{name}", **{"partition_by": PARTITIONS.get(name), **kw})
        timings[f"build_{name}"] = round(time.time() - t0, 3)
        # the schema is known, and a month-partitioned table may have no file at all
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")
    return write


def _write_fact(write: Callable[..., DataFrame], fact: DataFrame) -> DataFrame:
    # Rebalance by month, then sort by FACT_CLUSTER inside each task: a task writes one month
    # folder (no tasks x months small files), AQE splits a busy month across tasks, and row
    # groups are ordered by day within the month so day predicates skip the rest.
    return write("trending", fact, rebalance_by=[FACT_PARTITION], sort_by=FACT_CLUSTER)


def _dated(trending: DataFrame) -> DataFrame:
    return trending.withColumn(FACT_PARTITION, X.month_of("video_trending_date"))


def bucket_count(n_bytes: int, bucket_bytes: int | None = None) -> int:
    """Buckets of about ``BUCKET_BYTES``: a power of two, so that runs of other sizes still fit each other."""
    return 1 << max(0, -(-n_bytes // (bucket_bytes or BUCKET_BYTES)) - 1).bit_length()


def search_index(marts: dict[str, DataFrame]) -> dict[str, DataFrame] | None:
    """The stored trigram index among ``load_marts``' tables, for the ``index`` of the searches; None where the
    run was built without."""
    return {name: marts[name] for name in S.STORED} if all(name in marts for name in S.STORED) else None


def _write_marts(spark: SparkSession, base: str, write: Callable[..., DataFrame], fact: DataFrame, months_fact: DataFrame,
                 others: Callable[[str], DataFrame] | None, country: str, legacy: bool, search: bool, timings: dict,
                 parallel_jobs: int) -> None:
    """All marts. Those that are partitioned by month come from ``months_fact`` (the fact, or its touched
    months); the others are merged from the month partials written here and, where there are
    ``others``, those of the other months. Only the legacy tables read the whole ``fact``."""
    def by_month(name: str, df: DataFrame, *order: str) -> DataFrame:
        part = write(name, df, rebalance_by=PARTITIONS[name], sort_by=[*PARTITIONS[name], *order])
        return part if others is None else part.unionByName(others(name))

    def video_marts() -> None:
        # The three per-video marts come from one merge (stored once), then are projected from
        # that small per-video table.
        places = by_month("video_places", P.video_places(months_fact), "video_id")
        versions = by_month("video_versions", P.video_versions(months_fact), "video_id")
        profile = write("video_profile", P.video_profile(places, versions, country))
        n_bytes = path_bytes(spark, f"{base}/video_profile")
        buckets = bucket_count(n_bytes)
        for name, df in (("video_dim", M.video_dim_of(profile)), ("video_reach", M.video_reach_of(profile)),
                         ("video_us_stickiness", M.video_stickiness_of(profile))):
            t0 = time.time()
            files.materialize_bucketed(df, f"{base}/{name}", BUCKETED[name], buckets)
            timings[f"build_{name}"] = round(time.time() - t0, 3)
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{base}/{BUCKETS}")
        if search:
            S.index_tables(M.video_dim_of(profile), bucket_count(n_bytes, S.PART_BYTES),
                           lambda name, df: write(name, df, **S.STORED[name]))

    def channel_marts() -> None:
        write("channel_dim", P.channel_dim(by_month("channel_versions", P.channel_versions(months_fact), "channel_id")))
        daily = by_month("channel_us_daily", P.channel_days(months_fact, country), "date", "channel_id")
        # Per-video figures of the channel page, pre-aggregated so that a request reads a
        # channel's rows instead of the fact; H3 counts its rows.
        months = by_month("channel_video_months", P.channel_video_months(months_fact, country), "channel_id", "video_id")
        videos = write("channel_video_us", P.channel_video_stats(months),
                       range_by=["channel_id", "video_id"], sort_by=["channel_id", "video_id"])
        write("channel_us_alltime", M.channel_alltime(fact, country, daily, videos))

    def page_marts() -> None:
        # Rows per country and day: coverage, and V5 stored (a few thousand rows), so "latest day"
        # is resolved from it instead of scanning the fact on every request.
        days = by_month("country_days", P.country_days(months_fact), M.DATE, M.COUNTRY)
        write("us_dates", P.country_dates(days, country))
        # Per-video figures of the tag pages: a request reads one month of per-video rows.
        by_month("video_month_us", M.video_month_stats(months_fact, country), "video_id")
        by_month("video_days", M.video_days(months_fact).withColumn("month", X.month_of(M.DATE)),
                 "video_id", M.COUNTRY, M.DATE)

    def tag_marts() -> None:
        events = write("us_tag_events_clean", T.tag_events_clean(months_fact, country),
                       rebalance_by=["month"], sort_by=["month", "tag", "video_id"])
        # sorted by tag inside each month, so a tag's series reads one row group per month
        write("us_tag_monthly_clean", T.tag_monthly_clean(events, months_fact, country),
              rebalance_by=["month"], sort_by=["month", "tag"])

    def legacy_marts() -> None:
        lev = write("us_tag_events", T.tag_events_legacy(fact, country),
                    range_by=["month", "tag", "video_id"], sort_by=["month", "tag", "video_id"])
        totals = write("us_month_totals", T.month_totals_legacy(lev))
        monthly = write("us_tag_monthly", T.tag_monthly_legacy(lev, totals))
        write("us_tag_movers_monthly", T.tag_movers(monthly))

    # The groups only read the stored fact, so they are submitted as concurrent Spark jobs:
    # small mart jobs would otherwise leave executors idle one after the other. Any failure
    # is raised here, before the run is marked as complete.
    groups = [video_marts, channel_marts, page_marts, tag_marts] + ([legacy_marts] if legacy else [])
    t0 = time.time()
    with ThreadPoolExecutor(max_workers=parallel_jobs) as pool:
        for future in [pool.submit(g) for g in groups]:
            future.result()
    timings["build_marts_wall"] = round(time.time() - t0, 3)


def build_all(spark: SparkSession, raw: DataFrame | str, out_dir: str, country: str = DEFAULT_COUNTRY,
              legacy: bool = False, timings: dict | None = None, parallel_jobs: int = 4, search: bool = False) -> dict:
    """Rebuild every table from ``raw`` (all-text raw rows, or the path of the raw CSV)
    under ``out_dir``; ``legacy`` and ``search`` add the legacy tag tables and the searches' trigram
    index. From a path, the run keeps the manifest that ``refresh`` needs.

    Returns the quality reports (one row each) and the run folder name."""
    timings = timings if timings is not None else {}
    run = _new_run()
    base = f"{out_dir.rstrip('/')}/{run}"
    write = _writer(spark, base, timings)
    listed = None
    if isinstance(raw, str):
        listed = files.listing(spark, raw)
        raw = _sourced(files.read_raw(spark, raw))

    raw_p = write("trending_raw", raw)
    t0 = time.time()
    if listed is not None:
        manifest = _with_counts(listed, raw_p, run)
        files.materialize(manifest, f"{base}/{MANIFEST}")
        report = quality_of(files.read_table(spark, f"{base}/{MANIFEST}"))
    else:
        report = {
            "raw_quality": I.raw_quality(raw_p).first().asDict(),
            "clean_quality": I.clean_quality(raw_p).first().asDict(),
        }
    timings["build_quality"] = round(time.time() - t0, 3)

    fact = _write_fact(write, _dated(I.clean(raw_p)))
    _write_marts(spark, base, write, fact, fact, None, country, legacy, search, timings, parallel_jobs)

    # Readers see the new run only after every table is written.
    complete_run(spark, out_dir, run)
    report["run"] = run
    return report


# Refresh by month --------------------------------------------------------------------------------

def _sourced(raw: DataFrame) -> DataFrame:
    return raw.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE))


def _with_counts(listed: DataFrame, raw: DataFrame, run: str) -> DataFrame:
    """Manifest rows of the files ``listed``, whose raw rows ``raw`` this run holds: counts of C7 and C8,
    months and countries of the clean rows. One aggregation; its rows are as many as the files."""
    counts = I.quality_by(raw, SOURCE_FILE)
    return listed.join(counts, SOURCE_FILE, "left").withColumn("run", F.lit(run))


def quality_of(manifest: DataFrame) -> dict:
    """C7 and C8 of all files of a manifest: sums of the files' counts."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    r = manifest.agg(*[total(c) for c in ("total_raw", "bad_date_rows", "invalid_video_id_rows", "null_video_id_rows", "total_clean")],
                     F.size(F.array_distinct(F.flatten(F.collect_set("countries")))).alias("distinct_countries")).first()
    raw = {c: r[c] for c in ("total_raw", "bad_date_rows", "invalid_video_id_rows", "null_video_id_rows")}
    if not r["total_raw"]:  # sums of no rows are NULL, as in the reports
        raw |= {c: None for c in list(raw)[1:]}
    return {"raw_quality": raw, "clean_quality": {
        "total_clean": r["total_clean"], "dropped": r["total_raw"] - r["total_clean"],
        "distinct_countries": max(r["distinct_countries"], 0), "null_date_clean": 0}}


def refresh(spark: SparkSession, raw_path: str, out_dir: str, country: str = DEFAULT_COUNTRY, legacy: bool = False,
            timings: dict | None = None, parallel_jobs: int = 4, search: bool = False) -> dict:
    """Bring the tables up to the files that are under ``raw_path`` now: the result is that of
    ``build_all``, and months that no new, changed or removed file touches are neither read for, nor
    written in, the month-partitioned tables. Where files were only added, a touched month is the stored
    one and the new rows; else its rows come from the stored raw copies of the files that are left.
    The tables over all months are merged from the month partials; only the legacy tables read the
    fact's other months.

    The driver holds the new files' paths (as a scan of them does) and the calendar months. Returns the
    quality reports, the run and the months written; without a difference the current run stays."""
    timings = timings if timings is not None else {}
    out_dir = out_dir.rstrip("/")
    was = current_run(spark, out_dir)
    old = _stored(spark, f"{out_dir}/{was}", MANIFEST)
    if old is None:
        raise ValueError(f"{was} was not built from files: run build_all on the folder first")
    listed, same = files.listing(spark, raw_path), files.LISTED
    added, gone = listed.join(old, same, "left_anti"), old.join(listed, same, "left_anti")
    paths = [r[SOURCE_FILE] for r in added.select(SOURCE_FILE).collect()]
    gone_months = _months_of(gone)
    n_gone = gone.count()
    if not paths and not n_gone:
        return {**quality_of(old), "run": was, "months": []}

    run = _new_run()
    base = f"{out_dir}/{run}"
    write = _writer(spark, base, timings)
    fresh = _sourced(files.read_raw(spark, paths)) if paths else files.read_table(spark, f"{out_dir}/{was}/trending_raw").limit(0)
    fresh = write("trending_raw", fresh)
    kept = old.join(listed, same, "left_semi")
    files.materialize(kept.unionByName(_with_counts(added, fresh, run)), f"{base}/{MANIFEST}")
    manifest = files.read_table(spark, f"{base}/{MANIFEST}")
    months = sorted({*gone_months, *_months_of(manifest.filter(F.col("run") == run))})

    month = F.col(FACT_PARTITION)
    stored = _parts_of(spark, out_dir, was)
    was_fact = stored("trending")
    others = lambda name: stored(name).filter(~F.col(PARTITIONS[name][0]).isin(months))
    if n_gone:
        rows = _dated(I.clean(_live_rows(spark, out_dir, manifest)))
    else:
        rows = was_fact.unionByName(_dated(I.clean(fresh)))
    touched = _write_fact(write, rows.filter(month.isin(months)))
    fact = others("trending").unionByName(touched)

    before = _month_runs(spark, out_dir, was) or {was: [r[0] for r in was_fact.select(month).distinct().collect()]}
    after = [(m, r) for r, held in before.items() for m in held if m not in months]
    after += [(r[0], run) for r in touched.select(month).distinct().collect()]
    spark.createDataFrame(after, "month date, run string").coalesce(1).write.parquet(f"{base}/{MONTHS}")

    _write_marts(spark, base, write, fact, touched, others, country, legacy, search, timings, parallel_jobs)
    complete_run(spark, out_dir, run)
    return {**quality_of(manifest), "run": run, "months": months}


def _months_of(manifest: DataFrame) -> list:
    return [r["m"] for r in manifest.select(F.explode("months").alias("m")).distinct().collect()]


def main(argv=None) -> None:
    from trendscope.session import submitted_session
    from trendscope.sources.bridge import trending_raw
    p = argparse.ArgumentParser(description="Rebuild the trending fact and every mart.")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="raw CSV file or folder")
    src.add_argument("--tables", help="folder of benchmark Parquet tables (bridge source)")
    p.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    p.add_argument("--country", default=DEFAULT_COUNTRY)
    p.add_argument("--legacy", action="store_true", help="also build the legacy tag tables")
    p.add_argument("--search", action="store_true", help="also build the searches' trigram index")
    p.add_argument("--refresh", action="store_true", help="with --csv: write only the months that changed files touch")
    args = p.parse_args(argv)
    if args.refresh and not args.csv:
        p.error("--refresh needs --csv")
    spark = submitted_session(args.csv or args.tables)
    timings: dict = {}
    build = refresh if args.refresh else build_all
    print(build(spark, args.csv or trending_raw(spark, args.tables), args.out, args.country, args.legacy, timings,
                search=args.search))
    print(timings)


if __name__ == "__main__":
    main()
