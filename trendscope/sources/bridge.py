"""Bridge source: the raw trending table derived from the benchmark's star schema.

The reference's only input is one CSV of daily snapshots. The test and benchmark data are
TPC-H-like tables instead, so ``trending_raw`` derives the same 28 text columns from
``lineitem``, ``orders``, ``customer``, ``nation`` and ``part`` (FIXTURES.md §2): one raw
row per line item, with planted defects (bad dates, bad ids, fractional counts, none-like
tag strings, quoted tags, NULL channels) that exercise every cleaning rule.

Join order for scale: ``orders`` is joined to ``customer`` (and the 25-row ``nation``)
first, so the widest input, ``lineitem``, is shuffled once for ``orders`` and once for
``part``. Tables are read with their declared types, so building a query starts no job, and
only the columns the rules read are in them, so the Parquet scans prune. A country predicate written downstream reaches
the ``nation`` scan through Catalyst's predicate pushdown, because the country column only
reads nation columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendscope.schema import DEFAULT_COUNTRY, RAW_COLUMNS


# Columns that the bridge reads, with their types.
SOURCE_TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_returnflag string, l_shipdate timestamp",
    "orders": "o_orderkey long, o_custkey long, o_orderpriority string",
    "customer": "c_custkey long, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_TABLES[name]).parquet(table_path(sf_dir, name))


def _s(col) -> "F.Column":
    return col.cast("string")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows of the star schema, one per raw row: what ``raw_columns`` reads."""
    l, o, c, n, p = [read_table(spark, sf_dir, name) for name in SOURCE_TABLES]

    cust = c.join(n, c.c_nationkey == n.n_nationkey)
    ords = o.join(cust, o.o_custkey == cust.c_custkey)
    return l.join(ords, l.l_orderkey == ords.o_orderkey).join(p, l.l_partkey == p.p_partkey)


def raw_columns() -> dict[str, Column]:
    """The 28 text columns, from a row of ``source_rows``."""
    okey, pkey, line = F.col("l_orderkey"), F.col("p_partkey"), F.col("l_linenumber")
    ship = _s(F.col("l_shipdate").cast("date"))
    brand = F.col("p_brand")

    return {
        "video_id": F.when(okey % 109 == 0, F.lit(None).cast("string"))
        .when(okey % 101 == 0, F.concat(F.lit("bad id "), _s(pkey)))
        .otherwise(F.concat(F.lit("vid"), F.lpad(_s(pkey), 8, "0"))),
        # times without a date and partial dates are no timestamps; other separators are
        "video_published_at": F.when(pkey % 50 == 0, "12:30").when(pkey % 50 == 1, "T10:00")
        .when(pkey % 50 == 2, "2019").when(pkey % 50 == 3, "2019-05").when(pkey % 50 == 4, "2019-5-6")
        .when(pkey % 50 == 5, "2019/05/06 07:08").when(pkey % 50 == 6, "2019-05-06 07:08:09.5+02")
        .otherwise(F.concat(_s(1990 + pkey % 5), F.lit("-0"), _s(1 + pkey % 9), F.lit("-15T08:30:00Z"))),
        "video_trending__date": F.when(okey % 103 == 0, F.lit("not-a-date"))
        .when(okey % 103 == 1, F.substring(ship, 1, 4))
        .when(okey % 103 == 2, F.translate(ship, "-", "/"))
        .when(okey % 103 == 3, F.concat(F.translate(ship, "-", "."), F.lit(" 10:00:00")))
        .when(okey % 103 == 4, F.concat(F.translate(ship, "-", "."), F.lit("T00:00:00Z")))
        .otherwise(F.translate(ship, "-", ".")),
        "video_trending_country": F.when(F.col("n_nationkey") < 5, F.lit(DEFAULT_COUNTRY))
        .otherwise(F.col("n_name")),
        "channel_id": F.when(brand == "Brand#7", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("UC_"), brand)),
        # titles and channel names change from row to row and are sometimes missing
        "video_title": F.when(okey % 11 == 0, F.lit(None).cast("string"))
        .when(okey % 13 == 0, F.concat(F.col("p_name"), F.lit(" (new)"))).otherwise(F.col("p_name")),
        "video_description": F.when(pkey % 4 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("About "), F.col("p_name"))),
        "video_default_thumbnail": F.concat(F.lit("thumb/"), _s(pkey), F.lit(".jpg")),
        "video_category_id": _s(F.col("p_size")),
        "video_tags": F.when(line == 6, F.lit(None).cast("string"))
        .when(line == 5, F.lit("[none]"))
        .otherwise(F.concat_ws(
            ",",
            F.concat(F.lit(" #"), F.col("p_name")),
            F.concat(F.lit('"'), F.col("p_type"), F.lit('"')),
            F.concat(brand, F.lit('"')),
            F.replace(F.col("o_orderpriority"), F.lit("-"), F.lit(" | ")),
            F.col("l_returnflag"),
            F.when(line == 1, F.lit("yt:quality=high")),
            F.when(line == 2, F.lit("http://x.y")),
            F.when(line == 3, F.lit("")),
        )),
        "video_duration": F.concat(F.lit("PT"), _s(1 + pkey % 59), F.lit("M")),
        "video_dimension": F.lit("2d"),
        "video_definition": F.when(pkey % 3 == 0, F.lit("sd")).otherwise(F.lit("hd")),
        "video_licensed_content": F.when(pkey % 2 == 0, F.lit("True")).otherwise(F.lit("False")),
        "video_view_count": F.concat(
            F.when(okey % 107 == 1, F.lit("1_000")).when(okey % 107 == 2, F.lit("0.49999999999"))
            .otherwise(_s(F.floor(F.col("l_extendedprice")).cast("bigint"))),
            F.when(okey % 107 == 0, F.lit(".7")).otherwise(F.lit(""))),
        "video_like_count": F.when(line == 7, F.lit(None).cast("string"))
        .when((line == 4) & (okey % 50 == 0), F.lit("n/a"))
        .otherwise(_s(F.floor(F.col("l_quantity") * 10).cast("bigint"))),
        "video_comment_count": _s(F.col("l_partkey") % 500),
        "channel_title": F.when(okey % 17 == 0, F.lit(None).cast("string"))
        .when(okey % 19 == 0, F.concat(F.lit("New Channel "), brand)).otherwise(F.concat(F.lit("Channel "), brand)),
        "channel_description": F.concat(F.lit("Desc "), brand),
        "channel_custom_url": F.concat(F.lit("@"), F.lower(brand)),
        "channel_published_at": F.lit("2010-01-01T00:00:00Z"),
        "channel_country": F.when(brand == "Brand#3", F.lit(None).cast("string"))
        .otherwise(F.lit("US")),
        "channel_view_count": F.lit("1000000"),
        "channel_subscriber_count": F.lit("5000"),
        "channel_have_hidden_subscribers": F.lit("False"),
        "channel_video_count": F.lit("42"),
        "channel_localized_title": F.concat(F.lit("Channel "), brand),
        "channel_localized_description": F.concat(F.lit("Desc "), brand),
    }


def trending_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text raw trending rows (the ``trending_raw`` table of the reference)."""
    cols = raw_columns()
    return source_rows(spark, sf_dir).select(*[cols[name].alias(name) for name in RAW_COLUMNS])


# DuckDB text of the same derivation, for the oracle side of the correctness check.
BRIDGE_SQL = """
SELECT
  CASE WHEN l.l_orderkey % 109 = 0 THEN NULL
       WHEN l.l_orderkey % 101 = 0 THEN concat('bad id ', CAST(p.p_partkey AS VARCHAR))
       ELSE concat('vid', lpad(CAST(p.p_partkey AS VARCHAR), 8, '0')) END AS video_id,
  CASE p.p_partkey % 50 WHEN 0 THEN '12:30' WHEN 1 THEN 'T10:00' WHEN 2 THEN '2019' WHEN 3 THEN '2019-05'
       WHEN 4 THEN '2019-5-6' WHEN 5 THEN '2019/05/06 07:08' WHEN 6 THEN '2019-05-06 07:08:09.5+02'
       ELSE concat(CAST(1990 + p.p_partkey % 5 AS VARCHAR), '-0', CAST(1 + p.p_partkey % 9 AS VARCHAR),
                   '-15T08:30:00Z') END AS video_published_at,
  CASE WHEN l.l_orderkey % 103 = 0 THEN 'not-a-date'
       WHEN l.l_orderkey % 103 = 1 THEN substr(CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR), 1, 4)
       WHEN l.l_orderkey % 103 = 2 THEN strftime(CAST(l.l_shipdate AS DATE), '%Y/%m/%d')
       WHEN l.l_orderkey % 103 = 3 THEN strftime(CAST(l.l_shipdate AS DATE), '%Y.%m.%d 10:00:00')
       WHEN l.l_orderkey % 103 = 4 THEN strftime(CAST(l.l_shipdate AS DATE), '%Y.%m.%dT00:00:00Z')
       ELSE replace(CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR), '-', '.') END AS video_trending__date,
  CASE WHEN n.n_nationkey < 5 THEN 'United States' ELSE n.n_name END AS video_trending_country,
  CASE WHEN p.p_brand = 'Brand#7' THEN NULL ELSE concat('UC_', p.p_brand) END AS channel_id,
  CASE WHEN l.l_orderkey % 11 = 0 THEN NULL WHEN l.l_orderkey % 13 = 0 THEN concat(p.p_name, ' (new)')
       ELSE p.p_name END AS video_title,
  CASE WHEN p.p_partkey % 4 = 0 THEN NULL ELSE concat('About ', p.p_name) END AS video_description,
  concat('thumb/', CAST(p.p_partkey AS VARCHAR), '.jpg') AS video_default_thumbnail,
  CAST(p.p_size AS VARCHAR) AS video_category_id,
  CASE WHEN l.l_linenumber = 6 THEN NULL
       WHEN l.l_linenumber = 5 THEN '[none]'
       ELSE concat_ws(',', concat(' #', p.p_name), concat('"', p.p_type, '"'), concat(p.p_brand, '"'),
              replace(o.o_orderpriority, '-', ' | '), l.l_returnflag,
              CASE WHEN l.l_linenumber = 1 THEN 'yt:quality=high' END,
              CASE WHEN l.l_linenumber = 2 THEN 'http://x.y' END,
              CASE WHEN l.l_linenumber = 3 THEN '' END) END AS video_tags,
  concat('PT', CAST(1 + p.p_partkey % 59 AS VARCHAR), 'M') AS video_duration,
  '2d' AS video_dimension,
  CASE WHEN p.p_partkey % 3 = 0 THEN 'sd' ELSE 'hd' END AS video_definition,
  CASE WHEN p.p_partkey % 2 = 0 THEN 'True' ELSE 'False' END AS video_licensed_content,
  concat(CASE l.l_orderkey % 107 WHEN 1 THEN '1_000' WHEN 2 THEN '0.49999999999'
              ELSE CAST(CAST(floor(l.l_extendedprice) AS BIGINT) AS VARCHAR) END,
         CASE WHEN l.l_orderkey % 107 = 0 THEN '.7' ELSE '' END) AS video_view_count,
  CASE WHEN l.l_linenumber = 7 THEN NULL
       WHEN l.l_linenumber = 4 AND l.l_orderkey % 50 = 0 THEN 'n/a'
       ELSE CAST(CAST(floor(l.l_quantity * 10) AS BIGINT) AS VARCHAR) END AS video_like_count,
  CAST(l.l_partkey % 500 AS VARCHAR) AS video_comment_count,
  CASE WHEN l.l_orderkey % 17 = 0 THEN NULL WHEN l.l_orderkey % 19 = 0 THEN concat('New Channel ', p.p_brand)
       ELSE concat('Channel ', p.p_brand) END AS channel_title,
  concat('Desc ', p.p_brand) AS channel_description,
  concat('@', lower(p.p_brand)) AS channel_custom_url,
  '2010-01-01T00:00:00Z' AS channel_published_at,
  CASE WHEN p.p_brand = 'Brand#3' THEN NULL ELSE 'US' END AS channel_country,
  '1000000' AS channel_view_count,
  '5000' AS channel_subscriber_count,
  'False' AS channel_have_hidden_subscribers,
  '42' AS channel_video_count,
  concat('Channel ', p.p_brand) AS channel_localized_title,
  concat('Desc ', p.p_brand) AS channel_localized_description
FROM lineitem l
JOIN orders o   ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n   ON c.c_nationkey = n.n_nationkey
JOIN part p     ON l.l_partkey = p.p_partkey
"""
