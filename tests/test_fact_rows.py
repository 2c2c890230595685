"""Queries that read few columns of the fact derive them without storing it, with the rows of the stored one."""

import pytest
from pyspark.sql import functions as F

from trendscope.plans import catalog as C
from trendscope.sources.bridge import SOURCE_TABLES


@pytest.fixture(scope="module")
def own_rows(spark, tmp_path_factory):
    """Tables of a few hundred line items; keys repeat or are null here and there."""
    sf = str(tmp_path_factory.mktemp("own"))
    n = F.col("id")
    gap = lambda c, every: F.when(n % every != 0, c)
    day = F.date_add(F.lit("1999-11-20").cast("date"), (n * 7 % 90).cast("int")).cast("timestamp")
    tables = {
        "nation": spark.range(10).select(n.alias("n_nationkey"), F.concat(F.lit("N"), n).alias("n_name")),
        "customer": spark.range(21).select((n % 19).alias("c_custkey"), gap(n % 11, 13).alias("c_nationkey")),
        "orders": spark.range(130).select((n % 127).alias("o_orderkey"), gap(n % 20, 17).alias("o_custkey"),
                                          gap(F.concat(n % 5, F.lit("-LOW")), 23).alias("o_orderpriority")),
        "part": spark.range(31).select((n % 29).alias("p_partkey"), gap(F.concat(F.lit("anvil "), n), 9).alias("p_name"),
                                       F.concat(F.lit("Brand#"), n % 9).alias("p_brand"), F.lit("STEEL").alias("p_type"),
                                       (n % 7).alias("p_size")),
        "lineitem": spark.range(700).select(
            gap(n % 125, 41).alias("l_orderkey"), gap(n * 3 % 30, 43).alias("l_partkey"), (n % 7 + 1).alias("l_linenumber"),
            gap((n % 50).cast("double"), 11).alias("l_quantity"), (n * 1.5).alias("l_extendedprice"),
            F.lit("R").alias("l_returnflag"), gap(day, 37).alias("l_shipdate")),
    }
    for name, df in tables.items():
        fields = [f.split() for f in SOURCE_TABLES[name].split(", ")]
        df.select(*[F.col(c).cast(kind) for c, kind in fields]).write.parquet(f"{sf}/{name}.parquet")
    return sf


def _rows(df):
    return sorted(df.collect(), key=str)


def _read(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_queries_store_no_fact(spark, own_rows):
    queries = C.spark_queries()
    alone = {name: queries[name](spark, own_rows) for name in sorted(C.NARROW)}
    found = {name: _rows(df) for name, df in alone.items()}
    assert (spark.sparkContext.applicationId, own_rows) not in C._STORED_FACTS
    # the texts that nothing reads aren't computed
    assert "p_name" not in _read(alone["country_dates"])
    t = C.Tables(spark, own_rows)
    assert C.fact_rows(spark, own_rows).columns == t.trending.columns
    for name in sorted(C.NARROW):
        assert found[name] == _rows(C.CATALOG[name].build(t)), name
        assert found[name] or name == "tag_series_legacy", name      # whose tag these rows don't have
    # and once the application holds the fact, they read it
    assert C.fact_rows(spark, own_rows) is t.trending
    assert "l_orderkey" not in _read(queries["country_dates"](spark, own_rows))


def test_tag_text_tests_equal_the_trimmed_text(spark):
    """The cheap tests of a tag string give what trimming and comparing gives, nulls included."""
    from trendscope.functions import exprs as X
    texts = [None, "", " ", " 　", "\t", "\n", " x ", "None", " [NONE] ", "nan\n", "nul", "null null", "##", "#a#",
             '"', '"a', 'a"', '""', 'a"\n', "[none", "﻿"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    c = F.col("x")
    one_quote = F.when(c.startswith('"'), F.regexp_replace(c, '^"', "")).otherwise(F.regexp_replace(c, r'"+\z', ""))
    pairs = [(X.has_text(c), X.trim_zs(c) != ""), (X.is_none_like(c), F.lower(X.trim_zs(c)).isin(X.NONE_LIKE_TAGS)),
             (X.strip_leading_hashes(c), F.regexp_replace(c, "^#+", "")), (X.strip_one_quote_char(c), one_quote)]
    for now, plain in pairs:
        assert df.filter(~now.eqNullSafe(plain)).count() == 0
