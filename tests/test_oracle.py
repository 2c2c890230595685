"""Every registered query against its DuckDB oracle (row count, column names, values),
the same check the driver runs, here at sf0.001 to stay fast (the driver uses sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare
from trendscope.plans.catalog import oracle_queries, spark_queries

QUERIES = spark_queries()
ORACLE = oracle_queries()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(spark, duck_small, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert res["status"] == "ok", res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["video_id", "video_title", "channel_title", "video_default_thumbnail",
                          "video_view_count", "video_like_count", "video_comment_count",
                          "video_trending_date"]
    assert 0 < len(rows) <= 20


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "date": "DATE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, duck_small, name):
    spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in QUERIES[name](spark, SF_SMALL).schema.fields}
    oracle_types = {r[0]: r[1] for r in duck_small.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    assert spark_types == oracle_types
