"""trendscope: analytics over daily "trending content" snapshots, expressed as Spark plans.

Layout
------
``sources``    readers and writers (raw CSV, the bridge fixture, Parquet marts, views)
``functions``  column expressions (safe casts, id rule, tag normalisation, search pattern)
``operators``  the analytics: cleaning + QA, video/channel marts, tag marts, read queries,
               exploratory queries and KPI rows; DataFrames in, DataFrames out
``plans``      the full rebuild and the query catalogue (Spark plan + DuckDB oracle text)
``streaming``  the load-and-clean step (S1 + C6) run over a folder of arriving CSV files
"""

from trendscope.session import get_session, ensure_conf

__all__ = ["get_session", "ensure_conf"]
