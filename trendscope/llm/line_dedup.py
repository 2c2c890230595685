"""Line dedup by site-relative frequency.

Per host (site), the pages that contain a line are divided by the host's page total; a line
whose ratio is over ``max_ratio`` (and that is in at least ``min_pages`` pages) is
boilerplate and is dropped from every page of that host. Pages with the same text count as
one page, so that copies of a page don't turn its lines into boilerplate. Lines are compared
trimmed of spaces and tabs; blank lines are never dropped.

Nulls: a null text stays null and has no lines; a null host is a host of its own. Repeated
rows each give a row. A page left without lines has the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch

# Between what site-wide lines reach and ordinary ones don't: in the test tables a line that a site puts
# on its pages stands on 8.6 to 13 % of each host's, the next line on 4.6 % of them at most.
MAX_RATIO = 0.06
MIN_PAGES = 5


def _key(line: Column) -> Column:
    """The trimmed line's 16-byte hash; null for a blank line."""
    line = F.btrim(line, F.lit(" \t\r"))
    return F.when(line != "", F.unhex(F.md5(line)))


def _cleaned(docs: DataFrame, text_col: str, host_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``_row`` (a struct of all columns, so that no name can clash), ``_text``, ``_in``, ``_dropped``.

    Every count is partial before its shuffle. A host's list has at most (lines per page) /
    max_ratio entries; the join with it is planned by its written size (broadcast only below
    Spark's threshold, else a shuffle join whose hot hosts AQE splits)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(host_col).alias("_host"),
                       F.col(text_col).alias("_text"))
    split = F.split("_text", "\n")
    keyed = (rows.filter(F.col("_text").isNotNull())
             .select("_host", F.unhex(F.md5("_text")).alias("_page"), F.explode(F.transform(split, _key)).alias("_key"))
             .distinct())
    seen = (keyed.filter(F.col("_key").isNotNull()).groupBy("_host", "_key")
            .agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pages))
    total = (rows.filter(F.col("_text").isNotNull())
             .select(F.col("_host").alias("_total_host"), F.unhex(F.md5("_text")).alias("_page")).distinct()
             .groupBy("_total_host").agg(F.count("*").alias("_pages")))
    drop = scratch.table(seen.join(total, F.col("_host").eqNullSafe(F.col("_total_host")))
                         .filter(F.col("_n") > max_ratio * F.col("_pages"))
                         .groupBy(F.col("_host").alias("_drop_host")).agg(F.collect_set("_key").alias("_drop")))
    joined = rows.join(drop, F.col("_host").eqNullSafe(F.col("_drop_host")), "left")
    left = F.filter(split, lambda x: ~F.coalesce(F.array_contains("_drop", _key(x)), F.lit(False)))
    cleaned = F.col("_drop").isNotNull() & F.col("_text").isNotNull()
    n = F.when(F.col("_text").isNull(), 0).otherwise(F.size(split))
    return joined.select(
        "_row", F.when(cleaned, F.array_join(left, "\n")).otherwise(F.col("_text")).alias("_text"),
        n.cast("long").alias("_in"), F.when(cleaned, n - F.size(left)).otherwise(0).cast("long").alias("_dropped"))


def line_dedup(docs: DataFrame, *, text_col: str = "text", host_col: str = "source",
               max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``docs`` with the cleaned ``text_col``, and ``n_lines_in`` and
    ``n_lines_dropped`` (they replace input columns of these names)."""
    out = _cleaned(docs, text_col, host_col, max_ratio, min_pages)
    own = {text_col: "_text", "n_lines_in": "_in", "n_lines_dropped": "_dropped"}
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in own],
                      *[F.col(v).alias(k) for k, v in own.items()])


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their hosts' boilerplate lines; ``n_chars`` (where
    there is one) follows the text."""
    out = _cleaned(docs, "text", "source", MAX_RATIO, MIN_PAGES)
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_dropped") > 0, F.length("_text"))}
    return out.select(*[F.coalesce(new[c], F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) if c in new
                        else F.col("_row")[c].alias(c) for c in docs.columns])
