"""A14 by a trigram index: three-character pieces of titles and channel ids, to ids.

A match of ``ILIKE '%text%'`` holds every literal piece of the text (between its wildcards ``%`` and
``_``) in lower case, hence every trigram of these pieces. The index gives the ids that hold the rarest
of them; the rows of those ids are then verified by the same ``ILIKE``, so the result is that of the scan.

Stored tables (``index_tables``):

* ``title_grams``, ``channel_grams``: one row per trigram and id, sorted by the trigram, so that a lookup reads the
  row groups of its trigrams. Channels are indexed once per id, not per video.
* ``gram_counts``: ids per trigram, which tell before a search how many candidates there can be.
* ``title_rows``, ``channel_rows``: the dimension's rows in folders by a hash of the id. The candidates are
  broadcast, and only their folders are read (dynamic partition pruning).

A text without a literal piece of three characters has no trigram, and one whose rarest trigram stands for more
than ``MAX_CANDIDATES`` ids isn't selective: both scan the dimension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
LOOKUPS = 8               # the rarest trigrams of a text that are looked up
MAX_CANDIDATES = 100_000  # ids of a broadcast, some 5 MB
PART_BYTES = 8 << 20      # of the dimension, in a folder of its rows

TITLE, CHANNEL_TITLE, CHANNEL_ID = "video_title", "channel_title", "channel_id"
ROW_COLUMNS = ["video_id", "video_title", "channel_id", "channel_title", "video_default_thumbnail"]
CHANNEL_ROW_COLUMNS = ["video_id", "channel_id", "channel_title"]


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, in code points; none for shorter texts and NULL."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM)))))


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.hash(key), F.lit(parts)).alias("part")


def title_rows(dim: DataFrame, parts: int) -> DataFrame:
    return dim.select(*ROW_COLUMNS, _part("video_id", parts))


def channel_rows(dim: DataFrame, parts: int) -> DataFrame:
    return dim.select(*CHANNEL_ROW_COLUMNS, _part("channel_id", parts))


def title_grams(dim: DataFrame, parts: int) -> DataFrame:
    """(field, gram, part, id); a video has one title, so rows are distinct without a shuffle."""
    return dim.select(F.lit(TITLE).alias("field"), F.explode(grams_of(F.col(TITLE))).alias("gram"),
                      _part("video_id", parts), F.col("video_id").alias("id"))


def channel_grams(dim: DataFrame, parts: int) -> DataFrame:
    """(field, gram, part, id) of every title that a channel has, and of its id."""
    channels = dim.select("channel_id", "channel_title").distinct()
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), grams_of(F.col(c)).alias("grams"))
                                 for c in (CHANNEL_TITLE, CHANNEL_ID)])).alias("f")
    each = channels.select(F.col("channel_id").alias("id"), _part("channel_id", parts), fields)
    return each.select("f.field", F.explode("f.grams").alias("gram"), "part", "id").distinct()


def gram_counts(*grams: DataFrame) -> DataFrame:
    """Ids per field and trigram."""
    out = grams[0]
    for more in grams[1:]:
        out = out.unionByName(more)
    return out.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))


# How each table is stored: arguments of ``files.materialize``
STORED = {
    "title_rows": {"partition_by": ["part"], "rebalance_by": ["part"], "sort_by": ["part", "video_id"]},
    "channel_rows": {"partition_by": ["part"], "rebalance_by": ["part"], "sort_by": ["part", "channel_id", "video_id"]},
    "title_grams": {"range_by": ["gram", "id"], "sort_by": ["gram", "id"]},
    "channel_grams": {"range_by": ["gram", "id"], "sort_by": ["gram", "id"]},
    "gram_counts": {"range_by": ["gram"], "sort_by": ["gram"]},
}


def index_tables(dim: DataFrame, parts: int,
                 store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, DataFrame]:
    """All tables of the index; each goes through ``store``, and the counts read what it returned."""
    out = {name: store(name, make(dim, parts)) for name, make in (
        ("title_rows", title_rows), ("channel_rows", channel_rows),
        ("title_grams", title_grams), ("channel_grams", channel_grams))}
    out["gram_counts"] = store("gram_counts", gram_counts(out["title_grams"], out["channel_grams"]))
    return out


# Searching ---------------------------------------------------------------------------------------

def text_grams(spark: SparkSession, text: str) -> list[str]:
    """The trigrams that every match of ``text`` holds. Lower case is Spark's own, of the whole pattern as
    ``ILIKE`` takes it; a local relation, so no job runs."""
    pieces = F.filter(F.split(F.lower("pattern"), "[%_]"), lambda p: F.length(p) >= GRAM)
    pattern = spark.sql("SELECT * FROM VALUES (:pattern) AS t(pattern)", args={"pattern": f"%{text}%"})
    found = pattern.select(F.array_distinct(F.flatten(F.transform(pieces, grams_of)))).first()[0]
    return list(found or [])


def _rarest(index: dict[str, DataFrame], fields: list[str], grams: list[str]) -> dict[str, list[str]] | None:
    """The trigrams to look up in each field; None where too many ids hold even the rarest one. Without counts
    (an index that isn't stored) it is the first ones."""
    if "gram_counts" not in index:
        return {f: grams[:LOOKUPS] for f in fields}
    counted = index["gram_counts"].filter(F.col("gram").isin(grams) & F.col("field").isin(fields)).collect()
    n = {(r["field"], r["gram"]): r["n"] for r in counted}
    out = {}
    for f in fields:
        out[f] = sorted(grams, key=lambda g: n.get((f, g), 0))[:LOOKUPS]
        if n.get((f, out[f][0]), 0) > MAX_CANDIDATES:
            return None
    return out


def _candidates(index: dict[str, DataFrame], table: str, fields: list[str], text: str) -> DataFrame | None:
    """(part, id) of the ids that hold all trigrams looked up, in any one of the fields."""
    grams = text_grams(index[table].sparkSession, text)
    chosen = _rarest(index, fields, grams) if grams else None
    if chosen is None:
        return None
    out = None
    for f, wanted in chosen.items():
        rows = index[table].filter((F.col("field") == f) & F.col("gram").isin(wanted))
        ids = rows.groupBy("part", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted))
        ids = ids.select("part", "id")
        out = ids if out is None else out.unionByName(ids)
    return F.broadcast(out) if "gram_counts" in index else out


def _rows(index: dict[str, DataFrame], rows: str, key: str, found: DataFrame) -> DataFrame:
    table = index[rows]
    of_id = (table["part"] == found["part"]) & table[key].eqNullSafe(found["id"])
    return table.join(found, of_id, "left_semi").drop("part")


def title_dim(index: dict[str, DataFrame], dim: DataFrame, text: str) -> DataFrame:
    """The rows of ``dim`` that may hold ``text`` in their title: all that do, and few others."""
    found = _candidates(index, "title_grams", [TITLE], text)
    return dim if found is None else _rows(index, "title_rows", "video_id", found)


def channel_dim(index: dict[str, DataFrame], dim: DataFrame, text: str) -> DataFrame:
    """The rows of ``dim`` whose channel's title or id may hold ``text``."""
    found = _candidates(index, "channel_grams", [CHANNEL_TITLE, CHANNEL_ID], text)
    return dim if found is None else _rows(index, "channel_rows", "channel_id", found)
