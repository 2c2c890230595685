"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are numbered and cut into blocks of ``block_docs``. Block j (from 1) of
a source with weight w may run from slot floor((j - 1) / w) and must run before slot
ceil(j / w); each slot goes to the released block with the earliest deadline. Weights are
multiples of 1 / units, so the schedule repeats after ``units`` slots: one period, of a size
fixed by the parameters, is laid out on the driver and joined to all blocks. Within every
prefix of slots, a source that still has blocks is less than one block off its weight. Slots
of a source that has run out stay empty: every document is kept, and the order of the rest
stays as it is.

Nulls: a null source is a source of its own; a null id sorts first. Repeated rows each get a
position. The last block of a source may be short.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch

BLOCK_DOCS = 8
UNITS = 1000
SMOOTHING = 0.7
RANGE_BYTES = 128 << 20   # of stored input for each partition of a range shuffle
MAX_RANGES = 1_000_000    # an estimate of an input that isn't read from files may be far too large
MAX_SOURCES = 10_000


def unit_weights(weights: dict, units: int = UNITS) -> dict:
    """Weights as whole units that add up to ``units``: at least one each, the rest by largest
    remainder, ties by name (None first)."""
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    if len(names) > units:
        raise ValueError("more sources than units")
    total = sum(Fraction(weights[s]) for s in names)
    exact = {s: Fraction(weights[s]) / total * (units - len(names)) for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    rest = units - sum(out.values())
    for s in sorted(names, key=lambda s: -(exact[s] - int(exact[s])))[:rest]:
        out[s] += 1
    return out


def period(units_of: dict) -> list[tuple[object, int, int]]:
    """(source, block of the period, slot) for one period of earliest-deadline-first; ties go
    to the source that comes first in ``units_of``."""
    size, order = sum(units_of.values()), list(units_of)
    waiting = [(0, k, 0) for k in range(len(order))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []            # deadline, source, block
    out = []
    for slot in range(size):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * size // units_of[order[k]]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append((order[k], j, slot))
        if j + 1 < units_of[order[k]]:
            heapq.heappush(waiting, ((j + 1) * size // units_of[order[k]], k, j + 1))
    return out


def natural_weights(counts: dict, smoothing: float = SMOOTHING) -> dict:
    """count ** smoothing, as fractions of a million: flattens the natural shares."""
    return {s: max(1, round(n ** smoothing * 1_000_000)) for s, n in counts.items()}


def _slotted(docs: DataFrame, weights: dict | None, id_col: str, source_col: str, block_docs: int, units: int,
             max_sources: int) -> DataFrame:
    """``_row`` (a struct of all columns, so that no name can clash) and its place."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    kind = docs.schema[source_col].dataType.simpleString()
    order = [F.col("_source").asc_nulls_first(), F.col("_id").asc_nulls_first()]
    # a range shuffle on (source, id) splits a hot source over as many partitions as it needs
    n = range_partitions(docs)
    placed = scratch.table(
        docs.select(F.struct(*docs.columns).alias("_row"), F.col(source_col).alias("_source"), F.col(id_col).alias("_id"))
        .repartitionByRange(n, *order).sortWithinPartitions(*order)
        .select("_row", "_source", F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    # one row per source and partition that holds some of it: ranges overlap in one value at most
    parts = placed.groupBy(F.col("_source").alias("_s"), F.col("_part").alias("_p")).agg(
        F.count("*").alias("_n"), F.min("_at").alias("_from"))
    parts = scratch.table(parts)
    counts = {r["_s"]: r["n"] for r in
              parts.groupBy("_s").agg(F.sum("_n").alias("n")).limit(max_sources + 1).collect()}
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources: group them before mixing")
    if weights is None:
        weights = natural_weights(counts)
    unit = unit_weights({s: weights[s] for s in counts}, max(units, 4 * len(counts)))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_s", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_add"))
    # both tables below are bounded: max_sources rows and one period
    sizes = F.broadcast(spark.createDataFrame(list(unit.items()), f"_us {kind}, mix_units long"))
    slots = F.broadcast(spark.createDataFrame([(s, j, t) for s, j, t in period(unit)], f"_ts {kind}, _j long, _t long"))
    out = placed.join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    out = out.withColumn("mix_seq", F.col("_at") + F.col("_add"))
    out = out.withColumn("mix_block", F.floor(F.col("mix_seq") / block_docs))
    out = out.join(sizes, F.col("_source").eqNullSafe(F.col("_us")))
    out = out.join(slots, F.col("_source").eqNullSafe(F.col("_ts"))
                   & (F.col("mix_block") % F.col("mix_units") == F.col("_j")))
    slot = F.floor(F.col("mix_block") / F.col("mix_units")) * sum(unit.values()) + F.col("_t")
    return out.select("_row", "mix_units", "mix_seq", "mix_block", slot.alias("mix_slot"))


PLACE = ("mix_units", "mix_seq", "mix_block", "mix_slot")


def mix_sources(docs: DataFrame, weights: dict | None = None, *, id_col: str = "doc_id", source_col: str = "source",
                block_docs: int = BLOCK_DOCS, units: int = UNITS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """All columns of ``docs``, with ``mix_units`` (weight of the source, of max(units, 4 *
    sources)), ``mix_seq`` (place in the source, from 0, by id), ``mix_block`` and
    ``mix_slot`` (they replace input columns of these names). The mixed order is
    (mix_slot, mix_seq). ``weights``: target weight by source, for every source that occurs;
    None: the natural shares, smoothed."""
    out = _slotted(docs, weights, id_col, source_col, block_docs, units, max_sources)
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in PLACE], *PLACE)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents in the mixed order: files by name, and the rows in them,
    follow it."""
    n = range_partitions(docs)
    mixed = _slotted(docs, None, "doc_id", "source", BLOCK_DOCS, UNITS, MAX_SOURCES)
    return (mixed.repartitionByRange(n, "mix_slot", "mix_seq").sortWithinPartitions("mix_slot", "mix_seq")
            .select("_row.*"))


def range_partitions(docs: DataFrame) -> int:
    """Partitions of a range shuffle of whole documents: the session's count, or more where Spark's
    estimate of the input asks for it, as nothing splits a range afterwards."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), MAX_RANGES))


def in_file_order(docs: DataFrame) -> DataFrame:
    """The rows of a written table in the order of its files by number (names with more digits come later)
    and the rows in them, as a scan packs files by size. Rows that are not read from files stay as they are."""
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select(F.struct(*docs.columns).alias("_row"), F.length(meta["file_path"]).alias("_digits"),
                           meta["file_path"].alias("_file"), meta["row_index"].alias("_at"))
    except AnalysisException:
        return docs
    order = ("_digits", "_file", "_at")
    return rows.repartitionByRange(range_partitions(docs), *order).sortWithinPartitions(*order).select("_row.*")
