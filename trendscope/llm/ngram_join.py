"""N-gram Jaccard self-join by a grouped prefix join, with link components.

A document's set is its distinct n-word shingles (all words as one shingle where there are
fewer); documents link when 100 * intersection >= percent * union.

1. Documents with equal sets (size and 128-bit sum fingerprint) are one class; one
   representative goes on.
2. Shingles are ordered by frequency, rare ones first, then by hash. Frequencies are summed
   over all documents from counts of a task's chunks that reach ``CHUNK_LEAST``; sums from the
   least power of two on that leaves at most ``FREQUENT`` of them are used. Any common order
   gives the same links; this one keeps common passages out of prefixes.
3. Linked sets share a shingle among the first size - ceil(percent * size) + 1, and the first
   that they share is an early one of the smaller set. Classes with equal prefixes and sizes
   are one group, and groups are joined on prefix shingles that are early in one of them.
4. In each shingle's list every group is compared with one pivot (an early one), and every
   member of a group with its leader, so a large group of copies costs one pair per member.
   Pairs are filtered by size and by parity maps (each shingle flips one bit of its set's map,
   so two sets differ in at least as many shingles as their maps in bits), verified on whole
   sets, and components are formed. Then groups
   are expanded to their members, and lists that lie in one component are done. ``ROUNDS``
   further rounds compare a list's other members with one of its last component.
5. Every pair in a list that is still in different components, and passes the size and
   place filters, is verified. Pairs inside a component can't change it. So no link between
   components is lost, and no pair of copies is needed.

A text without words (or null) has the empty set and links with nothing: its component is its
own id. Rows with a null id link with nothing and have a null component. An id that stands for
several texts links by the set of each of them, and so ties their classes together; each row
is returned, with the size of its own set. Component ids are the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendscope.llm.components import smallest_reachable
from trendscope.llm.scratch import Scratch
from trendscope.llm.text import Texts, Words, lists, mix, shingle_sets, trimmed

N = 4
PERCENT = 85
FREQUENT = 500_000   # shingles with a frequency: at most 8 MB, broadcast
CHUNK = 1 << 21      # shingles that a task counts at once
CHUNK_LEAST = 3
BITS = 1 << 23       # of the filter for wanted documents: 2 MB, broadcast
ROUNDS = 1
PARITY_BITS = 1024   # of a set's parity map
WIDE_BITS = 16384    # of the second map of a large set
WIDE_FROM = 1000     # shingles of a large set


def _sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts)
    return shingle_sets(w, w.hashes(lower=True), n)


def _chunk_counts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Documents with each shingle, among those of a chunk, where they are CHUNK_LEAST or more."""
    chunk: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(chunk), return_counts=True)
        chunk.clear()
        enough = c >= CHUNK_LEAST
        return pa.RecordBatch.from_arrays([pa.array(h[enough].view(np.int64)), pa.array(c[enough], pa.int64())], ["t", "c"])

    for batch in batches:
        for _, texts in Texts.slices(batch.column(0)):
            chunk.append(_sets(texts, n)[1])
            if sum(map(len, chunk)) >= CHUNK:
                yield counted()
    if chunk:
        yield counted()


def _fingerprint(off: np.ndarray, h: np.ndarray) -> list[pa.Array]:
    """Two sums over the hashes of each text."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        out.append(pa.array((sums[off[1:]] - sums[off[:-1]]).view(np.int64)))
    return out


def prefix_size(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-percent * sizes // 100) + 1


def _parity(off: np.ndarray, h: np.ndarray, bits: int, least: int) -> pa.ListArray:
    """The parity map of each text's set, as 64-bit words; null for sets below ``least``."""
    size = np.diff(off)
    large = size >= least
    row = np.repeat(np.cumsum(large) - 1, size)
    h = h[np.repeat(large, size)]
    row = row[np.repeat(large, size)]
    bit = (mix(h ^ np.uint64(0x452821E638D01377)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(row * bits + bit, minlength=int(large.sum()) * bits) & 1
    words = np.packbits(odd.astype(bool)).view(np.int64)
    ends = np.concatenate([[0], np.cumsum(large)]).astype(np.int32) * (bits // 64)
    starts = pa.array(ends, mask=np.append(~large, False))
    return pa.ListArray.from_arrays(starts, pa.array(words))


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, common: np.ndarray,
              counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, text -> id, size and the prefix in the global order."""
    for batch in batches:
        for at, texts in Texts.slices(batch.column(1)):
            rows, h = _sets(texts, n)
            weight = np.zeros(len(h), dtype=np.int64)
            if len(common):
                place = np.minimum(np.searchsorted(common, h), len(common) - 1)
                weight = np.where(common[place] == h, counts[place], 0)
            order = np.lexsort((h, weight, rows))  # within a text: by frequency, then by hash
            off = np.searchsorted(rows, np.arange(texts.n + 1))
            size = np.diff(off)
            keep = np.arange(len(h)) - off[rows] < prefix_size(size, percent)[rows]
            prefix, of = h[order][keep], rows[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, texts.n), pa.array(size, pa.int64()), *_fingerprint(off, h),
                 *_fingerprint(np.searchsorted(of, np.arange(texts.n + 1)), prefix), _parity(off, h, PARITY_BITS, 0),
                 _parity(off, h, WIDE_BITS, WIDE_FROM), lists(prefix.view(np.int64), of, texts.n, pa.int64())],
                ["id", "n", "f1", "f2", "c1", "c2", "parity", "wide", "prefix"])


def _set_lists(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in Texts.slices(batch.column(1)):
            rows, h = _sets(texts, n)
            off = np.searchsorted(rows, np.arange(texts.n + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, texts.n), *_fingerprint(off, h),
                 pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], ["id", "f1", "f2", "set"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b and their sets -> the pairs that link."""
    for batch in batches:
        links = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            links[i] = both * 100 >= percent * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(links)) for c in batch.columns[:2]], ["a", "b"])


def _likely(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and parity maps allow a link."""
    def side(name: str, *columns: str) -> DataFrame:
        return members.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    sized = pairs.join(side("a", "n"), "a").join(side("b", "n"), "b").filter(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    both = F.col("n_a") + F.col("n_b")

    def allowed(name: str) -> Column:
        differ = F.aggregate(
            F.zip_with(f"{name}_a", f"{name}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")),
            F.lit(0).cast("long"), lambda n, x: n + x)
        return 100 * (both - differ) >= percent * (both + differ)

    small = (sized.join(side("a", "parity"), "a").join(side("b", "parity"), "b").filter(allowed("parity"))
             .select("a", "b", "n_a", "n_b"))
    # a large set's first map is nearly random; pairs of two large sets compare the second
    wide = members.filter(F.col("wide").isNotNull())
    return (small.join(wide.select(F.col("rep").alias("a"), F.col("wide").alias("wide_a")), "a", "left")
            .join(wide.select(F.col("rep").alias("b"), F.col("wide").alias("wide_b")), "b", "left")
            .filter(F.coalesce(allowed("wide"), F.lit(True))).select("a", "b"))


def _links(pairs: DataFrame, rows: DataFrame, members: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Verified pairs (a, b), from the whole sets of the documents that are in likely pairs."""
    likely = scratch.table(_likely(pairs.distinct(), members, percent))
    ends = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    sets = scratch.table(_sets_of(rows, members.select("rep", "n", "f1", "f2").join(ends, "rep"), n))
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    joined = likely.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    links = scratch.table(joined.mapInArrow(lambda b: trimmed(_verify(b, percent)), "a long, b long"))
    scratch.drop(sets)
    return links


def _early(percent: int, n: Column, p: Column) -> Column:
    """Whether a shingle at place p (from 0) can be the first that a set of n shares with a set
    of its own size or larger: then at most n - p can be shared, of n + n at least."""
    return (100 + percent) * (n - p) >= 2 * percent * n


def _first_shared(percent: int, n1: Column, n2: Column, p1: Column, p2: Column) -> Column:
    """Whether sets can link whose first shared shingle stands at places p1 and p2: at most
    least(n1 - p1, n2 - p2) can be shared. Every linked pair passes in one of its lists."""
    return (100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2)


def _frequent(rows: DataFrame, scratch: Scratch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their counts: at most FREQUENT."""
    counts = scratch.table(rows.select("text").mapInArrow(lambda b: trimmed(_chunk_counts(b, n)), "t long, c long")
                           .groupBy("t").agg(F.sum("c").alias("c")))
    level = F.floor(F.log2("c")).cast("int")
    held, cut = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        held += r["n"]
        if held > FREQUENT:
            break
        cut = r["level"]
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = counts.filter(level >= cut).toArrow()
    scratch.drop(counts)
    t = table["t"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(t)
    return t[order], table["c"].to_numpy()[order]


def _bits_of(ids: DataFrame) -> np.ndarray:
    """A bit array of BITS bits with the hashed ids: at most BITS / 64 sums reach the driver."""
    at = F.pmod(F.xxhash64("id"), F.lit(BITS))
    words = (ids.select(F.floor(at / 32).cast("int").alias("word"), (at % 32).alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask")).toArrow())
    out = np.zeros(BITS // 32, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint64)
    return out


def _wanted_sets(batches: Iterator[pa.RecordBatch], n: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, place of its bit, text -> the sets of the rows whose bit is set."""
    for batch in batches:
        at = batch.column(1).to_numpy()
        hit = (bits[at // 32] >> (at % 32).astype(np.uint64)) & np.uint64(1)
        yield from _set_lists([batch.filter(pa.array(hit.astype(bool))).select([0, 2])], n)


def _sets_of(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, n, set) of the documents ``wanted`` (rep, n, f1, f2). A bit array of fixed size keeps
    most other texts from being worked and shuffled; as it fills, more pass it. The join
    behind it is exact."""
    bits = rows.sparkSession.sparkContext.broadcast(_bits_of(wanted.select(F.col("rep").alias("id"))))  # BITS / 4 bytes
    found = (rows.filter("id is not null and text is not null")
             .select("id", F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("at"), "text")
             .mapInArrow(lambda b: trimmed(_wanted_sets(b, n, bits.value)), "id long, f1 long, f2 long, set binary"))
    return (found.join(wanted.withColumnRenamed("rep", "id"), ["id", "f1", "f2"])
            .select("id", "n", "f1", "f2", "set").dropDuplicates(["id", "n", "f1", "f2"]))


def _labelled(lists: DataFrame, stars: DataFrame) -> DataFrame:
    """``lists`` (t, rep, ...) with the component so far, of the shingles whose lists are in more
    than one component."""
    out = (lists.join(stars.select(F.col("node").alias("rep"), F.col("label").alias("l")), "rep", "left")
           .withColumn("label", F.coalesce("l", "rep")).drop("l"))
    apart = (out.groupBy("t").agg(F.min("label").alias("least"), F.max("label").alias("most"))
             .filter("least < most"))
    return out.join(apart, "t")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                    percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(_frequent(rows, scratch, n))
    prefixes = scratch.table(rows.mapInArrow(
        lambda b: trimmed(_prefixes(b, n, percent, *common.value)),
        "id long, n long, f1 long, f2 long, c1 long, c2 long, parity array<long>, wide array<long>, prefix array<long>"))
    key = ["n", "f1", "f2"]
    slim = scratch.table(prefixes.drop("prefix", "parity", "wide"))
    # every distinct set of an id is in a class; a node of the links is an id, with all its sets
    documents = scratch.table(slim.filter("id is not null and n > 0").distinct())
    classes = documents.groupBy(*key, "c1", "c2").agg(F.min("id").alias("rep"))
    groups = classes.groupBy("n", "c1", "c2").agg(F.min("rep").alias("g"))
    found = prefixes.filter("id is not null and n > 0")
    members = classes.join(groups, ["n", "c1", "c2"]).select("rep", "g", *key)
    members = scratch.table(members.join(found.select(F.col("id").alias("rep"), *key, "parity", "wide"), ["rep", *key])
                            .dropDuplicates(["rep", *key]))
    leaders = members.filter("rep = g").select(F.col("g").alias("id"), *key)
    kept = scratch.table(found.join(leaders, ["id", *key]).select(F.col("id").alias("g"), "n", "prefix"))
    scratch.drop(prefixes)
    # lists of the shingles that two or more groups share and that are early in one of them
    posted = kept.select("g", "n", F.posexplode("prefix").alias("p", "t"))
    early = _early(percent, F.col("n"), F.col("p"))
    shared = scratch.table(posted.groupBy("t").agg(
        F.min("g").alias("least"), F.max("g").alias("last"), F.min(F.when(early, F.col("g"))).alias("pivot"))
        .filter("least < last and pivot is not null").select("t", "pivot"))
    grouped = scratch.table(posted.join(shared, "t").withColumnRenamed("n", "gn"))
    scratch.drop(kept, shared)
    inside = members.filter("rep <> g").select(F.col("g").alias("a"), F.col("rep").alias("b"))
    # every group against its list's pivot, members against their leader
    pairs = grouped.filter("g <> pivot").select(F.col("pivot").alias("a"), F.col("g").alias("b")).unionByName(inside)
    # an id with several sets ties their classes together
    several = documents.groupBy("id").agg(F.count("*").alias("sets")).filter("sets > 1").select("id")
    tied = (documents.join(several, "id").join(members.select("rep", *key), key).filter("id <> rep")
            .select(F.col("id").alias("a"), F.col("rep").alias("b")))
    stars = _grown(None, _links(pairs, rows, members, n, percent, scratch).unionByName(tied), scratch)
    # what is still apart, by members; a group's members share their prefix, a list of their own
    own = members.join(inside.select(F.col("a").alias("g")).distinct(), "g").select(
        F.xxhash64("g", "n").alias("t"), "rep", "n", F.lit(0).alias("p"))
    lists = _labelled(grouped.join(members.select("g", "rep", "n", F.col("n").alias("gn")), ["g", "gn"])
                      .select("t", "rep", "n", "p").unionByName(own), stars)
    lists = scratch.table(lists.distinct())
    scratch.drop(grouped)
    for _ in range(ROUNDS):  # each list's last component against one of its members
        pivots = lists.filter("label = most").groupBy("t").agg(F.min("rep").alias("a"))
        pairs = lists.filter("label <> most").select("t", F.col("rep").alias("b")).join(pivots, "t").select("a", "b")
        stars = _grown(stars, _links(pairs, rows, members, n, percent, scratch), scratch)
        after = scratch.table(_labelled(lists.select("t", "rep", "n", "p"), stars))
        scratch.drop(lists)
        lists = after
    # each member outside its list's largest component against all of the list
    sizes = lists.groupBy("t", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("t").agg(F.max(F.struct("size", "label")).alias("m")).select("t", F.col("m.label").alias("main"))
    mixed = scratch.table(lists.join(largest, "t").select("t", "rep", "n", "p", "label", (F.col("label") == F.col("main")).alias("main")))

    def side(k: int, keep: Column) -> DataFrame:
        return mixed.filter(keep).select("t", *[F.col(c).alias(f"{c}{k}") for c in ("rep", "n", "p", "label")])

    early = _early(percent, F.col("n"), F.col("p"))  # of the smaller set; equal sizes are met from both sides
    allowed = (F.col("label1") != F.col("label2")) & (F.col("n1") <= F.col("n2")) & _first_shared(
        percent, F.col("n1"), F.col("n2"), F.col("p1"), F.col("p2"))
    pairs = (side(1, early & ~F.col("main")).join(side(2, F.lit(True)), "t").filter(allowed).unionByName(
        side(1, early & F.col("main")).join(side(2, ~F.col("main")), "t").filter(allowed))
        .select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")))
    stars = _grown(stars, _links(pairs, rows, members, n, percent, scratch), scratch)
    of = (documents.select("id", *key).join(members.select("rep", *key), key)
          .join(stars.select(F.col("node").alias("rep"), "label"), "rep", "left")
          .groupBy(F.col("id").alias("member")).agg(F.min(F.coalesce("label", "rep")).alias("component")))
    of = scratch.table(of.filter("component <> member"))
    out = slim.select("id", "n").join(of, F.col("id") == F.col("member"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "id").alias("component_id"))


def _grown(stars: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, label) with some more links."""
    if stars is not None:
        links = links.unionByName(stars.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    return scratch.table(smallest_reachable(links, scratch))


def _own_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """row, text -> row, size and fingerprint of its set."""
    for batch in batches:
        for at, texts in Texts.slices(batch.column(1)):
            rows, h = _sets(texts, n)
            off = np.searchsorted(rows, np.arange(texts.n + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, texts.n), pa.array(np.diff(off), pa.int64()), *_fingerprint(off, h)],
                                             ["_row", "n", "f1", "f2"])


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component of 5-word shingles at 80 percent stays, the one
    with the smallest id. Of several rows with its id, those with equal sets are one document,
    and the others stay beside it; rows with a null id stay."""
    component = near_duplicates(docs, n=5, percent=80)
    gone = component.filter("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # only rows of ids that stand several times are dealt by id; few or none, as their size shows
    again = Scratch(spark).table(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
                                 .filter("n > 1").select("doc_id"))
    rows = left.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    kinds = rows.schema["_row"].dataType.simpleString()
    sets = rows.mapInArrow(lambda b: trimmed(_own_sets(b, 5)), f"_row {kinds}, n long, f1 long, f2 long")
    rank = F.row_number().over(Window.partitionBy("_row.doc_id", "n", "f1", "f2").orderBy(F.xxhash64("_row.text"), "_row.text"))
    first = sets.withColumn("_rank", rank).filter("_rank = 1").select("_row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
