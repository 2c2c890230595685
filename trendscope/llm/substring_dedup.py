"""Substring dedup by seed and extend.

A window is ``length`` consecutive words. Seeds are winnowed anchors: of the ``SEED``-word
runs in a window the one with the least hash, so that equal windows have equal anchors at
equal places. Consecutive windows with the same anchor form a stretch of up to
length - SEED + 1 windows around it.

1. Documents are joined on anchors; only anchors in two or more documents go on.
2. Each seed is extended both ways over its whole stretch: occurrences with equal stretches
   form a class, in which all but the smallest document repeat every window of the stretch.
   A class of any size costs one row per occurrence; no pairs are made.
3. Where an anchor has several classes, the smallest documents of the classes are extended
   window by window: windows are joined, and one that also starts in a smaller document is
   a repeat.
4. Repeats that touch or overlap are merged into maximal spans, all of ``length`` words or more,
   and their words are removed.

Words are unchanged runs of characters other than x20 and x09-x0D. Windows are judged on the
input. Seeds, stretches and windows are compared by two 64-bit hashes (the anchor's and the
whole's).

A null text has no words. A row with a null id has no place in the order: it neither removes
nor loses words. Rows with the same id are one document's: they don't remove each other's
words. Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch
from trendscope.llm.text import Texts, Words, lists, mix, powers, trimmed, window_hashes

LENGTH = 50
SEED = 25
_PLACE_BITS = 28          # of a packed hash, for the place in a slice: 2**28 words
_SPAN = 0xA0761D6478BD642F


def _windowed_min(v: np.ndarray, n: int) -> np.ndarray:
    """Least of each n consecutive values, by doubling."""
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (n - size)], v[n - size:]) if n > size else v


class Stretches:
    """Runs of windows with one anchor, over the texts of a slice: text index ``row``, window
    range ``lo``..``hi`` (word places in the slice) and the hashes ``anchor`` and ``whole``."""

    def __init__(self, texts: Texts, length: int, seed: int):
        self.words = w = Words(texts)
        self.hashed = h = w.hashes()
        self.row = self.lo = self.hi = np.zeros(0, dtype=np.int64)
        self.anchor = self.whole = np.zeros(0, dtype=np.uint64)
        if len(h) < length:
            return
        if len(h) >= 1 << _PLACE_BITS:
            raise ValueError(f"a text of 2**{_PLACE_BITS} words or more")
        seeds = window_hashes(h, seed)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        packed = (seeds & ~mask) | np.arange(len(seeds), dtype=np.uint64)
        least = _windowed_min(packed, length - seed + 1)
        place = (least & mask).astype(np.int64)
        start = np.flatnonzero(np.arange(len(place)) + length <= w.first[1:][w.row[:len(place)]])
        if not len(start):
            return
        place, row = place[start], w.row[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        self.row, self.lo = row[at], start[at]
        self.hi = start[np.append(at[1:], len(start)) - 1]
        self.anchor = seeds[place[at]]
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * powers(_SPAN, len(h) + 1)[:-1], out=sums[1:])
        back = powers(pow(_SPAN, -1, 1 << 64), len(h) + 1)
        span = (sums[self.hi + length] - sums[self.lo]) * back[self.lo]
        inside = (place[at] - self.lo) * 1024 + (self.hi - self.lo)
        self.whole = mix(span + inside.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _seeds(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """id, key, text -> id, key and lists of anchors, whole hashes and window ranges."""
    for batch in batches:
        for at, texts in Texts.slices(batch.column(2)):
            s = Stretches(texts, length, seed)
            first = s.words.first[s.row]
            columns = [lists(s.anchor.view(np.int64), s.row, texts.n, pa.int64()),
                       lists(s.whole.view(np.int64), s.row, texts.n, pa.int64()),
                       lists(s.lo - first, s.row, texts.n, pa.int32()), lists(s.hi - first, s.row, texts.n, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, texts.n), batch.column(1).slice(at, texts.n),
                                              *columns], ["id", "key", "anchor", "whole", "lo", "hi"])


def _contested(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """id, key, text, list of whole hashes -> a row for every window of those stretches."""
    for batch in batches:
        for at, texts in Texts.slices(batch.column(2)):
            s = Stretches(texts, length, seed)
            wanted = batch.column(3).slice(at, texts.n)
            values = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.repeat(np.arange(texts.n), np.diff(wanted.offsets.to_numpy()))
            salt = np.uint64(0x8EBC6AF09C88C6E3)
            pick = np.flatnonzero(np.isin(mix(s.whole + s.row.astype(np.uint64) * salt),
                                          mix(values + rows.astype(np.uint64) * salt)))
            size = (s.hi - s.lo + 1)[pick]
            place = np.repeat(s.lo[pick], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(s.row[pick], size)
            whole = window_hashes(s.hashed, length)
            take = pa.array(row + at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(np.repeat(s.anchor[pick], size).view(np.int64)), pa.array(whole[place].view(np.int64)),
                 pa.array((place - s.words.first[row]).astype(np.int32))], ["id", "key", "anchor", "window", "lo"])


def _spans(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Word spans of windows lo..hi, merged where they touch or overlap."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), (hi + length).tolist())):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """carry, text, lists lo and hi -> carry, n_words, n_removed, spans, kept text."""
    for batch in batches:
        for at, texts in Texts.slices(batch.column(1)):
            w, data = Words(texts), texts.buf.tobytes()
            removed, spans, kept = [], [], []
            for i in range(texts.n):
                lo, hi = batch.column(2)[at + i], batch.column(3)[at + i]
                found = _spans(np.array(lo.as_py()), np.array(hi.as_py()), length) if lo.is_valid else []
                stay = np.ones(w.count[i], dtype=bool)
                for a, b in found:
                    stay[a:b] = False
                mine = slice(w.first[i], w.first[i + 1])
                kept.append(b" ".join([data[a:b] for a, b in zip(w.start[mine][stay].tolist(), w.end[mine][stay].tolist())]))
                removed.append(int((~stay).sum()))
                spans.append([{"first_word": a, "end_word": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, texts.n), pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))),
                 pa.array([k.decode() for k in kept], pa.string()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["carry", "n_words", "n_removed", "removed_spans", "kept_text", "kept_sha256"])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     seed: int = SEED) -> DataFrame:
    """Per row: the id, n_words, n_removed, removed_spans, kept_text (kept words joined by one
    space) and kept_sha256."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    seeds = scratch.table(ordered.mapInArrow(
        lambda b: trimmed(_seeds(b, length, seed)),
        f"id {kind}, key long, anchor array<long>, whole array<long>, lo array<int>, hi array<int>"))
    flat = seeds.select("id", "key", F.explode(F.arrays_zip("anchor", "whole", "lo", "hi")).alias("s")).select("id", "key", "s.*")
    shared = (flat.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                         (F.min("whole") != F.max("whole")).alias("contested"))
              .filter(F.col("first") < F.col("last")).select("anchor", "contested"))
    stretches = scratch.table(flat.join(scratch.table(shared), "anchor"))
    scratch.drop(seeds)
    # written, so that both sides of the join are shuffled for it and a hot class is split
    classes = scratch.table(stretches.groupBy("anchor", "whole").agg(F.min("id").alias("least")))
    judged = stretches.join(classes, ["anchor", "whole"])
    repeats = judged.filter(F.col("id") > F.col("least")).select("id", "key", "lo", "hi")
    wanted = (judged.filter((F.col("id") == F.col("least")) & F.col("contested"))
              .groupBy("id", "key").agg(F.collect_set("whole").alias("wanted")))
    windows = scratch.table(ordered.join(wanted, ["id", "key"]).select("id", "key", "text", "wanted").mapInArrow(
        lambda b: trimmed(_contested(b, length, seed)), f"id {kind}, key long, anchor long, window long, lo int"))
    least = scratch.table(windows.groupBy("anchor", "window").agg(F.min("id").alias("least")))
    single = (windows.join(least, ["anchor", "window"]).filter(F.col("id") > F.col("least"))
              .select("id", "key", "lo", F.col("lo").alias("hi")))
    # as many entries as a document has repeated stretches and windows: bounded by its length
    marks = scratch.table(repeats.unionByName(single).distinct().groupBy("id", "key").agg(
        F.collect_list(F.struct("lo", "hi")).alias("marks"))
        .select(F.col("id").alias("mark_id"), F.col("key").alias("mark_key"), F.col("marks.lo").alias("lo"),
                F.col("marks.hi").alias("hi")))
    joined = rows.join(marks, (F.col("id") == F.col("mark_id")) & (F.col("key") == F.col("mark_key")), "left")
    out = joined.select("id", "text", "lo", "hi").mapInArrow(
        lambda b: trimmed(_kept(b, length)),
        f"carry {kind}, n_words long, n_removed long, removed_spans array<struct<first_word: int, end_word: int>>, "
        "kept_text string, kept_sha256 string")
    return out.withColumnRenamed("carry", id_col)
