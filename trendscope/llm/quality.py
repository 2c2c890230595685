"""Quality rules with cross-document line frequency.

Base rules per document: too few words, or too many words inside repeated 3-word windows.
Method: every line with a word is normalised (runs of white space become one space, ends
trimmed, A-Z lower-cased) and hashed; the distinct documents of each host with that line are
counted (a document and its exact copies count once); a line is boilerplate of its host when
it is in more than ``max_docs`` documents and in more than ``max_share`` of the host's; a
document that keeps less than ``min_kept`` of its words without such lines is depleted and
rejected. Both limits must be exceeded, so that a group of near copies in a large host is
not taken for boilerplate.

Nulls: a null text has no words and fails the base rules; a null host is a host of its own;
a null id passes through. Repeated rows each give a row and count once per host.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch
from trendscope.llm.text import SPACE, Texts, Words, mix, trimmed, window_hashes

MIN_WORDS = 50          # fewer words fail
MAX_REPEAT_PERCENT = 50  # more words than this share in repeated 3-word windows fail
MAX_DOCS = 10           # documents of a host that may share a line
MAX_SHARE = 0.05        # share of a host's documents that may share a line
MIN_KEPT = 0.3          # words left without boilerplate lines

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = b" \t\n\x0b\x0c\r"

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "_text_key binary, _lines array<binary>, _line_words array<int>")


def _repeat_words(w: Words) -> np.ndarray:
    """Words of each text that a 3-word window found twice or more in it covers."""
    h = window_hashes(w.hashes(), 3)
    covered = np.zeros(len(w.row) + 1, dtype=np.int32)
    if len(h):
        inside = np.flatnonzero(w.row[:-2] == w.row[2:])
        key = mix(h[inside] + w.row[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        at = inside[order[again]]
        np.add.at(covered, at, 1)
        np.add.at(covered, np.minimum(at + 3, len(w.row)), -1)
    return np.bincount(w.row, weights=np.cumsum(covered[:-1]) > 0, minlength=w.texts.n).astype(np.int64)


def _lines(text: bytes) -> tuple[int, list[bytes], list[int]]:
    """Repeated lines; a 128-bit key and the word count of every line with a word."""
    seen, repeats, keys, counts = set(), 0, [], []
    for line in text.split(b"\n"):
        words = line.split()  # bytes.split: the six ASCII spaces
        if words:
            repeats += line in seen
            seen.add(line)
            keys.append(hashlib.blake2b(b" ".join(words).translate(_LOWER), digest_size=16).digest())
            counts.append(len(words))
    return repeats, keys, counts


def _measure(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in Texts.slices(batch.column(text)):
            w = Words(texts)
            inner = (texts.buf & 0xC0) != 0x80
            chars = np.concatenate([[0], np.cumsum(inner & ~SPACE[texts.buf])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[texts.buf])])
            data = texts.buf.tobytes()
            each = [data[a:b] for a, b in zip(texts.off[:-1], texts.off[1:])]
            lines = [_lines(x) for x in each]
            out = [pa.array(w.count, pa.int64()), pa.array(np.diff(chars[texts.off]), pa.int64()),
                   pa.array(np.diff(symbols[texts.off]), pa.int64()), pa.array([x[0] for x in lines], pa.int64()),
                   pa.array(_repeat_words(w), pa.int64()),
                   pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in each], pa.binary()),
                   pa.array([x[1] for x in lines], pa.list_(pa.binary())),
                   pa.array([x[2] for x in lines], pa.list_(pa.int32()))]
            rest = [c for i, c in enumerate(batch.slice(at, texts.n).columns) if i != text]
            names = [x for i, x in enumerate(batch.schema.names) if i != text]
            yield pa.RecordBatch.from_arrays(rest + out, names + [x.split()[0] for x in METRICS.split(", ")])


def boilerplate_lines(lines: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """From rows (_host, _doc, _lines): per host the array ``_removed`` of lines over both limits.

    ``_doc`` tells documents apart (copies share it). A host's array has at most (lines per
    document) / max_share entries. Counts are partial before each shuffle, so a hot host or
    line is not gathered in one task.
    """
    total = lines.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    count = (lines.select("_host", "_doc", F.explode("_lines").alias("_line")).distinct()
             .groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_docs))
    total = total.withColumnRenamed("_host", "_total_host")
    return (count.join(total, F.col("_host").eqNullSafe(F.col("_total_host")))
            .filter(F.col("_n") > max_share * F.col("_docs"))
            .groupBy(F.col("_host").alias("_removed_host")).agg(F.collect_set("_line").alias("_removed")))


def _judged(docs: DataFrame, carry: list[str], text_col: str, host_col: str, min_words: int,
            max_repeat_percent: int, max_docs: int, max_share: float, min_kept: float, keep_text: bool = False) -> DataFrame:
    """``_carry`` (a struct of the named columns, so that no name can clash) and the results; if asked
    for, ``_text`` beside ``_removed``."""
    scratch = Scratch(docs.sparkSession)
    carried = [F.col(c) for c in carry] + ([F.col(text_col).cast("string").alias("_kept_text")] if keep_text else [])
    rows = docs.select(F.struct(*carried).alias("_carry"), F.col(host_col).alias("_host"),
                       F.col(text_col).cast("string").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    measured = scratch.table(rows.mapInArrow(
        lambda b: trimmed(_measure(b, 2)), f"_carry {kinds['_carry']}, _host {kinds['_host']}, {METRICS}"))
    removed = scratch.table(boilerplate_lines(
        measured.select("_host", F.col("_text_key").alias("_doc"), "_lines"), max_docs, max_share))
    joined = measured.join(removed, F.col("_host").eqNullSafe(F.col("_removed_host")), "left")
    lost = F.aggregate(F.filter(F.arrays_zip("_lines", "_line_words"),
                                lambda x: F.array_contains("_removed", x["_lines"])),
                       F.lit(0).cast("long"), lambda n, x: n + x["_line_words"])
    n_kept = F.when(F.col("_removed").isNull(), F.col("n_words")).otherwise(F.col("n_words") - lost)
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    if keep_text:
        joined = joined.withColumn("_text", F.col("_carry._kept_text"))
    return (joined.withColumn("n_kept_words", n_kept).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("n_kept_words") >= min_kept * F.col("n_words"))))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the metrics, ``base_failed``, ``kept`` and
    ``n_kept_words`` (words without boilerplate lines)."""
    out = _judged(docs, [id_col], text_col, host_col, min_words, max_repeat_percent, max_docs, max_share, min_kept)
    return out.select("_carry.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_kept_words")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (column 1) without the lines whose keys are in the row's list (column 2)."""
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            if text is not None and removed.is_valid:
                gone = set(removed.as_py())
                text = "\n".join(line for line in text.split("\n") if gone.isdisjoint(_lines(line.encode())[1]))
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def quality_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``text`` without the lines over both limits (null: null; a text
    of such lines only is empty), ``n_words`` before, ``n_kept_words`` after, ``kept``."""
    judged = _judged(docs, [id_col], text_col, host_col, min_words, max_repeat_percent, max_docs, max_share, min_kept,
                     keep_text=True)
    rows = judged.select(F.struct(F.col("_carry")[id_col].alias("id"), "n_words", "n_kept_words", "kept").alias("row"),
                         "_text", "_removed")
    out = rows.mapInArrow(lambda b: trimmed(_without(b)), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(F.col("row.id").alias(id_col), "text", "row.n_words", "row.n_kept_words", "row.kept")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their columns unchanged."""
    return _judged(docs, docs.columns, "text", "source", MIN_WORDS, MAX_REPEAT_PERCENT, MAX_DOCS, MAX_SHARE,
                   MIN_KEPT).filter("kept").select("_carry.*")
