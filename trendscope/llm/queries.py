"""Registered queries of this subpackage: thin calls of the operators with production
parameters over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trendscope.llm import (fill_in_middle, html_extract, language_id, line_dedup, mixing, ngram_join, quality, secret_scan,
                            sentencepiece_nbest, substring_dedup, topk, warc, whitening)

_ready: set[str] = set()


def executors_ready(spark: SparkSession) -> None:
    """Once per application: where the executors can't import this package, ship it to them."""
    sc = spark.sparkContext
    if sc.applicationId in _ready:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def importable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import importlib.util
        try:
            found = importlib.util.find_spec("trendscope.llm") is not None
        except ModuleNotFoundError:
            found = False
        yield pa.RecordBatch.from_arrays([pa.array([found])], ["found"])

    importable.__module__ = "__main__"  # so that the probe itself is pickled by value
    if not all(r["found"] for r in spark.range(0, 1, 1, 1).mapInArrow(importable, "found boolean").collect()):
        path = os.path.join(tempfile.mkdtemp(prefix="trendscope-"), "trendscope.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
    _ready.add(sc.applicationId)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    executors_ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "text", "n_lines_in", "n_lines_dropped")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.encode_edits(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform_and_restore(_table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_rows(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_ngram_join, op3_language_id, op4_mixing, op5_quality_rules,
                            op6_substring_dedup, op7_line_dedup, op8_sentencepiece, op9_topk, op10_html_extract,
                            op11_fill_in_middle, op12_warc, op13_whitening)}

_WORD = r"[^\x20\x09-\x0D]+"
_ROWS = "rows_ AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents)"

_OP2 = f"""
WITH RECURSIVE {_ROWS},
words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '{_WORD}') AS w FROM rows_),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {ngram_join.N} THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + {ngram_join.N - 1}], ' ') FOR i IN range(1, len(w) - {ngram_join.N - 2})])
                END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {ngram_join.PERCENT} * (a.n + b.n - count(*))),
reach(p, q) AS (SELECT p, q FROM links UNION SELECT reach.p, links.q FROM reach JOIN links ON reach.q = links.p)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       least(doc_id, coalesce((SELECT min(q) FROM reach WHERE reach.p = sets.doc_id), doc_id)) AS component_id FROM sets
"""

# the period is laid out slot by slot: among the released blocks, the earliest deadline
_OP4 = f"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS k FROM documents GROUP BY source),
weights AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i,
                   greatest(1, CAST(round_even(power(k, {mixing.SMOOTHING}) * 1000000, 0) AS HUGEINT)) AS w FROM counted),
whole AS (SELECT count(*) AS s, greatest({mixing.UNITS}, 4 * count(*)) AS u, sum(w) AS total FROM weights),
floors AS (SELECT source, i, u, 1 + (w * (u - s)) // total AS a, (w * (u - s)) % total AS rest FROM weights, whole),
units AS (SELECT source, i, u, CAST(a + CAST(row_number() OVER (ORDER BY rest DESC, i) <= u - sum(a) OVER () AS INT) AS BIGINT) AS a
          FROM floors),
slots AS (
  SELECT CAST(0 AS BIGINT) AS t, list(CAST(0 AS BIGINT) ORDER BY i) AS c, list(a ORDER BY i) AS a, any_value(u) AS u,
         CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS j FROM units
  UNION ALL
  SELECT t + 1, [c[k] + CAST(k = p AS INT) FOR k IN range(1, len(a) + 1)], a, u, p, c[p]
  FROM (SELECT t, c, a, u, list_min([{{'d': ((c[k] + 1) * u + a[k] - 1) // a[k], 'k': k}} FOR k IN range(1, len(a) + 1)
                                     IF c[k] < a[k] AND c[k] * u // a[k] <= t]).k AS p FROM slots WHERE t < u)),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS seq FROM documents)
SELECT doc_id, placed.source, units.a AS mix_units, seq AS mix_seq, seq // {mixing.BLOCK_DOCS} AS mix_block,
       seq // {mixing.BLOCK_DOCS} // units.a * units.u + slots.t - 1 AS mix_slot
FROM placed JOIN units ON placed.source IS NOT DISTINCT FROM units.source
JOIN slots ON slots.p = units.i AND slots.j = seq // {mixing.BLOCK_DOCS} % units.a
"""

_OP5 = rf"""
WITH {_ROWS},
words AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '{_WORD}') AS w FROM rows_),
grams AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM grams),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM found CROSS JOIN (VALUES (0), (1), (2)) AS t(k) WHERE c >= 2 GROUP BY r),
lines AS (SELECT r, source, md5(text) AS page, line, regexp_extract_all(line, '{_WORD}') AS lw,
                 translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM rows_)
          WHERE len(regexp_extract_all(line, '{_WORD}')) > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
total AS (SELECT source, count(DISTINCT md5(text)) AS docs FROM rows_ GROUP BY source),
boiler AS (SELECT lines.source, k FROM lines JOIN total ON lines.source IS NOT DISTINCT FROM total.source
           GROUP BY lines.source, k, docs
           HAVING count(DISTINCT page) > {quality.MAX_DOCS} AND count(DISTINCT page) > {quality.MAX_SHARE} * docs),
lost AS (SELECT r, sum(len(lw)) AS n FROM lines JOIN boiler
         ON lines.source IS NOT DISTINCT FROM boiler.source AND lines.k = boiler.k GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(w) - coalesce(lost.n, 0) AS BIGINT) AS n_kept_words
      FROM words LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
       AND n_kept_words >= {quality.MIN_KEPT} * n_words AS kept FROM m
"""

_OP6 = f"""
WITH {_ROWS},
words AS (SELECT r, doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM rows_),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {substring_dedup.LENGTH - 1}], ' ')) AS x
            FROM (SELECT *, unnest(range(1, len(w) - {substring_dedup.LENGTH - 2})) AS i FROM words
                  WHERE len(w) >= {substring_dedup.LENGTH})),
repeats AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {substring_dedup.LENGTH})) AS k FROM repeats),
marked AS (SELECT r, list(k) AS ks FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string([w[k] FOR k IN range(1, len(w) + 1) IF ks IS NULL OR NOT list_contains(ks, k)], ' ')) AS kept_sha256
FROM words LEFT JOIN marked USING (r)
"""

_OP7 = f"""
WITH {_ROWS.replace("coalesce(text, '') AS text", "text")},
lines AS (SELECT r, source, text, i, l, trim(l, ' ' || chr(9) || chr(13)) AS k
          FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS l,
                       generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows_ WHERE text IS NOT NULL)),
total AS (SELECT source, count(DISTINCT text) AS pages FROM rows_ GROUP BY source),
drops AS (SELECT lines.source, k FROM lines JOIN total ON lines.source IS NOT DISTINCT FROM total.source WHERE k <> ''
          GROUP BY lines.source, k, pages
          HAVING count(DISTINCT text) >= {line_dedup.MIN_PAGES} AND count(DISTINCT text) > {line_dedup.MAX_RATIO} * pages),
marked AS (SELECT lines.*, drops.k IS NOT NULL AS gone FROM lines LEFT JOIN drops
           ON lines.source IS NOT DISTINCT FROM drops.source AND lines.k = drops.k),
done AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS d,
                coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM marked GROUP BY r)
SELECT doc_id, t AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_lines_in, CAST(coalesce(d, 0) AS BIGINT) AS n_lines_dropped
FROM rows_ LEFT JOIN done USING (r)
"""

_OP9 = f"""
WITH valid AS (
  SELECT vec_id, [CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM valid WHERE vec_id % {topk.EVERY} = 0) q JOIN valid c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {topk.K}
"""

_OP11 = f"""
WITH tokens AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                       sha256('{fill_in_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(0, 4)] AS h FROM tokens),
formed AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS x, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS y,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                            OR h[3] % 100 >= {fill_in_middle.FIM_PERCENT} THEN 'plain'
                       WHEN h[4] % 100 < {fill_in_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:x], ''), '') AS p,
                 coalesce(array_to_string(u[x + 1:y], ''), '') AS m, coalesce(array_to_string(u[y + 1:n], ''), '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts
"""

_NIBBLES = "".join(f"{i:04b}" for i in range(16))
_FIVES = "".join(f"{i:05b}|" for i in range(32))
_OP12 = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
grouped AS (SELECT page_id, b, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS least FROM payloads),
digits AS (SELECT *, array_to_string([substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)
                                      FOR i IN range(1, 41)], '') AS bits FROM grouped)
SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (strpos('{_FIVES}', substr(bits, 5 * i + 1, 5) || '|') + 5) // 6, 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN least IS NULL OR page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM digits
"""

ORACLE_SQL: dict[str, str] = {"op2_ngram_join": _OP2, "op4_mixing": _OP4, "op5_quality_rules": _OP5, "op6_substring_dedup": _OP6,
                              "op7_line_dedup": _OP7, "op9_topk": _OP9, "op11_fill_in_middle": _OP11, "op12_warc": _OP12}
