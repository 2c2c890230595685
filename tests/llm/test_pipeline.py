"""The pipeline against a plain Python version of all its stages, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import plain
from tests.oracle_compare import compare
from trendscope.llm import line_dedup, mixing, quality, queries, sentencepiece_nbest


def plain_run(rows, vocabulary):
    kept = [r for r, q in zip(rows, plain.quality(rows, quality.MIN_WORDS, quality.MAX_REPEAT_PERCENT, quality.MAX_DOCS,
                                                  quality.MAX_SHARE, quality.MIN_KEPT)) if q["kept"]]
    kept = plain.clean_lines(kept, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES)
    label = plain.components(kept, 5, 80)
    kept = [r for r in kept if label[r["doc_id"]] == r["doc_id"]]
    counts = {}
    for r in kept:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    units = mixing.unit_weights(mixing.natural_weights(counts), max(mixing.UNITS, 4 * len(counts)))
    place = plain.mix(kept, units, mixing.BLOCK_DOCS)
    kept.sort(key=lambda r: place[r["doc_id"]])
    encoder = sentencepiece_nbest.Encoder(vocabulary, sentencepiece_nbest.N_BEST)
    out = []
    for r in kept:
        if len(r["text"]) < 1500:
            score, ids = plain.best_path(r["text"], vocabulary)
        else:
            found, scores, _ = encoder.encode(r["text"])
            score, ids = scores[0], found.tolist()
        out.append((r["doc_id"], r["lang"], r["source"], len(r["text"]), len(ids), score, list(ids)))
    return out


def test_pipeline_against_plain_python(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    expected = plain_run(rows, sentencepiece_nbest.Vocabulary(sentencepiece_nbest.default_model()))
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_pieces", "n_best_scores", "ids"]
    got = sorted((r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_pieces"], r["n_best_scores"][0], list(r["ids"]))
                 for r in out.collect())
    assert 0 < len(got) < len(rows)
    assert got == sorted(expected)


def test_pipeline_keeps_the_mixed_order(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    expected = plain_run(rows, sentencepiece_nbest.Vocabulary(sentencepiece_nbest.default_model()))
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, SF_SMALL).collect()] == [r[0] for r in expected]


def test_encode_stage_follows_files(spark, tmp_path):
    """Files of growing size: a scan reads the largest first."""
    import pyarrow.parquet as pq
    spark.range(0, 8, 1, 8).selectExpr(
        "explode(transform(sequence(0, 20 * id), x -> 1000 * id + x)) AS doc_id").selectExpr(
        "doc_id", "repeat(concat('text ', sha2(string(doc_id), 256), ' '), 20) AS text").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    dict(corpus_pipeline.STAGES)["sentencepiece"](spark, docs, SF_SMALL).write.parquet(str(tmp_path / "out"))
    written = [i for f in sorted((tmp_path / "out").glob("part-*.parquet"))
               for i in pq.ParquetFile(f).read()["doc_id"].to_pylist()]
    assert len(written) == docs.count() and written == sorted(written)


def test_mixing_stage_writes_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.parquet"))
    import pyarrow.parquet as pq
    written = [i for f in files for i in pq.ParquetFile(f).read()["doc_id"].to_pylist()]
    rows = [r.asDict() for r in docs.collect()]
    counts = {}
    for r in rows:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    units = mixing.unit_weights(mixing.natural_weights(counts), max(mixing.UNITS, 4 * len(counts)))
    place = plain.mix(rows, units, mixing.BLOCK_DOCS)
    assert written == sorted(place, key=place.get)


def test_stages_keep_columns_and_extra_ones(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).selectExpr(
        "*", "1 AS kept", "'a' AS `_row`", "2 AS mix_slot", "'b' AS component_id", "3 AS n_pieces", "4 AS rep")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_SMALL)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {"n_pieces", "ids", "rep", "_row"} <= set(last.columns) and last.count() == docs.count()


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, duck_small, name):
    res = compare(spark, duck_small, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_SMALL)
    assert res["status"] == "ok", res


CONTRACT = {
    "op1_secret_scan": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string",
    "op2_ngram_join": "doc_id bigint n_shingles bigint component_id bigint",
    "op3_language_id": "doc_id bigint held_out boolean lang_pred string score double",
    "op5_quality_rules": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint "
                         "n_repeat_words bigint base_failed boolean kept boolean",
    "op6_substring_dedup": "doc_id bigint n_words bigint n_removed bigint kept_sha256 string",
    "op9_topk": "query_id bigint rank int vec_id bigint score bigint",
    "op10_html_extract": "page_id bigint url string text string n_chars bigint",
    "op11_fill_in_middle": "doc_id bigint n bigint form string prefix_chars bigint middle_chars bigint output_sha256 string "
                           "restored_sha256 string",
    "op12_warc": "page_id bigint payload_bytes bigint payload_digest string record_type string refers_to bigint",
    "op13_whitening": "vec_id bigint component int n bigint deviation bigint whitened double explained double "
                      "identity_error double",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    words = CONTRACT[name].split()
    assert df.dtypes[:len(words) // 2] == list(zip(words[::2], words[1::2]))
    if "documents" in df.inputFiles()[0] if df.inputFiles() else True:
        assert df.count() > 0
