"""Quality rules, line dedup and HTML extraction with production values and extreme inputs."""

import random
import time

import duckdb
import numpy as np
import pytest

from tests.llm import plain
from trendscope.llm import html_extract, line_dedup, ngram_join, quality, queries, topk

DOCS = "doc_id long, text string, source string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def depleted():
    """A host of 200 pages: 20 of them are mostly the site's lines, the others carry one of these."""
    rng = random.Random(1)
    site = [words(rng, 20) for _ in range(6)]
    rows = [(i, "\n".join([words(rng, 60), site[i % 6], words(rng, 30)]), "host") for i in range(180)]
    rows += [(1000 + i, "\n".join([words(rng, 20), *site]), "host") for i in range(20)]
    rows += [(2000 + i, "\n".join([words(rng, 60), site[i % 6].upper()]), "other") for i in range(30)]
    return rows + [(3000, None, "host"), (3001, "", None), (3002, "\n".join(site), "host"), (3003, "\n".join(site), "host")]


def test_depleted_documents_are_rejected(spark, depleted):
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(depleted, DOCS)).collect()}
    for doc_id, text, _ in depleted:
        r = out[doc_id]
        if 1000 <= doc_id < 2000:  # 120 of 140 words are the site's
            assert not r["base_failed"] and not r["kept"] and (r["n_words"], r["n_kept_words"]) == (140, 20)
        elif doc_id < 1000:
            assert r["kept"] and (r["n_words"], r["n_kept_words"]) == (110, 90)
        elif doc_id < 3000:  # on this host every line is on five pages only
            assert r["kept"] and r["n_words"] == r["n_kept_words"]
    rows = [{"doc_id": i, "text": t, "source": s} for i, t, s in depleted]
    want = plain.quality(rows, quality.MIN_WORDS, quality.MAX_REPEAT_PERCENT, quality.MAX_DOCS, quality.MAX_SHARE, quality.MIN_KEPT)
    assert {r["doc_id"]: w["kept"] for r, w in zip(rows, want)} == {i: r["kept"] for i, r in out.items()}


def test_texts_without_the_removed_lines(spark, depleted):
    out = {r["doc_id"]: r for r in quality.quality_texts(spark.createDataFrame(depleted, DOCS)).collect()}
    assert len(out) == len(depleted)
    for doc_id, text, _ in depleted:
        lines = (text or "").split("\n")
        want = {0: "\n".join([lines[0], *lines[2:]]), 1: lines[0], 2: text, 3: ""}[doc_id // 1000]
        assert out[doc_id]["text"] == (None if text is None else want)
        if text is not None:
            assert len(out[doc_id]["text"].split()) == out[doc_id]["n_kept_words"]


def test_site_lines_go_from_every_host(spark):
    """A line on 8 to 9 % of the pages of each host goes from all, one on 4.5 % from none."""
    rng = random.Random(2)
    rows = []
    for host, pages in (("a", 200), ("b", 400), ("c", 800), ("hot", 3000)):
        for i in range(pages):
            lines = [words(rng, 8), *(["Share this page"] if i % 12 == 0 else []), *(["Read more"] if i % 23 == 0 else []), words(rng, 4)]
            rows.append((len(rows), "\n".join(lines), host))
    out = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert not any("Share this page" in r["text"] for r in out)
    assert sum("Read more" in r["text"] for r in out) == sum("Read more" in t for _, t, _ in rows)


def test_site_line_of_the_table_goes_from_all_hosts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    dropped = line_dedup.line_dedup(docs.select("doc_id", "source", "text")).filter("n_lines_dropped > 0")
    assert dropped.select("source").distinct().count() == docs.select("source").distinct().count()


# HTML --------------------------------------------------------------------------------------------

def extract(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    return {r["page_id"]: r["text"] for r in html_extract.extract_pages(rows).collect()}


def test_line_breaks_are_white_space(spark):
    out = extract(spark, ["<article><p>one<br>two</p><p>a<br/><BR />b <br>c</p></article>"])
    assert out[0] == "one two\na b c"


def test_pages_without_labels(spark):
    body = "".join(f"<p>{'This is a sentence of the article, number %d. ' % i * 4}</p>" for i in range(6))
    menu = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(20))
    labelled = f"<html><body><nav><ul>{menu}</ul></nav><article>{body}</article><footer><a href='/'>Home</a></footer></body></html>"
    bare = f"<html><body><div><ul>{menu}</ul></div><div>{body}</div></body></html>"
    out = extract(spark, [labelled] * 30 + [bare])
    assert "number 5" in out[30] and out[30].count("This is a sentence") == 24 and "Link 3" not in out[30]
    alone = extract(spark, [bare])
    assert alone[0].count("This is a sentence") in (0, 24)


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "text", "<p><table>" + "<div>" * 100_000 + "text", "<b>" * 100_000 + "</i>" * 100_000,
    "<ul><li>" * 50_000 + "x", "<article>" + "<span><p>a" * 60_000, "</div>" * 100_000], ids=range(6))
def test_deep_pages_take_seconds(page):
    began = time.time()
    model = html_extract.Model({})
    html_extract.main_text(page, model)
    assert time.time() - began < 20


def test_sampling_is_exact_at_any_size():
    for rows in (1, 5000, 5001, 10**6, 10**10, 10**13):
        bound = html_extract.hash_bound(rows, 5000)
        share = (bound + (1 << 63) + 1) / 2**64
        assert share * rows == pytest.approx(min(rows, 5000), rel=1e-6) and -(1 << 63) <= bound < 1 << 63


# n-gram join with ids that stand for several texts ------------------------------------------------

def brute_force(rows, n, percent):
    """{id: smallest reachable id}, an id being linked by any of its sets."""
    sets = [(i, plain.shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("seed", [0])
def test_ids_with_several_texts_link_by_each(spark, seed):
    rng = random.Random(seed)
    base = [words(rng, 40) for _ in range(14)]

    def near(text):
        w = text.split()
        w[rng.randrange(len(w))] = "zz"
        return " ".join(w)

    rows = [(1, base[0]), (1, base[1]), (2, base[1])]
    rows += [(rng.randrange(3, 40), rng.choice([t, near(t)])) for t in rng.choices(base, k=60)]
    rows += [(50, words(rng, 3)), (50, ""), (51, None), (None, base[0]), rows[0], (52, " ".join(base[2].split()[:20])),
             (53, base[2]), (53, " ".join(base[2].split()[:20]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    label = brute_force(rows, 4, 85)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((i, len(plain.shingles(t, 4)), label.get(i)) for i, t in rows), key=str)

    stage = ngram_join.near_duplicate_stage(spark, docs, "").collect()
    kept = brute_force(rows, 5, 80)
    want = {(i, frozenset(plain.shingles(t, 5))) for i, t in rows if i is not None and kept[i] == i}
    assert sorted(((r["doc_id"], sorted(plain.shingles(r["text"], 5))) for r in stage if r["doc_id"] is not None), key=str) == sorted(
        ((i, sorted(x)) for i, x in want), key=str)
    assert sum(r["doc_id"] is None for r in stage) == 1


# top-k -------------------------------------------------------------------------------------------

def test_reading_stops_by_its_bounds():
    rng = np.random.default_rng(3)
    x = rng.integers(-2000, 2000, (2000, 4)).astype(float)
    order = np.argsort(x, axis=0, kind="stable")
    ranks = np.empty(x.shape, dtype=np.int32)
    np.put_along_axis(ranks, order, np.arange(2000, dtype=np.int32)[:, None], axis=0)
    for flat in (False, True):
        y = np.ones_like(x) if flat else x  # equal vectors can't be told apart: the lists are read to their end
        lists, reached = np.sort(y, axis=0), []
        best = topk.nra(y, ranks, np.arange(2000), lists, y[7], 7, 10, reached)
        assert reached == [(1.0, 1999)] if flat else reached[0][0] < 1 and reached[0][1] <= 2 * topk.FEW
        want = sorted((-(y[i] @ y[7]), i) for i in range(2000) if i != 7)[:10]
        assert [(-(y[i] @ y[7]), i) for i in best] == want


def test_a_query_row_that_stands_twice_counts_once(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(250)]
    rows += [rows[100], rows[200], (200, [rng.gauss(0, 1) for _ in range(5)]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLE_SQL['op9_topk']})").fetchall()
    assert sorted(map(tuple, topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert len(want) == 30


# language identification -------------------------------------------------------------------------

def test_held_out_rows_follow_the_checksum(spark):
    import zlib
    from trendscope.llm import language_id
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["held_out"] for r in language_id.identify_languages(docs).collect()}
    assert got == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs.select("doc_id").collect()}
