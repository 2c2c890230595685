"""Segmentation against a lattice of its own, many segments at once, edits, and very long texts."""

import itertools
import random
import time

import numpy as np
import pytest

from trendscope.llm import queries
from trendscope.llm import sentencepiece_nbest as S


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary(S.default_model())


def every_path(text, v):
    """All segmentations of a short text by trying all sets of cuts: (score, ids), in the operator's order."""
    text = S.MARK + text.replace(" ", S.MARK)
    found = []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        score, ids = 0, []
        for a, b in zip(at, at[1:]):
            if text[a:b] in v.pieces:
                ids.append(v.pieces[text[a:b]][0])
                score += v.pieces[text[a:b]][1]
            elif b == a + 1:
                ids += [v.bytes[x] for x in text[a].encode()]
                score += v.unknown
            else:
                break
        else:
            found.append((score, ids))
    return sorted(found, key=lambda x: (-x[0], x[1][::-1]))


TEXTS = ["", "a", " ", "\n", "the the", "ab\n\nc d", "é\U0001f600 ö", "aaaa aaa", "t,he in", "\x00", "東京 a", "in in in"]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_paths_against_all_sets_of_cuts(vocabulary, n):
    rng = random.Random(n)
    texts = TEXTS + ["".join(rng.choice("aathein \n,.é") for _ in range(rng.randrange(1, 11))) for _ in range(40)]
    encoder = S.Encoder(vocabulary, n)
    encoder.prepare([encoder.cut(t) for t in texts])
    for text in texts:
        want = every_path(text, vocabulary)[:n]
        ids, scores, found = encoder.encode(text, True)
        assert scores == [s for s, _ in want] and [x.tolist() for x in found] == [x for _, x in want]
        assert ids.tolist() == want[0][1]


def test_many_segments_at_once(vocabulary):
    rng = random.Random(2)
    segments = sorted({"".join(rng.choice(marks) for _ in range(rng.randrange(1, S.LONG + 1)))
                       for marks in ("abe\u2581", "the\u2581in", "東é\U0001f600a", "\n") for _ in range(150)})
    scores, gaps, counts, ids = S.best_of_many(segments, vocabulary)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for k, segment in enumerate(segments):
        two = S.n_best(segment, vocabulary, 2)
        assert (scores[k], tuple(parts[k])) == two[0]
        assert gaps[k] == (two[0][0] - two[1][0] if len(two) > 1 else -1)
        assert S.best_and_gap(segment, vocabulary) == (scores[k], gaps[k], tuple(parts[k]))


def test_linked_paths_order_as_whole_lists_do():
    rng = random.Random(4)
    nodes = [S.Partial(0, 0, 0, (), None)]
    ids = {id(nodes[0]): ()}
    for _ in range(3000):
        parent = rng.choice(nodes[-200:])
        step = tuple(rng.randrange(3) for _ in range(rng.choice([1, 1, 1, 3])))
        if any(n.parent is parent and n.ids[0] == step[0] for n in nodes[-400:]):
            continue  # edges into a place differ in their first id from the end
        nodes.append(S.Partial(0, 0, 0, step, parent))
        ids[id(nodes[-1])] = ids[id(parent)] + step
    for _ in range(4000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        if ids[id(a)] != ids[id(b)]:
            assert (a < b) == (ids[id(a)] < ids[id(b)])


def test_a_text_of_a_million_letters_without_a_space(spark, vocabulary):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_000_000))
    began = time.time()
    row = S.encode(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert time.time() - began < 120
    assert len(row["n_best_ids"]) == S.N_BEST and row["n_best_scores"] == sorted(row["n_best_scores"], reverse=True)
    encoder = S.Encoder(vocabulary, S.N_BEST)
    score = {i: s for i, s in vocabulary.pieces.values()}
    for ids, total in zip(row["n_best_ids"], row["n_best_scores"]):
        assert encoder.decode(np.array(ids)) == text and sum(score[i] for i in ids) == total
    assert len({tuple(x) for x in row["n_best_ids"]}) == S.N_BEST


def test_edits_make_whole_paths(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    edits = S.encode_edits(docs).withColumn("n_best_ids", S.paths())
    encoder = S.Encoder(S.Vocabulary(S.default_model()), S.N_BEST)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = 0
    for r in edits.collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert r["n_best_ids"] is None and r["edits"] is None
            continue
        _, scores, found = encoder.encode(text, True)
        assert list(r["n_best_scores"]) == scores and [list(x) for x in r["n_best_ids"]] == [x.tolist() for x in found]
        changed += sum(len(path) for path in r["edits"])
    assert changed > 0


def test_query_gives_all_paths(spark):
    out = queries.op8_sentencepiece(spark, "/root/testdata/sf0.001").withColumn("n_best_ids", S.paths())
    assert out.filter("size(n_best_ids) <> size(n_best_scores) or n_best_ids[0] <> ids").count() == 0
    assert out.filter("size(n_best_ids) > 1").count() > 100


def test_models_with_fractional_scores_are_refused(monkeypatch):
    import sentencepiece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_score", lambda self, i: -0.5, raising=False)
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "GetScore", lambda self, i: -0.5, raising=False)
    with pytest.raises(ValueError):
        S.Vocabulary(S.default_model())
