"""Language identification against a plain version, secrets planted in a whole table, very long texts."""

import random
import string
import time
import zlib
from collections import Counter
from math import exp, log, log1p

import pytest
from pyspark.sql import functions as F

from trendscope.llm import language_id, secret_scan
from trendscope.llm.scratch import Scratch, clear

DOCS = "/root/testdata/sf0.001/documents.parquet"


# language identification, one n-gram and one bit at a time -----------------------------------------

def _features(text):
    data = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    out = Counter()
    for i in range(len(data) - 1):
        if data[i] == data[i + 1] == 32:
            continue
        pair = data[i] * 256 + data[i + 1]
        out[(pair * 2654435761) % 2**32 >> 18] += 1
        if i + 2 < len(data):
            out[2**14 + ((pair * 256 + data[i + 2]) * 2246822519 % 2**32 >> 18)] += 1
    return out


def _plain(rows):
    """{id: (language, score)} of (id, text, lang) rows, each with a letter."""
    size = 2**15
    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(_features(text))
    names = sorted(counts)
    # all ways to split the languages in two
    splits = [[1] + [1 - 2 * (mask >> k & 1) for k in range(len(names) - 1)] for mask in range(1, 2 ** (len(names) - 1))]
    share = []
    for name in names:
        total = sum(counts[name].values()) + 0.5 * size
        share.append([(counts[name][f] + 0.5) / total for f in range(size)])
    mean = lambda xs: sum(xs) / len(xs)
    weights, own = [], []
    for split in splits:
        sides = [[k for k, bit in enumerate(split) if bit == side] for side in (1, -1)]
        weights.append([round(65536 * (log(mean([share[k][f] for k in sides[0]])) - log(mean([share[k][f] for k in sides[1]]))))
                        for f in range(size)])
        own.append([bit * sum(p * w for p, w in zip(share[k], weights[-1])) / 65536 for k, bit in enumerate(split)])
    out = {}
    for i, text, _ in rows:
        found = _features(text)
        n = sum(found.values())
        margins = [sum(w[f] * c for f, c in found.items()) / 65536 / n for w in weights]
        losses = []
        for k in range(len(names)):
            total = sum(o[k] for o in own)
            losses.append(sum(o[k] / total * log1p(exp(-4.0 * split[k] * m)) for o, split, m in zip(own, splits, margins)))
        best = min(range(len(names)), key=lambda k: losses[k])
        out[i] = names[best], 1 / sum(exp(losses[best] - x) for x in losses)
    return out


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))]
    want = _plain(rows)
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs).collect()}
    assert len({x[0] for x in want.values()}) > 2 and len(want) > 150
    for i, (name, score) in want.items():
        assert got[i]["lang_pred"] == name, i
        assert got[i]["score"] == pytest.approx(score, abs=1e-9), i


# secrets planted in every document -----------------------------------------------------------------

def test_planted_secrets_and_no_others(spark):
    """A random key beside a sensitive word in each text of a table is found, at its place, and the planted sentence
    adds nothing else. Names beside one are reported too where they are rarer than the dictionary and the text: here in
    about an eighth of the texts."""
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]
    plain_names = ["getAuthenticationToken2", "application-settings-v2", "2001-10-01T00:00:00", "XXXXXXXXXXXXXXXXXXXX0",
                   "changeme_undefined_1", "username_password_01"]
    rows, where = [], {}
    for i, text in docs:
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice((24, 32, 40, 64))))
        cut = rng.randrange(len(text) + 1)
        before = f"{text[:cut]}\nthe {rng.choice(('credential', 'bearer', 'client id', 'passphrase'))} is "
        rows.append((i, f"{before}{key}\n{text[cut:]}"))
        where[i] = f"novelty:{len(before)}:{len(before) + len(key)}"
    harmless = [(i, f"{text}\nthe credential is {rng.choice(plain_names)} today") for i, text in docs]
    scan = lambda rows: {r["doc_id"]: r for r in secret_scan.scan_secrets(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted, clean, untouched = scan(rows), scan(harmless), scan(docs)
    found = [i for i, span in where.items() if span in planted[i]["spans"].split(",")]
    assert len(found) >= 0.99 * len(docs)
    assert sum(r["n_novelty"] for r in planted.values()) - len(found) <= 0.02 * len(docs)
    assert sum(r["n_novelty"] for r in clean.values()) - sum(r["n_novelty"] for r in untouched.values()) <= 0.2 * len(docs)
    assert all(clean[i]["spans"] == untouched[i]["spans"] for i, _ in docs if not clean[i]["n_novelty"])


# very long texts -----------------------------------------------------------------------------------

def test_long_texts_take_seconds(spark):
    rng = random.Random(5)
    names = [f"the token {''.join(rng.choice(string.ascii_letters) for _ in range(20))} was read\n" for _ in range(2000)]
    texts = ["z" * 2_000_000, "credential " * 200_000, "0123456789abcdef" * 100_000, " " * 2_000_000, "".join(names),
             "key " + "Ab1+/_" * 300_000]
    rows = spark.createDataFrame([(i, t, "en" if i else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    began = time.time()
    spans = {r["doc_id"]: r for r in secret_scan.scan_secrets(rows).collect()}
    assert spans[2]["spans"] == "hex:0:1600000" and spans[4]["n_novelty"] > 1900
    assert spans[0]["spans"] == spans[1]["spans"] == spans[3]["spans"] == spans[5]["spans"] == ""
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(rows).collect()}
    assert got[3] == "und" and set(got) == set(range(6))
    assert time.time() - began < 120


# scratch tables ------------------------------------------------------------------------------------

def test_scratch_folders_of_finished_calls_go(spark, tmp_path):
    import os
    kept, gone = Scratch(spark), Scratch(spark)
    table = kept.table(spark.range(5))
    other = gone.table(spark.range(7))
    assert other.count() == 7 and os.path.isdir(gone.root.removeprefix("file:"))
    gone.close()
    assert not os.path.exists(gone.root.removeprefix("file:")) and table.count() == 5
    gone.close()                                             # a second time is no fault
    newer = Scratch(spark)
    rows = newer.table(spark.range(3))
    clear(spark, keep=(newer,))
    assert not os.path.exists(kept.root.removeprefix("file:")) and rows.agg(F.sum("id")).first()[0] == 3
