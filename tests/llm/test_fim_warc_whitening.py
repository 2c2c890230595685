"""Fill-in-the-middle, WARC archives and whitening against plain Python versions."""

import gzip
import hashlib
import io
import math
import random
import re
from base64 import b32encode
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.test_operators import ROWS, frame, key, same
from trendscope.llm import fill_in_middle as fim
from trendscope.llm import warc, whitening
from trendscope.llm.scratch import Scratch

# 11 ----------------------------------------------------------------------------------------------


def plain_fim(doc_id, text, fim_percent=90, spm_percent=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    row = {"doc_id": doc_id, "n": len(units)}
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return row | {"form": "plain", "output": text, "prefix_chars": None, "middle_chars": None, "restored": text}
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    return row | {"form": form, "prefix_chars": len(p), "middle_chars": len(m), "restored": text,
                  "output": f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"}


FIM_ROWS = ROWS + [(200 + i, t, None, None) for i, t in enumerate(
    ["<P>", "a <S> b", "<M", "<", "x<P", "<P<S<M", "P>S>M>", "é", "日本語 text x", "\U0001f600\U0001f600a", "\x00a\x00", "aB1cD",
     "\r\n\r\n", "S><P <S <M"] + ["<" * k + "P" * k + "S><" for k in range(1, 30)])] + [
    (500, "long text, é! " * 60_000, None, None), (501, "x" * 500_000, None, None)]


@pytest.mark.parametrize("fim_percent, spm_percent", [(90, 20), (100, 50), (0, 0)])
def test_fim_against_plain(spark, fim_percent, spm_percent):
    out = fim.fill_in_middle(frame(spark, FIM_ROWS), fim_percent=fim_percent, spm_percent=spm_percent)
    back = fim.restore(out.withColumnRenamed("output", "made"), output_col="made")
    expected = [plain_fim(r[0], r[1], fim_percent, spm_percent) for r in FIM_ROWS]
    same(out, expected, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    same(back, expected, ["doc_id", "n", "form", "restored"])


def test_fim_digests_stream_the_descriptors(spark):
    expected = [plain_fim(r[0], r[1]) for r in FIM_ROWS]
    for e in expected:
        e["output_sha256"] = hashlib.sha256(e["output"].encode()).hexdigest()
        e["restored_sha256"] = hashlib.sha256(e["restored"].encode()).hexdigest()
    same(fim.transform_and_restore(frame(spark, FIM_ROWS)), expected,
         ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])


def test_fim_pieces_are_over_unchanged_buffers(spark):
    marks = b"".join(fim.SENTINELS.values())
    out = fim.fill_in_middle(frame(spark, FIM_ROWS), wanted=("pieces", "output")).collect()
    texts = {r[0]: (r[1] or "").encode() for r in FIM_ROWS}
    for r in out:
        if r["doc_id"] is not None:
            buffers = (texts[r["doc_id"]], marks)
            made = b"".join(buffers[p["buffer"]][p["start"]:p["start"] + p["length"]] for p in r["pieces"])
            assert made == r["output"].encode()
            assert len(r["pieces"]) == (1 if r["form"] == "plain" else 6)


def test_piece_table_cuts_and_permutes_back():
    rng = random.Random(5)
    for _ in range(200):
        text = bytes(rng.randrange(97, 100) for _ in range(rng.randrange(0, 9)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        table = fim.PieceTable((text, fim._MARKS), [(fim.TEXT, 0, len(text))])
        for cut in cuts:
            table = table.cut(cut)
        assert [bytes(v) for v in table.views()] == [text[:cuts[0]], text[cuts[0]:cuts[1]], text[cuts[1]:]]
        for form in fim.FORMS:
            moved = table.arrange(form)
            assert moved.restore(form).data() == text == fim.parse(moved.data(), form).restore(form).data()
            assert moved.sha256() == hashlib.sha256(moved.data()).hexdigest()


# 12 ----------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, type string, gap string, _key string, headers string"
HTML = ["<p>a</p>", "", None, "é" * 40, "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\x1f\u008b\x08 not a member", "x" * 70_000,
        "\r\n\r\n", "\n", "<html>" + "".join(f"<p>{i}</p>" for i in range(9000))]


def page_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, f"http://x/{i}?q=é\r\nX-Evil: 1" if i % 7 == 0 else f"http://x/{i}", rng.choice(HTML), *"abcd") for i in range(n)]
    rows += [(None, None, "<p>a</p>", *"abcd"), (None, "u", "alone", *"abcd"), (None, "u", "alone", *"abcd"), rows[3], rows[3],
             (900, None, "twice", *"abcd"), (900, None, "twice", *"abcd"), (901, None, "twice", *"abcd")]
    return rows


def plain_archive(rows):
    least = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    out = []
    for page_id, _, html, *_ in rows:
        data, first = (html or "").encode(), least.get(html or "")
        revisit = first is not None and page_id != first
        out.append({"page_id": page_id, "payload_bytes": len(data), "payload_digest": b32encode(hashlib.sha1(data).digest()).decode(),
                    "record_type": "revisit" if revisit else "response", "refers_to": first if revisit else None})
    return out


def test_warc_round_trip(spark):
    rows = page_rows()
    same(warc.archive_and_read(spark.createDataFrame(rows, PAGES).repartition(3)), plain_archive(rows),
         ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc_archives_are_whole_and_bounded(spark, tmp_path, compress):
    rows = page_rows()
    scratch = Scratch(spark)
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, scratch=scratch, compress=compress,
                        archive_bytes=20_000)
    read = warc.read_archives(spark, path)
    got = read.filter("type in ('response', 'revisit')").collect()
    assert warc.gaps(read).count() == 0 and read.filter("type = 'warcinfo'").count() == read.select("path").distinct().count() > 1
    bodies = {(r["headers"].get("page-id"), r["type"]): bytes(r["payload"]) for r in got}
    for row, e in zip(rows, plain_archive(rows)):
        name = None if row[0] is None else str(row[0])
        body = bodies[name, e["record_type"]]
        assert body == (b"" if e["record_type"] == "revisit" else (row[2] or "").encode()) or name is None
    ids = {r["record_id"] for r in got}
    assert all(r["headers"]["warc-refers-to"] in ids for r in got if r["type"] == "revisit")
    assert not any("x-evil" in r["headers"] for r in got)
    for file in (tmp_path / "a").glob("part-*"):
        data = file.read_bytes()
        text = gzip.GzipFile(fileobj=io.BytesIO(data)).read() if compress else data[:-1]  # the sink's line end
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def archive(compress, n=12, seed=0):
    rng = random.Random(seed)
    records = [warc.page_record(i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(400))), None, False)
               for i in range(n)]
    return [warc.packed(r, compress) for r in records]


def salvaged(data):
    found = list(warc.salvage(data))
    at = 0
    for start, end, _, _ in [*found, (len(data), len(data) + 1, None, None)]:  # nothing but padding outside
        assert start >= at and end > start and not data[at:start].replace(warc.EMPTY_MEMBER, b"").strip(b"\0\r\n")
        at = end
    return ([int(r["headers"]["page-id"]) for _, _, r, _ in found if r],
            [(start, end, why) for start, end, r, why in found if r is None])


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_all_but_the_damaged(compress):
    parts = archive(compress)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    whole = b"".join(parts)
    assert salvaged(whole) == (list(range(12)), [])
    rng = random.Random(9)
    for _ in range(60):  # one byte of some records changed
        hit = sorted(rng.sample(range(12), rng.choice([1, 2, 3])))
        data = bytearray(whole)
        for k in hit:
            # headers of plain records have no checksum, so their blocks are hit
            first = 0 if compress else parts[k].index(b"\r\n\r\n") + 4
            at = starts[k] + rng.randrange(first, len(parts[k]) - 4)
            data[at] ^= 1 << rng.randrange(8)
        got, gaps = salvaged(bytes(data))
        assert set(range(12)) - set(got) <= set(hit) and got == sorted(got)
        for start, end, why in gaps:
            assert why and start in starts and (end in starts or end == len(data))
    cut = whole[:starts[5] + 20] + whole[starts[6]:]  # the rest of record 5 is lost
    got, gaps = salvaged(cut)
    assert got == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11] and [(s, e) for s, e, _ in gaps] == [(starts[5], starts[5] + 20)]
    noise = bytes(rng.randrange(1, 256) for _ in range(500)) + warc.MEMBER + b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"
    got, gaps = salvaged(noise + whole[:starts[3]] + noise + whole[starts[3]:] + noise)
    assert got == list(range(12)) and [e - s for s, e, _ in gaps] == [len(noise), len(noise), len(noise.rstrip(b"\r\n")) + 4]
    got, gaps = salvaged(whole[:-30])
    assert got == list(range(11)) and gaps[0][:2] == (starts[11], len(whole) - 30)
    assert salvaged(b"") == ([], []) and salvaged(b"\0\0") == ([], []) and salvaged(b"junk")[1] == [(0, 4, "no version line")]


def test_salvage_reasons():
    good = warc.page_record(1, "u", b"payload", None, False)
    for change, why in (
            (lambda d: d.replace(b"payload\r", b"pay1oad\r"), "block digest differs"),
            (lambda d: re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", d).replace(b"payload\r", b"pay1oad\r"), "payload digest differs"),
            (lambda d: re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 9\r\n\r\nHTTP", d), "block length or ending is wrong"),
            (lambda d: re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: x\r\n\r\nHTTP", d), "no content length"),
            (lambda d: d.replace(b"WARC-Type", b"WARC_Kind"), "no record type or id"),
            (lambda d: d.replace(b"WARC-Type:", b"WARC Type "), "bad header line"),
            (lambda d: d.replace(b"WARC-Date: ", b"WARC-Date: \xff"), "bad header line"),
            (lambda d: d[:60], "headers without an end")):
        assert salvaged(change(good))[1][0][2] == why
        assert salvaged(change(good) + good)[0] == [1]
        member = warc.packed(change(good), True)
        assert salvaged(member + warc.packed(good, True)) == ([1], [(0, len(member), why)])
    two = warc.packed(good + good, True)
    assert salvaged(two) == ([], [(0, len(two), "more than one record in a member")])
    assert salvaged(warc.packed(good, True)[:-8])[1][0][2] in ("member without an end", "bad member")
    assert salvaged(warc.packed(good, True) + warc.EMPTY_MEMBER + good) == ([1, 1], [])


def test_large_members_end_in_a_zero_byte():
    data = warc.page_record(1, "u", b"a" * (17 << 20), None, False)
    member = warc.packed(data, True)
    assert member[-1] == 0 and gzip.decompress(member) == data and salvaged(member) == ([1], [])


def test_warc_reads_damaged_archives(spark, tmp_path):
    parts = archive(True)
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + 30] ^= 255
    (tmp_path / "one.warc.gz").write_bytes(bytes(data))
    (tmp_path / "two.warc").write_bytes(b"broken" + b"".join(archive(False, 3)) + b"tail")
    read = warc.read_archives(spark, str(tmp_path), payloads=False)
    log = {(r["path"].rsplit("/", 1)[1], r["start"], r["n_bytes"]) for r in warc.gaps(read).collect()}
    assert read.filter("gap is null").count() == 14 and read.filter("payload is not null").count() == 0
    assert log == {("one.warc.gz", len(parts[0]), len(parts[1])), ("two.warc", 0, 6),
                   ("two.warc", 6 + sum(map(len, archive(False, 3))), 4)}


# 13 ----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, n string, deviation string"


def plain_moments(xs):
    """Exact count, sums and covariance of the distinct vectors."""
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    centred = [[Fraction(v[i]) - Fraction(sums[i], n) for i in range(d)] for v in fit]
    return n, sums, [[sum(c[i] * c[j] for c in centred) / n for j in range(d)] for i in range(d)]


def check_whitening(out, rows, components):
    xs = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]) for r in rows]
    n, sums, cov = plain_moments(xs)
    d = len(sums)
    values, axes = np.linalg.eigh(np.array([[float(v) for v in r] for r in cov]))
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, d)
    assert len(out) == k * len(rows)
    by = {}
    for r in out:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    signs = {}
    for row, x in zip(rows, xs):
        for c in range(1, k + 1):
            r = by[row[0]][c][0]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            if values[c - 1] < 1e-9:
                assert r["whitened"] is None
                continue
            assert r["explained"] == pytest.approx(values[c - 1] / np.trace(np.array([[float(v) for v in q] for q in cov])), rel=1e-9)
            exact = sum(float(Fraction(a) - Fraction(s, n)) * axes[i, c - 1] for i, (a, s) in enumerate(zip(x, sums)))
            exact /= math.sqrt(values[c - 1])
            if abs(exact) > 1e-6:
                assert signs.setdefault(c, np.sign(exact * r["whitened"])) == np.sign(exact * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(exact), abs=1e-7)
            assert r["identity_error"] < 1e-6
    assert len({r["identity_error"] for r in out}) <= 1


def vector_rows(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (n, d)) @ np.diag(np.linspace(3, 0.5, d)) * spread
    rows = [(i, [float(v) for v in row], *"xyz") for i, row in enumerate(base)]
    return rows + [(n + 1, rows[0][1], *"xyz"), (n + 2, rows[0][1], *"xyz"), rows[5]]


@pytest.mark.parametrize("n, d, spread", [(80, 6, 1.0), (60, 20, 0.1), (40, 3, 1e6), (30, 1, 1.0)])
def test_whitening_against_exact_fractions(spark, n, d, spread):
    rows = vector_rows(n, n, d, spread)
    bad = [(1000, None, *"xyz"), (1001, [float("nan")] * d, *"xyz"), (1002, [float("inf")] * d, *"xyz"),
           (1003, [None] * d, *"xyz"), (1004, [], *"xyz"), (1005, [3e38] * d, *"xyz")]
    out = whitening.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(5)).collect()
    check_whitening(out, rows, 16)


def test_whitening_of_constant_and_dependent_vectors(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0], *"xyz") for i in range(20)]
    check_whitening(whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect(), rows, 16)
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], *"xyz"), (None, [1.0, 2.0], *"xyz")], VECTORS)).collect()
    assert sorted(out, key=key) == sorted(
        [(i, c, 1, 0, None, None, 0.0) for i in (1, None) for c in (1, 2)], key=key)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_whitening_fits_each_length(spark):
    short, long_ = vector_rows(1, 30, 2), vector_rows(2, 30, 4)
    out = whitening.whiten(spark.createDataFrame(
        short + [(r[0] + 500, *r[1:]) for r in long_], VECTORS).repartition(3)).collect()
    check_whitening([r for r in out if r["vec_id"] < 500], short, 16)
    check_whitening([r for r in out if r["vec_id"] >= 500], [(r[0] + 500, *r[1:]) for r in long_], 16)


@pytest.mark.parametrize("bound", [1, 1 << 20, 1 << 30, (1 << 47) - 1, 1 << 48, 1 << 55, 1 << 61, 1 << 70])
def test_square_sums_are_exact(bound):
    rng = random.Random(bound)
    values = [[rng.randint(-bound, bound) for _ in range(3)] for _ in range(500)] + [[bound, -bound, 0]]
    t = np.array(values, dtype=np.int64 if bound < 1 << 62 else object)
    assert whitening.square_sums(t, bound) == [sum(v[k] ** 2 for v in values) for k in range(3)]


def test_covariance_is_exact_beyond_64_bits():
    rng = random.Random(3)
    x = np.array([[rng.randint(-(1 << 45), 1 << 45) + 1_000_000 for _ in range(4)] for _ in range(300)], np.int64)
    n, sums, cov = plain_moments([tuple(r) for r in x.tolist()])
    fit = whitening.Fit(n, sums, x.min(0).tolist(), x.max(0).tolist())
    for kind in (fit.kind, object):
        fit.kind = kind
        y = fit.centred(x)
        assert y.tolist() == [[n * a - s for a, s in zip(r, sums)] for r in x.tolist()]
        squares = {(i, j): whitening.square_sums(y[:, i:i + 1] + (y[:, j:j + 1] if i != j else 0), 2 * fit.bound)[0]
                   for i in range(4) for j in range(i, 4)}
        got = whitening.Whitener(fit, squares, 4).covariance
        assert got.tolist() == [[float(v) for v in r] for r in cov]
