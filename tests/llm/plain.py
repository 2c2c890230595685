"""Plain Python versions of the operators, for small inputs. Rows are dicts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    w = words(lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def components(rows, n, percent):
    """{id: smallest reachable id} for rows with distinct ids."""
    sets = {r["doc_id"]: shingles(r["text"], n) for r in rows if r["doc_id"] is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def metrics(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def quality(rows, min_words, max_repeat_percent, max_docs, max_share, min_kept):
    docs_of, line_docs = defaultdict(set), defaultdict(set)
    key = lambda line: lower(" ".join(words(line)))
    for r in rows:
        text = r["text"] or ""
        docs_of[r["source"]].add(text)
        for line in text.split("\n"):
            if words(line):
                line_docs[r["source"], key(line)].add(text)
    out = []
    for r in rows:
        m = metrics(r["text"])
        removed = sum(len(words(x)) for x in (r["text"] or "").split("\n") if words(x)
                      and len(line_docs[r["source"], key(x)]) > max_docs
                      and len(line_docs[r["source"], key(x)]) > max_share * len(docs_of[r["source"]]))
        m["n_kept_words"] = m["n_words"] - removed
        m["base_failed"] = m["n_words"] < min_words or 100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"]
        m["kept"] = not m["base_failed"] and m["n_kept_words"] >= min_kept * m["n_words"]
        out.append({"doc_id": r["doc_id"], **m})
    return out


def clean_lines(rows, max_ratio, min_pages):
    pages, seen = defaultdict(set), defaultdict(set)
    for r in rows:
        if r["text"] is not None:
            pages[r["source"]].add(r["text"])
            for line in r["text"].split("\n"):
                seen[r["source"], line.strip(" \t\r")].add(r["text"])

    def gone(source, line):
        line = line.strip(" \t\r")
        n = len(seen[source, line])
        return line != "" and n >= min_pages and n > max_ratio * len(pages[source])

    out = []
    for r in rows:
        lines = [] if r["text"] is None else r["text"].split("\n")
        left = [x for x in lines if not gone(r["source"], x)]
        out.append({**r, "text": None if r["text"] is None else "\n".join(left),
                    "n_lines_in": len(lines), "n_lines_dropped": len(lines) - len(left)})
    return out


def cut_windows(rows, length):
    least, out = {}, []
    for r in rows:
        w = words(r["text"])
        if r["doc_id"] is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i:i + length])
                least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    for r in rows:
        w, gone = words(r["text"]), set()
        if r["doc_id"] is not None:
            for i in range(len(w) - length + 1):
                if least[tuple(w[i:i + length])] < r["doc_id"]:
                    gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append({"doc_id": r["doc_id"], "n_words": len(w), "n_removed": len(gone), "kept_text": kept,
                    "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()})
    return out


def schedule(units):
    """Slots of one period, one by one: the released block with the earliest deadline."""
    total, names, done, out = sum(units.values()), list(units), Counter(), []
    for slot in range(total):
        ready = [(-(-(done[s] + 1) * total // units[s]), k, s) for k, s in enumerate(names)
                 if done[s] < units[s] and done[s] * total // units[s] <= slot]
        s = min(ready)[2]
        out.append((s, done[s], slot))
        done[s] += 1
    return out


def mix(rows, units, block_docs):
    """{doc_id: (slot, place in the source)}"""
    total, by = sum(units.values()), defaultdict(list)
    for r in rows:
        by[r["source"]].append(r["doc_id"])
    slot = {(s, j): t for s, j, t in schedule(units)}
    out = {}
    for s, ids in by.items():
        for seq, i in enumerate(sorted(ids)):
            block = seq // block_docs
            out[i] = (block // units[s] * total + slot[s, block % units[s]], seq)
    return out


def lag_bound(units):
    """The largest distance of any source from its share after any slot of a period."""
    total, done, worst = sum(units.values()), Counter(), Fraction(0)
    for s, _, slot in schedule(units):
        done[s] += 1
        worst = max([worst, *(abs(done[x] - Fraction((slot + 1) * units[x], total)) for x in units)])
    return worst


def best_path(text, vocabulary):
    """Viterbi over a whole text, without cuts: (score, ids); ties by the ids from the end."""
    text = "▁" + text.replace(" ", "▁")
    best = [(0, ())]
    for j in range(1, len(text) + 1):
        options = []
        for i in range(max(0, j - vocabulary.longest), j):
            found = vocabulary.pieces.get(text[i:j])
            if found:
                options.append((best[i][0] - found[1], (found[0], best[i][1])))
        if text[j - 1] not in vocabulary.pieces:
            ids = best[j - 1][1]
            for b in text[j - 1].encode():
                ids = (vocabulary.bytes[b], ids)
            options.append((best[j - 1][0] - vocabulary.unknown, ids))
        least = min(o[0] for o in options)
        best.append(min((o for o in options if o[0] == least), key=lambda o: _chain(o[1])))
    return -best[-1][0], _chain(best[-1][1])[::-1]


def _chain(ids):
    out = []
    while ids:
        out.append(ids[0])
        ids = ids[1]
    return out


def all_paths(text, vocabulary, lattice, n):
    """The n best of all paths: scores and ids."""
    text = "▁" + text.replace(" ", "▁")
    edges, found = lattice(text, vocabulary), []

    def back(j, ids, score):
        if j == 0:
            found.append((-score, ids))
        for i, s, piece in edges[j] if j else ():
            back(i, ids + piece[::-1], score + s)

    back(len(text), (), 0)
    found.sort()
    return [(-a, list(ids[::-1])) for a, ids in found[:n]]
