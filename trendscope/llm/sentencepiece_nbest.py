"""SentencePiece encoding and decoding with exact n-best segmentation.

The text gets one leading space, spaces become the piece marker, and all segmentations into
vocabulary pieces form a lattice; a character without a piece is one edge of its UTF-8 bytes'
pieces, scored below every piece. A path's score is the sum of its pieces' scores (whole
numbers in a merge-ranked model, where larger is better).

Forward Viterbi gives the best score from the start to every place. These scores are the
exact heuristic of an A-star search backward from the end, which pops whole paths in order
of score. Equal scores are ordered by the ids from the end, smaller first.

No piece has the marker behind another character, so the lattice is cut before every run of
markers, around line feeds, and between a Latin letter and a mark that no piece has behind
one (as found in the vocabulary). The segments' n-best lists are
merged exactly into the text's. Segments repeat, so their best paths are kept between the texts of a task;
new ones are segmented many at a time by numpy, place by place. A long segment goes through the plain
functions, in time and memory that follow its length.

The other n - 1 paths are mostly the best one, so they travel as ``edits`` of its ids (place, how many
ids go, the ids that come), from which ``paths`` makes whole lists again.

A null text gives null results; the empty text is the lone marker of the leading space.
Literal markers in a text decode to spaces, as in SentencePiece, so that its round trip fails. Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.llm.mixing import in_file_order
from trendscope.llm.text import trimmed

N_BEST = 4
KEPT_SEGMENTS = 400_000  # a task keeps so many segments; then those met in one text only go
LONG = 48                # characters; longer segments go through the plain functions
UNKNOWN_PENALTY = 10
MARK = "▁"
LETTER = "[A-Za-z\u00c0-\u024f]"


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, whole-number scores and byte pieces, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes = [m.unk_id()] * 256
        self.text: list[bytes] = []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.text.append(b"")
            else:
                if m.get_score(i) != round(m.get_score(i)):
                    raise ValueError("the model's scores are not whole numbers")
                self.pieces[piece] = (i, round(m.get_score(i)))
                self.text.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece has the marker behind another character")
        if any("\n" in p for p in self.pieces):
            raise ValueError("a piece has a line feed")
        # every prefix of a piece -> (id, score) of the piece, or None
        self.prefixes: dict[str, tuple[int, int] | None] = {}
        for piece in self.pieces:
            for k in range(1, len(piece) + 1):
                self.prefixes[piece[:k]] = self.pieces.get(piece[:k])
        self._table()
        # ASCII marks that no piece has behind a Latin letter: the lattice is cut there, too
        pairs = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()} - {p[1] for p in pairs if re.match(LETTER, p[0])}
        cut = f"{MARK}*+{LETTER}++(?=[{re.escape(''.join(sorted(marks)))}])|" if marks else ""
        self.segment = re.compile(f"{cut}{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")


    def _table(self) -> None:
        """The prefixes as numbered nodes, and steps (node, character) -> node in a hash table."""
        number = {"": 0} | {prefix: k for k, prefix in enumerate(self.prefixes, 1)}
        self.node_id, self.node_score = np.full(len(number), -1, np.int32), np.zeros(len(number), np.int64)
        bits = max(4, (4 * len(number)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.child = np.full(1 << bits, _FREE, np.uint64), np.zeros(1 << bits, np.int32)
        for prefix, k in list(number.items())[1:]:
            if self.prefixes[prefix] is not None:
                self.node_id[k], self.node_score[k] = self.prefixes[prefix]
            key = number[prefix[:-1]] << 21 | ord(prefix[-1])
            slot = (key * int(_SPREAD) & (1 << 64) - 1) >> int(self.shift)
            while self.keys[slot] != _FREE:
                slot = (slot + 1) & (1 << bits) - 1
            self.keys[slot], self.child[slot] = key, k

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to, 0 where no piece goes on."""
        key = nodes.astype(np.uint64) << np.uint64(21) | codes
        slot = (key * _SPREAD >> self.shift).astype(np.int64)
        out = np.zeros(len(key), np.int32)
        left = np.arange(len(key))
        while len(left):
            there = self.keys[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (there != _FREE)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out


_FREE, _SPREAD = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15)


def lattice(segment: str, v: Vocabulary) -> list[list[tuple[int, int, tuple[int, ...]]]]:
    """For each end: (start, score, ids) of the edges that end there."""
    n, get = len(segment), v.prefixes.get
    edges: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 1, min(n, i + v.longest) + 1):
            if (found := get(segment[i:j], 0)) == 0:
                break
            if found is not None:
                edges[j].append((i, found[1], (found[0],)))
        if not edges[i + 1] or edges[i + 1][-1][0] != i:
            raw = segment[i].encode(errors="surrogatepass")
            edges[i + 1].append((i, v.unknown, tuple(v.bytes[b] for b in raw)))
    return edges


def forward(edges: list[list[tuple[int, int, tuple[int, ...]]]]) -> list[int]:
    """Viterbi: the best score from the start to every place."""
    best = [0] * len(edges)
    for j in range(1, len(edges)):
        best[j] = max([best[i] + score for i, score, _ in edges[j]])
    return best


class Partial:
    """A path from a place to the end, as a link to the one it extends. Ordered by cost, then by the
    ids from the end: two paths differ at the first step behind their last common link, which is
    found over links that jump back (their lengths double, as in a skew binary number)."""

    __slots__ = ("cost", "at", "behind", "ids", "parent", "depth", "jump")

    def __init__(self, cost: int, at: int, behind: int, ids: tuple[int, ...], parent: Partial | None):
        self.cost, self.at, self.behind, self.ids, self.parent = cost, at, behind, ids, parent
        self.depth = parent.depth + 1 if parent else 0
        if parent is None:
            self.jump = self
        else:
            one, two = parent.jump, parent.jump.jump
            self.jump = two if parent.depth - one.depth == one.depth - two.depth else parent

    def back_to(self, depth: int) -> Partial:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.parent
        return node

    def __lt__(self, other: Partial) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        depth = min(self.depth, other.depth)
        a, b = self.back_to(depth), other.back_to(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.ids < b.ids

    def all_ids(self) -> tuple[int, ...]:
        out, node = [], self
        while node.parent is not None:
            out += reversed(node.ids)
            node = node.parent
        return tuple(out)


def n_best(segment: str, v: Vocabulary, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best (score, ids) by score, then by the ids from the end."""
    edges = lattice(segment, v)
    best = forward(edges)
    out: list[tuple[int, tuple[int, ...]]] = []
    heap = [Partial(-best[-1], len(segment), 0, (), None)]  # cost: the negated best score of any path through it
    while heap and len(out) < n:
        path = heapq.heappop(heap)
        if path.at == 0:
            out.append((-path.cost, path.all_ids()))
            continue
        for i, score, piece in edges[path.at]:
            behind = path.behind + score
            heapq.heappush(heap, Partial(-(best[i] + behind), i, behind, piece[::-1], path))
    return out


def best_and_gap(segment: str, v: Vocabulary) -> tuple[int, int, tuple[int, ...]]:
    """The first of ``n_best`` as score and ids, and how far the second is behind (-1: none)."""
    edges, low = lattice(segment, v), -1 << 60
    first, second = [0], [low]  # the two best scores to each place
    for into in edges[1:]:
        one = two = low
        for i, score, _ in into:
            for to in (first[i] + score, second[i] + score):
                if to > one:
                    one, two = to, one
                elif to > two:
                    two = to
        first.append(one)
        second.append(two)
    ids, at = [], len(segment)
    while at:  # of edges that are as good, the one whose ids from the end are smaller
        piece, at = min((piece[::-1], i) for i, score, piece in edges[at] if first[i] + score == first[at])
        ids += piece
    gap = first[-1] - second[-1]
    return first[-1], -1 if gap > 1 << 50 else gap, tuple(reversed(ids))


def best_of_many(segments: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``best_and_gap`` of many short segments: scores, gaps, numbers of ids, and the ids in one array.
    Pieces are followed from all characters at once; then the two best scores come place by
    place, over all segments that are that long."""
    m = len(segments)
    sizes = np.fromiter(map(len, segments), np.int64, m)
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seg = np.repeat(np.arange(m), sizes)
    ends = np.cumsum(sizes)
    local = np.arange(len(codes)) - (ends - sizes)[seg]
    left = sizes[seg] - local
    # places are numbered by their distance from the start, then by segment
    own = local * m + seg
    pos, node, found = np.arange(len(codes)), np.zeros(len(codes), np.int32), []
    known = np.zeros(len(codes), bool)
    k = 0
    while len(pos):
        node = v.step(node, codes[pos + k])
        k += 1
        there = node > 0
        pos, node = pos[there], node[there]
        whole = v.node_id[node] >= 0
        ended, by = pos[whole], node[whole]
        if k == 1:
            known[ended] = True
        found.append((own[ended], own[ended] + k * m, v.node_score[by], v.node_id[by]))
        inside = left[pos] > k
        pos, node = pos[inside], node[inside]
    rest = np.flatnonzero(~known)
    found.append((own[rest], own[rest] + m, np.full(len(rest), v.unknown), np.full(len(rest), -1)))
    source, target, score, piece = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(target, kind="stable")
    source, target, score, piece = source[order], target[order], score[order], piece[order]
    low, longest = -1 << 60, int(sizes.max(initial=0))
    first, second = np.full((longest + 1) * m, low), np.full((longest + 1) * m, low)
    first[:m] = 0
    back = np.zeros(len(first), np.int64)
    borders = np.searchsorted(target, np.arange(1, longest + 2) * m)
    for a, b in zip(borders, borders[1:]):
        one, two, into = first[source[a:b]] + score[a:b], second[source[a:b]] + score[a:b], target[a:b]
        begins = np.empty(b - a, bool)
        begins[0] = True
        np.not_equal(into[1:], into[:-1], out=begins[1:])
        new = np.flatnonzero(begins)
        top = np.maximum.reduceat(one, new)
        group = np.cumsum(begins) - 1
        at = np.flatnonzero(one == top[group])
        chosen = np.empty(len(new), np.int64)
        chosen[group[at[::-1]]] = at[::-1]  # the first of those that are as good
        one[chosen] = two[chosen]
        places = into[new]
        first[places], second[places], back[places] = top, np.maximum.reduceat(one, new), a + chosen
    last = sizes * m + np.arange(m)
    scores, gaps = first[last], first[last] - second[last]
    gaps[gaps > 1 << 50] = -1
    # back from all ends at once; steps with bytes, and ties, are left to the plain function
    at, who, steps, plain = last, np.arange(m), [], gaps == 0
    while len(who):
        edge = back[at]
        plain[who[piece[edge] < 0]] = True
        steps.append((who, piece[edge]))
        more = source[edge] >= m
        at, who = source[edge][more], who[more]
    who, got = np.concatenate([x for x, _ in steps[::-1]]), np.concatenate([x for _, x in steps[::-1]])
    counts = np.bincount(who, minlength=m)
    ids = got[np.argsort(who, kind="stable")].astype(np.int32)
    if plain.any():
        parts, last_at, starts = [], 0, np.cumsum(counts) - counts
        for i in np.flatnonzero(plain).tolist():
            _, _, other = best_and_gap(segments[i], v)
            parts += [ids[last_at:starts[i]], np.array(other, np.int32)]
            last_at, counts[i] = starts[i] + counts[i], len(other)
        ids = np.concatenate([*parts, ids[last_at:]])
    return scores, gaps, counts, ids


def applied(ids: np.ndarray, edits: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """The ids of a path from those of the best one."""
    parts, last = [], 0
    for at, size, other in edits:
        parts += [ids[last:at], np.array(other, np.int32)]
        last = at + size
    return np.concatenate([*parts, ids[last:]])


class Encoder:
    """Encodes texts, keeping for each segment the ids and score of its best path, and how far
    the second is behind."""

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n = v, n
        width = np.array([len(b) for b in v.text], dtype=np.int64)
        self._text = np.frombuffer(b"".join(v.text), dtype=np.uint8)
        self._width, self._from = width, np.cumsum(width) - width
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        for name in ("size", "start", "score", "gap", "texts"):
            setattr(self, name, np.zeros(1 << 12, np.int64))
        self.used = 0
        self.more: dict[str, list] = {}

    def _keep_common(self) -> None:
        """Forget the segments that were met in one text only; if that's few, all."""
        common = [(segment, k) for segment, k in self.place.items() if self.texts[k] > 1]
        old, more = (self.ids, self.size, self.start, self.score, self.gap), self.more
        self._reset()
        self.more = more
        if len(common) < KEPT_SEGMENTS * 3 // 4 and common:
            at = np.array([k for _, k in common])
            size, start = old[1][at], old[2][at]
            ends = np.cumsum(size)
            ids = old[0][np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
            self._put([segment for segment, _ in common], old[3][at], old[4][at], size, ids)

    def _put(self, segments: list[str], scores, gaps, counts, ids: np.ndarray) -> None:
        k, m = len(self.place), len(segments)
        while k + m > len(self.size):
            for name in ("size", "start", "score", "gap", "texts"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.size[k:k + m], self.score[k:k + m], self.gap[k:k + m] = counts, scores, gaps
        self.start[k:k + m] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.place.update(zip(segments, range(k, k + m)))

    def cut(self, text: str) -> list[str]:
        return self.v.segment.findall(MARK + text.replace(" ", MARK))

    def prepare(self, cuts: list[list[str]]) -> None:
        """Segment what is new in some texts, cut into segments."""
        if len(self.place) > KEPT_SEGMENTS:
            self._keep_common()
        new = list(set().union(*cuts).difference(self.place))
        short = [s for s in new if len(s) <= LONG]
        for k in range(0, len(short), 1 << 14):
            part = short[k:k + (1 << 14)]
            self._put(part, *best_of_many(part, self.v))
        for segment in new:
            if len(segment) > LONG:
                score, gap, ids = best_and_gap(segment, self.v)
                self._put([segment], score, gap, np.array([len(ids)]), np.array(ids, np.int32))

    def encode(self, text: str, paths: bool = False) -> tuple[np.ndarray, list[int], list[np.ndarray] | None]:
        """Ids of the best path, the scores of the n best paths, and (if asked for) their ids."""
        segments = self.cut(text)
        self.prepare([segments])
        ids, scores, edits = self.edits(segments)
        return ids, scores, [applied(ids, e) for e in edits] if paths else None

    def edits(self, segments: list[str]) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, tuple[int, ...]]]]]:
        """Of a text whose segments are prepared: ids of the best path, the scores of the n best paths,
        and each path as edits of the best one: (first id replaced, how many, the ids instead)."""
        at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
        self.texts[at] += 1
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[at] - (ends - size), size)]
        total = int(self.score[at].sum())
        found = self._changes(segments, at)
        return ids, [total - behind for behind, _ in found], [
            [(int(ends[k] - size[k]), int(size[k]), other) for k, other in changes] for _, changes in found]

    def _changes(self, segments: list[str], at: np.ndarray) -> list[tuple[int, tuple]]:
        """The n best paths in order, as (score behind the best, ((segment, other ids), ...)).

        A segment whose second path is farther behind than n - 1 others' differs in none of
        them. Of equal segments only the first and the last n - 1 can differ: a change between
        them has n - 1 that are as good and come before it in the order."""
        gap = self.gap[at]
        open_ = np.flatnonzero(gap >= 0)
        wanted = self.n - 1
        found: list[tuple[int, tuple]] = [(0, ())]
        if wanted < 1 or not len(open_):
            return found
        bar = np.partition(gap[open_], wanted - 1)[wanted - 1] if len(open_) >= wanted else None
        picked = open_ if bar is None else open_[gap[open_] <= bar]
        if bar == 0:  # other paths that are as good have greater ids, and earlier ones come first
            picked = picked[:wanted]
        if len(picked) > 2 * wanted:
            same: dict[int, list[int]] = {}
            for k in picked.tolist():
                same.setdefault(at[k], []).append(k)
            picked = sorted({k for ks in same.values() for k in (*ks[:wanted], *ks[-wanted:])})
        for k in picked:
            options = []
            paths = self._others(segments[k])
            for behind, rank, other in paths:
                if bar is None or behind <= bar:
                    change = ((int(k), other),) if other is not paths[0][2] else ()
                    options += [(so_far + behind, rank, order, changes + change)
                                for order, (so_far, changes) in enumerate(found)]
            options.sort(key=lambda o: o[:3])
            found = [(o[0], o[3]) for o in options[:self.n]]
        return found

    def _others(self, segment: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """The segment's n best as (score behind, rank of the ids from the end, ids); the best
        has rank 0 among those that are as good."""
        out = self.more.get(segment)
        if out is None:
            if len(self.more) > KEPT_SEGMENTS // 16:
                self.more.clear()
            paths = n_best(segment, self.v, self.n)
            rank = {ids: r for r, ids in enumerate(sorted((ids for _, ids in paths), key=lambda x: x[::-1]))}
            out = self.more[segment] = [(paths[0][0] - score, rank[ids], ids) for score, ids in paths]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the leading space."""
        width = self._width[ids]
        ends = np.cumsum(width)
        if not len(ends):
            return ""
        data = self._text[np.arange(ends[-1]) + np.repeat(self._from[ids] - (ends - width), width)].tobytes()
        return data.decode(errors="replace").removeprefix(" ")


EDITS = "array<array<struct<at: int, size: int, ids: array<int>>>>"
KINDS = {"ids": "array<int>", "edits": EDITS, "ids_sha256": "string", "n_best_sha256": "array<string>",
         "round_trip": "boolean"}
ARROW = {"ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "n_best_sha256": pa.list_(pa.string()), "round_trip": pa.bool_(),
         "edits": pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))}
SLICE_ROWS, SLICE_CHARS = 256, 1 << 21


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def _id_lists(values: list[np.ndarray | None]) -> pa.ListArray:
    """A list column from its rows' arrays, without looking at each id."""
    sizes = [0 if x is None else len(x) for x in values]
    there = [x for x in values if x is not None]
    off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.empty(0, np.int32), *there]), pa.int32()),
                                    mask=pa.array([x is None for x in values]))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows and texts in slices of bounded size; a text beyond it is a slice of its own."""
    at, texts, chars = 0, [], 0
    for text in batch.column(1):
        texts.append(text.as_py())
        chars += len(texts[-1] or "")
        if len(texts) == SLICE_ROWS or chars >= SLICE_CHARS:
            yield batch.slice(at, len(texts)), texts
            at, texts, chars = at + len(texts), [], 0
    if texts:
        yield batch.slice(at, len(texts)), texts


def _encode(batches: Iterator[pa.RecordBatch], shared, n: int, wanted: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    e = Encoder(shared.value, n)
    make = {"ids": lambda text, ids, edits: ids,
            "edits": lambda text, ids, edits: [[{"at": a, "size": k, "ids": other} for a, k, other in path] for path in edits[1:]],
            "ids_sha256": lambda text, ids, edits: _digest(ids),
            "n_best_sha256": lambda text, ids, edits: [_digest(applied(ids, path)) for path in edits],
            "round_trip": lambda text, ids, edits: e.decode(ids) == text}
    for batch in batches:
        for part, texts in _slices(batch):
            cuts = [None if text is None else e.cut(text) for text in texts]
            e.prepare([segments for segments in cuts if segments is not None])
            sizes, best, out = [], [], {w: [] for w in wanted}
            for text, segments in zip(texts, cuts):
                if text is None:
                    for values in (sizes, best, *out.values()):
                        values.append(None)
                    continue
                ids, scores, edits = e.edits(segments)
                sizes.append(len(ids))
                best.append(scores)
                for w, values in out.items():
                    values.append(make[w](text, ids, edits))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(best, pa.list_(pa.int64())),
                 *[_id_lists(values) if w == "ids" else pa.array(values, ARROW[w]) for w, values in out.items()]],
                ["carry", "n_pieces", "n_best_scores", *wanted])


def _run(docs: DataFrame, carry: list[str], text_col: str, model: str | None, n: int, wanted: tuple[str, ...]) -> DataFrame:
    rows = docs.select(F.struct(*carry).alias("carry"), F.col(text_col).cast("string").alias("text"))
    # a vocabulary's size doesn't grow with the data
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    kind = rows.schema["carry"].dataType.simpleString()
    rest = ", ".join(f"{w} {KINDS[w]}" for w in wanted)
    out = rows.mapInArrow(lambda b: trimmed(_encode(b, shared, n, wanted)),
                          f"carry {kind}, n_pieces long, n_best_scores array<long>, {rest}")
    taken = ("n_pieces", "n_best_scores", *wanted)
    return out.select(*[F.col("carry")[c].alias(c) for c in carry if c not in taken], *taken)


def paths(ids: str = "ids", edits: str = "edits") -> Column:
    """The ids of all n paths, best first, from the best path's and the others' edits of them."""
    def whole(path: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("last"))
        return F.aggregate(
            path, start,
            lambda had, e: F.struct(F.concat(had["ids"], F.slice(ids, had["last"] + 1, e["at"] - had["last"]), e["ids"]).alias("ids"),
                                    (e["at"] + e["size"]).alias("last")),
            lambda had: F.concat(had["ids"], F.slice(ids, had["last"] + 1, F.size(ids))))

    return F.when(F.col(ids).isNotNull(), F.concat(F.array(F.col(ids)), F.transform(edits, whole)))


def encode(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", model: str | None = None,
           n: int = N_BEST) -> DataFrame:
    """``keep`` columns, ``n_pieces``, ``n_best_scores`` (best first), ``ids`` of the best path and
    ``n_best_ids`` of all n paths, in the order of the scores."""
    out = _run(docs, list(keep), text_col, model, n, ("ids", "edits"))
    return out.withColumn("n_best_ids", paths()).drop("edits")


def encode_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                   n: int = N_BEST) -> DataFrame:
    """As ``encode``, but with the digests of the ids (32-bit little-endian) and ``round_trip``:
    whether ``ids`` decode to the text."""
    return _run(docs, [id_col], text_col, model, n, ("ids_sha256", "round_trip", "n_best_sha256"))


def encode_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                 n: int = N_BEST) -> DataFrame:
    """All n paths, as ``ids`` of the best and ``edits`` of the others (``paths`` makes whole lists of
    them), with the digest of the best path's ids and whether they decode to the text."""
    return _run(docs, [id_col], text_col, model, n, ("ids_sha256", "round_trip", "ids", "edits"))


def encode_checked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
                   n: int = N_BEST) -> DataFrame:
    """As ``encode_edits``, with ``n_best_ids`` of all n paths, best first, instead."""
    out = encode_edits(docs, id_col=id_col, text_col=text_col, model=model, n=n)
    return out.withColumn("n_best_ids", paths()).drop("ids", "edits")


def decode(encoded: DataFrame, *, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """All columns, and ``text`` (replaced where there is one); null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value, 1)
        for batch in batches:
            texts = [None if x.as_py() is None else e.decode(np.array(x.as_py(), np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    rows = encoded.select(F.struct(*encoded.columns).alias("row"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("row")[c].alias(c) for c in encoded.columns if c != "text"], "text")


def encode_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' columns but the text, with its pieces, in the order of the
    stage before: files by name, and the rows in them, follow it. Of the other paths it gives the scores."""
    keep = [c for c in docs.columns if c != "text"]
    return _run(in_file_order(docs), keep, "text", None, N_BEST, ("ids",))
