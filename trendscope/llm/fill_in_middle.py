"""Fill-in-the-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change:
the bytes of the texts and the bytes of the sentinels. Cutting splits a descriptor in two,
an arrangement permutes descriptors and puts sentinel descriptors between them, and the
inverse permutation of the arrangement restores the document. A hash streams the descriptors,
so that no rearranged copy of a text is needed for its digest.

Tokens are runs of Latin letters, and single code points otherwise. Two draws from the id
choose the cuts between tokens, two more the form: ``psm`` (prefix, suffix, middle), ``spm``
(suffix, prefix, middle) or ``plain`` (the text itself).

A null text counts as empty, and an empty text or one that holds a sentinel stays plain, as
its output could not be taken apart again. A null id draws like an empty one. Equal rows give
equal rows. Long texts are one slice of a batch; memory follows the longest text. Columns of
the input other than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendscope.llm.text import Texts, trimmed

SEED = 1
FIM_PERCENT = 90    # documents that are rearranged at all
SPM_PERCENT = 20    # of these, in the order suffix, prefix, middle
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
# a form's order of the parts; their order in the document is prefix, middle, suffix
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")
TEXT, MARKS = 0, 1
_MARKS = b"".join(SENTINELS.values())

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True

PIECES = "array<struct<buffer: int, start: long, length: long>>"
_PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])


class PieceTable:
    """Descriptors over the buffers ``(text, sentinels)``."""

    def __init__(self, buffers: tuple, pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    def cut(self, at: int) -> PieceTable:
        """The same document with a border ``at`` bytes behind its start. An empty side stays as
        an empty descriptor, so that n cuts in ascending order make n + 1 parts of one piece."""
        out, seen, done = [], 0, False
        for i, (buffer, start, length) in enumerate(self.pieces):
            inside = at - seen
            if not done and inside <= length and (inside < length or i == len(self.pieces) - 1):
                out += [(buffer, start, inside), (buffer, start + inside, length - inside)]
                done = True
            else:
                out.append((buffer, start, length))
            seen += length
        return PieceTable(self.buffers, out)

    def arrange(self, form: str) -> PieceTable:
        """Three pieces in the form's order, each behind its sentinel."""
        part = dict(zip(PARTS, self.pieces))
        out = []
        for name in FORMS[form]:
            out += [(MARKS, _MARKS.index(SENTINELS[name]), len(SENTINELS[name])), part[name]]
        return PieceTable(self.buffers, out)

    def restore(self, form: str) -> PieceTable:
        """The inverse permutation of ``arrange``: text pieces back in the document's order."""
        texts = [p for p in self.pieces if p[0] == TEXT]
        place = {name: i for i, name in enumerate(FORMS[form])}
        return PieceTable(self.buffers, [texts[place[name]] for name in PARTS])

    def views(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield memoryview(self.buffers[buffer])[start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def data(self) -> bytes:
        return b"".join(self.views())


def parse(text: bytes, form: str) -> PieceTable:
    """The piece table of an output: its sentinels, each of which stands in it once, become
    descriptors of the sentinel buffer, and what is between them text descriptors."""
    if form == "plain":
        return PieceTable((text, _MARKS), [(TEXT, 0, len(text))])
    at = [text.index(SENTINELS[name]) for name in FORMS[form]]
    pieces = []
    for name, here, following in zip(FORMS[form], at, [*at[1:], len(text)]):
        size = len(SENTINELS[name])
        pieces += [(MARKS, _MARKS.index(SENTINELS[name]), size), (TEXT, here + size, following - here - size)]
    return PieceTable((text, _MARKS), pieces)


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers: the first groups of the hash of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


class Tokens:
    """Places of the tokens of a slice of texts: ``start`` in bytes, ``first[i]:first[i + 1]`` those
    of text i, and ``head``, the bytes that begin a code point."""

    def __init__(self, texts: Texts):
        letter = _LETTER[texts.buf]
        self.head = (texts.buf & 0xC0) != 0x80
        follows = np.zeros(len(letter), dtype=bool)
        follows[1:] = letter[1:] & letter[:-1]
        inner = texts.off[:-1]
        follows[inner[inner < len(letter)]] = False
        self.start = np.flatnonzero(self.head & ~follows)
        self.first = np.searchsorted(self.start, texts.off)

    def cut(self, i: int, unit: int, end: int) -> int:
        """The byte where ``unit`` tokens of text i end."""
        at = self.first[i] + unit
        return int(self.start[at]) if at < self.first[i + 1] else end


def _transform(batches: Iterator[pa.RecordBatch], seed: int, fim_percent: int, spm_percent: int,
               wanted: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in Texts.slices(batch.column(1)):
            tokens, data = Tokens(texts), texts.buf.tobytes()
            ids = batch.column(0).slice(at, texts.n)
            sizes, forms, before, inside = [], [], [], []
            out = {w: [] for w in wanted}
            for i, doc_id in enumerate(ids.to_pylist()):
                a, b = int(texts.off[i]), int(texts.off[i + 1])
                n = int(tokens.first[i + 1] - tokens.first[i])
                h = draws(seed, doc_id)
                table = PieceTable((data, _MARKS), [(TEXT, a, b - a)])
                if a == b or h[2] % 100 >= fim_percent or any(data.find(s, a, b) >= 0 for s in SENTINELS.values()):
                    form, chars = "plain", (None, None)
                else:
                    form = "spm" if h[3] % 100 < spm_percent else "psm"
                    cuts = [tokens.cut(i, u, b) for u in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
                    for cut in cuts:
                        table = table.cut(cut - a)
                    chars = [int(np.count_nonzero(tokens.head[x:y])) for x, y in ((a, cuts[0]), cuts)]
                    table = table.arrange(form)
                sizes.append(n)
                forms.append(form)
                before.append(chars[0])
                inside.append(chars[1])
                for w, values in out.items():
                    if w == "pieces":  # places count from the start of the document's own text
                        values.append([{"buffer": k, "start": s - a if k == TEXT else s, "length": l}
                                       for k, s, l in table.pieces])
                    elif w == "output":
                        values.append(table.data().decode())
                    else:
                        values.append(table.sha256())
            kinds = {"pieces": pa.list_(_PIECE), "output": pa.string(), "output_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()),
                 pa.array(inside, pa.int64()), *[pa.array(v, kinds[w]) for w, v in out.items()]],
                ["id", "n", "form", "prefix_chars", "middle_chars", *wanted])


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   wanted: tuple[str, ...] = ("output",)) -> DataFrame:
    """Per row: the id, ``n`` tokens, ``form``, code points of prefix and middle (null if plain)
    and, of ``output``, ``output_sha256`` and ``pieces`` (descriptors over the document's text,
    buffer 0, and the sentinels, buffer 1), the wanted ones. One pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = {"pieces": PIECES, "output": "string", "output_sha256": "string"}
    rest = "".join(f", {w} {kinds[w]}" for w in wanted)
    out = rows.mapInArrow(
        lambda b: trimmed(_transform(b, seed, fim_percent, spm_percent, wanted)),
        f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long{rest}")
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def _restore(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, slice_ in Texts.slices(batch.column(1)):
            data, off = slice_.buf.tobytes(), slice_.off.tolist()
            forms, out, digests = batch.column(2).slice(at, slice_.n).to_pylist(), [], []
            for a, b, form in zip(off, off[1:], forms):
                table = parse(data[a:b], form)
                if form != "plain":
                    table = table.restore(form)
                digests.append(table.sha256())
                out.append(table.data().decode() if texts else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, slice_.n), pa.array(out, pa.string()), pa.array(digests, pa.string())],
                ["row", "restored", "restored_sha256"])


def restore(outputs: DataFrame, *, output_col: str = "output", form_col: str = "form", texts: bool = True) -> DataFrame:
    """Other columns of ``outputs`` with ``restored``, the document rebuilt from its output and
    form alone (unless not ``texts``), and ``restored_sha256``."""
    keep = [c for c in outputs.columns if c not in (output_col, "restored", "restored_sha256")]
    rows = outputs.select(F.struct(*keep).alias("row"), F.col(output_col).alias("text"), F.col(form_col).alias("form"))
    out = rows.mapInArrow(lambda b: trimmed(_restore(b, texts)),
                          f"row {rows.schema['row'].dataType.simpleString()}, restored string, restored_sha256 string")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *(["restored"] if texts else []), "restored_sha256")


def transform_and_restore(docs: DataFrame) -> DataFrame:
    """The digests of every document's output and of what is rebuilt from it."""
    return restore(fill_in_middle(docs, wanted=("output", "output_sha256")), texts=False)
