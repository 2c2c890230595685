"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit one binary classifier, linear in the
counts of byte 2- and 3-grams, tells the languages whose bit is 1 from the others: its
weights are the log ratio of the n-gram's mean probability in both sets, from counts over
all training rows. Decoding is loss-weighted: a language's loss is the weighted sum over its
bits of log(1 + exp(-bit * margin)), where the margin is the mean weight of the text's
n-grams and the weights are the margins that the language itself has in training. The
language with the smallest loss wins; ties go to the smaller name. ``score`` is its share in
a softmax of the losses; ``ambiguous`` marks a runner-up that is close.

Letters A-Z are lower-cased, bytes of other letters stay, all else counts as one separator.
Whole texts count. A text that is null or has no letter is ``und`` with score 0; with no
training rows everything is. Rows with a null language or text don't train. A null id counts
as the empty text in the split. Repeated rows each train and each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendscope.llm.text import Texts

BITS = 14                 # n-grams of each length are hashed to 2**BITS features
FEATURES = 2 << BITS
SMOOTHING = 0.5
GAIN = 4.0                # of the mean margin in the loss
AMBIGUOUS = 0.9           # scores below are ambiguous
MAX_LANGUAGES = 1000      # a model has MAX_LANGUAGES * FEATURES counts at most
SCALE = 1 << 16           # weights are whole multiples of 1 / SCALE: sums don't depend on slices

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngrams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text index) of all n-grams with a letter, by text within each length."""
    c = _FOLD[texts.buf]
    row = np.repeat(np.arange(texts.n, dtype=np.int32), np.diff(texts.off))
    pair = c[:-1] * np.uint32(256) + c[1:]
    two = np.flatnonzero((row[:-1] == row[1:]) & (pair != 32 * 256 + 32)) if len(c) > 1 else np.zeros(0, np.int64)
    three = two[(two < len(c) - 2)]
    three = three[row[three] == row[three + 2]] if len(c) > 2 else np.zeros(0, np.int64)
    a = (pair[two] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    b = ((pair[three] * np.uint32(256) + c[three + 2]) * np.uint32(2246822519)) >> np.uint32(32 - BITS)
    return (np.concatenate([a, b + np.uint32(1 << BITS)]).astype(np.int64),
            np.concatenate([row[two], row[three]]).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, feature) over a whole partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, texts in Texts.slices(batch.column(1)):
            feature, row = ngrams(texts)
            names = sorted(set(langs[at:at + texts.n]))
            which = np.array([names.index(x) for x in langs[at:at + texts.n]])
            found = np.bincount(which[row] * FEATURES + feature, minlength=len(names) * FEATURES)
            for name, part in zip(names, found.reshape(len(names), FEATURES)):
                sums[name] = sums[name] + part if name in sums else part
    for name, part in sums.items():
        at = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                          pa.array(part[at], pa.int64())], ["lang", "feature", "n"])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of bits +1 / -1: all distinct splits for up to five languages, else about
    10 log2(n) random splits, the best of a hundred draws by smallest distance."""
    if n <= 5:
        splits = [s for s in product((1, -1), repeat=n - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], dtype=np.int64).T.reshape(n, len(splits))
    rng, best = np.random.default_rng(seed), None
    for _ in range(100):
        code = rng.choice([1, -1], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        distance = ((code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=np.int64) * 10**6).min()
        if best is None or distance > best[0]:
            best = (distance, code)
    return best[1]


class Model:
    """Languages, codewords, whole-number weights (bits x features) and loss weights."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = len(self.languages)
        chance = np.array([(counts[x] + SMOOTHING) / (counts[x].sum() + SMOOTHING * FEATURES)
                           for x in self.languages]).reshape(n, FEATURES)
        self.code = codewords(n) if n > 1 else np.ones((n, 0), dtype=np.int64)
        ratio = [np.log(chance[bit > 0].mean(0)) - np.log(chance[bit < 0].mean(0)) for bit in self.code.T]
        self.weights = np.rint(np.array(ratio).reshape(-1, FEATURES) * SCALE).astype(np.int64)
        own = np.maximum(self.code * (chance @ self.weights.T / SCALE), 1e-9)
        self.loss_weights = own / own.sum(1, keepdims=True) if n > 1 else own

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language's index and score, from mean margins (texts x bits)."""
        loss = np.einsum("cb,tcb->tc", self.loss_weights,
                         np.logaddexp(0, -GAIN * self.code[None] * margins[:, None, :]))
        best = loss.argmin(1)
        gap = loss - loss[np.arange(len(loss)), best][:, None]
        return best, 1 / np.exp(-np.minimum(gap, 700)).sum(1)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [c for i, c in enumerate(batch.columns) if i != 2]
        for at, texts in Texts.slices(batch.column(2)):
            names, scores = ["und"] * texts.n, np.zeros(texts.n)
            data = texts.buf.tobytes()
            letter = np.array([any(map(str.isalpha, data[a:b].decode())) for a, b in zip(texts.off[:-1], texts.off[1:])])
            if len(model.languages) == 1:
                names = [model.languages[0] if x else "und" for x in letter]
                scores = letter.astype(float)
            elif model.languages and letter.any():
                feature, row = ngrams(texts)
                n = np.bincount(row, minlength=texts.n)
                order = np.argsort(row, kind="stable")
                feature, ends = feature[order], np.concatenate([[0], np.cumsum(n)])
                margins = np.empty((texts.n, len(model.weights)))
                for b, weights in enumerate(model.weights):
                    sums = np.concatenate([[0], np.cumsum(weights[feature])])
                    margins[:, b] = (sums[ends[1:]] - sums[ends[:-1]]) / SCALE / np.maximum(n, 1)
                best, score = model.decode(margins)
                names = [model.languages[i] if x else "und" for i, x in zip(best, letter)]
                scores = np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [c.slice(at, texts.n) for c in held]
                + [pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                   pa.array(letter & (scores < AMBIGUOUS), pa.bool_())],
                ["id", "held_out", "lang_pred", "score", "ambiguous"])


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Count over all rows; only the summed model (languages x features) reaches the driver."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = (rows.mapInArrow(_count, "lang string, feature int, n long")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    table = counts.limit(MAX_LANGUAGES * FEATURES + 1).toArrow()
    names = pc.unique(table["lang"]).to_pylist()
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for name in names:
        part = table.filter(pc.equal(table["lang"], name))
        out[name] = np.zeros(FEATURES, dtype=np.int64)
        out[name][part["feature"].to_numpy()] = part["n"].to_numpy()
    return Model(out)


def held_out(id_col: str) -> Column:
    """A fifth of the rows, by the id's text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score, ambiguous. No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bits x features numbers, as MAX_LANGUAGES bounds them
    out = rows.mapInArrow(lambda b: _predict(b, shared.value),
                          f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, "
                          "score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, then predict every row."""
    return predict(docs, train(docs.filter(~held_out("doc_id"))))
