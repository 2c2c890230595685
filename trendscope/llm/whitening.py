"""Whitening of embeddings from polarised covariances.

Components become whole numbers x = floor(scale * c) + shift. The fit list holds each distinct
vector once: n vectors with sums S. All moments are sums of exact squares of centred values
y = n * x - S: one of y_i for every dimension, one of y_i + y_j for every pair. As
(y_i + y_j)^2 - y_i^2 - y_j^2 = 2 y_i y_j, differences of these variances give all
cross-covariances, exactly; only their quotient by n^3 is rounded. The matrix goes to ``eigh``;
components are numbered by falling eigenvalue, and each eigenvector's largest entry is
positive. Every row, copies included, is projected, and the covariance of the projected fit
list is measured against the identity in a pass of its own.

Tasks sum whole numbers: in 64 bits with as many limbs as the range of the values asks for,
beyond 2**62 as Python's numbers. The driver gets d * (d + 1) / 2 sums for vectors of d dimensions,
whatever the number of rows.

Vectors that are null or hold null or non-finite components take no part, nor do those with a
component beyond +-2**52 / scale, which has no exact whole number. Vectors of another length are
another fit. Vectors without components give no rows. A component without variance (an eigenvalue not
above d * 2**-52 of the largest one) has null ``whitened`` and no part in the identity error;
``explained`` is null where nothing varies. Ids may be null and repeat; each row is
projected. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendscope.llm.scratch import Scratch
from trendscope.llm.text import trimmed

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = 1 << 52
ROWS = 1 << 12         # vectors that are squared at once; 2**14 at most, for the limbs' sums
LIMB = 24
PART = 10 ** 18        # sums travel as two decimals, high * PART + low


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x) of the rows whose vector takes part."""
    fits = F.forall(vector_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * scale <= LARGEST))
    return vectors.filter(F.col(vector_col).isNotNull()).filter(F.coalesce(fits, F.lit(False))).select(
        F.col(id_col).alias("id"),
        F.transform(vector_col, lambda e: F.floor(e.cast("double") * scale).cast("long") + shift).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows of the batch, matrix) of vectors of equal length, ``ROWS`` at most."""
    for batch in batches:
        x = batch.column(batch.schema.get_field_index(column))
        values = x.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
        dims = np.diff(ends, prepend=0)
        for d in np.unique(dims[dims > 0]).tolist():
            rows = np.flatnonzero(dims == d)
            for at in range(0, len(rows), ROWS):
                part = rows[at:at + ROWS]
                yield d, part, values[(ends[part] - d)[:, None] + np.arange(d)]


def _split(total: int) -> tuple[Decimal, Decimal]:
    high, low = divmod(total, PART)
    return Decimal(high), Decimal(low)


SUMS = "dims int, i int, j int, n long, high decimal(38,0), low decimal(38,0), least long, most long"


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38), pa.decimal128(38), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SUMS.split(", ")])


def _first_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count, sums and range of every dimension."""
    totals: dict[int, list] = {}
    for d, _, x in _matrices(batches, "x"):
        had = totals.setdefault(d, [0, [0] * d, x[0], x[0]])
        had[0] += len(x)
        # two parts, so that the sum of a slice fits in 64 bits
        had[1] = [s + (int(a) << 32) + int(b) for s, a, b in zip(had[1], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]
        had[2], had[3] = np.minimum(had[2], x.min(0)), np.maximum(had[3], x.max(0))
    yield _sum_rows([(d, i, i, n, *_split(s[i]), int(least[i]), int(most[i]))
                     for d, (n, s, least, most) in totals.items() for i in range(d)])


class Fit:
    """Count, sums and range of the fit list's vectors of one length."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)
        # y = n * x - S is computed from x - base, to stay small
        self.base = [s // n for s in sums]
        self.offset = [s - n * b for s, b in zip(sums, self.base)]
        self.bound = n * (1 + max(max(b - lo, hi - b) for b, lo, hi in zip(self.base, least, most)))  # of abs(y)
        self.kind = np.int64 if 2 * self.bound < 1 << 62 else object

    def centred(self, x: np.ndarray) -> np.ndarray:
        near = x - np.array(self.base, np.int64)
        return near.astype(self.kind) * self.n - np.array(self.offset, dtype=self.kind)


def square_sums(t: np.ndarray, bound: int) -> list[int]:
    """The exact sum of squares of each column; ``bound`` holds all absolute values."""
    if t.dtype == object:
        return (t * t).sum(0).tolist()
    if bound * bound * len(t) < 1 << 63:
        return np.einsum("nj,nj->j", t, t).tolist()
    mask = (1 << LIMB) - 1
    limbs = [t & mask, t >> LIMB]
    if bound >> (2 * LIMB):
        limbs[1:] = [limbs[1] & mask, limbs[1] >> LIMB]
    out = [0] * t.shape[1]
    for a in range(len(limbs)):
        for b in range(a, len(limbs)):
            part = np.einsum("nj,nj->j", limbs[a], limbs[b]).tolist()
            shift = LIMB * (a + b) + (a != b)
            out = [o + (p << shift) for o, p in zip(out, part)]
    return out


def _second_moments(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    """A task's sums of the squares of y_i (as i, i) and of y_i + y_j."""
    totals: dict[int, list[list[int]]] = {}
    for d, _, x in _matrices(batches, "x"):
        fit = fits[d]
        y = fit.centred(x)
        had = totals.setdefault(d, [[0] * (d - i) for i in range(d)])
        for i in range(d):
            alone = square_sums(y[:, i:i + 1], fit.bound)
            pairs = square_sums(y[:, i:i + 1] + y[:, i + 1:], 2 * fit.bound)
            had[i] = [a + b for a, b in zip(had[i], alone + pairs)]
    yield _sum_rows([(d, i, i + k, 0, *_split(s), 0, 0) for d, table in totals.items()
                     for i, row in enumerate(table) for k, s in enumerate(row)])


class Whitener:
    """Eigenvalues and unit eigenvectors (columns of ``axes``) of one length's covariance."""

    def __init__(self, fit: Fit, squares: dict[tuple[int, int], int], components: int):
        self.fit = fit
        d, cube = fit.d, fit.n ** 3
        cov = np.zeros((d, d))
        for i in range(d):
            cov[i, i] = squares[i, i] / cube
            for j in range(i + 1, d):
                cov[i, j] = cov[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * cube)
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
        trace = sum(squares[i, i] for i in range(d)) / cube
        self.covariance, self.components = cov, min(components, d)
        self.axes = axes[:, :self.components]
        values = values[:self.components]
        self.varies = values > d * 2.0 ** -52 * max(values[0], 0.0)
        self.scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, values, 1.0)), 0.0)
        self.explained = values / trace if trace > 0 else np.full(self.components, np.nan)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.fit.n) @ self.axes * self.scale


def _total(row) -> int:
    return int(row["high"]) * PART + int(row["low"])


def fit_whitening(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """A whitener for every length of the vectors ``x`` of ``fit_list``, which hold each vector once."""
    summed = lambda rows: rows.groupBy("dims", "i", "j").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"),
        F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dims", "i", "j").collect()
    firsts: dict[int, list] = {}
    for r in summed(fit_list.mapInArrow(lambda b: trimmed(_first_moments(b)), SUMS)):
        firsts.setdefault(r["dims"], []).append(r)
    fits = {d: Fit(rows[0]["n"], [_total(r) for r in rows], [r["least"] for r in rows], [r["most"] for r in rows])
            for d, rows in firsts.items()}
    squares: dict[int, dict[tuple[int, int], int]] = {}
    for r in summed(fit_list.mapInArrow(lambda b: trimmed(_second_moments(b, fits)), SUMS)):
        squares.setdefault(r["dims"], {})[r["i"], r["j"]] = _total(r)
    return {d: Whitener(fit, squares[d], components) for d, fit in fits.items()}


def identity_errors(fit_list: DataFrame, whiteners: dict[int, Whitener]) -> dict[int, float]:
    """Per length, the largest absolute entry of the whitened fit list's covariance minus the identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, _, x in _matrices(batches, "x"):
            w = whiteners[d].whiten(whiteners[d].fit.centred(x))
            sums[d] = sums.get(d, 0.0) + w.T @ w
        rows = [(d, i, j, v) for d, m in sums.items() for (i, j), v in np.ndenumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
            list(zip(*rows)) or [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["dims", "i", "j", "v"])

    out = {d: 0.0 for d in whiteners}
    for r in (fit_list.mapInArrow(lambda b: trimmed(run(b)), "dims int, i int, j int, v double")
              .groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect()):
        w = whiteners[r["dims"]]
        if w.varies[r["i"]] and w.varies[r["j"]]:
            out[r["dims"]] = max(out[r["dims"]], abs(r["v"] / w.fit.n - (r["i"] == r["j"])))
    return out


def _project(batches: Iterator[pa.RecordBatch], whiteners: dict[int, Whitener],
             errors: dict[int, float]) -> Iterator[pa.RecordBatch]:
    def seen(batches):
        for batch in batches:
            ids.append(batch.column(0))
            yield batch

    ids: list[pa.Array] = []
    for d, rows, x in _matrices(seen(batches), "x"):
        w = whiteners[d]
        k, y = w.components, w.fit.centred(x)
        far = square_sums(np.ascontiguousarray(y.T), w.fit.bound) if len(y) else []
        out = w.whiten(y)
        at = np.repeat(np.arange(len(rows)), k)
        del ids[:-1]
        yield pa.RecordBatch.from_arrays(
            [ids[-1].take(pa.array(np.repeat(rows, k))),
             pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
             pa.array(np.full(len(at), w.fit.n, np.int64)),
             pa.array([Decimal(v) for v in far], pa.decimal128(38)).take(pa.array(at)),
             pa.array(out.ravel(), mask=np.tile(~w.varies, len(rows))),
             pa.array(np.tile(w.explained, len(rows)), mask=np.tile(np.isnan(w.explained), len(rows))),
             pa.array(np.full(len(at), errors[d]))],
            ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per row and component: the id, ``component`` (from 1), ``n`` of the fit list, ``deviation`` (the sum of
    (n * x - S)^2, a whole number of 38 digits), ``whitened``, ``explained`` and ``identity_error``."""
    scratch = Scratch(vectors.sparkSession)
    rows = whole_numbers(vectors, id_col, vector_col, scale, shift)
    fit_list = scratch.table(rows.filter(F.size("x") > 0).select("x").distinct())
    whiteners = fit_whitening(fit_list, components)
    errors = identity_errors(fit_list, whiteners)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: trimmed(_project(b, whiteners, errors)),
                          f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                          "explained double, identity_error double")
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def whiten_rows(vectors: DataFrame) -> DataFrame:
    """``whiten`` with ``deviation`` as long; it is null where it needs more than 64 bits."""
    return whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))
