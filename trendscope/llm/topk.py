"""Exact top-k search by no-random-access aggregation.

Vectors become whole numbers floor(scale * x); the score is the inner product. Candidates and
queries are dealt into blocks of bounded size, and each pair of blocks is one group. In a
group, each dimension is a sorted list of the candidates; a query reads all lists from its
better end, equally deep. Values not read yet lie between a list's last read value and its
far end, which gives every candidate a lower and an upper bound. Candidates whose upper bound
is below the k-th lower bound can't qualify and are dropped. The depth grows step by step, by half of
what is left of the lists, with this test after each step, until ``FEW`` candidates are left, whose final
scores are then resolved, or the lists end. The best k of each block are merged per query. Exact, with ties to the smaller id.

Rows with a null id, a null vector or a null or non-finite component take no part; a vector
is compared with queries of its own length. Scores are exact below 2**53. A query is never
its own neighbour: rows with its id are left out. Repeated candidate rows each count;
repeated query rows count once.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
EVERY = 100
SCALE = 1024
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 2048
FIRST = 2                              # the first step reads one FIRST-th of every list
FEW = 32                               # candidates whose scores are resolved at once


def nra(x: np.ndarray, ranks: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, own: int,
        k: int, reached: list | None = None) -> np.ndarray:
    """Indices of the best k candidates for the query. ``x``: candidates x dimensions;
    ``ranks``: place of each value in its ascending list; ``lists``: the sorted lists. ``reached`` takes
    the share of the lists read and how many candidates were left."""
    n = len(x)
    up = q > 0
    flip = np.where(up, 0, -1).astype(ranks.dtype)  # ~rank counts from the other end
    alive = np.flatnonzero(ids != own)
    least = np.where(up, lists[0] * q, lists[-1] * q)
    depth = 0
    while depth < n and len(alive) > max(FEW, k):
        depth += max(1, (n - depth) // FIRST)
        # a dimension is read for a candidate when its place from the better end is below depth
        seen = (ranks[alive] ^ flip) >= np.where(up, n - depth, -depth).astype(ranks.dtype)
        known = np.einsum("nd,nd,d->n", x[alive], seen.astype(np.float64), q)
        last = np.where(up, lists[n - depth] * q, lists[depth - 1] * q)
        bounds = (~seen).astype(np.float64) @ np.stack([least, last], axis=1)
        low, high = known + bounds[:, 0], known + bounds[:, 1]
        bar = np.partition(low, len(low) - k)[len(low) - k]
        alive = alive[high >= bar]
    if reached is not None:
        reached.append((depth / n, len(alive)))
    score = x[alive] @ q
    return alive[np.lexsort((ids[alive], -score))[:k]]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _group(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = {"query_id": [], "vec_id": [], "score": []}
    if candidates.num_rows and queries.num_rows:
        dims = candidates["dims"][0].as_py()
        x, q = _matrix(candidates["v"], dims), _matrix(queries["v"], dims)
        ids, own = candidates["id"].to_numpy(), queries["id"].to_numpy()
        order = np.argsort(x, axis=0, kind="stable")
        ranks = np.empty(x.shape, dtype=np.int32)
        np.put_along_axis(ranks, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        lists = np.take_along_axis(x, order, axis=0)
        for one, name in zip(q, own):
            best = nra(x, ranks, ids, lists, one, name, k)
            out["query_id"] += [name] * len(best)
            out["vec_id"] += ids[best].tolist()
            out["score"] += (x[best] @ one).astype(np.int64).tolist()
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its k best other rows as query_id,
    rank, vec_id, score. Block counts follow the row counts, so that every group is small."""
    valid = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(F.coalesce(valid, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dims"),
        F.transform(vector_col, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    rows = rows.filter("dims > 0")
    asked = rows.filter(F.col("id") % every == 0).distinct()
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1))).first()
    c, q = max(1, ceil(n / CANDIDATE_BLOCK)), max(1, ceil(m / QUERY_BLOCK))
    candidates = rows.withColumn("cb", F.pmod(F.xxhash64("id", "v"), F.lit(c))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    queries = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c - 1).cast("long"))))
    keys = ["dims", "cb", "qb"]
    best = (candidates.groupBy(*keys).cogroup(queries.groupBy(*keys))
            .applyInArrow(lambda a, b: _group(a, b, k), "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
