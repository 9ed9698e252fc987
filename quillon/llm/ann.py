"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries and candidates are dealt into blocks; each cell of the block grid is one
task. A cell multiplies int8 codes tile by tile, which bounds each inner product
from both sides: with x = xq + e and y = yq + f (codes times scale, and what
rounding left), |x.y - xq.yq| <= |xq||f| + |e||yq| + |e||f|. Pairs whose upper
bound reaches the k-th best lower bound survive, are recomputed in double on the
original vectors and merged into heaps of k.

Codes and norms are those of vectors scaled by a power of two to a largest
component between a half and one, so nothing in a bound overflows or vanishes;
what is below 2^-500 of it, and what rounding of the double product may add, is
in the slack. Pairs whose product in double may itself overflow or lose digits
are not bounded at all: they survive. So the result is the exact k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query block and of a candidate block; a cell holds one of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 4096
#: Queries of a product tile, numbers of vectors that are recomputed at a time.
TILE, EXACT_NUMBERS = 128, 1 << 21
#: Exponents between which a product of two vectors is bounded; beyond, a double may overflow or lose digits.
LEAST_EXPONENT, MOST_EXPONENT = -900, 1000


def usable(vec: str) -> Column:
    """Vectors that take part: not null, not all zero, every component finite."""
    return F.expr(
        f"coalesce(size(`{vec}`) > 0 and forall(`{vec}`, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity')) and exists(`{vec}`, x -> x <> 0), false)"
    )


class _Codes:
    """int8 codes of vectors scaled by 2^-exponent, with the norms that the bound needs."""

    def __init__(self, x: np.ndarray) -> None:
        self.exponent = np.frexp(np.abs(x).max(1))[1]
        half = self.exponent // 2  # in two steps: 2^1074 is no double
        x = np.ldexp(np.ldexp(x, -half[:, None]), (half - self.exponent)[:, None])
        self.scale = np.abs(x).max(1) / 127
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        kept = self.codes * self.scale[:, None]
        self.norm, self.lost = np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def cell_nearest(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best (score, id) of this cell, best first, ties to the smaller id. A score that is no number ranks last."""
    qc, cc = _Codes(q), _Codes(c)
    dims = q.shape[1]
    exact = np.float32 if dims * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay whole
    right = cc.codes.astype(exact).T
    pairs = max(64, EXACT_NUMBERS // dims)
    for t in range(0, len(qid), TILE):
        own = slice(t, t + TILE)
        approx = (qc.codes[own].astype(exact) @ right).astype(np.float64) * qc.scale[own, None] * cc.scale
        slack = qc.norm[own, None] * cc.lost + qc.lost[own, None] * (cc.norm + cc.lost)
        slack += 1e-9 * (np.abs(approx) + slack)  # what rounding of the bound itself may hide
        slack += dims * (2.0**-48 * (qc.norm + qc.lost)[own, None] * (cc.norm + cc.lost) + 2.0**-500)
        power = qc.exponent[own, None] + cc.exponent
        bounded = (power > LEAST_EXPONENT) & (power < MOST_EXPONENT)
        factor = np.ldexp(1.0, np.where(bounded, power, 0))
        self_pair = qid[own, None] == cid
        low = np.where(self_pair | ~bounded, -np.inf, (approx - slack) * factor)
        kth = np.partition(low, max(0, len(cid) - k), axis=1)[:, max(0, len(cid) - k)] if len(cid) > k else np.full(len(low), -np.inf)
        row, col = np.nonzero((~bounded | ((approx + slack) * factor >= kth[:, None])) & ~self_pair)
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(low))]
        for p in range(0, len(row), pairs):
            r, s = row[p : p + pairs], col[p : p + pairs]
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.cumsum(q[t + r] * c[s], axis=1)[:, -1]  # in order, so that equal vectors score alike everywhere
            score[np.isnan(score)] = -np.inf
            for i, v, j in zip(r.tolist(), score.tolist(), (-cid[s]).tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (v, j))
                elif heap[0] < (v, j):
                    heapq.heapreplace(heap, (v, j))
        for i, heap in enumerate(heaps):
            yield int(qid[t + i]), [(v, -j) for v, j in sorted(heap, reverse=True)]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score double: the k largest inner products of each query.

    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do null keys. Rows with the query's own key are no candidates;
    vectors are compared with those of their own length only. Of repeated rows
    each is a candidate and each query key is answered once, for the smallest of
    its vectors. Components may be of any size: a product that overflows is
    infinite, and one of infinities of both signs counts as the least. Empty
    tables give no row; other columns, whatever their names, are not read.
    """
    single = all(dict(df.dtypes)[vec] == "array<float>" for df in (queries, candidates))  # half the bytes through the shuffle
    pick = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<float>" if single else "array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    asked, there = pick(queries).groupBy("id").agg(F.min("v").alias("v")), pick(candidates)
    n_q, n_c = queries.count(), candidates.count()
    rows, cols = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = asked.withColumn("i", block(rows)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).withColumn("asks", F.lit(True))
    right = there.withColumn("j", block(cols)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("asks", F.lit(False))
    cells = left.select("i", "j", "id", "v", "asks").unionByName(right.select("i", "j", "id", "v", "asks")).withColumn("n", F.size("v"))

    def run(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        asks = part["asks"].to_numpy(bool)
        for side in (part[asks], part[~asks]):
            if side.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, c = (np.stack(p["v"].to_numpy()).astype(np.float64) for p in (part[asks], part[~asks]))
        for qid, best in cell_nearest(part["id"].to_numpy()[asks], q, part["id"].to_numpy()[~asks], c, k):
            out += [(qid, j, v) for v, j in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = cells.groupBy("n", "i", "j").applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
