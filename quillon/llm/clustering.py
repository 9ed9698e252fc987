"""Centroid clustering in whole numbers.

Components are turned into integers floor(scale x). A round assigns every vector
to its nearest centroid by |x|^2 - 2 x.c + |c|^2, in blocks of float64 matrix
products: as long as dims (max |x| + max |c|)^2 is below 2^53 every term and
every partial sum is a whole number that a double holds, so the products are
exact in any order of summation. Vectors beyond the bound are compared in 64-bit
or, where those don't reach either, in unbounded integers. Each partition sends
one row of sums, which RDD.treeAggregate combines; the driver sees k x dims
numbers a round, whatever the input.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import materialised

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a block; bounds (one bit to spare) of whole numbers in a double and in 64 bits.
BLOCK, IN_DOUBLE, IN_LONG = 4096, float(1 << 52), float(1 << 61)
LARGEST = (1 << 63) - 1


def usable(vec: str, dims: int) -> Column:
    """Vectors that take part: `dims` components, none null or non-finite."""
    return F.expr(f"coalesce(size(`{vec}`) = {dims} and forall(`{vec}`, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity')), false)")


def whole(x: float, scale: int) -> int:
    """floor(scale x) of a finite double as an unbounded integer; scale is a power of two."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)


def blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of a batch (key, vector) in blocks of doubles."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    for a in range(0, len(flat), BLOCK):
        yield slice(a, a + BLOCK), flat[a : a + BLOCK]


@dataclass
class Assigned:
    """A block's clusters and squared distances. Rows that are `exact` have theirs in arrays, the others as unbounded integers by row."""

    cluster: np.ndarray
    exact: np.ndarray
    grid: np.ndarray
    distance: np.ndarray
    far: dict[int, int]


def assign(x: np.ndarray, centroids: list[list[int]], scale: int = SCALE) -> Assigned:
    """Nearest centroid of each row, ties to the smaller number."""
    dims = x.shape[1]
    with np.errstate(over="ignore"):
        grid = np.floor(x * scale)  # a power of two: exact unless it overflows
        most = np.abs(grid).max(1) + (float(max(abs(c) for row in centroids for c in row)) if _fits(centroids) else math.inf)
        bound = dims * most * most
    exact, in_long = bound < IN_DOUBLE, (bound >= IN_DOUBLE) & (bound < IN_LONG)
    cluster, distance, far = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), {}
    if exact.any():
        own, c = grid[exact], np.array(centroids, np.float64)
        d = (own * own).sum(1)[:, None] - 2 * (own @ c.T) + (c * c).sum(1)
        cluster[exact], distance[exact] = d.argmin(1), d.min(1).astype(np.int64)
    if in_long.any():
        at, c = np.nonzero(in_long)[0], np.array(centroids, np.int64)
        for part in np.array_split(at, -(-len(at) // 64)):
            gap = grid[part].astype(np.int64)[:, None, :] - c
            d = (gap * gap).sum(2)
            cluster[part] = d.argmin(1)
            far |= zip(part.tolist(), d.min(1).tolist(), strict=True)
    for i in np.nonzero(~exact & ~in_long)[0].tolist():
        own = [whole(v, scale) for v in x[i].tolist()]
        d = [sum((p - q) ** 2 for p, q in zip(own, c, strict=True)) for c in centroids]
        far[i] = min(d)
        cluster[i] = d.index(far[i])
    return Assigned(cluster, exact, grid, distance, far)


def _fits(centroids: list[list[int]]) -> bool:
    return all(abs(c) < 1 << 53 for row in centroids for c in row)


@dataclass
class Sums:
    """Of each cluster: vectors, sums of components, summed distance; all unbounded integers."""

    count: list[int]
    total: list[list[int]]
    distance: list[int]

    @staticmethod
    def none(k: int, dims: int) -> Sums:
        return Sums([0] * k, [[0] * dims for _ in range(k)], [0] * k)

    def add(self, other: Sums) -> Sums:
        plus = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
        return Sums(plus(self.count, other.count), [plus(a, b) for a, b in zip(self.total, other.total, strict=True)], plus(self.distance, other.distance))


def summed(x: np.ndarray, centroids: list[list[int]], scale: int) -> Sums:
    """One block's sums."""
    k = len(centroids)
    found = assign(x, centroids, scale)
    own, d = found.cluster[found.exact], found.distance[found.exact]
    member = (own[:, None] == np.arange(k)).astype(np.float64)
    total = (member.T @ found.grid[found.exact]).astype(np.int64).tolist()  # BLOCK components of under 2^26: whole in a double
    high, low = (np.bincount(own, weights=w, minlength=k).astype(np.int64).tolist() for w in (d >> 26, d & ((1 << 26) - 1)))
    out = Sums(np.bincount(found.cluster, minlength=k).tolist(), total, [(h << 26) + v for h, v in zip(high, low, strict=True)])
    for i, v in found.far.items():
        c = found.cluster[i]
        out.total[c] = [a + whole(b, scale) for a, b in zip(out.total[c], x[i].tolist(), strict=True)]
        out.distance[c] += v
    return out


def gathered(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> Sums:
    """Sums over all vectors: a row for each partition, combined level by level."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums.none(len(centroids), dims)
        for batch in batches:
            for _, x in blocks(batch, dims):
                sums = sums.add(summed(x, centroids, scale))
        yield pa.RecordBatch.from_pydict({"sums": [pickle.dumps(sums)]})

    rows = vectors.mapInArrow(part, "sums binary").rdd.map(lambda r: pickle.loads(r["sums"]))
    return rows.treeAggregate(Sums.none(len(centroids), dims), Sums.add, Sums.add)


def cluster(df: DataFrame, key: str = "vec_id", vec: str = "embedding", dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """key, cluster int, distance, cluster_inertia, inertia long, centroid_sha256 of each vector that takes part.

    Centroids start as the k vectors with the smallest SHA-256 of `seed:key`
    (equal keys: the smaller vector), fewer where there are fewer. A round
    assigns all vectors and moves every centroid that has any to the floor of
    their mean; after the last one vectors are assigned once more.

    Vectors that are null, of another length or hold a null or non-finite
    component have no row. A null key hashes as an empty one; repeated rows are
    vectors each. A distance or inertia that 64 bits can't hold is null, which
    changes no assignment. An empty table gives no row; other columns, whatever
    their names, are not read.
    """
    own = "float" if dict(df.dtypes)[vec] == "array<float>" else "double"
    vectors = df.select(F.col(key).alias("key"), F.col(vec).cast(f"array<{own}>").alias("vec")).where(usable("vec", dims))
    vectors = materialised(vectors)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    centroids = [[whole(x, scale) for x in r["vec"]] for r in vectors.orderBy(draw, "vec").limit(k).collect()]  # k rows
    kind = df.schema[key].dataType.simpleString()
    made = f"`key` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return df.sparkSession.createDataFrame([], made).withColumnRenamed("key", key)
    for _ in range(rounds):
        sums = gathered(vectors, centroids, dims, scale)
        centroids = [[t // n for t in total] if n else c for n, total, c in zip(sums.count, sums.total, centroids, strict=True)]
    inertia = gathered(vectors, centroids, dims, scale).distance
    fits = lambda v: v if v <= LARGEST else None
    own_inertia, all_inertia = [fits(v) for v in inertia], fits(sum(inertia))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in blocks(batch, dims):
                found = assign(x, centroids, scale)
                of, distance = found.cluster.tolist(), found.distance.tolist()
                for i, v in found.far.items():
                    distance[i] = fits(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows],
                        pa.array(found.cluster, pa.int32()),
                        pa.array(distance, pa.int64()),
                        pa.array([own_inertia[c] for c in of], pa.int64()),
                        pa.array([all_inertia] * len(of), pa.int64()),
                        pa.array([digests[c] for c in of], pa.string()),
                    ],
                    ["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return vectors.mapInArrow(last, made).withColumnRenamed("key", key)


def oracle_sql(dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in DuckDB's SQL over `embeddings`, for vectors whose squared distances fit 64 bits."""
    d = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    assigned = lambda r: f"SELECT v.row, arg_min(c.cluster, ({d}, c.cluster)) AS cluster, CAST(min({d}) AS BIGINT) AS distance FROM v, c{r} c GROUP BY v.row"
    floored = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = [
        f"v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS cluster, x FROM v QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) <= {k})",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS ({assigned(r)})",
            f"m{r} AS (SELECT cluster, list({floored} ORDER BY i) AS x FROM (SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(range(1, {dims + 1})) AS i, unnest(v.x) AS e FROM a{r} a JOIN v USING (row)) GROUP BY ALL) GROUP BY cluster)",
            f"c{r + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))",
        ]
    steps += [f"f AS ({assigned(rounds)})", "t AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM f GROUP BY cluster)"]
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(f.cluster AS INTEGER) AS cluster, f.distance, t.cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM f) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN v USING (row) JOIN t USING (cluster) JOIN c{rounds} c USING (cluster)"""
