"""Centroid clustering by Exponion search: exact k-means on whole numbers.

Vectors are turned into integers, so every distance, sum and mean is exact and a result does not depend on the order
of tasks. Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance
to any other. When centroids have moved, both bounds move by what the centroids moved:

1. a vector whose upper bound is below its lower bound, or below half the distance from its centroid to the nearest
   other one, keeps its centroid; so does one that passes once its upper bound is made exact;
2. any other scans only the centroids in the ball around its centroid whose radius is twice that distance plus
   the distance from its centroid to the nearest other one. Each centroid's list of the others, sorted by
   distance, tells which these are: a prefix of the list. The two nearest centroids are in it, and as the radius is
   inclusive, so are those of a tie, which the smaller number wins.

Bounds are doubles, made wider by ``SLACK`` than rounding can be; squared distances are integers. A round is one pass over
the vectors with their bounds, a table in the shared folder, so a lost executor's part is read again. Centroids (k of
them, k is a parameter) are all that goes to the tasks, and k rows of sums all that comes back.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; rows
of one id, and repeated rows, are vectors of their own; a row without an id is clustered but never a start, and ties
between equal start hashes go by the vector; with fewer vectors than centroids each vector is a start; an
empty table gives an empty result; other columns are not read. Integers of any size are exact; a squared distance or
sum of them beyond 2**63 - 1 is given as that number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import discard, stored, table

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
#: Relative and absolute widening of bounds.
SLACK = 1e-9
#: Components up to this size have squared distances of up to 2**12 components in 64 bits.
SMALL = 2**24
LIMB = 40
MOST = 2**63 - 1
STATE = "vec_id bigint, q array<double>, cluster int, upper double, lower double, distance bigint"


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """vec_id, q: the components of the vectors that are kept; integers() makes whole numbers of them."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("v") == components) & F.coalesce(sound, F.lit(False))).select("vec_id", F.col("v").alias("q"))


def integers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component x, exact as scale is a power of two: 64-bit integers if all are small, else Python's."""
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * scale)
    if not np.isfinite(found).all():
        # scaled beyond the largest double
        return np.array([[int(x) * int(scale) for x in row] for row in column.to_pylist()], dtype=object)
    if np.abs(found).max(initial=0) <= SMALL:
        return found.astype(np.int64)
    return np.array([[int(x) for x in row] for row in found], dtype=object)


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid, exact."""
    out = np.empty((len(q), len(centroids)), np.result_type(q, centroids))
    for j, c in enumerate(centroids):
        apart = q - c
        out[:, j] = (apart * apart).sum(axis=1)
    return out


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


class Neighbours:
    """Distances between centroids: for each the others sorted by distance, and the way each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        apart = _root(squared(centroids, centroids))
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1) * (1 + SLACK)
        own = apart + np.diag(np.full(k, np.inf))
        self.nearest = own.min(axis=1)
        self.moved = np.zeros(k) if before is None else _root(((centroids - before) ** 2).sum(axis=1)) * (1 + SLACK)
        top = np.argsort(-self.moved, kind="stable")[:2]
        # the furthest that any other centroid has moved
        self.others = np.where(np.arange(k) == top[0], self.moved[top[-1]] if k > 1 else 0.0, self.moved[top[0]])


def nearest_two(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first nearest centroid of each row, its squared distance and the second distance (infinite with one centroid)."""
    best = np.argmin(d, axis=1)
    rows = np.arange(len(d))
    low = d[rows, best]
    if d.shape[1] == 1:
        return best, low, np.full(len(d), np.inf)
    rest = d.astype(np.float64)
    rest[rows, best] = np.inf
    return best, low, np.sqrt(rest.min(axis=1))


def assigned(q: np.ndarray, centroids: np.ndarray, near: Neighbours | None, a: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The new cluster, upper and lower bound of each row, and how many distances were measured. a is -1 for rows never assigned.

    Without near, or for integers too large for doubles, every distance is measured and the bounds tell nothing.
    """
    if near is None or q.dtype == object:
        return np.argmin(squared(q, centroids), axis=1), np.full(len(q), np.inf), np.zeros(len(q)), q.shape[0] * len(centroids)
    a, upper, lower = a.copy(), upper.copy(), lower.copy()
    measured = 0
    new = np.flatnonzero(a < 0)
    if len(new):
        best, low, second = nearest_two(squared(q[new], centroids))
        a[new], upper[new], lower[new] = best, _root(low) * (1 + SLACK), second * (1 - SLACK)
        measured += len(new) * len(centroids)
    old = np.setdiff1d(np.arange(len(q)), new, assume_unique=True)
    upper[old] += near.moved[a[old]]
    lower[old] -= near.others[a[old]]
    bound = np.maximum(lower, near.nearest[a] / 2 * (1 - SLACK))
    open_ = old[upper[old] >= bound[old]]
    if len(open_):
        apart = q[open_] - centroids[a[open_]]
        upper[open_] = _root((apart * apart).sum(axis=1)) * (1 + SLACK)
        measured += len(open_)
        open_ = open_[upper[open_] >= bound[open_]]
    for c in np.unique(a[open_]):
        rows = open_[a[open_] == c]
        ball = np.searchsorted(near.sorted[c], (2 * upper[rows] + near.nearest[c]) * (1 + 3 * SLACK), "right")
        # rows that scan about as many centroids go together
        steps = np.minimum(2 ** np.ceil(np.log2(ball)).astype(int), len(centroids))
        for n in np.unique(steps):
            some = rows[steps == n]
            own = np.sort(near.order[c][:n])
            best, low, second = nearest_two(squared(q[some], centroids[own]))
            a[some], upper[some], lower[some] = own[best], _root(low) * (1 + SLACK), second * (1 - SLACK)
            measured += len(some) * n
    return a, upper, lower, measured


def _distance(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centroid of the same row."""
    apart = q - centroids
    return (apart * apart).sum(axis=1)


def _pass(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, scale: int, last: bool) -> DataFrame:
    """Every vector with its cluster and bounds for these centroids; with last also its squared distance."""
    # bounds are doubles: where numbers are too large for them to be safe, all distances are measured
    near = None if object in (centroids.dtype, before is not None and before.dtype) else Neighbours(centroids, before)
    first = "cluster" not in rows.columns
    width = centroids.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = integers(batch.column("q"), width, scale)
            at = lambda name, empty, kind: np.full(len(q), empty, kind) if first else batch.column(name).to_numpy(zero_copy_only=False).astype(kind)  # noqa: E731, B023
            a, upper, lower, _ = assigned(q, centroids, near, at("cluster", -1, np.int64), at("upper", 0.0, float), at("lower", 0.0, float))
            found = pa.array([min(int(x), MOST) for x in _distance(q, centroids[a])] if last else [None] * len(q), pa.int64())
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), found]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "cluster", "upper", "lower", "distance"])

    return rows.mapInArrow(run, STATE)


def _sums(rows: DataFrame, k: int, width: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, exact sums of components): partial sums of each task, then k rows (of each limb) to the driver."""
    mask = (1 << LIMB) - 1

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            if batch.num_rows:
                q, a = integers(batch.column("q"), width, scale), batch.column("cluster").to_numpy()
                for c in np.unique(a):
                    n[c] += int((a == c).sum())
                    total[c] += q[a == c].sum(axis=0).astype(object)
        out = []
        for c in np.flatnonzero(n):
            # sums in parts of 40 bits, the last with the sign, so that parts of all tasks add up in decimals
            left, limb = [int(x) for x in total[c]], 0
            while limb == 0 or any(left):
                small = all(abs(x) <= mask for x in left)
                out.append((int(c), limb, int(n[c]) if limb == 0 else 0, left if small else [x & mask for x in left]))
                left, limb = ([0] * width if small else [x >> LIMB for x in left]), limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())], strict=True)], names=["cluster", "limb", "n", "sums"])

    parts = rows.select("q", "cluster").mapInArrow(run, "cluster int, limb int, n bigint, sums array<bigint>")
    summed = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():
        n, total = found.get(r.cluster, (0, [0] * width))
        found[r.cluster] = (n + r.n, [x + (int(r[f"s{i}"]) << LIMB * r.limb) for i, x in enumerate(total)])
    return found


def _matrix(rows: Sequence[Sequence[int]], width: int) -> np.ndarray:
    small = all(abs(x) <= SMALL for row in rows for x in row)
    return np.array(rows, np.int64 if small else object).reshape(-1, width)


def starts(rows: DataFrame, k: int, width: int, scale: int, salt: str = "1") -> np.ndarray:
    """The k vectors whose salted ids have the smallest hashes, in that order."""
    named = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    picked = named.orderBy("h", "q").limit(k).collect()
    return _matrix([[int(x) for x in row] for r in picked for row in integers(pa.array([r.q], pa.list_(pa.float64())), width, scale)], width)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each vector; the centroids, one a row). scale is a power of two."""
    spark, scratch = vectors.sparkSession, []
    rows = kept_vectors(vectors, id_col, vector_col, components, scale)
    centroids, before = starts(rows, k, components, scale), None
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        done, scratch = scratch, []
        rows = stored(_pass(rows, centroids, before, scale, False), scratch)
        discard(spark, done)
        sums = _sums(rows, len(centroids), components, scale)
        means = [[x // sums[c][0] for x in sums[c][1]] if c in sums else [int(x) for x in centroids[c]] for c in range(len(centroids))]
        before, centroids = centroids, _matrix(means, components)
    done, scratch = scratch, []
    found = stored(_pass(rows, centroids, before, scale, True).select("vec_id", "cluster", "distance"), scratch)
    discard(spark, done)
    return found, centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: its cluster, squared distance, the inertia of its cluster and of all, and its centroid's hash."""
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    every = sum(int(r.s) for r in sums)
    named = [(r.cluster, min(int(r.s), MOST), min(every, MOST), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row for each centroid, k at most
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"d{i} as (select v.r, v.vec_id, v.q, c.n, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as dist from v cross join c{i} c)")
        steps.append(f"a{i} as (select r, vec_id, q, n, dist from d{i} qualify row_number() over (partition by r order by dist, n) = 1)")
        if i < rounds:
            steps.append(f"m{i} as (select n, list(m order by i) as q from (select n, i, floor(sum(x)::double / count(*))::bigint as m from (select n, unnest(q) as x, unnest(range(len(q))) as i from a{i}) group by n, i) group by n)")
            steps.append(f"c{i + 1} as (select c.n, coalesce(m.q, c.q) as q from c{i} c left join m{i} m on m.n = c.n)")
    return f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q
  from embeddings where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as n, q from v order by sha256('1:' || vec_id) limit {CENTROIDS}
), {", ".join(steps)}
select vec_id, n::integer as cluster, dist as distance, sum(dist) over (partition by n)::bigint as cluster_inertia, sum(dist) over ()::bigint as inertia,
       sha256(array_to_string((select q from c{rounds} c where c.n = a{rounds}.n), ',')) as centroid_sha256
from a{rounds}
"""


ORACLE = _oracle()
