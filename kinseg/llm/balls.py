"""Centroid clustering of vectors in exact whole numbers, by ball k-means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import forget, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components stay below this in size, so that a squared distance over 64 of them fits a long.
LARGEST = 1 << 27
STATE = "vec_id long, v array<int>, cluster int, distance long, n long, sums array<long>, far long, inertia decimal(38,0)"


@dataclass
class Ball:
    """A cluster: its centroid, how many it holds, and a radius that no member lies beyond (None: not known)."""

    centroid: list[int]
    n: int = 0
    radius: int | None = None


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def root_above(x: int) -> int:
    """The smallest whole number whose square is x or more."""
    return isqrt(x - 1) + 1 if x else 0


def neighbours(balls: list[Ball]) -> list[list[tuple[int, int]]]:
    """For each ball [(bound, other)] in ascending order: members at a squared distance of bound or more may lie as near to the other.

    A member at distance d from its centroid is at least D - d from one that is D
    away, so it is nearer to its own while 2 d < D. Others that this holds for up to the radius are no neighbours.
    """
    out = []
    for i, ball in enumerate(balls):
        apart = sorted((squared(ball.centroid, other.centroid), j) for j, other in enumerate(balls) if j != i)
        out.append([(-(-d // 4), j) for d, j in apart if ball.radius is None or d <= 4 * ball.radius**2])
    return out


def reassigned(v: np.ndarray, own: np.ndarray, centroids: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each vector, exactly; ties go to the smaller number.

    Only a ball's annuli are compared, the m-th one with the m nearest neighbours; the stable core inside them is not.
    """
    best, distance = own.copy(), ((v - centroids[own]) ** 2).sum(axis=1)
    start = distance.copy()
    for i, others in enumerate(near):
        rest = np.flatnonzero(own == i)
        for bound, j in others:
            rest = rest[start[rest] >= bound]
            if not rest.size:
                break
            far = ((v[rest] - centroids[j]) ** 2).sum(axis=1)
            better = (far < distance[rest]) | ((far == distance[rest]) & (j < best[rest]))
            best[rest[better]], distance[rest[better]] = j, far[better]
    return best, distance


def whole_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of so many finite components, each as floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dimensions))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)
            good = np.isfinite(x).all(axis=1)
            v = np.floor(scale * x[good])
            if (np.abs(v) >= LARGEST).any():
                raise ValueError(f"a component times {scale} reaches {LARGEST}; distances would not fit")
            offsets = np.arange(0, v.size + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, v.astype(np.int32).ravel())], ["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("embedding is not null")
    return rows.mapInArrow(run, "vec_id long, v array<int>")


def assigned(state: DataFrame, balls: list[Ball]) -> DataFrame:
    """STATE: one row per vector with its nearest centroid, and at the end of each task a row per cluster with what it adds up to."""
    centroids, near = np.array([b.centroid for b in balls], np.int64), neighbours(balls)
    dimensions, k = centroids.shape[1], len(balls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, far, inertia = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), [0] * k
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, dimensions).astype(np.int64)
            best, distance = reassigned(v, batch.column(2).to_numpy().astype(np.int64), centroids, near)
            for i in range(k):
                members = best == i
                if members.any():
                    sums[i] += v[members].sum(axis=0)
                    n[i] += members.sum()
                    far[i] = max(far[i], distance[members].max())
                    inertia[i] += sum(distance[members].tolist())
            rows = len(best)
            empty = [pa.nulls(rows, kind) for kind in (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.decimal128(38))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(distance), *empty], NAMES)
        offsets = np.arange(0, k * dimensions + 1, dimensions, dtype=np.int32)
        totals = [pa.array(n), pa.ListArray.from_arrays(offsets, sums.ravel()), pa.array(far), pa.array(inertia, pa.decimal128(38))]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)), pa.nulls(k, pa.int64()), *totals], NAMES)

    return state.filter("n is null").select("vec_id", "v", "cluster").mapInArrow(run, STATE)


NAMES = [f.split()[0] for f in STATE.split(", ")]


def moved(state: DataFrame, balls: list[Ball]) -> list[Ball]:
    """The balls of the next round: centroids at the means of their members, empty ones as they were.

    A ball's radius grows by no more than its centroid moves. k rows of totals and k times as many
    sums as there are components reach the driver.
    """
    totals = state.filter("n > 0")
    of = {r.cluster: r for r in totals.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}
    parts = totals.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x"))
    sums = {(r.cluster, r.at): r.x for r in parts.collect()}
    out = []
    for i, ball in enumerate(balls):
        n = of[i].n if i in of else 0
        if not n:
            out.append(Ball(ball.centroid, 0, 0))
            continue
        centroid = [sums[i, at] // n for at in range(len(ball.centroid))]
        out.append(Ball(centroid, n, root_above(of[i].far) + root_above(squared(centroid, ball.centroid))))
    return out


def ball_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    vectors: vec_id and embedding. Kept are those of exactly `dimensions` components, all finite, each
    taken as floor(scale * x). The k centroids start at the kept vectors whose `seed:vec_id` hashes lowest. A
    round assigns every vector and then moves each centroid to the floor of its members' mean; a last
    assignment follows. All of it is exact, so ties and results do not depend on partitions.

    Each round is one pass without a shuffle: tasks read vectors with their
    clusters and write them again to the shared folder, with one row of totals per cluster.

    Null, short, long and non-finite vectors give no row. Repeated rows count as
    often as they come; a null id hashes as an empty one. With fewer than k kept vectors there are fewer
    centroids; an empty table gives no rows. Other columns are ignored. A component of 2**27 or more after scaling is an error.
    """
    spark = vectors.sparkSession
    state = written(whole_vectors(vectors, dimensions, scale).select("*", F.lit(0).alias("cluster"), F.lit(None).cast("long").alias("n")), "balls")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    balls = [Ball(list(r.v)) for r in state.orderBy(name, "v").limit(k).select("v").collect()]
    if not balls:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for at in range(rounds + 1):
        balls = moved(state, balls) if at else balls
        state, before = written(assigned(state, balls), "balls"), state
        forget(before)
    inertia = {r.cluster: int(r.x) for r in state.filter("n > 0").groupBy("cluster").agg(F.sum("inertia").alias("x")).collect()}
    digest = lambda ball: sha256(",".join(map(str, ball.centroid)).encode()).hexdigest()
    rows = [(i, x, sum(inertia.values()), digest(balls[i])) for i, x in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.filter("n is null").drop("inertia").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
