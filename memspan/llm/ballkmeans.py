"""Centroid clustering by ball k-means over integer vectors.

A cluster is a ball: its centroid, and as radius the distance of its farthest member. A
centroid can only win a member ``x`` of ball ``i`` if it lies within twice the distance of
``x`` from its own centroid, so only centroids within twice the radius are neighbours of the
ball, sorted by their distance. That distance splits the ball: members nearer to the centroid
than half way to the nearest neighbour are its stable core and are compared with nothing;
members of the ``a``-th annulus are compared with the first ``a`` neighbours. A ball that
has not moved, nor any of its neighbours, keeps all members without a look at them.

Everything is exact: components are integers, distances are squared, and radii are upper
bounds in integers, so equal distances are seen as equal and go to the smaller number.

The driver holds the centroids alone (``k`` times ``dims`` integers, both parameters) and, of
each round, a row of sums for each cluster. Vectors stay where their rows lie: a round is a
pass over them that writes a table in the shared folder, and a sum with partial sums in each
task, so a cluster of a third of all rows is no hot key.

Defined cases: vectors that are null, have another number of components, or hold a null or
non-finite one are left out; so are those with a component so large that four times a
squared distance would not fit in 64 bits (of 64 components: integers of 2**26 and more).
First centroids are rows with an id, in the order of a hash of it, of equal ids in that of
their vectors; if there are fewer than ``k`` rows, each is one. Rows that repeat an id or a
vector count each; of equal centroids the smaller number takes all. Sums over 64 bits are
null. An empty table gives no rows and no centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspan.sources.tables import discard, fresh_path, written

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1


@dataclass
class Balls:
    """Centroids, of each its neighbours by distance, and whether it moved, or it and all its neighbours rested, since the last assignment."""

    centers: np.ndarray
    near: list[np.ndarray]
    reach: list[np.ndarray]
    moved: np.ndarray
    still: np.ndarray


@dataclass
class Clusters:
    """Rows ``id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, and the final centroids."""

    rows: DataFrame
    centroids: list[list[int]]


def balls(centers: Sequence[Sequence[int]], farthest: Sequence[int], before: Sequence[Sequence[int]]) -> Balls:
    """Balls of centroids, from the largest squared distance of a member to the centroid ``before`` (under 0: no member)."""
    at, was = np.array(centers, np.int64), np.array(before, np.int64)
    between = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    shift = ((at - was) ** 2).sum(axis=1)
    near, reach = [], []
    for i, most in enumerate(farthest):
        # An upper bound of the radius after the centroid's step, in whole numbers.
        radius = 0 if most < 0 else math.isqrt(int(most)) + 1 + (math.isqrt(int(shift[i])) + 1 if shift[i] else 0)
        others = [j for j in range(len(at)) if j != i and most >= 0 and int(between[i, j]) <= 4 * radius * radius]
        others.sort(key=lambda j: (between[i, j], j))
        near.append(np.array(others, np.int64))
        reach.append(between[i, near[-1]])
    moved = shift > 0
    return Balls(at, near, reach, moved, np.array([not moved[i] and not moved[near[i]].any() for i in range(len(at))], bool))


def _squares(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    apart = points - center
    return np.einsum("ij,ij->i", apart, apart)


def first_labels(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point, of equal ones the smaller number, and its squared distance."""
    label, best = np.zeros(len(points), np.int64), _squares(points, centers[0])
    for j in range(1, len(centers)):
        d = _squares(points, centers[j])
        won = d < best
        label[won], best[won] = j, d[won]
    return label, best


def next_labels(points: np.ndarray, label: np.ndarray, dist: np.ndarray, of: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """Labels and squared distances after centroids have moved, and how many distances were computed."""
    new, best, looked = label.copy(), dist.copy(), 0
    for i in np.unique(label):
        if of.still[i]:
            continue
        mine = np.flatnonzero(label == i)
        if of.moved[i]:
            best[mine] = _squares(points[mine], of.centers[i])
            looked += len(mine)
        own = best[mine]
        # The annulus: how many neighbours lie within twice a member's distance; none for the stable core.
        annulus = np.searchsorted(of.reach[i], 4 * own, side="right")
        for a, j in enumerate(of.near[i]):
            ring = mine[annulus > a]
            if not len(ring):
                break
            d = _squares(points[ring], of.centers[j])
            looked += len(ring)
            won = (d < best[ring]) | ((d == best[ring]) & (j < new[ring]))
            new[ring[won]], best[ring[won]] = j, d[won]
    return new, best, looked


def _assigner(dims: int, of: Balls | np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            if isinstance(of, Balls):
                label, dist, _ = next_labels(points, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), of)
            else:
                label, dist = first_labels(points, of)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label.astype(np.int32)), pa.array(dist)], names=["id", "v", "label", "dist"])

    return run


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``id, v``: sound vectors as integers, each component times ``scale`` rounded down."""
    vector = F.col(f"`{vec_col}`")
    bound = float(1 << ((60 - (dims - 1).bit_length()) // 2 - 1))
    scaled = lambda x: F.floor(x.cast("double") * scale)
    sound = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < bound, F.lit(False))  # noqa: E731  NaN is above all numbers
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("x")).where((F.size("x") == dims) & F.forall("x", sound))
    return rows.select("id", F.transform("x", lambda x: scaled(x).cast("int")).alias("v"))


def _long(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None


def ball_kmeans(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> Clusters:
    """Clusters after ``rounds`` rounds of assignment and update, and a last assignment."""
    spark = df.sparkSession
    points = whole_vectors(df, id_col, vec_col, dims, scale)
    hashed: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    seeds = [row["v"] for row in points.where(F.col("id").isNotNull()).orderBy(hashed, "v").limit(k).select("v").collect()]  # k rows
    kind = points.schema["id"].dataType.simpleString()
    shape = f"id {kind}, v array<int>, label int, dist bigint"
    told = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not seeds:
        none = spark.createDataFrame([], f"id {kind}, cluster int, distance bigint, {told.split(', ', 1)[1]}")
        return Clusters(none, [])
    centers, of = seeds, np.array(seeds, np.int64)
    table, path = points, None
    for turn in range(rounds + 1):
        to = fresh_path(spark)
        table = written(table.mapInArrow(_assigner(dims, of), shape), to)
        if path:
            discard(spark, path)
        path = to
        if turn < rounds:
            sums = F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(dims)))
            found = table.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"), sums.alias("sums")).collect()  # a row for each cluster
            farthest, before = [-1] * len(centers), centers
            centers = [list(c) for c in centers]
            for row in found:
                farthest[row["label"]] = row["far"]
                centers[row["label"]] = [s // row["n"] for s in row["sums"]]
            of = balls(centers, farthest, before)
    spread = {row["label"]: int(row["s"]) for row in table.groupBy("label").agg(F.sum(F.col("dist").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(spread.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    facts = spark.createDataFrame([(i, _long(spread.get(i, 0)), _long(whole), digest[i]) for i in range(len(centers))], told)
    rows = table.select("id", F.col("label").alias("cluster"), F.col("dist").alias("distance")).join(F.broadcast(facts), "cluster")
    return Clusters(rows.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), [list(map(int, c)) for c in centers])
