"""Exact centroid clustering with heap-ordered bounds.

Vectors lie in blocks of bounded size, written once and dealt to buckets by
block.  Beside every block a narrow state is kept: for each cluster a binary
heap of its vectors, ordered by the gap between a lower bound on the distance to
any other centroid and an upper bound on the distance to their own.  When
centroids move, the gap of a vector shrinks by at most the drift of its own
centroid plus the largest drift of another one.  That sum is accumulated once
per cluster, and a vector enters the heap with its gap plus the sum so far, so
no round touches the entries of vectors whose gap is still open: the top of a
heap is compared with the accumulated drift, and only what has expired is
popped, measured against all centroids exactly and pushed into a heap again.

Vectors that change clusters are all that a round adds up, as whole numbers, so
centroids do not depend on the order of tasks.  Only centroids, drifts and
those sums (clusters times width) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.sources.staging import bucketed, staged

BLOCK = 2048
SCALE = 256
SLACK = 1e-9  # gaps are given up a little early, never late
# Up to here float products and their sums over the width are exact whole numbers.
EXACT_IN_DOUBLES = 1 << 53
LARGEST = 1 << 27

Heap = list[tuple[float, int]]


@dataclass
class Clustering:
    """Blocks of vectors, their state after the last round, and the centroids."""

    vectors: DataFrame
    state: DataFrame
    centroids: np.ndarray
    rescanned: list[int] = field(default_factory=list)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as whole numbers."""
    scaled = np.floor(np.asarray(values, np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} have no exact distance in 64 bits")
    return scaled.astype(np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, as doubles where those are exact."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < EXACT_IN_DOUBLES:
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
        own = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centroids, centroids)
        return own - 2 * (x @ centroids.T)
    out = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        difference = x - centroid
        out[:, c] = np.einsum("ij,ij->i", difference, difference)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and the open gap to any other one."""
    distances = squared_distances(x, centroids)
    best, rows = distances.argmin(axis=1), np.arange(len(x))
    upper = np.sqrt(distances[rows, best].astype(np.float64))
    others = distances.astype(np.float64)
    others[rows, best] = np.inf
    lower = np.sqrt(others.min(axis=1))
    return best, lower - upper - SLACK * np.where(np.isinf(lower), 0, lower + upper + 1)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Per cluster: how far its own centroid moved, plus the farthest move of another one."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
    if len(moved) < 2:
        return moved
    first, second = np.sort(moved)[::-1][:2]
    return moved + np.where(np.arange(len(moved)) == moved.argmax(), second, first)


def put(block: int, heaps: list[Heap], delta: np.ndarray, rescanned: int) -> pd.DataFrame:
    entries = [entry for heap in heaps for entry in heap]
    return pd.DataFrame({
        "block": [block],
        "sizes": [np.array([len(h) for h in heaps], np.int32).tobytes()],
        "gaps": [np.array([e[0] for e in entries], np.float64).tobytes()],
        "places": [np.array([e[1] for e in entries], np.int32).tobytes()],
        "delta": [delta.ravel()], "rescanned": [rescanned],
    })


def heaps_of(state: pd.DataFrame) -> list[Heap]:
    row = state.iloc[0]
    ends = np.frombuffer(row["sizes"], np.int32).cumsum().tolist()
    entries = list(zip(
        np.frombuffer(row["gaps"], np.float64).tolist(), np.frombuffer(row["places"], np.int32).tolist()
    ))
    return [entries[start:end] for start, end in zip([0, *ends], ends)]


def vectors_of(block: pd.DataFrame, width: int) -> np.ndarray:
    return np.frombuffer(block["x"].iloc[0], np.int32).reshape(-1, width).astype(np.int64)


def add(delta: np.ndarray, cluster: int, x: np.ndarray, sign: int) -> None:
    delta[cluster, 0] += sign * len(x)
    delta[cluster, 1:] += sign * x.sum(axis=0)


def first_state(block: pd.DataFrame, centroids: np.ndarray) -> pd.DataFrame:
    """All vectors are measured, and every cluster's heap is built."""
    x = vectors_of(block, centroids.shape[1])
    best, gap = nearest(x, centroids)
    delta = np.zeros((len(centroids), 1 + x.shape[1]), np.int64)
    heaps = []
    for c in range(len(centroids)):
        here = np.flatnonzero(best == c)
        heap = list(zip(gap[here].tolist(), here.tolist()))
        heapify(heap)
        heaps.append(heap)
        add(delta, c, x[here], 1)
    return put(int(block["block"].iloc[0]), heaps, delta, len(x))


def next_state(
    block: pd.DataFrame, state: pd.DataFrame, centroids: np.ndarray, drifted: np.ndarray
) -> pd.DataFrame:
    """Only expired vectors are popped, measured and pushed again."""
    heaps = heaps_of(state)
    popped: list[int] = []
    was: list[int] = []
    for c, heap in enumerate(heaps):
        while heap and heap[0][0] <= drifted[c]:
            popped.append(heappop(heap)[1])
            was.append(c)
    x = vectors_of(block, centroids.shape[1])[popped]
    best, gap = nearest(x, centroids)
    delta = np.zeros((len(centroids), 1 + x.shape[1]), np.int64)
    for place, c, key in zip(popped, best.tolist(), (gap + drifted[best]).tolist()):
        heappush(heaps[c], (key, place))
    old = np.array(was, np.int64)
    for c in np.unique(np.concatenate([old, best])[np.tile(old != best, 2)]).tolist():
        add(delta, c, x[(old == c) & (best != c)], -1)
        add(delta, c, x[(old != c) & (best == c)], 1)
    return put(int(block["block"].iloc[0]), heaps, delta, len(popped))


def members(block: pd.DataFrame, state: pd.DataFrame, centroids: np.ndarray) -> pd.DataFrame:
    """(id, cluster, distance) of a block's vectors."""
    x = vectors_of(block, centroids.shape[1])
    cluster = np.zeros(len(x), np.int32)
    for c, heap in enumerate(heaps_of(state)):
        cluster[[place for _, place in heap]] = c
    away = x - centroids[cluster]
    ids = np.frombuffer(block["ids"].iloc[0], np.int64)
    known = np.frombuffer(block["known"].iloc[0], np.bool_)
    return pd.DataFrame({
        "id": pd.Series(ids, dtype="Int64").where(known), "cluster": cluster,
        "distance": np.einsum("ij,ij->i", away, away),
    })


def _blocks(rows: DataFrame, scale: int, block: int) -> DataFrame:
    """Blocks of at most ``block`` vectors; a task packs the rows that it reads."""

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for part in batches:
            for at in range(0, len(part), block):
                some = part.iloc[at:at + block]
                x = whole(np.stack(some["embedding"].to_numpy()), scale)
                yield pd.DataFrame({
                    "block": [number],
                    "ids": [some["id"].fillna(0).to_numpy(np.int64).tobytes()],
                    "known": [some["id"].notna().to_numpy(np.bool_).tobytes()],
                    "x": [x.astype(np.int32).tobytes()],
                })
                number += 1

    return bucketed(
        rows.mapInPandas(pack, "block long, ids binary, known binary, x binary"), "vectors", "block"
    )


STATE = "block long, sizes binary, gaps binary, places binary, delta array<long>, rescanned long"


def _starting(centroids: np.ndarray) -> Callable:
    return lambda block: first_state(block, centroids)


def _moving(centroids: np.ndarray, drifted: np.ndarray) -> Callable:
    return lambda block, state: next_state(block, state, centroids, drifted)


def _change(state: DataFrame, shape: tuple[int, int]) -> tuple[np.ndarray, int]:
    """What a round adds to the clusters' counts and sums, and how many vectors it measured."""
    out = np.zeros(shape, object)
    sums = state.select(F.posexplode("delta").alias("place", "d")).where("d != 0").groupBy("place").agg(
        F.sum("d").alias("d")
    )
    for row in sums.collect():  # clusters times (1 + width) rows at most
        out[divmod(row["place"], shape[1])] = row["d"]
    return out, state.agg(F.sum("rescanned")).first()[0] or 0


def cluster_vectors(
    table: DataFrame, clusters: int, rounds: int, start: Callable[[Column], Column],
    width: int, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, block: int = BLOCK,
) -> Clustering | None:
    """Assign and move ``rounds`` times, then assign once more; None without any vector.

    ``start`` orders the vectors by their id; the first ``clusters`` of them are
    the centroids to begin with.  Rows count whose vector has ``width``
    components, none null or non-finite.  Repeated rows are vectors of their own;
    a row without id is a vector, and comes last in the starting order.
    Components whose squared distances 64 bits do not hold (beyond 2**27 when
    scaled) raise.
    """
    finite = F.forall(
        column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    rows = table.where((F.size(column) == width) & finite).select(
        F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("embedding")
    )
    first = rows.orderBy(F.col("id").isNull(), start(F.col("id")), "id", "embedding").limit(clusters).collect()
    if not first:
        return None
    centroids = whole(np.array([r["embedding"] for r in first]), scale)
    vectors = _blocks(rows, scale, block)
    shape = (len(centroids), 1 + width)
    drifted = np.zeros(len(centroids))
    state = staged(vectors.groupBy("block").applyInPandas(_starting(centroids), STATE), "heaps")
    totals, seen = _change(state, shape)
    rescanned = [seen]
    for _ in range(rounds):
        moved = centroids.copy()
        filled = totals[:, 0] > 0
        moved[filled] = (totals[filled, 1:] // totals[filled, :1]).astype(np.int64)
        drifted = (drifted + drifts(centroids, moved)) * (1 + SLACK)
        centroids = moved
        heaps = state.drop("delta", "rescanned").groupBy("block")
        state = staged(vectors.groupBy("block").cogroup(heaps).applyInPandas(
            _moving(centroids, drifted), STATE), "heaps")
        change, seen = _change(state, shape)
        totals = totals + change
        rescanned.append(seen)
    return Clustering(vectors, state, centroids, rescanned)


def assignments(made: Clustering | None, spark=None) -> DataFrame:
    """Per vector: id, cluster, distance, inertia of its cluster and of all, the centroid's digest."""
    if made is None:
        return spark.createDataFrame(
            [], "id long, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string")
    centroids = made.centroids
    heaps = made.state.drop("delta", "rescanned").groupBy("block")
    found = staged(made.vectors.groupBy("block").cogroup(heaps).applyInPandas(
        lambda b, s: members(b, s, centroids), "id long, cluster int, distance long"), "members")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    rows = [
        (c, inertia.get(c, 0), total, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, centroid in enumerate(centroids.tolist())
    ]
    per_cluster = found.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # One row per cluster, a parameter of the clustering.
    return found.join(F.broadcast(per_cluster), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
