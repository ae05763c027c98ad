"""Centroid clustering: Lloyd's rounds that look only at what the last round changed.

Each vector keeps its owner (the nearest centroid) and its distance, in a table
in the shared folder; the driver keeps the exact integer sum and count of every
cluster. After an update a vector whose owner stayed is compared with the
centroids that moved and with no other: those that stayed are as far as they
were, and lost to the owner then. A vector whose owner moved is compared with
all. Vectors that change hands are added up as signed transfers, -x to the old
cluster and +x to the new one, first inside a task: at most two rows a cluster
and task are shuffled, so a cluster of a third of all vectors is as good as
any other. Nothing is shuffled by vector; a round reads and writes the table
once and its movers once more.

Components are integers, so sums, means and distances are exact and do not
depend on the order of addition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Tables, keep, prepare

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Integers beyond this are refused: squared distances of 64 components would leave a long.
LARGEST = 1 << 27
#: Below this a double holds every sum of a distance exactly.
DOUBLES = 1 << 22
STATE = "vec_id long, v array<int>, owner int, distance long, before int"


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(rows.reshape(-1).astype(np.int32)))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every row of ``c``, exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    kind = np.float64 if largest <= DOUBLES and x.shape[1] <= WIDTH else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def integer_vectors(df: DataFrame, vec_id: str, vector: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with exactly ``width`` components, none of them null or not finite."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.columns
            fits = pc.fill_null(pc.equal(pc.list_value_length(lists), width), False)
            values = _matrix(lists.filter(fits), width).astype(np.float64)
            finite = np.isfinite(values).all(axis=1)
            whole = np.floor(scale * values[finite])
            if np.abs(whole).max(initial=0) > LARGEST:
                raise ValueError(f"components of more than {LARGEST // scale} have no exact distances")
            yield pa.RecordBatch.from_arrays([ids.filter(fits).filter(pa.array(finite)), _lists(whole)], names=["vec_id", "v"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v array<int>")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of "seed:id", in that order; those without an id come last, equal ids by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """``state`` with owners by the new centroids; ``moved`` are the numbers of those that are not where they were (all in the first round, where no vector has an owner)."""
    still = np.ones(len(centroids), dtype=bool)
    still[moved] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, owners, distances = (batch.column(c) for c in ("vec_id", "v", "owner", "distance"))
            x, before = _matrix(lists, centroids.shape[1]), owners.to_numpy(zero_copy_only=False)
            owner, distance = before.copy(), distances.to_numpy(zero_copy_only=False).copy()
            stays = (before >= 0) & still[before]
            if not stays.all():
                d = _distances(x[~stays], centroids)
                owner[~stays], distance[~stays] = d.argmin(1), d.min(1)
            if stays.any():
                d = _distances(x[stays], centroids[moved])
                rival, nearest = moved[d.argmin(1)], d.min(1)
                own, far = owner[stays], distance[stays]
                wins = (nearest < far) | ((nearest == far) & (rival < own))
                owner[stays], distance[stays] = np.where(wins, rival, own), np.where(wins, nearest, far)
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(before, pa.int32())], names=["vec_id", "v", "owner", "distance", "before"])

    return state.select("vec_id", "v", "owner", "distance").mapInArrow(run, STATE)


def _transfers(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What clusters gain and lose by the vectors that changed hands: component sums (k x width) and counts (k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.int64)
            x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
            owner, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("owner", "before"))
            np.add.at(total, owner, x)
            np.subtract.at(total, before[before >= 0], x[before >= 0])
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(total[at, place])], names=["cluster", "place", "n"])

    parts = state.where("owner <> before").select("v", "owner", "before").mapInArrow(run, "cluster int, place int, n long")
    total = np.zeros((k, width + 1), dtype=np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n")).collect():  # k * (width + 1) rows at most
        total[r.cluster, r.place] = r.n
    return total[:, :-1], total[:, -1]


def delta_lloyd(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of the kept vectors after ``rounds`` updates, as a written table, and the final centroids.

    Kept are the vectors of exactly ``width`` components, all finite; others
    (null vectors, null or infinite components) have no row. With fewer
    vectors than ``k`` each is a centroid; with none there is no row. Ties go
    to the smaller number, and an empty cluster keeps its centroid. Rows
    without an id are clustered like others but start no cluster unless ids
    run out; repeated rows count as often as they come. Other columns of
    ``df`` are not read. Components of more than two million are refused with
    an error, as squared distances would leave a long.

    Only centroids and sums, ``k`` rows of ``width`` numbers, reach the driver.
    """
    with Tables(df.sparkSession) as tables:
        vectors = tables.keep(integer_vectors(df, vec_id, vector, width, scale))
        centroids = first_centroids(vectors, k, seed)
        if not len(centroids):
            return keep(vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))), centroids
        n_clusters = len(centroids)
        sums, counts = np.zeros((n_clusters, width), dtype=np.int64), np.zeros(n_clusters, dtype=np.int64)
        state = vectors.withColumn("owner", F.lit(-1)).withColumn("distance", F.lit(0).cast("long"))
        before, moved = vectors, np.arange(n_clusters)
        for _ in range(rounds):
            if not len(moved):
                break  # no centroid moved, so no owner changes any more
            state = tables.keep(_assigned(state, centroids, moved))
            tables.drop(before)
            before = state
            more, n = _transfers(state, n_clusters, width)
            sums, counts = sums + more, counts + n
            means = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            moved, centroids = np.flatnonzero((means != centroids).any(axis=1)), means
        if len(moved):
            state = _assigned(state, centroids, moved)
        return keep(state.select("vec_id", "v", F.col("owner").alias("cluster"), "distance")), centroids


def cluster_report(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clustered`` (vec_id, cluster, distance) with cluster_inertia, inertia and centroid_sha256; a row per cluster is broadcast."""
    spark = clustered.sparkSession
    inertia = {r.cluster: r.n for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row per centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, inertia.get(i, 0), sum(inertia.values()), h) for i, h in enumerate(digest)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.select("vec_id", "cluster", "distance").join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
