"""k-means under exact integer distances, with Elkan's bounds.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound to each of the others.
When centroids move, bounds move with them; by the triangle inequality a centroid needs no distance where the
upper bound is below its lower bound or below half of its distance from the vector's own centroid. Upper bounds are
rounded up and lower bounds down, and only strict inequalities skip, so no centroid that is as near as the
best one is ever passed over: ties go to the smaller number, as without bounds.

Vectors, their centroid and their bounds are a table in the shared folder, written anew in every round. The
driver sees k centroids: sums of components are made in tasks, then by cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.shared import dropped, giving_back, written

#: Components of a vector, centroids, rounds of moving them, and the factor that makes components integers.
WIDTH, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Relative error that roots, sums and single precision stay within.
SLACK = 1e-6
STATE = "vec_id long, v array<long>, cluster int, distance long, upper float, lower binary, measured int"
SUMS = "cluster int, n long, sums array<long>"


def integers(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of the components; vectors of another length, or with null or non-finite components, are left out.

    Null vec_ids stay, and so do repeated rows.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)).cast("long"))
    return vectors.where((F.size(x) == width) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors with the k smallest hashes of their ids; of rows with one id the smaller vector comes first, null ids come last."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").select("v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of v from c (one centroid, or one a row); raises where they may reach 2**62."""
    most = max(float(np.abs(v.astype(np.float64)).max(initial=0)), float(np.abs(c.astype(np.float64)).max(initial=0)))
    if 4 * most * most * v.shape[-1] >= 2**62:
        raise ValueError("squared distances of these vectors may reach 2**62")
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def above(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


def between(centroids: np.ndarray) -> np.ndarray:
    """(k, k): no two centroids are nearer than this."""
    return np.stack([below(squares(centroids, c)) for c in centroids])


def assigned(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Moves own to the nearest centroid of each row of v, bounds with it; the number of distances that each row took.

    own -1: no centroid is known, and all are measured.
    """
    measured = np.zeros(len(v), np.int32)
    exact = np.full(len(v), -1)
    new = own < 0
    own[new], exact[new] = 0, squares(v[new], centroids[0])
    upper[new], lower[new, 0] = above(exact[new]), below(exact[new])
    measured[new] = 1
    half = between(centroids) / 2
    np.fill_diagonal(half, np.inf)
    nearest = half.min(1)
    rows = np.flatnonzero(~(upper < nearest[own]) | new)
    for j in range(len(centroids)):
        maybe = rows[(own[rows] != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < half[own[rows], j])]
        loose = maybe[exact[maybe] < 0]
        exact[loose] = squares(v[loose], centroids[own[loose]])
        upper[loose], lower[loose, own[loose]] = above(exact[loose]), below(exact[loose])
        measured[loose] += 1
        maybe = maybe[~(upper[maybe] < lower[maybe, j]) & ~(upper[maybe] < half[own[maybe], j])]
        d = squares(v[maybe], centroids[j])
        lower[maybe, j] = below(d)
        measured[maybe] += 1
        won = (d < exact[maybe]) | ((d == exact[maybe]) & (j < own[maybe]))
        to = maybe[won]
        own[to], exact[to], upper[to] = j, d[won], above(d[won])
    return measured


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1)


def _round(centroids: np.ndarray, before: np.ndarray | None, last: bool):
    """One assignment: bounds of rows follow what the centroids moved since before; last: with exact distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        moved = np.zeros(k) if before is None else above(np.array([squares(b[None], c)[0] for b, c in zip(before, centroids)]))
        for batch in batches:
            n = batch.num_rows
            v = _matrix(batch)
            if before is None:
                own, upper, lower = np.full(n, -1), np.zeros(n), np.zeros((n, k))
            else:
                own = batch["cluster"].to_numpy().astype(np.int64)
                upper = batch["upper"].to_numpy().astype(np.float64) + moved[own]
                lower = np.maximum(np.frombuffer(b"".join(batch["lower"].to_pylist()), np.float32).reshape(n, k).astype(np.float64) - moved, 0)
            measured = assigned(v, own, upper, lower, centroids)
            distance = squares(v, centroids[own]) if last else np.zeros(n, np.int64)
            # Single precision halves what is stored; it errs to the safe side.
            kept = (lower * (1 - SLACK)).astype(np.float32)
            columns = [batch["vec_id"], batch["v"], pa.array(own.astype(np.int32)), pa.array(distance), pa.array((upper * (1 + SLACK)).astype(np.float32)), pa.array([row.tobytes() for row in kept], pa.binary()), pa.array(measured)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "distance", "upper", "lower", "measured"])

    return run


def _sums(k: int):
    """The sums of each cluster's vectors in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), [0] * k
        for batch in batches:
            v, own = _matrix(batch), batch["cluster"].to_numpy()
            count += np.bincount(own, minlength=k)
            for j in np.unique(own).tolist():
                sums[j] = sums[j] + v[own == j].sum(0)
        for j in np.flatnonzero(count).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([count[j]]), pa.array([sums[j].tolist()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean, component by component; empty clusters keep their centroid."""
    parts = state.select("cluster", "v").mapInArrow(giving_back(_sums(len(centroids))), SUMS)
    # Counts beside the components; the sums of many tasks may pass 64 bits.
    each = parts.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("sums"))).alias("at", "x"))
    out = centroids.copy()
    totals = {(r.cluster, r.at): int(r.x) for r in each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    for j in {j for j, _ in totals}:
        out[j] = [totals[j, at] // totals[j, 0] for at in range(1, centroids.shape[1] + 1)]
    return out


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and measured of vectors(vec_id, embedding).

    Vectors of another width, null ones, and such with null or non-finite components are left out. The first centroids
    are the vectors whose ids have the smallest hashes (fewer, where there are not k). Equal distances go to the smaller
    cluster. Repeated rows count each time, null vec_ids stay, other columns are ignored, and no vectors give no
    rows. measured: the distances that a vector took in the last round. Raises where squared distances may reach 2**62.
    """
    rows = written(integers(vectors, width, scale))
    centroids = first_centroids(rows, k)
    state, before = rows, None
    for n in range(rounds + 1):
        new = state.mapInArrow(giving_back(_round(centroids, before, n == rounds)), STATE)
        new = written(new)
        dropped(state)
        state, before = new, centroids
        if n < rounds and len(centroids):
            centroids = moved_centroids(state, centroids)
    total = state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    inertia = {r.cluster: r.inertia for r in total}
    told = [(j, inertia.get(j, 0), sum(inertia.values()), centroid_hash(c)) for j, c in enumerate(centroids)]
    told = state.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows are broadcast.
    return state.select("vec_id", "cluster", "distance", "measured").join(F.broadcast(told), "cluster")
