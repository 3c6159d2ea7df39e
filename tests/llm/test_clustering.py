"""k-means against plain rounds without bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from hitloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows: list[tuple], k: int, rounds: int, width: int, scale: int):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    told = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, o, d in told if o == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total[j], sum(total.values()), digest[j]) for i, j, d in told), key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("scale", [2, 64])
def test_plain_rounds(spark, scale):
    """A small scale makes many equal distances."""
    rng = np.random.default_rng(scale)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.4).astype(np.float32).tolist(), "x") for i in range(300)]
    rows += [rows[7], (300, rows[7][1], None), (None, rows[3][1], ""), (None, rows[3][1], ""), (301, None, ""), (302, [0.5] * 5 + [None], ""), (303, [0.5] * 5 + [float("nan")], ""), (304, [1.0] * 7, ""), (305, [], ""), (306, [float("-inf")] * 6, ""), (7, [9.0] * 6, "")]
    got = clustering.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), 7, 3, 6, scale)
    assert found(got) == plain(rows, 7, 3, 6, scale)


def test_bounds_skip(spark):
    """Tight groups far apart: most vectors take no distance in the last round, and results stay those of plain rounds."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 8)) * 20
    rows = [(i, (centres[i % 16] + rng.normal(size=8) * 0.05).tolist(), "") for i in range(1600)]
    got = clustering.cluster(spark.createDataFrame(rows, SCHEMA), 16, 3, 8, 64)
    assert found(got) == plain(rows, 16, 3, 8, 64)
    assert got.where("measured > 8").count() == 0
    assert sum(r.measured for r in got.collect()) < 4 * len(rows)


def test_few_and_none(spark):
    rows = [(1, [1.0, 2.0], ""), (2, [3.0, -4.0], "")]
    assert found(clustering.cluster(spark.createDataFrame(rows, SCHEMA), 16, 3, 2)) == plain(rows, 16, 3, 2, 64)
    assert found(clustering.cluster(spark.createDataFrame([], SCHEMA), 16, 3, 2)) == []
    assert found(clustering.cluster(spark.createDataFrame(rows * 4, SCHEMA), 2, 1, 2)) == plain(rows * 4, 2, 1, 2, 64)


def test_too_large(spark):
    with pytest.raises(ValueError, match="2\\*\\*62"):
        clustering.squares(np.array([[2**31, 0]]), np.array([-(2**31), 0]))
