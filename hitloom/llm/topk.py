"""Exact top-k by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key, vectors are cut
into annuli: runs of one pivot's vectors that are next to each other in distance, each with its ranges of
distances to all pivots and its greatest norm. A query q at distance D from a pivot is no nearer than
max(D - hi, lo - D, 0) to vectors at distances in [lo, hi] from it, and inner products follow from
distances and norms. Annuli that are neighbours make a shelf, which a task holds while blocks of queries
pass by: each query opens annuli in the order of their bounds and stops where none reaches its k-th score.

A query's first k-th score comes from the annuli around its own place, so that blocks are sent to shelves
that may matter only. Bounds pass over what cannot matter and nothing else, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.shared import dropped, giving_back, partitions, written

#: Pivots of each vector length (from a sample by hash of the vector), rows of an annulus and of a shelf,
#: queries of a block, and shelves whose bounds a task holds.
PIVOTS, ANNULUS, SHELF, QUERIES, RACK = 48, 512, 1 << 16, 256, 16
SCALE = 1024
#: No score; it has a positive counterpart.
NONE = -np.iinfo(np.int64).max

INDEX = "query boolean, shelf long, width int, pivot int, lo binary, hi binary, norm double, ids binary, marks binary, vectors binary, least binary"
FOUND = "query_id long, mark long, vec_id long, score long, opened long"
#: Pivots by vector length.
Pivots = dict[int, np.ndarray]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, mark and v: floor(scale * x) of every component; vectors with null or non-finite components, or null, are left out.

    mark, a hash of v, tells rows of one vec_id apart. Rows that repeat both are kept once; empty vectors are vectors too.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)).cast("long"))
    rows = vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()
    return rows.select("vec_id", F.xxhash64("v").alias("mark"), "v")


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, matrix) of the runs of vectors of equal length."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)])
    edges = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield a, b, flat[at[a] : at[b]].reshape(b - a, sizes[a])


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * m @ pivots.T))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in doubles while all sums stay below 2**53; raises where they may reach 2**62."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most >= 2**62:
        raise ValueError("inner products of these vectors may reach 2**62")
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ v.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to the smaller id; scores of NONE come last."""
    if scores.shape[1] > k:
        # Only what reaches some k-th score, ties included, is sorted.
        least = np.partition(scores, -k, axis=1)[:, -k]
        wide = np.flatnonzero((scores >= least[:, None]).any(axis=0))
    else:
        wide = np.arange(scores.shape[1])
    some = scores[:, wide]
    return wide[np.lexsort((np.broadcast_to(ids[wide], some.shape), -some), axis=1)[:, :k]]


def bounds(q: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(queries, annuli): no inner product of a query with a vector of the annulus is above this."""
    qn = (q.astype(np.float64) ** 2).sum(1)[:, None]
    gap = np.zeros((len(q), len(norm)))
    for p in range(d.shape[1]):
        np.maximum(gap, np.maximum(d[:, p, None] - hi[None, :, p], lo[None, :, p] - d[:, p, None]) - 1e-6 * (1 + hi[None, :, p]), out=gap)
    far = np.minimum((qn + norm[None] - gap * gap) / 2, np.sqrt(qn * norm[None]))
    # Rounding never takes a bound below the true one.
    return np.minimum(np.ceil(far + 1 + 1e-9 * np.abs(far)), 2.0**62).astype(np.int64)


def _keyed(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, m in _runs(batch["v"]):
                d = distances(m, pivots[m.shape[1]])
                near = d.argmin(1)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["mark"], part["v"], pa.array(np.full(b - a, m.shape[1], np.int32)), pa.array(near.astype(np.int32)), pa.array(d[np.arange(b - a), near])],
                    names=["vec_id", "mark", "v", "width", "pivot", "d"],
                )

    return run


def _index(pivots: Pivots, every: int, k: int):
    """Annuli and blocks of queries of rows that come sorted by length, pivot and distance."""

    def shelf(number: int, width: int, pivot: np.ndarray, ids: np.ndarray, marks: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
        d = distances(m, pivots[width])
        norms = (m.astype(np.float64) ** 2).sum(1)
        edges = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)]
        cuts = [(x, min(b, x + ANNULUS)) for a, b in zip(edges, edges[1:]) for x in range(a, b, ANNULUS)]
        asked: list[np.ndarray] = []
        least: list[np.ndarray] = []
        for n, (x, y) in enumerate(cuts):
            yield (False, number, width, int(pivot[x]), d[x:y].min(0).tobytes(), d[x:y].max(0).tobytes(), norms[x:y].max(), ids[x:y].tobytes(), marks[x:y].tobytes(), m[x:y].tobytes(), b"")
            own = x + np.flatnonzero(ids[x:y] % every == 0)
            if len(own):
                # The annuli around a query's own place give its first k-th score.
                a, b = cuts[max(0, n - 1)][0], cuts[min(len(cuts) - 1, n + 1)][1]
                s = products(m[own], m[a:b])
                s[np.arange(len(own)), own - a] = NONE
                asked.append(own)
                least.append(np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(own), NONE))
        if asked:
            at, low = np.concatenate(asked), np.concatenate(least)
            for x in range(0, len(at), QUERIES):
                some = at[x : x + QUERIES]
                yield (True, (number << 8) + x // QUERIES, width, -1, b"", b"", norms[some].max(), ids[some].tobytes(), marks[some].tobytes(), m[some].tobytes(), low[x : x + QUERIES].tobytes())

    types = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), *[pa.binary()] * 4]
    names = ["query", "shelf", "width", "pivot", "lo", "hi", "norm", "ids", "marks", "vectors", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        number = pyspark.TaskContext.get().partitionId() << 24
        kept: list[tuple[np.ndarray, ...]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            width = kept[0][3].shape[1]
            pivot, ids, marks, m = (np.concatenate(c) for c in zip(*kept))
            for row in shelf(number, width, pivot, ids, marks, m):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            for a, b, m in _runs(batch["v"]):
                pivot, ids, marks = (batch[c].to_numpy()[a:b] for c in ("pivot", "vec_id", "mark"))
                for x in range(0, b - a, SHELF):
                    part = (pivot[x : x + SHELF], ids[x : x + SHELF], marks[x : x + SHELF], m[x : x + SHELF].astype("<i8"))
                    if kept and (kept[0][3].shape[1] != m.shape[1] or sum(len(c[0]) for c in kept) + len(part[0]) > SHELF):
                        yield from flushed()
                        kept, number = [], number + 1
                    kept.append(part)
        if kept:
            yield from flushed()

    return run


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, marks = (np.frombuffer(row[c], "<i8") for c in ("ids", "marks"))
    return ids, marks, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _reached(pivots: Pivots):
    """Of joined blocks of queries and racks of shelves' bounds: the shelves that a block must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, q = _block(row)
            p = pivots[row["width"]]
            lo, hi = (np.frombuffer(b"".join(x[c] for x in row["annuli"]), np.float64).reshape(-1, len(p)) for c in ("lo", "hi"))
            far = bounds(q, distances(q, p), lo, hi, np.array([x["norm"] for x in row["annuli"]]))
            open_ = (far >= np.frombuffer(row["least"], "<i8")[:, None]).any(axis=0)
            shelves = np.unique(np.array([x["shelf"] for x in row["annuli"]])[open_])
            yield pa.RecordBatch.from_arrays([pa.array(shelves, pa.int64()), pa.array(np.full(len(shelves), row["qblock"]), pa.int64())], names=["shelf", "qblock"])

    return run


def _searched(pivots: Pivots, k: int):
    """Rows come shelf by shelf, first its annuli and then the blocks that visit it: the k best of each query there,
    as far as they reach its k-th score, and a row without vec_id that counts the annuli it opened."""

    def visit(row: dict, annuli: list[dict]) -> pa.RecordBatch:
        ids, marks, q = _block(row)
        least = np.frombuffer(row["least"], "<i8").copy()
        p = pivots[row["width"]]
        lo, hi = (np.stack([a[c] for a in annuli]) for c in ("lo", "hi"))
        far = bounds(q, distances(q, p), lo, hi, np.array([a["norm"] for a in annuli]))
        score = np.full((len(q), k), NONE)
        found = np.zeros((len(q), k), np.int64)
        opened = np.zeros(len(q), np.int64)
        # By the most that any query may gain: k-th scores only rise, so the first annulus without gain is the end.
        gain = np.where(far >= least[:, None], far.astype(np.float64) - least[:, None], -1).max(axis=0)
        for n in np.argsort(-gain, kind="stable").tolist():
            if gain[n] < 0:
                break
            asks = np.flatnonzero(far[:, n] >= least)
            if not len(asks):
                continue
            opened[asks] += 1
            a = annuli[n]
            s = products(q[asks], a["vectors"])
            s[(ids[asks, None] == a["ids"][None]) & (marks[asks, None] == a["marks"][None])] = NONE
            first = best(s, a["ids"], k)
            both = np.concatenate([score[asks], np.take_along_axis(s, first, 1)], axis=1)
            names = np.concatenate([found[asks], a["ids"][first]], axis=1)
            order = np.lexsort((names, -both), axis=1)[:, :k]
            score[asks], found[asks] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
            least[asks] = np.maximum(least[asks], score[asks, k - 1])
        hit = score > NONE
        who = np.repeat(np.arange(len(q)), hit.sum(1))
        none = np.zeros(len(q), np.int64)
        columns = [np.concatenate(c) for c in ((ids[who], ids), (marks[who], marks), (found[hit], none), (score[hit], none), (np.zeros(len(who), np.int64), opened))]
        empty = np.arange(len(columns[0])) >= len(who)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=empty if n in (2, 3) else None) for n, c in enumerate(columns)], names=["query_id", "mark", "vec_id", "score", "opened"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, annuli = None, []
        for row in _rows(batches):
            if row["shelf"] != shelf:
                shelf, annuli = row["shelf"], []
            if row["query"]:
                yield visit(row, annuli)
            else:
                ids, marks, m = _block(row)
                annuli.append({"ids": ids, "marks": marks, "vectors": m, "norm": row["norm"], "lo": np.frombuffer(row["lo"], np.float64), "hi": np.frombuffer(row["hi"], np.float64)})

    return run


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score and opened of the k best rows of vectors(vec_id, embedding) for each query.

    Queries are the rows whose vec_id is divisible by every; opened is the number of annuli that a query looked into.
    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part.
    A row that is repeated counts once. Rows of one vec_id with different vectors are different rows: each
    is a query with ranks of its own and a candidate of the others. Vectors of each length are searched among
    their own. Scores that may reach 2**62 raise. Other columns are ignored; an empty table gives no rows.

    The pivots are the only fit on a sample (PIVOTS vectors of each length by least hash); all rows are indexed.
    """
    spark = vectors.sparkSession
    rows = written(integers(vectors, scale))
    sample = Window.partitionBy(F.size("v")).orderBy("mark", "vec_id")
    pivots: dict[int, list] = {}
    for r in rows.withColumn("rn", F.row_number().over(sample)).where(F.col("rn") <= PIVOTS).select("v").collect():
        pivots.setdefault(len(r.v), []).append(r.v)
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, opened long")
    pivots = {n: np.unique(np.array(v, np.float64).reshape(len(v), n), axis=0) for n, v in pivots.items()}
    parts = max(partitions(spark), rows.count() // SHELF)
    order = ["width", "pivot", "d", "vec_id", "mark"]
    keyed = rows.mapInArrow(_keyed(pivots), "vec_id long, mark long, v array<long>, width int, pivot int, d double")
    index = written(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(giving_back(_index(pivots, every, k)), INDEX))
    dropped(rows)
    annuli = index.where(~F.col("query"))
    blocks = index.where("query").withColumnRenamed("shelf", "qblock")

    # Blocks meet all bounds, rack by rack; a rack holds the bounds of about RACK shelves.
    racks = -(-annuli.select("shelf").distinct().count() // RACK)
    rack = annuli.select("width", F.pmod(F.xxhash64("shelf"), F.lit(racks)).alias("rack"), F.struct("shelf", "lo", "hi", "norm").alias("a")).groupBy("width", "rack").agg(F.collect_list("a").alias("annuli"))
    met = blocks.select("qblock", "width", "ids", "marks", "vectors", "least").withColumn("rack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(racks - 1).cast("long")))).join(rack, ["width", "rack"])
    visits = met.mapInArrow(giving_back(_reached(pivots)), "shelf long, qblock long").join(blocks, "qblock")
    both = annuli.unionByName(visits.drop("qblock")).select(*annuli.columns)
    found = written(both.repartition(F.col("shelf")).sortWithinPartitions("shelf", "query").mapInArrow(giving_back(_searched(pivots, k)), FOUND))
    top = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    opened = found.where("vec_id is null").groupBy("query_id", "mark").agg(F.sum("opened").alias("opened"))
    return ranked.drop("opened").join(opened, ["query_id", "mark"]).select("query_id", "rank", "vec_id", "score", "opened")
