"""Matching of predicted to true objects by weighted overlap."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitloom.operators.events import large_events, per_event
from hitloom.operators.rounds import parts

#: Pairs of an event up to which one task matches it.
LARGE = 100_000


def overlap(hits: DataFrame, truth: str, pred: str, weight: str) -> DataFrame:
    """event_id, truth, pred, iou of all pairs that share hits; ids below 0 are noise."""
    both = hits.where((F.col(truth) >= 0) & (F.col(pred) >= 0)).groupBy("event_id", truth, pred).agg(F.sum(weight).alias("i"))
    t = hits.where(F.col(truth) >= 0).groupBy("event_id", truth).agg(F.sum(weight).alias("t"))
    p = hits.where(F.col(pred) >= 0).groupBy("event_id", pred).agg(F.sum(weight).alias("p"))
    joined = both.join(t, ["event_id", truth]).join(p, ["event_id", pred])
    return joined.select("event_id", truth, pred, F.coalesce(F.try_divide("i", F.col("t") + F.col("p") - F.col("i")), F.lit(0.0)).alias("iou"))


def assign(value: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that maximise the sum of value: shortest augmenting paths with potentials."""
    n, m = value.shape
    if n > m:
        return [(r, c) for c, r in assign(value.T)]
    cost = value.max(initial=0) - value
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[j]:
            done[j] = True
            gain = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = ~done[1:] & (gain < least[1:])
            least[1:][better], came[1:][better] = gain[better], j
            to = int(np.where(done, np.inf, least).argmin())
            step = least[to]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            j = to
        while j:
            row_of[j] = row_of[came[j]]
            j = came[j]
    return [(row_of[j] - 1, j - 1) for j in range(1, m + 1) if row_of[j]]


def assign_sparse(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """As assign(), of pairs (row, column, value > 0) alone: memory follows the pairs and not rows times columns.

    Rows come one by one; each looks for the shortest augmenting path to a free column, or to leaving a row without one.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for r, c, x in pairs:
        near.setdefault(r, []).append((c, x))
    top = max((x for _, _, x in pairs), default=0.0)
    u, v = dict.fromkeys(near, 0.0), {c: 0.0 for _, c, _ in pairs}
    of_column: dict[int, int] = {}
    of_row: dict[int, int] = {}
    for start in near:
        far, came, reached, heap = {}, {}, {start: 0.0}, []
        row, at, end, least = start, 0.0, None, np.inf
        settled: set[int] = set()
        while True:
            if at + top - u[row] < least:  # the row may stay alone, at no value
                least, end = at + top - u[row], (row, None)
            for c, x in near[row]:
                d = at + top - x - u[row] - v[c]
                if c not in settled and d < far.get(c, np.inf):
                    far[c], came[c] = d, row
                    heapq.heappush(heap, (d, c))
            while heap and heap[0][1] in settled:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            at, c = heapq.heappop(heap)
            settled.add(c)
            if c not in of_column:
                least, end = at, (came[c], c)
                break
            row = of_column[c]
            reached[row] = at
        for r, d in reached.items():
            u[r] += least - d
        for c in settled:
            v[c] += far[c] - least
        row, c = end
        while True:  # the path turns over, from its end to its start
            given = of_row.pop(row, None)
            if c is not None:
                of_row[row], of_column[c] = c, row
            if row == start:
                break
            row, c = came[given], given
    return list(of_row.items())


def best_pairs(rows: np.ndarray, columns: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the pairs of the best assignment; values are above 0. Connected parts are solved alone."""
    _, r = np.unique(rows, return_inverse=True)
    _, c = np.unique(columns, return_inverse=True)
    c = c + r.max(initial=-1) + 1
    label = np.arange(c.max(initial=-1) + 1)
    while True:  # smallest label of a part
        low = label.copy()
        np.minimum.at(low, r, label[c])
        np.minimum.at(low, c, low[r])
        low = low[low]
        if (low == label).all():
            break
        label = low
    out: list[int] = []
    order = np.argsort(label[r], kind="stable")
    edges = np.flatnonzero(np.diff(label[r][order], prepend=-1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(order)]):
        some = order[a:b]
        chosen = set(assign_sparse([(int(r[k]), int(c[k]), float(value[k])) for k in some])) if b - a > 1 else {(int(r[some[0]]), int(c[some[0]]))}
        out += [k for k in some.tolist() if (int(r[k]), int(c[k])) in chosen]
    return np.array(out, np.int64)


def match(overlaps: DataFrame, truth: str, pred: str, threshold: float) -> DataFrame:
    """The assignment of each event with the greatest total overlap; pairs below threshold count nothing.

    Objects that share no overlap, not even through others, do not matter to one another: each connected part is solved
    alone. Events of more than LARGE pairs are cut into parts by joins first, and a task then holds a part, not an event.
    """
    schema = pa.schema([("event_id", pa.int64()), (truth, pa.int32()), (pred, pa.int32()), ("iou", pa.float64())])
    columns = f"event_id long, {truth} int, {pred} int, iou double"
    kept = overlaps.where((F.col("iou") >= threshold) & (F.col("iou") > 0)).select("event_id", truth, pred, "iou")

    def one(event: pa.Table) -> pa.Table:
        at = best_pairs(*(event[c].to_numpy() for c in (truth, pred, "iou")))
        return event.select(schema.names).take(pa.array(at)).cast(schema)

    large = large_events(kept, LARGE)
    if large is None:
        return per_event(kept, one, columns, truth, pred)
    wide = kept.join(large, "event_id", "left_semi")
    # Both kinds of objects are nodes: even and odd numbers.
    part = parts(wide.select("event_id", (F.col(truth).cast("long") * 2).alias("a"), (F.col(pred).cast("long") * 2 + 1).alias("b")))
    parted = wide.join(part.select("event_id", (F.col("node") / 2).cast("int").alias(truth), "part").where(F.col("node") % 2 == 0), ["event_id", truth])
    small = per_event(kept.join(large, "event_id", "left_anti"), one, columns, truth, pred)
    return small.unionByName(per_event(parted, one, columns, truth, pred, key=("event_id", "part")))


def frame(hits: DataFrame, weight: str, threshold: float) -> DataFrame:
    """True and predicted objects of hits(event_id, t_idx, pred), matched or alone: t_idx, t_energy, pred, pred_energy, iou.

    Weights are summed before events come together, and one task matches an event and joins both sides; events of more than
    LARGE pairs are matched by parts and joined. Ids below 0 are noise.
    """
    cells = hits.groupBy("event_id", "t_idx", "pred").agg(F.sum(weight).alias("w"))
    schema = pa.schema([("event_id", pa.int64()), ("t_idx", pa.int32()), ("t_energy", pa.float64()), ("pred", pa.int32()), ("pred_energy", pa.float64()), ("iou", pa.float64())])

    def one(event: pa.Table) -> pa.Table:
        a, b, w = (event[c].to_numpy() for c in ("t_idx", "pred", "w"))
        t, p = np.unique(a[a >= 0]), np.unique(b[b >= 0])
        total_t, total_p = (np.bincount(np.searchsorted(names, ids[ids >= 0]), w[ids >= 0], len(names)) for ids, names in ((a, t), (b, p)))
        inner = (a >= 0) & (b >= 0)
        i, j, both = np.searchsorted(t, a[inner]), np.searchsorted(p, b[inner]), w[inner]
        union = total_t[i] + total_p[j] - both
        iou = np.divide(both, union, out=np.zeros_like(both), where=union != 0)
        good = np.flatnonzero((iou >= threshold) & (iou > 0))
        pairs = {int(i[k]): k for k in good[best_pairs(i[good], j[good], iou[good])].tolist()}
        rows = [(t[n], total_t[n], *((p[j[k]], total_p[j[k]], iou[k]) if (k := pairs.get(n)) is not None else (None,) * 3)) for n in range(len(t))]
        matched = {int(j[k]) for k in pairs.values()}
        rows += [(None, None, p[n], total_p[n], None) for n in range(len(p)) if n not in matched]
        number = event["event_id"][0].as_py()
        return pa.Table.from_pylist([dict(zip(schema.names, (number, *x))) for x in rows], schema=schema)

    columns = "event_id long, t_idx int, t_energy double, pred int, pred_energy double, iou double"
    large = large_events(cells, LARGE)
    if large is None:
        return per_event(cells, one, columns, "t_idx", "pred")
    wide = cells.join(large, "event_id", "left_semi")
    matches = match(overlap(wide, "t_idx", "pred", "w"), "t_idx", "pred", threshold)
    true = wide.where("t_idx >= 0").groupBy("event_id", "t_idx").agg(F.sum("w").alias("t_energy")).join(matches, ["event_id", "t_idx"], "left")
    predicted = wide.where("pred >= 0").groupBy("event_id", "pred").agg(F.sum("w").alias("pred_energy"))
    both = true.join(predicted, ["event_id", "pred"], "full").select("event_id", "t_idx", "t_energy", "pred", "pred_energy", "iou")
    return per_event(cells.join(large, "event_id", "left_anti"), one, columns, "t_idx", "pred").unionByName(both)


def angle(a: Sequence[str], b: Sequence[str]) -> Column:
    """The angle between two directions, given by their components; null where one has no length."""

    def dot(x: Sequence[str], y: Sequence[str]) -> Column:
        return sum((F.col(i) * F.col(j) for i, j in zip(x[1:], y[1:])), F.col(x[0]) * F.col(y[0]))

    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def processed(predictions: DataFrame) -> DataFrame:
    """Predictions with corrected energy, half the width between quantiles as unc, and the place of the highest score as pid."""
    highest = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    return predictions.select("event_id", "hit_id", (F.col("energy") * F.col("corr")).alias("energy"), (0.5 * (F.col("q_high") - F.col("q_low"))).alias("unc"), highest.alias("pid"))
