"""Groups of neighbours around the rows of highest score, event by event.

Events of bounded size come together in a task; larger ones go through rounds of joins on their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.operators.events import large_events
from hitloom.operators.rounds import first_in_order

#: Rows of an event up to which one task groups it.
LARGE = 100_000
KEY = ["event_id", "hit_id"]
GROUPED = "event_id long, hit_id long, centre_id long, place long, slot long"


def _grouped(edges: DataFrame, hits: DataFrame, score: str, least: float | None, two: bool) -> DataFrame:
    """Events in tasks, and by rounds those of more than LARGE rows; looking for them is one job on event_id."""
    large = large_events(hits, LARGE)
    if large is None:
        return _in_tasks(edges, hits, score, least, two)
    small, rest = ([df.join(large, "event_id", how) for df in (edges, hits)] for how in ("left_anti", "left_semi"))
    return _in_tasks(*small, score, least, two).unionByName(_in_rounds(*rest, score, least, two))


def _in_rounds(edges: DataFrame, hits: DataFrame, score: str, least: float | None, two: bool) -> DataFrame:
    """Centres by rounds, and what they take.

    In the first of two passes a row is no centre if an earlier centre has it as a neighbour, or as a neighbour of what
    that centre takes: the taken are all neighbours that it has, by whomever they were taken.
    """
    # As in the order of tasks: no score comes first, NaN last.
    order = F.when(F.col(score).isNull(), float("inf")).otherwise(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))))
    may = F.lit(True) if least is None else F.coalesce((F.col(score) >= least) & ~F.isnan(F.col(score).cast("double")), F.lit(False))
    rows = hits.select(*KEY, order.alias("score"), may.alias("_may"))
    far = rows.select("event_id", F.col("hit_id").alias("nbr_id"))
    near = edges.where("nbr_id <> hit_id").join(rows, KEY).join(far, ["event_id", "nbr_id"], "left_semi")
    near = near.select("event_id", F.col("hit_id").alias("a_id"), F.col("nbr_id").alias("b_id"), "slot", "score", "_may")
    takes = near.where("_may")
    picks: list[tuple[DataFrame, DataFrame]] = []
    if two:
        via = near.select("event_id", F.col("a_id").alias("b_id"), F.col("b_id").alias("c_id"))
        touched = takes.join(via, ["event_id", "b_id"]).select("event_id", "a_id", F.col("c_id").alias("b_id")).where("a_id <> b_id")
        covers = near.select("event_id", "a_id", "b_id").unionByName(touched)
        picks.append(_pass(rows, covers, takes))
        gone = picks[0][1].select(*KEY).unionByName(picks[0][0].select(*KEY))
        rows = rows.join(gone, KEY, "left_anti")
        for end in ("a_id", "b_id"):
            takes = takes.join(gone.withColumnRenamed("hit_id", end), ["event_id", end], "left_anti")
    picks.append(_pass(rows, takes, takes))
    out: DataFrame | None = None
    for number, (centres, taken) in enumerate(picks):
        one = centres.select(*KEY, F.col("hit_id").alias("centre_id"), F.lit(number).alias("pass"), "score", F.lit(-1).alias("_at"))
        one = one.unionByName(taken.select(*KEY, "centre_id", F.lit(number).alias("pass"), "score", F.col("slot").alias("_at")))
        out = one if out is None else out.unionByName(one)
    place = F.dense_rank().over(Window.partitionBy("event_id").orderBy("pass", F.desc("score"), "centre_id")) - 1
    slot = F.row_number().over(Window.partitionBy("event_id", "centre_id").orderBy("_at", "hit_id")) - 1
    return out.select(*KEY, "centre_id", place.cast("long").alias("place"), slot.cast("long").alias("slot"))


def _pass(rows: DataFrame, covers: DataFrame, takes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centres (with their score), and the other rows that they take: each goes to the first centre whose neighbour it is."""
    centres = first_in_order(rows, covers).join(rows, KEY).select(*KEY, "score")
    met = takes.join(centres.select("event_id", F.col("hit_id").alias("a_id")), ["event_id", "a_id"], "left_semi")
    first = met.groupBy("event_id", F.col("b_id").alias("hit_id")).agg(F.min(F.struct((-F.col("score")).alias("s"), "a_id", "slot")).alias("t"))
    taken = first.join(centres, KEY, "left_anti").select(*KEY, F.col("t.a_id").alias("centre_id"), (-F.col("t.s")).alias("score"), "t.slot")
    return centres, taken


def _in_tasks(edges: DataFrame, hits: DataFrame, score: str, least: float | None, two: bool) -> DataFrame:
    """centre_id, place (the centre's number in its event) and slot (place among what the centre takes, 0: itself) of each row.

    Edges and rows of an event are one row each where event_id put them, so that nothing is shuffled for the join and each edge
    is a few numbers in an array. All events of a batch go on together, by the rank of the row whose turn it is.
    """
    near = edges.where("nbr_id <> hit_id").groupBy("event_id").agg(F.collect_list(F.struct(*(F.col(name).cast("long").alias(name) for name in ("hit_id", "slot", "nbr_id")))).alias("n"))
    rows = hits.where("event_id is not null").groupBy("event_id").agg(F.collect_list(F.struct(F.col(score).cast("double").alias("s"), F.col("hit_id").cast("long").alias("hit_id"))).alias("r"))
    none = F.array().cast("array<long>")
    linked = [F.coalesce(f"n.{name}", none).alias(to) for name, to in (("hit_id", "of"), ("slot", "slot"), ("nbr_id", "nbr_id"))]
    events = rows.join(near, "event_id", "left").select(F.col("event_id").cast("long").alias("event_id"), "r.hit_id", "r.s", *linked)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _of_events(batch, least, two)

    return events.mapInArrow(go, GROUPED)


def _of_events(batch: pa.RecordBatch, least: float | None, two: bool) -> pa.RecordBatch:
    """The grouping of all events of a batch. Rows are known by their places in it; those of an event stand together, in order of descending score."""
    lengths, links = batch["hit_id"].value_lengths().to_numpy(), batch["of"].value_lengths().to_numpy()
    event, from_event = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(links)), links)
    ids, scores = batch["hit_id"].flatten().to_numpy(), batch["s"].flatten()
    missing, scores = scores.is_null().to_numpy(zero_copy_only=False), scores.to_numpy(zero_copy_only=False)
    ranked = np.lexsort((ids, -scores, ~missing, event))  # no score comes first, NaN last
    ids, scores = ids[ranked], scores[ranked]
    start, total = np.cumsum(lengths) - lengths, len(ids)
    by_id = np.lexsort((ids, event))

    def places(name: str) -> np.ndarray:
        """Rows by (event, id): ids become numbers that ascend, so that one search finds an event's row."""
        known, code = np.unique(ids, return_inverse=True)
        wanted = batch[name].flatten().to_numpy()
        at = np.searchsorted(known, wanted)
        return by_id[np.searchsorted(event[by_id] * len(known) + code[by_id], from_event * len(known) + at)]

    # Each row's neighbours, itself first; places that are left over point past all rows, where nothing is free.
    of, other = places("of"), places("nbr_id")
    number = np.bincount(of, minlength=total)
    order = np.lexsort((other, batch["slot"].flatten().to_numpy(), of))
    slot_of = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    near = np.full((total + 1, 1 + (number.max() if len(of) else 0)), total)
    near[:, 0] = np.arange(total + 1)
    near[of[order], 1 + slot_of] = other[order]
    may = np.ones(total, bool) if least is None else scores >= least

    free, touched = np.ones(total + 1, bool), np.zeros(total + 1, bool)
    free[total] = False
    centre, place, slot = (np.full(total + 1, -1) for _ in range(3))
    centres = np.zeros(len(lengths), int)
    by_length = np.argsort(-lengths, kind="stable")
    longest_first = -lengths[by_length]
    for wait in (True, False) if two else (False,):
        for rank in range(int(lengths.max())):
            own = by_length[: np.searchsorted(longest_first, -rank)]
            at = start[own] + rank
            turn = free[at] & ~touched[at] if wait else free[at]
            own, at = own[turn], at[turn]
            met = near[at]
            taken = free[met]
            taken[:, 1:] &= may[at][:, None]
            row, column = np.nonzero(taken)
            got = met[row, column]
            free[got] = False
            centre[got], place[got], slot[got] = at[row], centres[own][row], (taken.cumsum(1) - 1)[row, column]
            centres[own] += 1
            if wait:
                touched[near[got].ravel()] = True
    return pa.RecordBatch.from_pydict({"event_id": batch["event_id"].take(pa.array(event)), "hit_id": ids, "centre_id": ids[centre[:total]], "place": place[:total], "slot": slot[:total]})


def local_cluster(edges: DataFrame, hits: DataFrame, score: str, least: float | None = None) -> DataFrame:
    """Rows in descending score: a free row becomes a centre and takes its free neighbours; below least it takes itself only."""
    return _grouped(edges, hits, score, least, False)


def local_group(edges: DataFrame, hits: DataFrame, score: str, least: float | None = None) -> DataFrame:
    """As local_cluster, in two passes: the first one leaves rows alone that are neighbours of what was taken before."""
    return _grouped(edges, hits, score, least, True)
