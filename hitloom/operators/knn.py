"""Nearest-neighbour joins inside events.

Rows of small events meet in arrays, one shuffle by event in all. Rows of large events meet in the cells of a grid that
is halved again and again where rows are dense, by equi-joins on (event, level, cell), so that neither an event nor
a crowded place costs its square. The cells are part of the plan only where there are large events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hitloom.operators.events import large_events

SELF, NEAR = "p", "n"
#: Rows of an event up to which arrays of its rows cost less than cells do.
SMALL = 256
#: Pairs of rows whose distances one task holds at a time.
PAIRS = 1 << 19
#: Rows of small events that one task takes at a time.
HELD = 1 << 16
#: Halvings of an event's longest side at most.
BITS = 30
#: A squared distance of a probe and a neighbour, given the coordinates of each by name (a probe's also has columns of its own):
#: sums and products only, as both columns and numpy arrays are put in.
Place = Callable[[str], Column | np.ndarray]
Distance = Callable[[Place, Place], Column | np.ndarray]


def squared(coords: Sequence[str]) -> Distance:
    def distance(p: Place, n: Place) -> Column:
        parts = [(p(c) - n(c)) * (p(c) - n(c)) for c in coords]
        return sum(parts[1:], parts[0])

    return distance


def columns(side: str) -> Place:
    return lambda name: F.col(f"{side}_{name}")


def _side(hits: DataFrame, name: str, keep: Sequence[str], coords: Sequence[str]) -> DataFrame:
    return hits.select(*keep, F.col("hit_id").alias("hit_id" if name == SELF else "nbr_id"), *(F.col(c).alias(f"{name}_{c}") for c in coords))


def _placed(hits: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Rows of an event with a place: no coordinate is null, NaN or infinite."""
    return hits.where("event_id IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in coords))


def _slots(rows: DataFrame, near: Column, k: int, own: str, radius: float | None, carry: Sequence[str]) -> DataFrame:
    """A row for each of the first k of near, by distance, then id; self comes ahead of them, is left out, or counts as any other row."""
    near = F.sort_array(near)
    if own != "found":
        near = F.filter(near, lambda n: n["nbr_id"] != F.col("hit_id"))
    if own == "first":
        me = F.struct(F.lit(0.0).alias("dsq"), F.col("hit_id").alias("nbr_id"), *(F.col(f"own_{c}").alias(f"n_{c}") for c in carry))
        near = F.concat(F.array(me), F.slice(near, 1, k - 1))
    else:
        near = F.slice(near, 1, k)
    out = rows.select("event_id", "hit_id", *(F.col(f"own_{c}").alias(c) for c in carry), F.posexplode(near).alias("slot", "_n"))
    out = out.select("event_id", "hit_id", "_n.nbr_id", "_n.dsq", "slot", *carry, *(f"_n.n_{c}" for c in carry))
    return out if radius is None else out.where(F.col("dsq") <= radius * radius)


def _in_arrays(rows: DataFrame, k: int, coords: Sequence[str], distance: Distance, extra: Sequence[str], own: str, radius: float | None, carry: Sequence[str], meets: Distance | None = None) -> DataFrame:
    """lists() of events whose rows stand one after another; distances of many events are taken at once.

    Rows go to Python as flat columns in the order of event and id, and a short list of neighbours comes back for each.
    """
    kept = list(dict.fromkeys(["hit_id", *coords, *extra, *carry, "_asks", "_found"]))
    able = [f"{c} is not null" for c in extra]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    by_id = Window.partitionBy("event_id").orderBy(*kept, "_able")
    placed = rows.withColumn("_able", F.expr(" and ".join(able) or "true")).select("event_id", *kept, "_able", F.row_number().over(by_id).alias("_at"))
    sent = ["_at", *kept, "_able"]

    def listed(table: pa.Table) -> pa.Array:
        """The neighbours of each row of whole events."""
        ids, asks, may_be, able = table["hit_id"].chunk(0), *(table[x].to_numpy() for x in ("_asks", "_found", "_able"))
        new = table["_at"].to_numpy() == 1
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(ids))
        # Equal ids stand side by side.
        code = (new | np.concatenate([[True], pc.not_equal(ids[1:], ids[:-1]).fill_null(True).to_numpy(zero_copy_only=False)])).cumsum()
        value = {name: _numbers(table[name].chunk(0)) for name in dict.fromkeys([*coords, *extra])}
        # Entries of all lists: the row, the one that stands there, and its distance.
        owner, near, far = [], [], []
        for n in np.unique(sizes):
            of_size = starts[sizes == n]
            step = max(1, PAIRS // int(n * n))
            for first in (of_size[i : i + step] for i in range(0, len(of_size), step)):
                at = first[:, None] + np.arange(n)
                with np.errstate(all="ignore"):
                    d = distance(lambda c: value[c][at][:, :, None], lambda c: value[c][at][:, None, :]).astype(float)
                may = may_be[at][:, None, :] & able[at][:, :, None]
                if meets is not None:
                    may = may & meets(lambda c: value[c][at][:, :, None], lambda c: value[c][at][:, None, :])
                if radius is not None:
                    may = may & (d <= radius * radius)
                if own != "found":
                    may = may & (code[at][:, :, None] != code[at][:, None, :])
                key = np.where(may, d, np.nan)
                if own == "first":
                    me = np.arange(n)
                    key[:, me, me], d[:, me, me], may[:, me, me] = -np.inf, 0.0, True
                order = key.argsort(-1, kind="stable")
                if not np.isnan(d).any():
                    order = order[:, :, :k]
                taken = np.take_along_axis(may, order, -1)
                slot = taken.cumsum(-1) - 1
                e, p, j = np.nonzero(taken & (slot < k) & asks[at][:, :, None])
                other = order[e, p, j]
                owner.append(first[e] + p)
                near.append(first[e] + other)
                far.append(d[e, p, other])
        row = np.concatenate(owner)
        # Those of a row stand in their order.
        by_row = row.argsort(kind="stable")
        ends = np.concatenate([[0], np.bincount(row, minlength=len(ids)).cumsum()]).astype(np.int32)
        other = pa.array(np.concatenate(near)[by_row])
        fields = [ids.take(other), pa.array(np.concatenate(far)[by_row]), *(table[c].chunk(0).take(other) for c in carry)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["nbr_id", "dsq", *(f"n_{c}" for c in carry)]))

    def nearest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_arrays(list(batch), sent))
            if sum(map(len, held)) >= HELD:
                table = pa.concat_tables(held).combine_chunks()
                # The last event may go on in the next batch.
                last = int(np.flatnonzero(table["_at"].to_numpy() == 1)[-1])
                if last:
                    yield listed(table[:last])
                held = [table[last:]]
        if sum(map(len, held)):
            yield listed(pa.concat_tables(held).combine_chunks())

    # Not deterministic: no filter is to be moved below it, which would take rows out of their events.
    shape = StructType([StructField("nbr_id", kinds["hit_id"]), StructField("dsq", DoubleType()), *(StructField(f"n_{c}", kinds[c]) for c in carry)])
    run = F.arrow_udf(nearest, ArrayType(shape)).asNondeterministic()
    return placed.select("event_id", "hit_id", *carry, run(*sent).alias("near")).where("size(near) > 0")


def exploded(lists: DataFrame, *keep: Column | str) -> DataFrame:
    """An edge for each entry of lists(), with slot, its place there; keep: what an edge is to have of its row besides event_id and hit_id."""
    edge = lists.select("event_id", "hit_id", *keep, F.posexplode("near").alias("slot", "_n"))
    own = edge.columns[2:-2]
    return edge.select("event_id", "hit_id", "_n.nbr_id", "_n.dsq", "slot", *own, *(f"_n.{f}" for f in lists.schema["near"].dataType.elementType.names[2:]))


def _listed(edges: DataFrame, carry: Sequence[str]) -> DataFrame:
    """lists() of edges."""
    near = F.sort_array(F.collect_list(F.struct("slot", "nbr_id", "dsq", *(f"n_{c}" for c in carry))))
    near = F.transform(near, lambda n: F.struct(*(n[x].alias(x) for x in ("nbr_id", "dsq", *(f"n_{c}" for c in carry)))))
    return edges.groupBy("event_id", "hit_id").agg(*(F.first(c).alias(c) for c in carry), near.alias("near"))


def _numbers(values: pa.Array) -> np.ndarray:
    """Whole numbers in 64 bits, decimals as doubles, nulls as NaN."""
    if pa.types.is_decimal(values.type):
        values = values.cast(pa.float64())
    numbers = values.to_numpy(zero_copy_only=False)
    return numbers.astype(np.int64) if numbers.dtype.kind in "iu" else numbers


def _first(pairs: DataFrame, probe: Sequence[str], need: int) -> DataFrame:
    """The need nearest rows of each probe: ids of a place count one by one."""
    w = Window.partitionBy(*probe).orderBy("dsq", "nbr_id")
    return pairs.withColumn("nbr_id", F.explode("ids")).drop("ids").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= need)


def _through_cells(rows: DataFrame, k: int, coords: Sequence[str], distance: Distance, extra: Sequence[str], own: str, radius: float | None, carry: Sequence[str], shrink: Column | None, width: float | None) -> DataFrame:
    """Neighbours of the rows of large events.

    Rows at one place are one node with their first ids, and ask once. Places are in a cell at every level, whose
    side halves from one to the next. A probe takes the finest cell of its own that holds k + 1 rows: the distance
    of the last of them bounds its neighbours, which all lie in the few cells of that level (or of a coarser one) that
    the bound reaches.
    """
    need, binned = k + 1, list(coords[:3])
    place, probe = ["event_id", *coords], ["event_id", *coords, *extra]
    cells = [f"c_{c}" for c in binned]

    box = rows.groupBy("event_id").agg(F.count("*").alias("rows"), *(F.min(c).alias(f"lo_{c}") for c in binned), *(F.max(c).alias(f"hi_{c}") for c in binned))
    sides = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in binned]
    finest = F.log2(F.col("rows") / need) + 1 if width is None else F.log2(F.col("side") / width)
    depth = F.when(F.col("side") > 0, F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(finest).cast("int")))).otherwise(0)
    box = box.withColumn("side", F.greatest(*sides) if len(sides) > 1 else sides[0]).withColumn("depth", depth).select("event_id", "side", "depth", *(f"lo_{c}" for c in binned))

    def at(c: str) -> Column:
        """The place along the longest side, from 0 to 1."""
        return F.when(F.col("side") > 0, (F.col(c) - F.col(f"lo_{c}")) / F.col("side")).otherwise(0.0)

    def cell(c: str, level: str) -> Column:
        fine = F.least(F.floor(at(c) * float(2**BITS)), F.lit(2**BITS - 1)).cast("long")
        return F.call_function("shiftright", fine, F.lit(BITS) - F.col(level)).alias(f"c_{c}")

    w = Window.partitionBy(*place).orderBy("hit_id")
    first = rows.where("_found").select(*place, "hit_id").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= need)
    nodes = first.groupBy(*place).agg(F.sort_array(F.collect_list("hit_id")).alias("ids")).join(box, "event_id")
    grid = nodes.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    grid = grid.select("event_id", "level", *(cell(c, "level") for c in binned), *(F.col(c).alias(f"{NEAR}_{c}") for c in coords), "ids")
    cell_key = ["event_id", "level", *cells]
    crowd = grid.groupBy(*cell_key).agg(F.sum(F.size("ids")).alias("_held")).where(F.col("_held") >= need)

    bound = [shrink.alias("_shrink")] if shrink is not None else []
    asks = rows.where("_asks").select(*probe, *bound).distinct().join(box, "event_id")
    boxed = [*probe, *(["_shrink"] if bound else []), "side", *(f"lo_{c}" for c in binned)]
    levels = asks.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth")))).select("*", *(cell(c, "level") for c in binned))
    levels = levels.join(crowd, cell_key, "left").groupBy(*boxed).agg(F.coalesce(F.max(F.when(F.col("_held").isNotNull(), F.col("level"))), F.lit(0)).alias("level"))

    def met(probes: DataFrame) -> DataFrame:
        """Probes with the nodes of the cells that they name."""
        named = probes.select("*", *(F.col(c).alias(f"{SELF}_{c}") for c in [*coords, *extra]))
        return named.join(grid, cell_key).withColumn("dsq", distance(columns(SELF), columns(NEAR)).cast("double")).where("dsq is not null")

    own_cell = met(levels.select(*boxed, "level", *(cell(c, "level") for c in binned)))
    near = _first(own_cell.select(*boxed, "level", "dsq", "ids"), probe, need)
    far = F.when(F.count("*") >= need, F.max("dsq")).otherwise(float("inf"))
    if radius is not None:
        far = F.least(far, F.lit(radius * radius))
    bounded = near.groupBy(*boxed, "level").agg(far.alias("far"))
    reach = F.sqrt("far") if shrink is None else F.when(F.col("_shrink") > 0, F.sqrt(F.col("far") / F.col("_shrink"))).otherwise(float("inf"))
    share = F.when(F.col("side") > 0, reach / F.col("side")).otherwise(0.0)
    # The reach is two cells at most.
    coarse = F.when(F.col("share") > 0, F.least("level", F.greatest(F.lit(0), F.floor(F.log2(2 / F.col("share"))).cast("int")))).otherwise(F.col("level"))
    reaching = bounded.withColumn("share", share * (1 + 1e-9) + 1e-9).withColumn("level", coarse)
    last = F.pow(F.lit(2.0), F.col("level"))
    for c in binned:
        lo = F.floor(F.greatest(at(c) - F.col("share"), F.lit(0.0)) * last)
        hi = F.least(F.floor(F.least(at(c) + F.col("share"), F.lit(1.0)) * last), (last - 1).cast("long"))
        reaching = reaching.withColumn(f"c_{c}", F.explode(F.sequence(F.least(lo, (last - 1).cast("long")), hi)))
    best = _first(met(reaching).where("dsq <= far").select(*probe, "dsq", "ids"), probe, need)
    best = best.groupBy(*probe).agg(F.collect_list(F.struct("dsq", "nbr_id")).alias("_near"))
    none = F.array().cast(f"array<struct<dsq:double,nbr_id:{rows.schema['hit_id'].dataType.simpleString()}>>")
    out = _slots(rows.where("_asks").join(best, probe, "left"), F.coalesce("_near", none), k, own, radius, ())
    if not carry:
        return out
    mine = rows.select("event_id", "hit_id", *carry)
    other = rows.select("event_id", F.col("hit_id").alias("nbr_id"), *(F.col(c).alias(f"n_{c}") for c in carry))
    return out.join(mine, ["event_id", "hit_id"]).join(other, ["event_id", "nbr_id"]).select(*out.columns, *carry, *(f"n_{c}" for c in carry))


def _nearest(
    hits: DataFrame,
    k: int,
    coords: Sequence[str],
    distance: Distance,
    probes: Column | None = None,
    neighbours: Column | None = None,
    own: str = "first",
    radius: float | None = None,
    carry: Sequence[str] = (),
    extra: Sequence[str] = (),
    shrink: Column | None = None,
    width: float | None = None,
    listed: bool = False,
) -> DataFrame:
    """Small events through arrays, large ones through cells: both give the same rows, as edges or as lists.

    Looking for large events is one job that counts by event_id: without any, the table is read and shuffled once, where
    the plan of the cells alone would shuffle it some twenty times to find nothing.
    """
    masks = {name: F.lit(True) if mask is None else F.coalesce(mask, F.lit(False)) for name, mask in (("_asks", probes), ("_found", neighbours))}
    rows = _placed(hits, coords).withColumns(masks).select("event_id", "hit_id", *coords, *extra, *(c for c in carry if c not in coords), "_asks", "_found")
    arrays = partial(_in_arrays, k=k, coords=coords, distance=distance, extra=extra, own=own, radius=radius, carry=carry)
    shape = (lambda x: x) if listed else (lambda x: exploded(x, *carry))
    large = large_events(rows, SMALL)
    if large is None:
        return shape(arrays(rows))
    small, rest = (rows.join(large, "event_id", how) for how in ("left_anti", "left_semi"))
    cells = _through_cells(rest, k, coords, distance, extra, own, radius, carry, shrink, width)
    return shape(arrays(small)).unionByName(_listed(cells, carry) if listed else cells)


def knn(hits: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z"), probes: Column | None = None, neighbours: Column | None = None, max_radius: float | None = None, own: str = "first", carry: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows of each row's event: event_id, hit_id, nbr_id, dsq, slot.

    probes / neighbours: which rows ask, and which can be found (masks and directions). own: a probe always
    finds itself in slot 0 ("first"), never ("none"), or as any other row ("found"). Ties go to the smaller id. Rows
    without a place (null or not finite in a coordinate) or without event_id take no part. carry: columns of the
    row, and as n_ columns of its neighbour, that edges are to have, so that no join has to fetch them.
    """
    return _nearest(hits, k, coords, squared(coords), probes, neighbours, own, max_radius, carry)


def lists(hits: DataFrame, k: int, coords: Sequence[str] = ("x", "y", "z"), carry: Sequence[str] = (), neighbours: Column | None = None, own: str = "first") -> DataFrame:
    """knn() with the neighbours of a row in one list: event_id, hit_id, the columns of carry, near: array of nbr_id, dsq and n_ columns, by slot.

    What is summed or sought over the neighbours of a row needs no shuffle of edges then.
    """
    return _nearest(hits, k, coords, squared(coords), neighbours=neighbours, own=own, carry=carry, listed=True)


def within(hits: DataFrame, radius: str, coords: Sequence[str] = ("x", "y", "z"), probes: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """lists() of all rows that are nearer than each row's own radius, a column; itself counts as any other. For events of SMALL rows at most."""

    def meets(p: Place, n: Place) -> np.ndarray:
        return squared(coords)(p, n) < p(radius) * p(radius)

    asks = F.lit(True) if probes is None else F.coalesce(probes, F.lit(False))
    rows = _placed(hits, coords).withColumns({"_asks": asks, "_found": F.lit(True)}).select("event_id", "hit_id", *coords, radius, *(c for c in carry if c not in (*coords, radius)), "_asks", "_found")
    return _in_arrays(rows, SMALL, coords, squared(coords), (radius,), "found", None, carry, meets)


def knn_grid(hits: DataFrame, k: int, width: float | None = None, coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """knn() whose finest cells, in large events, have sides of about width (else they follow from the number of rows)."""
    return _nearest(hits, k, coords, squared(coords), width=width)


def knn_warped(hits: DataFrame, k: int, matrix: Sequence[Sequence[Column]], coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Neighbours under each probe's own linear map: matrix[j][i] are columns of the probe.

    A map shrinks no distance below its least singular value, and that is at least |det| * ((n - 1) / s)^((n - 1) / 2) with s
    the sum of squared entries: so far cells are opened in large events. Probes whose map has nulls find only themselves.
    """
    n = len(coords)
    entries = [f"m{j}{i}" for j in range(n) for i in range(n)]
    named = hits.select("event_id", "hit_id", *coords, *(matrix[j][i].cast("double").alias(f"m{j}{i}") for j in range(n) for i in range(n)))

    def distance(p: Place, q: Place) -> Column:
        diff = [p(c) - q(c) for c in coords]
        rows = [sum((p(f"m{j}{i}") * diff[j] for j in range(1, n)), p(f"m0{i}") * diff[0]) for i in range(n)]
        return sum((r * r for r in rows[1:]), rows[0] * rows[0])

    squares = sum((F.col(m) * F.col(m) for m in entries[1:]), F.col("m00") * F.col("m00"))
    det = _determinant([[F.col(f"m{j}{i}") for i in range(n)] for j in range(n)])
    shrink = det * det * (F.pow(F.try_divide(F.lit(float(n - 1)), squares), float(n - 1)) if n > 1 else 1.0) * (1 - 1e-9)
    return _nearest(named, k, coords, distance, extra=entries, shrink=shrink)


def _determinant(m: Sequence[Sequence[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    terms = [m[0][i] * _determinant([[*row[:i], *row[i + 1 :]] for row in m[1:]]) for i in range(len(m))]
    return sum((t if i % 2 == 0 else -t for i, t in enumerate(terms[1:], 1)), terms[0])


def _grid(hits: DataFrame, coords: Sequence[str], width: float) -> DataFrame:
    return hits.withColumns({f"c_{c}": F.floor(F.col(c) / width) for c in coords})


def knn_single_ring(hits: DataFrame, k: int, width: float, coords: Sequence[str] = ("x", "y", "z"), binned: Sequence[str] = ("x", "y")) -> DataFrame:
    """Neighbours among a row's own cell and those around it, self first: approximate.

    Small events go through arrays, events that are large or have rows without a place through an equi-join on cells.
    """

    def ring(p: Place, n: Place) -> np.ndarray:
        near = [abs(np.floor(p(c) / width) - np.floor(n(c) / width)) <= 1 for c in binned]
        return np.logical_and.reduce(near)

    unplaced = F.expr(" or ".join(f"{c} is null or isnan({c}) or abs({c}) = double('inf')" for c in coords))
    odd = hits.groupBy("event_id").agg(F.count("*").alias("_n"), F.max(unplaced).alias("_odd")).where((F.col("_n") > SMALL) | F.col("_odd")).select("event_id")
    if odd.isEmpty():
        return _ring_in_arrays(hits, k, coords, ring)
    small, rest = (hits.join(odd, "event_id", how) for how in ("left_anti", "left_semi"))
    return _ring_in_arrays(small, k, coords, ring).unionByName(_ring_by_join(rest, k, width, coords, binned))


def _ring_in_arrays(hits: DataFrame, k: int, coords: Sequence[str], ring: Distance) -> DataFrame:
    rows = hits.where("event_id is not null").select("event_id", "hit_id", *coords, F.lit(True).alias("_asks"), F.lit(True).alias("_found"))
    return exploded(_in_arrays(rows, k, coords, squared(coords), (), "first", None, (), ring))


def _ring_by_join(hits: DataFrame, k: int, width: float, coords: Sequence[str], binned: Sequence[str]) -> DataFrame:
    grid = _grid(hits, binned, width)
    cells = [f"c_{c}" for c in binned]
    left = grid
    for c in cells:
        left = left.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    pairs = _side(left, SELF, ["event_id", *cells], coords).join(_side(grid, NEAR, ["event_id", *cells], coords), ["event_id", *cells])
    w = Window.partitionBy("event_id", "hit_id").orderBy(F.col("nbr_id") != F.col("hit_id"), "dsq", "nbr_id")
    pairs = pairs.withColumn("dsq", squared(coords)(columns(SELF), columns(NEAR))).select("event_id", "hit_id", "nbr_id", "dsq")
    return pairs.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < k)


def close(hits: DataFrame, radius: float, coords: Sequence[str], binned: Sequence[str] = ("x", "y")) -> DataFrame:
    """Pairs of rows of an event, each once, whose cells of width radius touch: p_ and n_ coordinates, for a condition to follow.

    Rows nearer than radius along every axis of binned are all there. Rows without a place take no part.
    """
    grid = _grid(_placed(hits, coords), binned, radius)
    cells = [f"c_{c}" for c in binned]
    left = grid
    for c in cells:
        left = left.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return _side(left, SELF, ["event_id", *cells], coords).join(_side(grid, NEAR, ["event_id", *cells], coords), ["event_id", *cells]).where("hit_id < nbr_id").drop(*cells)


def mismatches(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per row, k less the neighbours that both edge tables name."""
    # Rows with their few neighbours are joined, and not edges with edges.
    rows, other = (e.groupBy("event_id", "hit_id").agg(F.collect_set("nbr_id").alias(name)) for e, name in ((a, "_a"), (b, "_b")))
    same = F.coalesce(F.size(F.array_intersect("_a", "_b")).cast("long"), F.lit(0))
    return rows.join(other, ["event_id", "hit_id"], "left").select("event_id", "hit_id", (k - F.when(F.col("_b").isNull(), 0).otherwise(same)).alias("mismatches"))
