"""Near-duplicate groups: an exact metric-space join under Jaccard distance.

Distance is 1 - |A & B| / |A | B|, a metric; two sets link within r = 0.2. The join goes so:

1. Equal sets become one class, the point of all later steps.
2. A pivot must be near to be of use, so points look pivots up instead of drawing them blindly: linked
   points share some of their lowest shingles in any fixed order, and the order is frequent ones last.
   Points that share too few with all others have no link and leave. Each shared shingle names one
   pivot, the least point that has it, and each linked pair of points meets at some pivot.
3. A pivot's region holds all points that look it up, with their exact distances. Points within r link
   to the pivot, which settles nearly all of a region at once.
4. Points of a region that are not yet in its largest component are its probes. By the triangle
   inequality a probe at distance d meets points at distances within r of d only: regions are cut in
   rings of width r, and probes are replicated to the neighbouring rings. Rings larger than a block are
   joined block by block; inside a block the join goes on recursively with pivots of its own.

No step sees a pair that is in one component already, so thousands of near copies cost one distance
each. Every task holds one block at most; components come from joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.graph import components
from hitloom.llm.shared import giving_back, group_giving_back, numbered, partitions, written
from hitloom.llm.words import set_key, shingle_sets

#: Likeness of a link as a fraction, and the radius it gives.
NEAR, OF = 80, 100
RADIUS = 1 - NEAR / OF + 1e-9
#: Share of a set that points look pivots up with, beyond the 20 % that linked sets may differ in.
EXTRA = 0.06
#: A shingle of at least this share of all rows is frequent: at most mean set size / share of them exist.
FREQUENT = 0.002
#: Points of a block on either side.
BLOCK = 256
#: Rows of a local count, and pairs of a reduce group on average.
FLUSH, PAIRS = 2_000_000, 1_000_000


def _need(n: np.ndarray | int) -> np.ndarray | int:
    """Least intersection of a set of n with any set that it links to."""
    return -(-n * NEAR // OF)


def window(n: int) -> tuple[int, int]:
    """How many of a set's first shingles are looked up, and how many of them a linked set has in its own window."""
    more = int(np.ceil(EXTRA * n))
    least = max(1, int(np.ceil(EXTRA * np.ceil(n * NEAR / OF))))  # the other set may be that much smaller
    return n - int(_need(n)) + more, min(more, least)


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return shingle_sets(batch["text"].to_pylist())


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (its id, set size and set key), and locally frequent shingles with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])
    kept: list[np.ndarray] = []
    size = docs = 0

    def frequent() -> pa.RecordBatch:
        flat = np.concatenate(kept)
        flat.sort()
        begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        count = np.diff(np.append(begin, len(flat)))
        take = count >= max(2, FREQUENT * docs / 2)
        h = pa.array(flat[begin[take]].view(np.int64))
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, none, h, pa.array(count[take])], schema=schema)

    for batch in batches:
        n, k1, k2 = [], [], []
        for hashes in _rows(batch):
            a, b = set_key(hashes)
            n.append(len(hashes)), k1.append(a), k2.append(b)
            kept.append(hashes)
            size, docs = size + len(hashes), docs + 1
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), none, none], schema=schema)
        if size >= FLUSH:
            yield frequent()
            kept, size, docs = [], 0, 0
    if size:
        yield frequent()


def _windows(often: np.ndarray, buckets: int):
    """Looked-up pairs (shingle, point), packed by bucket of the shingle; points that look up frequent ones name them in bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            h, k = (np.concatenate(x) for x in zip(*kept))
            at = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((k, h, at))
            h, k, at = h[order], k[order], at[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            h, k, at = h[fresh], k[fresh], at[fresh]
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() + [len(h)]
            blobs = [h[x:y].tobytes() + k[x:y].tobytes() for x, y in zip(begin, begin[1:])]
            return pa.RecordBatch.from_arrays([pa.array(at[begin[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "pairs"])

        for batch in batches:
            for hashes in _rows(batch):
                if not len(hashes):
                    continue
                point = set_key(hashes)[0]
                many = hashes[np.isin(hashes, often, assume_unique=True)] if len(often) else hashes[:0]
                take = window(len(hashes))[0]
                rare = (np.setdiff1d(hashes, many, assume_unique=True) if len(many) else hashes)[:take]
                kept.append((rare, np.full(len(rare), point, np.int64)))
                size += len(rare)
            if size >= FLUSH // 4:
                yield packed()
                kept, size = [], 0
        if size:
            yield packed()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: the pairs whose shingle belongs to two points or more, with the number of points."""
    blobs = [np.frombuffer(b, np.int64).reshape(2, -1) for b in table["pairs"].to_pylist()]
    h, k = np.concatenate(blobs, axis=1)
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k = h[fresh], k[fresh]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(begin, len(h)))
    per = np.repeat(count, count)
    return pa.table({"k": k[per > 1], "h": h[per > 1], "c": per[per > 1]})


def _chosen(often: np.ndarray):
    """Sets of points and the shingles to look pivots up with; points that cannot link give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for hashes, want, shared, counts in zip(_rows(batch), batch["k"].to_pylist(), batch["hs"].to_pylist(), batch["cs"].to_pylist()):
                n = len(hashes)
                if not n or set_key(hashes)[0] != want:
                    continue
                take, least = window(n)
                many = hashes[np.isin(hashes, often, assume_unique=True)] if len(often) else hashes[:0]
                more = many[: max(0, take - (n - len(many)))]
                h = np.concatenate([np.array(shared or [], np.int64), more.view(np.int64)])
                c = np.concatenate([np.array(counts or [], np.int64), np.full(len(more), 1 << 62)])
                if len(h) < least:
                    continue
                first = np.lexsort((h, c))[: len(h) - least + 1]
                out.append((want, n, hashes.view(np.int64), h[first]))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))],
                names=["k", "n", "hashes", "looks"],
            )

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p, k = batch["ph"], batch["kh"]
        common = [
            len(np.intersect1d(p[i].values.to_numpy(), k[i].values.to_numpy(), assume_unique=True)) for i in range(batch.num_rows)
        ]
        both = pa.array(common, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["p"], batch["k"], batch["pn"], batch["n"], both], names=["p", "k", "pn", "n", "both"])


def linked(both: np.ndarray, n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return OF * both >= NEAR * (n + m - both)


def region_links(points: list[np.ndarray], probes: list[np.ndarray]) -> list[tuple[int, int]]:
    """All (probe, point) within the radius, by pivots, their cells and triangle windows, down to small regions."""
    sizes, probe_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (points, probes))

    def common(left: list[int], right: list[int]) -> np.ndarray:
        """Intersection sizes, probes (or points) in left against points in right."""
        flat = np.concatenate([points[j] for j in right])
        owner = np.repeat(np.arange(len(right)), sizes[right])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = np.zeros((len(left), len(right)), np.int64)
        for row, own in enumerate(left):
            a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            hit = b > a
            for x, y in zip(a[hit].tolist(), b[hit].tolist()):
                out[row, owner[x:y]] += 1
        return out

    def distance(left: list[np.ndarray], sizes_left: np.ndarray, right: list[int]) -> np.ndarray:
        both = common(left, right)
        return 1 - both / (sizes_left[:, None] + sizes[right][None] - both)

    def brute(own: list[int], asked: list[int]) -> list[tuple[int, int]]:
        both = common([probes[i] for i in asked], own)
        hit = linked(both, probe_sizes[asked][:, None], sizes[own][None])
        return [(asked[i], own[j]) for i, j in zip(*np.nonzero(hit))]

    def join(own: list[int], asked: list[int]) -> list[tuple[int, int]]:
        if not own or not asked:
            return []
        if len(own) <= 32 or len(asked) <= 4:
            return brute(own, asked)
        pivots = own[:: -(-len(own) // 6)]
        near = distance([points[j] for j in own], sizes[own], pivots)
        far = distance([probes[i] for i in asked], probe_sizes[asked], pivots)
        cell = near.argmin(axis=1)
        found: list[tuple[int, int]] = []
        for c in range(len(pivots)):
            mine = np.flatnonzero(cell == c)
            if not len(mine):
                continue
            reach = near[mine, c]
            come = np.flatnonzero((far[:, c] <= reach.max() + RADIUS) & (far[:, c] >= reach.min() - RADIUS))
            inner, outer = [own[j] for j in mine], [asked[i] for i in come]
            found += join(inner, outer) if len(inner) < 0.7 * len(own) else brute(inner, outer)
        return found

    return join(list(range(len(points))), list(range(len(probes))))


def _block_links(table: pa.Table) -> pa.Table:
    probe = np.array(table["probe"].to_pylist(), bool)
    k, comp = table["k"].to_numpy(), table["comp"].to_numpy()
    rows = [x.values.to_numpy() for x in table["hashes"]]
    mine, asked = np.flatnonzero(~probe), np.flatnonzero(probe)
    pairs = {}
    for i, j in region_links([rows[x] for x in mine], [rows[x] for x in asked]):
        a, b = asked[i], mine[j]
        if comp[a] != comp[b]:
            pairs[(k[a], comp[b])] = (k[a], k[b])  # one link of a probe with a component is enough
    found = list(pairs.values())
    return pa.table({"a": pa.array([int(x) for x, _ in found], pa.int64()), "b": pa.array([int(y) for _, y in found], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and component (a key of the group) of every row of docs(doc_id, text).

    Null, empty and blank texts have no shingles, link with nothing and are components of their own. Rows
    with equal sets are always linked; repeated rows give repeated rows. Null doc_ids are passed over
    when the smallest is sought and a component of nothing else has a null id. Other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    seen = written(hashed.mapInArrow(giving_back(_described), "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, h long, c long"))
    described = seen.where("h is null").select("doc_id", "text_hash", "n_shingles", "k1", "k2")
    total = described.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    counts = seen.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(8, FREQUENT * total.rows))
    often = np.sort(np.array([r.h for r in counts.select("h").collect()], np.int64).view(np.uint64))
    buckets = max(partitions(spark), 48, total.shingles // PAIRS)

    classes = described.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.xxhash64("doc_id", "text_hash")).alias("row"))
    shared = (
        rows.mapInArrow(giving_back(_windows(often, buckets)), "bucket int, pairs binary").groupBy("bucket").applyInArrow(group_giving_back(_shared), "k long, h long, c long")
    )
    looked = written(shared.groupBy("k").agg(F.collect_list("h").alias("hs"), F.collect_list("c").alias("cs")))
    # A class is read from one of its rows, known by id and text: many rows may share an id or have none.
    points = classes.select(F.col("k1").alias("k"), "row")
    # Points that look up nothing shared may still have frequent shingles only.
    asked = points.join(looked, "k", "left") if len(often) else points.join(looked, "k")
    texts = hashed.select(F.xxhash64("doc_id", "text_hash").alias("row"), "text")
    found = asked.join(texts, "row").select("k", "hs", "cs", "text").mapInArrow(giving_back(_chosen(often)), "k long, n long, hashes array<long>, looks array<long>")
    chosen = written(found.dropDuplicates(["k"]))  # rows may be repeated
    sets = chosen.select("k", "n", "hashes")
    looks = chosen.select("k", F.explode("looks").alias("h"))
    pivot = looks.groupBy("h").agg(F.min("k").alias("p"), F.max("k").alias("other")).where("p <> other").select("h", "p")
    meets = written(looks.join(pivot, "h").where("p <> k").select("p", "k").distinct())
    centre = sets.select(F.col("k").alias("p"), F.col("n").alias("pn"), F.col("hashes").alias("ph"))
    met = meets.join(sets.withColumnRenamed("hashes", "kh"), "k").join(centre, "p")
    regions = written(
        met.select("p", "k", "pn", "n", "ph", "kh")
        .mapInArrow(giving_back(_distances), "p long, k long, pn long, n long, both long")
        .withColumn("d", 1 - F.col("both") / (F.col("n") + F.col("pn") - F.col("both")))
    )
    direct = regions.where(F.expr(f"{OF} * both >= {NEAR} * (n + pn - both)")).select(F.col("p").alias("a"), F.col("k").alias("b"))
    labels = components(direct)
    more = written(_ring_links(regions, sets, labels))
    if more.limit(1).count():
        labels = components(more, labels)

    lowest = classes.select(F.col("k1").alias("node"), "k2", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = lowest.select(F.col("node").alias("k1"), "k2", "label").join(lowest.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label")
    return described.join(lowest.select("k1", "k2", "label", "component_id"), ["k1", "k2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_hash",
        F.col("label").alias("component"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (null ones last, ties by text).

    Rows without words belong to no group and stay; all columns stay.
    """
    inner, new, old = numbered(docs)
    doc_id, text = (F.col(new[old.index(c)]) for c in ("doc_id", "text"))
    inner = inner.withColumns({"doc_id": doc_id.cast("long"), "text": text.cast("string")})
    id_ = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), "text_hash")
    kept = near_duplicates(inner).where("component is not null").groupBy("component").agg(F.min(id_).alias("first")).select("first.*")
    keys = ["no_id", "id", "text_hash"]
    own = inner.withColumns({"no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "text_hash": F.xxhash64("text")})
    first = own.join(kept, keys, "left_semi").dropDuplicates(keys)
    blank = inner.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return first.select(new).unionByName(blank.select(new)).toDF(*old)


def _ring_links(regions: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between points of one region that its pivot has not brought together."""
    named = labels.select(F.col("node").alias("k"), "label")
    member = regions.select("p", "k", "n", "d").join(named, "k", "left").withColumn("comp", F.coalesce("label", "k")).drop("label")
    member = written(member.withColumn("ring", F.floor(F.col("d") / (RADIUS + 1e-6)).cast("int")))
    largest = member.groupBy("p", "comp").count().groupBy("p").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("parts"))
    open_ = largest.where("parts > 1").select("p", "main")
    inside = member.join(open_, "p")
    probes = inside.where("comp <> main").withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    size = inside.groupBy("p", "ring").agg(F.count("*").alias("m")).join(probes.groupBy("p", "ring").agg(F.count("*").alias("q")), ["p", "ring"])
    size = size.select("p", "ring", F.ceil(F.col("m") / BLOCK).alias("bm"), F.ceil(F.col("q") / BLOCK).alias("bq"))
    keys = ["p", "ring", "x", "y"]

    def dealt(df: DataFrame, own: str, other: str, x: str, y: str, probe: bool) -> DataFrame:
        return (
            df.join(size, ["p", "ring"])
            .withColumn(x, F.pmod(F.xxhash64("k"), F.col(own)))
            .withColumn(y, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
            .select(*keys, "k", "comp", F.lit(probe).alias("probe"))
        )

    both = dealt(inside, "bm", "bq", "x", "y", False).unionByName(dealt(probes, "bq", "bm", "y", "x", True))
    return both.join(sets.select("k", "hashes"), "k").groupBy(*keys).applyInArrow(_block_links, "a long, b long")
