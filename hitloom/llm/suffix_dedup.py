"""Removal of long repeated strings through suffix arrays.

A byte goes if a string of WIDTH bytes that covers it also starts anywhere else. All strings of WIDTH bytes
are dealt to shards by content, so that equal ones meet: a string's anchor is its run of GRAM bytes with
the least hash, and the starts whose strings share an anchor are a context. Equal strings have equal anchors,
so a string whose anchor occurs once in the whole table occurs once, and is dropped before any bytes move.

Each shard builds a suffix array of its contexts (Larsson-Sadakane refinement: only groups that are still
tied are sorted again, by the rank h bytes on, h doubling) and Kasai's common prefixes, with one lane a
context. Neighbours in the array that share WIDTH bytes are equal strings.

An anchor that very many texts share would fill a shard. Such anchors are dealt to many shards; their
strings that occur once in their shard are then merged across shards, by binary search in sorted keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.shared import giving_back, group_giving_back, numbered, partitions, written
from hitloom.llm.words import PLACES, mixed, prefix_hash, span_hash

#: Bytes of a repeated string, and of the runs that anchors are chosen from.
WIDTH, GRAM = 200, 56
#: Bytes of a block that is hashed at once, of a piece of a long text, of contexts that a task collects, and of a shard's contexts on average.
BLOCK, PIECE, COLLECTED, SHARD = 1 << 18, 1 << 17, 1 << 24, 1 << 20
#: Anchors of a local count; an anchor is frequent from this share of all anchors, so at most 1 / share are.
FLUSH, FREQUENT = 400_000, 1 / 20_000
LEAST_FREQUENT = 30

#: A row is known by its doc_id (or NO_ID) and a hash of its text.
KEY, NO_ID = ["key", "key2"], -(1 << 63)
SPANS = "key long, key2 long, lo long, hi long, c1 long, c2 long"


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every full window."""
    n = len(x)
    pad = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of starts with one anchor: text number, first start, number of starts, hash of the anchor."""
    units = [(k, at, t[at : at + PIECE + WIDTH - 1]) for k, t in enumerate(texts) for at in range(0, max(0, len(t) - WIDTH + 1), PIECE)]
    out = []
    for first, last in _blocks([len(u[2]) for u in units]):
        part = units[first:last]
        data = np.frombuffer(b"".join(u[2] for u in part), np.uint8)
        length = np.fromiter((len(u[2]) for u in part), np.int64, len(part))
        begin = np.cumsum(length) - length
        run = prefix_hash(data)
        at = np.arange(len(data) - GRAM + 1)
        grams = span_hash(run, at, at + GRAM)
        low = np.uint64((1 << 21) - 1)
        best = sliding_minimum((grams & ~low) | at.astype(np.uint64), WIDTH - GRAM + 1)
        anchor = (best & low).astype(np.int64)
        unit = np.repeat(np.arange(len(part)), length)[: len(anchor)]
        start = np.arange(len(anchor)) - begin[unit]
        fine = start <= length[unit] - WIDTH
        starts, unit, anchor, start = np.flatnonzero(fine), unit[fine], anchor[fine], start[fine]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (unit[1:] != unit[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(starts)))
        number, offset = (np.fromiter((u[i] for u in part), np.int64, len(part)) for i in (0, 1))
        out.append((number[unit[head]], offset[unit[head]] + start[head], count, grams[anchor[head]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


def _blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for k, n in enumerate(lengths):
        if total and total + n > BLOCK:
            yield first, k
            first, total = k, 0
        total += n
    if lengths:
        yield first, len(lengths)


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchors(buckets: int):
    """Packed anchors by bucket: kind 0 seen once here, kind 1 counts of those seen more often, kind 2 the places of the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0

        def packed() -> Iterator[pa.RecordBatch]:
            key, key2, pos, h = (np.concatenate(c) for c in zip(*kept))
            order = np.argsort(h, kind="stable")
            key, key2, pos, h = key[order], key2[order], pos[order], h[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(head, len(h)))
            once = np.repeat(count == 1, count)
            many = head[count > 1]
            by = lambda x: (x.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for kind, at, cols in (
                (0, by(h[once]), (h[once], key[once], key2[once], pos[once])),
                (1, by(h[many]), (h[many], count[count > 1])),
                (2, by(mixed(key[~once].view(np.uint64)).view(np.int64)), (h[~once], key[~once], key2[~once], pos[~once])),
            ):
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, cols = at[order], [c[order] for c in cols]
                edge = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist(), len(at)]
                blobs = [b"".join(c[x:y].tobytes() for c in cols) for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at[edge[:-1]], pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "packed"])

        for batch in batches:
            keys, keys2 = (batch[k].to_numpy() for k in KEY)
            number, start, count, h = contexts(_raw(batch["text"]))
            kept.append((keys[number], keys2[number], start * 256 + count, h))
            size += len(h)
            if size >= FLUSH:
                yield from packed()
                kept, size = [], 0
        if size:
            yield from packed()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: places of anchors that occur again, and counts of anchors with many places (key null)."""
    kinds, blobs = table["kind"].to_pylist(), table["packed"].to_pylist()
    rows = {k: np.concatenate([np.frombuffer(b, np.int64).reshape(2 if k == 1 else 4, -1) for b, x in zip(blobs, kinds) if x == k] or [np.zeros((2 if k == 1 else 4, 0), np.int64)], axis=1) for k in range(3)}
    h, key, key2, pos = rows[0]
    name, back = np.unique(np.concatenate([h, rows[1][0]]), return_inverse=True)
    count = np.bincount(back, np.concatenate([np.ones(len(h)), rows[1][1]])).astype(np.int64)
    again = count[back[: len(h)]] > 1
    many = count >= LEAST_FREQUENT
    none = pa.nulls(int(many.sum()), pa.int64())
    return pa.table(
        {
            "key": pa.concat_arrays([pa.array(np.concatenate([key[again], rows[2][1]])), none]),
            "key2": pa.concat_arrays([pa.array(np.concatenate([key2[again], rows[2][2]])), none]),
            "pos": np.concatenate([pos[again], rows[2][3], count[many]]),
            "h": np.concatenate([h[again], rows[2][0], name[many]]),
        }
    )


def _dealt(often: dict[int, int], shards: int):
    """Contexts' bytes by shard; equal ones of a task travel once with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, bytes, bool], list[int]] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            shard, text, hot = zip(*kept)
            places = [np.array(v, np.int64).tobytes() for v in kept.values()]
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(text, pa.binary()), pa.array(hot), pa.array(places, pa.binary())], names=["shard", "bytes", "hot", "places"])

        for batch in batches:
            for key, key2, raw, pos, hs in zip(batch["key"].to_pylist(), batch["key2"].to_pylist(), _raw(batch["text"]), batch["pos"].to_pylist(), batch["hs"].to_pylist()):
                for p, h in zip(pos, hs):
                    at, n = p >> 8, p & 255
                    salts = often.get(h, 0)
                    shard = (h + (key % salts + 1) * 0x9E3779B1 if salts else h) % shards
                    part = raw[at : at + n + WIDTH - 1]
                    kept.setdefault((shard, part, salts > 0), []).extend((key, key2, at))
                    size += len(part)
            if size >= COLLECTED:
                yield packed()
                kept, size = {}, 0
        if kept:
            yield packed()

    return run


def suffix_array(data: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted suffixes of data and their ranks. words: the eight bytes from each place on, as one number."""
    n = len(data)
    sa = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    key, h = words[sa], 8
    while True:
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
        where = np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))
        rank[sa[slots]] = slots[where]
        alone = head & np.append(head[1:], True)
        slots = slots[~alone]
        if not len(slots):
            return sa, rank
        own = sa[slots]
        # Suffixes that end within h bytes come first, the shortest before all.
        next_ = np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + h + 1, n - own)
        key = (rank[own].astype(np.uint64) << np.uint64(32)) | next_.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sa[slots], key = own[order], key[order]
        h *= 2


def common_prefixes(words: np.ndarray, sa: np.ndarray, rank: np.ndarray, begin: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Kasai: at each place, how many bytes its suffix shares with the one before it in the array, up to most.

    A suffix shares at least one byte less than the suffix one place before it did. Lanes (begin, length) are
    walked in step; a lane's first suffix starts from nothing.
    """
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    lanes = np.argsort(-length, kind="stable")
    begin, length = begin[lanes], length[lanes]
    shared = np.zeros(len(begin), np.int64)
    padded = np.concatenate([words, np.zeros(most + 8, words.dtype)])
    for step in range(int(length.max(initial=0))):
        active = int(np.searchsorted(-length, -step))
        at = begin[:active] + step
        other = before[at]
        have = np.maximum(shared[:active] - 1, 0)
        have[other < 0] = 0
        grow = np.flatnonzero((other >= 0) & (have < most))
        while len(grow):
            a, b = at[grow] + have[grow], other[grow] + have[grow]
            differ = padded[a] ^ padded[b]
            same = differ == 0
            # Leading equal bytes of the eight: their top byte is the first one.
            partial = grow[~same]
            have[partial] += 7 - np.floor(np.log2(np.maximum(differ[~same], 1).astype(np.float64))).astype(np.int64) // 8
            have[grow[same]] += 8
            grow = grow[same]
            grow = grow[have[grow] < most]
        end = n - np.maximum(at, other)
        have = np.minimum(np.minimum(have, most), end)
        shared[:active] = have
        out[at] = have
    return out


def _words(data: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(data)]
    return out


def equal_strings(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, class) of every string of WIDTH bytes in parts; equal strings share a class."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    begin = np.cumsum(length) - length
    words = _words(data)
    sa, rank = suffix_array(data, words)
    shared = common_prefixes(words, sa, rank, begin, length, WIDTH)
    number = np.empty(len(data), np.int64)
    number[sa] = np.cumsum(shared[sa] < WIDTH)
    part = np.repeat(np.arange(len(parts)), length - WIDTH + 1)
    starts = np.arange(len(part)) - np.repeat(np.cumsum(length - WIDTH + 1) - (length - WIDTH + 1), length - WIDTH + 1)
    return part, starts, number[begin[part] + starts]


def _settled(table: pa.Table) -> pa.Table:
    """Of one shard: spans of strings that occur again in it; single strings of frequent anchors with their key; and the
    keys of those anchors' repeated strings (key null)."""
    places: dict[bytes, list[bytes]] = {}
    hot: dict[bytes, bool] = {}
    for text, own, often in zip(table["bytes"].to_pylist(), table["places"].to_pylist(), table["hot"].to_pylist()):
        places.setdefault(text, []).append(own)
        hot[text] = often
    parts = list(places)
    owners = [np.frombuffer(b"".join(v), np.int64).reshape(-1, 3) for v in places.values()]
    times = np.fromiter(map(len, owners), np.int64, len(owners))
    part, start, number = equal_strings(parts)
    _, back = np.unique(number, return_inverse=True)
    total = np.bincount(back, times[part])[back]
    again = total > 1
    out: list[list[np.ndarray]] = [[] for _ in range(6)]

    def add(key, key2, lo, hi, c1, c2) -> None:
        for col, x in zip(out, (key, key2, lo, hi, c1, c2)):
            col.append(np.asarray(x, np.int64))

    # Runs of repeated starts in one context.
    head = again.copy()
    head[1:] &= ~(again[:-1] & (part[1:] == part[:-1]))
    tail = again.copy()
    tail[:-1] &= ~(again[1:] & (part[1:] == part[:-1]))
    for p, lo, hi in zip(part[head].tolist(), start[head].tolist(), start[tail].tolist()):
        own = owners[p]
        none = np.zeros(len(own), np.int64)
        add(own[:, 0], own[:, 1], own[:, 2] + lo, own[:, 2] + hi + WIDTH, none, none)
    is_hot = np.fromiter((hot[p] for p in parts), bool, len(parts))
    keys: list[tuple[np.ndarray, np.ndarray]] = []
    absent = 0
    if is_hot.any():
        data = np.frombuffer(b"".join(parts), np.uint8)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        run, begin = prefix_hash(data), np.cumsum(length) - length
        at = begin[part] + start
        c1 = span_hash(run, at, at + WIDTH)
        c2 = mixed(c1 + PLACES[0]) ^ span_hash(run, at, at + WIDTH // 2)
        single = is_hot[part] & ~again
        first = np.array([o[0] for o in owners]) if owners else np.zeros((0, 3), np.int64)
        lo = first[part[single], 2] + start[single]
        add(first[part[single], 0], first[part[single], 1], lo, lo + WIDTH, c1[single].view(np.int64), c2[single].view(np.int64))
        told = np.unique(np.stack([c1[is_hot[part] & again], c2[is_hot[part] & again]]), axis=1) if (is_hot[part] & again).any() else np.zeros((2, 0), np.uint64)
        absent = told.shape[1]
        keys.append((told[0].view(np.int64), told[1].view(np.int64)))
        none = np.zeros(absent, np.int64)
        add(none, none, none, none, *keys[0])
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    mask = np.zeros(len(cols[0]), bool)
    mask[len(mask) - absent :] = absent > 0
    return pa.table({"key": pa.array(cols[0], pa.int64(), mask=mask)} | dict(zip(("key2", "lo", "hi", "c1", "c2"), cols[1:])))


def _merged(table: pa.Table) -> pa.Table:
    """Of one range of string keys: the single strings whose key another shard has too, by binary search."""
    # The ranks of both halves in one number stand for all 128 bits.
    c1, c2 = (np.unique(table[c].to_numpy(), return_inverse=True)[1] for c in ("c1", "c2"))
    mine = c1 * len(c1) + c2
    both = np.sort(mine)
    again = np.searchsorted(both, mine, "right") - np.searchsorted(both, mine, "left") > 1
    keep = again & ~np.asarray(table["key"].is_null())
    return table.select([*KEY, "lo", "hi"]).filter(pa.array(keep))


def repeats(rows: DataFrame) -> DataFrame:
    """KEY and spans (byte ranges to remove, in any order) of rows(key, key2, text) in which strings occur again.

    KEY stands for a row; rows with equal ones must have equal texts, and count as often as they occur.
    """
    spark = rows.sparkSession
    parts = max(partitions(spark), 48)
    seen = rows.where(F.octet_length("text") >= WIDTH).select(*KEY, "text")
    found = written(seen.mapInArrow(giving_back(_anchors(parts)), "bucket int, kind int, packed binary").groupBy("bucket").applyInArrow(group_giving_back(_repeated), "key long, key2 long, pos long, h long"))
    placed = found.where("key is not null")
    size = placed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr(f"pos % 256 + {WIDTH - 1}")), F.lit(0)).alias("bytes")).first()
    least = max(LEAST_FREQUENT, int(size.n * FREQUENT))
    often = {r.h: int(r.pos // least + 1) for r in found.where(F.col("key").isNull() & (F.col("pos") >= least)).collect()}
    shards = max(parts, size.bytes // SHARD)
    listed = placed.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "h")).alias("x")).select(*KEY, F.col("x.pos").alias("pos"), F.col("x.h").alias("hs"))
    moved = seen.join(listed, KEY).select(*KEY, "text", "pos", "hs").mapInArrow(giving_back(_dealt(often, shards)), "shard int, bytes binary, hot boolean, places binary")
    spans = written(moved.groupBy("shard").applyInArrow(group_giving_back(_settled), SPANS))
    final = spans.where("key is not null and c1 = 0 and c2 = 0").select(*KEY, "lo", "hi")
    if often:
        open_ = spans.where("c1 <> 0 or c2 <> 0").withColumn("range", F.pmod("c1", F.lit(parts)))
        final = final.unionByName(open_.groupBy("range").applyInArrow(group_giving_back(_merged), "key long, key2 long, lo long, hi long"))
    return final.groupBy(*KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def joined_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans as separate runs in order."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with the spans of each row; a null text is empty."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "key2": F.xxhash64("_text")})
    return rows.join(repeats(rows.select(*KEY, F.col("_text").alias("text"))), KEY, "left").drop(*KEY)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text).

    A null text is empty and has no bytes. Repeated rows are copies of each other: from WIDTH bytes on all of
    them goes. Null doc_ids stay null, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, sha = [], [], [], []
            for raw, found in zip(_raw(batch["_text"]), batch["spans"].to_pylist()):
                runs = joined_runs(found)
                size.append(len(raw)), gone.append(sum(b - a for a, b in runs)), spans.append(len(runs))
                sha.append(hashlib.sha256(without(raw, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", "_text", "spans").mapInArrow(giving_back(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes cut from text; all rows and columns stay, and a null text stays null.

    Characters of which a cut leaves only some bytes go with them.
    """
    inner, columns, names = numbered(docs)
    at = columns[names.index("text")]
    found = _with_spans(inner.withColumns({"doc_id": F.col(columns[names.index("doc_id")]), "text": F.col(at)})).drop("doc_id", "text")
    kept = found.select(*columns, "_text", "spans")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[: len(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if old is None else without(raw, joined_runs(spans)).decode(errors="ignore")
                for old, raw, spans in zip(batch[at].to_pylist(), _raw(batch["_text"]), batch["spans"].to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == at else batch[c] for c in columns], names=columns)

    return kept.mapInArrow(giving_back(run), schema).toDF(*names)
