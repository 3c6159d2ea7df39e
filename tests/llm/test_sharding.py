"""Shards against their law."""

from __future__ import annotations

import zlib
from collections import Counter

from hitloom.llm import sharding

SCHEMA = "doc_id long, text string, shard int, slot long, h string"


def run(spark, rows, shards=40):
    return sharding.shard_by_bytes(spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA), shards).collect()


def test_bytes_are_balanced(spark):
    rows = [(i, f"text number {i} é" * (1 + i % 7)) for i in range(3000)] + [(10_000 + i, "the same text" * 3) for i in range(1500)]
    rows += [(None, None), (20_000, None), (20_001, ""), (20_002, "lone"), (20_002, "lone")]
    got = run(spark, rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    mean = sum(total.values()) / 40
    assert set(total) == set(range(40)) and max(abs(x - mean) for x in total.values()) < 0.25 * mean
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_few_rows(spark):
    assert run(spark, []) == []
    (one,) = run(spark, [(None, None)])
    assert (one.size, one.slot, one.shard in range(40)) == (16, 0, True)


def test_against_a_plain_version(spark):
    import random
    import zlib
    from bisect import bisect_right

    import xxhash

    from hitloom.llm import sharding

    rng = random.Random(8)
    rows = [(i, rng.choice(["", None, "same text " * 5, "é" * rng.randrange(300), "".join(rng.choices("abc ", k=rng.randrange(500)))])) for i in range(700)]
    rows += [(None, "x"), (3, "x"), (3, "x")]

    def key(row: tuple) -> tuple:
        d, t = row
        h = 42 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest()
        return (h - (h >> 63 << 64), zlib.crc32((t or "").encode()), d is not None, d or 0)

    placed, first = [], 0
    for row in sorted(rows, key=key):
        size = len((row[1] or "").encode()) + 16
        placed.append((row, size, first))
        first += size
    targets = [first * k // 40 for k in range(1, 40)]
    groups: dict[tuple, list] = {}
    for row, size, at in placed:
        groups.setdefault(key(row)[:2], []).append((at, at + size))
    ends = {g: (min(a for a, _ in v), max(b for _, b in v)) for g, v in groups.items()}
    want, count = [], {}
    for row, size, at in placed:
        own = [bisect_right(targets, a) for a, _ in groups[key(row)[:2]]]
        lo, hi = ends[key(row)[:2]]
        shard = bisect_right(targets, at)
        if min(own) < max(own) and hi - lo <= 0.1 * first / 40:
            shard = bisect_right(targets, (lo + hi) // 2)
        count[shard] = count.get(shard, -1) + 1
        want.append((row[0], size, key(row)[1], "bytes", shard, count[shard], None))
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
