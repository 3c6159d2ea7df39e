"""Ranked search against a plain score of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hitloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id int, text string, rank string"


def split(text: str | None) -> list[str]:
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(i, Counter(split(t))) for i, t, *_ in docs if split(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in {i for i, *_ in items}:
        asked = [t for i, text in {(i, t) for i, t, *_ in items} if i == item for t in split(text)]
        scored = []
        for doc_id, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard", [1, 300, 1 << 21])
def test_plain_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(ranking, "SHARD", shard)
    rng = random.Random(shard)
    said = ["Alpha", "beta", "GAMMA", "Éclair", "éclair", "x1", "日本", "don't", "a_b", "🙂", "zz"]
    docs = [(i, rng.choice([" ", "\n", "--", "\x7f"]).join(rng.choices(said, k=rng.randrange(30))), "s") for i in range(150)]
    docs += [docs[3], (None, docs[5][1], ""), (None, docs[5][1], ""), (3, "alpha beta", ""), (400, None, ""), (401, "", ""), (402, " .,;", ""), (403, "beta " * 5000, "")]
    items = [(1, "alpha BETA beta", ""), (2, "éclair unknown 日本", ""), (3, None, ""), (4, "nothing here", ""), (None, "gamma don t", ""), (5, "zz", ""), (5, "zz", "again"), (5, "x1 🙂", ""), (6, "", "")]
    got = ranking.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), 20)
    assert found(got) == plain(docs, items, 20)


def test_ties_at_the_last_place(spark):
    docs = [(i, "same words here", "") for i in range(60, 0, -1)] + [(100, "same words", "")]
    items = [(1, "same", ""), (2, "here words", "")]
    got = ranking.search(spark.createDataFrame(docs, DOCS).repartition(6), spark.createDataFrame(items, ITEMS), 20)
    assert found(got) == plain(docs, items, 20)


def test_blocks_of_items(spark, monkeypatch):
    """Small blocks: every item meets every shard once."""
    monkeypatch.setattr(ranking, "BLOCK", 200)
    docs = [(i, f"w{i % 7} w{i % 5} w{i % 3}", "") for i in range(90)]
    items = [(i, f"w{i % 7} w{i}", "") for i in range(12)]
    got = ranking.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 20)
    assert found(got) == plain(docs, items, 20)


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    assert found(ranking.search(docs, items)) == []
    assert found(ranking.search(spark.createDataFrame([(1, "a", "")], DOCS), spark.createDataFrame([], ITEMS))) == []


def test_row_groups_of_the_index_end_by_bytes(spark):
    """Neither who writes shards nor who reads them holds a hundred at once."""
    text = F.expr("concat_ws(' ', transform(sequence(1, 60000), i -> hex(xxhash64(id, i))))")
    shards, documents = ranking.index(spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")))
    files = [pq.ParquetFile(f).metadata for f in Path(shards.written_path.removeprefix("file:")).glob("*.parquet")]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert documents == 40 and sum(g.num_rows for g in groups) > 10
    assert max(g.total_byte_size for g in groups) < 1 << 25
