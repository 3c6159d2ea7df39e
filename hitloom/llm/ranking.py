"""Ranked lexical search over document shards of impact-weighted postings.

Documents are cut into shards of bounded text. A shard is one row of a table: its terms, and for each of them the
documents that hold it with their integer impacts, one after the other (compressed sparse rows). Impacts need nothing
but the number of documents and of terms in all, so they are computed once, when the index is built.

A block of queries meets every shard. Term by term, weight times impact is added to one dense array of the shard's
documents for each query; a partition at the k-th score that keeps all its ties selects the best. A task
carries the k best of each query from shard to shard, and only these are merged over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hitloom.llm.shared import giving_back, written

#: Bytes of terms of a shard (a longer document ends the shard that it is in), and of a block of queries.
SHARD, BLOCK = 1 << 21, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of ASCII that are no letter or digit part terms; all others belong to terms, A-Z as a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "ids array<long>, terms array<binary>, held array<int>, places binary, impacts binary"
FOUND = "item_id {kind}, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents, total = 0, 0
    for batch in batches:
        for text in batch["text"]:
            n = len(terms(text.as_py() or ""))
            documents, total = documents + (n > 0), total + n
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "terms"])


def sizes(docs: DataFrame) -> tuple[int, int]:
    """The documents with a term, and all their terms with repeats."""
    row = docs.select("text").mapInArrow(giving_back(_counted), "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _indexed(documents: int, total: int):
    """Shards of documents in the order in which they come."""

    def shard(ids: list, owner: np.ndarray, term: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
        n = np.bincount(owner, minlength=len(ids))
        # Both factors stay far below 2**63; div rounds down, as all is positive.
        m = 75 + np.array([25 * x * documents // total for x in n.tolist()], np.int64)
        key, tf = np.unique(term * len(ids) + owner, return_counts=True)
        place = key % len(ids)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
        held = np.bincount(key // len(ids), minlength=len(names))
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([names], pa.list_(pa.binary())), pa.array([held.tolist()], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([place.astype("<i4").tobytes()]), pa.array([impact.astype("<i4").tobytes()])], names=["ids", "terms", "held", "places", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, owner, term, known, size = [], [], [], {}, 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = terms(text.as_py() or "")
                if not words:
                    continue
                owner.append(np.full(len(words), len(ids)))
                term.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                ids.append(doc_id)
                size += sum(map(len, words))
                if size >= SHARD:
                    yield shard(ids, np.concatenate(owner), np.concatenate(term), list(known))
                    ids, owner, term, known, size = [], [], [], {}, 0
        if ids:
            yield shard(ids, np.concatenate(owner), np.concatenate(term), list(known))

    return run


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The shards of docs(doc_id, text) as a table in the shared folder, and the number of documents with a term.

    held: how many of the shard's documents hold each term; places and impacts: these documents' places in ids and
    their impacts, term after term. Documents without a term are in no shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, total = sizes(rows)
    return written(rows.mapInArrow(giving_back(_indexed(documents, total)), INDEX), large_rows=True), documents


def questions(items: DataFrame, shards: DataFrame, documents: int) -> DataFrame:
    """item_id and its terms as (term, gain) of items(item_id, text): gain is the term's weight times its count in the item.

    Terms that no document holds and null texts drop out. Rows of one item_id are one item, equal rows once.
    """
    said = items.select("item_id", F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM_PATTERN), 0)).alias("term"))
    asked = said.groupBy("item_id", F.col("term").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    held = shards.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held").alias("held"))
    # The few terms that are asked for are looked up before counts of all terms would be shuffled.
    known = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    return asked.join(known, "term").select("item_id", "term", (weight * F.col("times")).alias("gain"))


def blocks(asked: DataFrame) -> tuple[DataFrame, int]:
    """Items with their terms in blocks of about BLOCK bytes, as rows (block, items), and the number of blocks.

    An item is dealt to its block by a hash, whole.
    """
    size = asked.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    many = math.ceil(size / BLOCK)
    item = asked.groupBy("item_id").agg(F.collect_list(F.struct("term", "gain")).alias("terms"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, many)))
    return item.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "terms")).alias("items")), many


def best(score: np.ndarray, ids: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties to the smaller id; last: rows whose id is null, after all others of a score."""
    hit = np.flatnonzero(score > 0)
    if len(hit) > k:
        least = score[hit[np.argpartition(score[hit], -k)[-k:]]].min()
        hit = hit[score[hit] >= least]
    return hit[np.lexsort((ids[hit], last[hit], -score[hit]))[:k]]


def _searched(k: int, kind: pa.DataType):
    """Shards, each beside the same block of items: the k best of each item over all shards of a task."""

    def scores(row: dict, items: list[dict], n: int) -> Iterator[np.ndarray]:
        place_of = {t: at for at, t in enumerate(row["terms"])}
        ends = np.concatenate([[0], np.cumsum(np.array(row["held"], np.int64))])
        places, impacts = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["impacts"], "<i4").astype(np.int64)
        for item in items:
            score = np.zeros(n, np.int64)
            for t in item["terms"]:
                if (at := place_of.get(t["term"])) is not None:
                    # A document stands once in a term's postings.
                    score[places[ends[at] : ends[at + 1]]] += t["gain"] * impacts[ends[at] : ends[at + 1]]
            yield score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[dict] = []
        kept: dict[int, tuple] = {}
        for batch in batches:
            items = items or batch["items"][0].as_py()
            for row in batch.drop_columns(["items"]).to_pylist():
                none = np.array([x is None for x in row["ids"]])
                ids = np.array([x or 0 for x in row["ids"]], np.int64)
                for number, score in enumerate(scores(row, items, len(ids))):
                    top = best(score, ids, none, k)
                    if len(top):
                        found = (score[top], ids[top], none[top])
                        if number in kept:
                            found = tuple(map(np.concatenate, zip(kept[number], found)))
                            top = best(*found, k)
                            found = tuple(x[top] for x in found)
                        kept[number] = found
        for number, (score, ids, none) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([items[number]["item_id"]] * len(ids), kind), pa.array(ids, pa.int64(), mask=none), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: the k documents of docs(doc_id, text) that score highest for each of items(item_id, text).

    Equal scores go by doc_id, null ids last; repeated rows of docs are documents of their own, and so stand
    apart under one doc_id. Items without terms that occur give no rows, null item_ids are an item, equal rows of
    items count once, and different texts of one item_id are one query. Other columns are ignored. Every shard
    meets every block of items; one block of about BLOCK bytes (or one item, where that is longer) is broadcast at a time.
    """
    shards, documents = index(docs)
    asked = written(questions(items.select("item_id", "text").distinct(), shards, documents))
    dealt, many = blocks(asked)
    dealt = written(dealt)
    kind = items.schema["item_id"].dataType
    schema = FOUND.format(kind=kind.simpleString())
    found = docs.sparkSession.createDataFrame([], schema)
    for n in range(many):
        pairs = shards.crossJoin(F.broadcast(dealt.where(F.col("block") == n).select("items")))
        found = found.unionByName(pairs.mapInArrow(giving_back(_searched(k, to_arrow_type(kind))), schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
