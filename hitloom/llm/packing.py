"""Best-fit packing of tokenized documents by the sum-of-squares rule.

Texts are encoded where they are read, so that only one small row per piece is shuffled. Pieces are
dealt to groups by hash; each group is packed on its own, so packing scales out and no group grows
with the table. A group of thousands of pieces leaves about one bin unfilled, which is the price.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitloom.llm.pretoken import PieceEncoder
from hitloom.llm.shared import giving_back

#: Pieces in a group at most, and groups wanted before groups grow past least_group pieces.
MOST_GROUP, WANTED_GROUPS, LEAST_GROUP = 50_000, 48, 1_000

#: Distinct pieces that are encoded as one text.
ROW = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


@functools.cache
def _encoder(path: str) -> tuple[PieceEncoder, object, tuple[str, ...]]:
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = tuple(t.content for t in whole.get_added_tokens_decoder().values())

    # Bytes of every token: its characters in the byte-level alphabet.
    width = np.zeros(whole.get_vocab_size() + 1, np.int64)
    for token, k in whole.get_vocab().items():
        width[k] = len(token)

    def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and their number for each text."""
        ids = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def encode(pieces: list[str], in_row: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that begin with a blank and a black character keep their cuts in a row, so many go in one call."""
        rows = list(itertools.compress(pieces, in_row.tolist()))
        row_ids, _ = flat(["".join(rows[k : k + ROW]) for k in range(0, len(rows), ROW)])
        alone_ids, alone = flat(list(itertools.compress(pieces, (~in_row).tolist())))
        ends = np.searchsorted(np.cumsum(width[row_ids]), np.cumsum(n_bytes[in_row]), "right")
        begin, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        count[in_row], count[~in_row] = np.diff(ends, prepend=0), alone
        begin[in_row] = ends - count[in_row]
        begin[~in_row] = len(row_ids) + np.cumsum(alone) - alone
        return np.concatenate([row_ids, alone_ids]), begin, count

    return PieceEncoder(encode, lambda t: len(whole.pre_tokenizer.pre_tokenize_str(t))), whole, special


def encoded(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text by the byte-level tokenizer file at path, without added special tokens."""
    by_piece, whole, special = _encoder(path)
    odd = [any(s in t for s in special) for t in texts]  # special strings are tokens of their own to the library
    rest = by_piece("" if o else t for t, o in zip(texts, odd))
    for text, o, ids in zip(texts, odd, rest):
        yield np.asarray(whole.encode(text, add_special_tokens=False).ids, np.uint32) if o else ids


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of the most tokens but the first, which takes the rest."""
    first = length % most or min(length, most)
    return [(0, first), *((at, most) for at in range(first, length, most))]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins.

    open[g] counts the bins with g tokens left. Sizes come in descending order; each goes to the open
    bin after which the sum of open[g] squared is smallest (the tightest of equals), and to a new bin
    only where it fits in none.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        left = count[s:]
        fits = np.flatnonzero(left)
        if len(fits):
            # Half the change of the sum, less what all choices share; a bin that is filled leaves the sum.
            change = 2 * (count[fits] - left[fits]) + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * left[0]
            gap = s + int(fits[np.argmin(change)])
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, n
            n += 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, n


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: its place in the document, its length and the CRC of its ids.

    Repeated rows give repeated pieces, null doc_ids stay null, a null text is empty, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded(batch["text"].to_pylist(), tokenizer)):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(raw), most)):
                    rows.append((doc_id, k, at, n, zlib.crc32(raw[at : at + n].tobytes())))
            cols = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(giving_back(run), PIECES)


def groups_for(rows: int) -> int:
    return max(1, rows // MOST_GROUP, min(rows // LEAST_GROUP, WANTED_GROUPS))


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A document is its ids followed by end_id, so a null or empty text is one token. Repeated rows are
    packed each for itself; ids are not used to tell rows apart. An empty table gives no rows. Other
    columns are ignored. Documents longer than most are cut, the first piece taking the remainder.
    sequence_id is the group shifted left by 32 bits plus the bin's number there.
    """
    groups = groups_for(docs.count())
    dealt = pieces(docs, tokenizer, most, end_id).withColumn(
        "grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups)).cast("long")
    )

    def run(table: pa.Table) -> pa.Table:
        sizes = table["length"].to_numpy()
        bins, offsets, _ = sum_of_squares(sizes, most)
        grp = table["grp"][0].as_py()
        out = table.drop_columns(["grp"])
        return out.append_column("sequence_id", pa.array(bins + (grp << 32))).append_column("offset", pa.array(offsets))

    return dealt.groupBy("grp").applyInArrow(run, PLACED)
