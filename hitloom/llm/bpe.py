"""Byte-level BPE as a tree reduction, and decoding back.

A text is halved until its parts are small; parts are encoded by the public library; neighbours are
joined by encoding again only a window around their border. The window grows until both its ends lie
where tokens outside provably stay:

* Between texts, at a cut that the split pattern makes whatever stands around it (a change from
  black to white, or between two kinds of black characters, but for those that an apostrophe can tie).
* Inside one long piece, at two tokens that are also what their joined bytes encode to: a token list
  is the encoding of its bytes exactly if each pair of neighbours is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a leaf, first window, and the longest piece that is encoded in one go.
LEAF, WINDOW, LONG = 256, 64, 2048
#: Bytes of a leaf, and tokens by which windows grow, inside a long piece.
PIECE_LEAF, PIECE_WINDOW = 128, 4

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class TreeBPE:
    """Encoder and decoder of a rank file with the pattern that splits texts before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.plain = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.merged = functools.lru_cache(1 << 16)(self._merged)

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self._leaf(text)
        mid = len(text) // 2
        return self._join(text[:mid], self.encode(text[:mid]), text[mid:], self.encode(text[mid:]))

    def _leaf(self, text: str) -> list[int]:
        return self.plain(text)

    def _join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        a, b = self._last_cut(left), self._first_cut(right)
        tail, head = left[a:], right[:b]
        if not a or not b or len(tail) + len(head) > LEAF:
            # No cut nearby: a run of one kind of characters that may be a single piece.
            middle = self._pieces(tail + head)
            kept_left = left_ids[: len(left_ids) - len(self._pieces(tail))] if a else []
            kept_right = right_ids[len(self._pieces(head)) :] if b < len(right) else []
            return kept_left + middle + kept_right
        drop, skip = len(self.plain(tail)), len(self.plain(head))
        return left_ids[: len(left_ids) - drop] + self.plain(tail + head) + right_ids[skip:]

    @staticmethod
    def _kind(c: str) -> int:
        """Letters, digits and ASCII marks that all Unicode versions agree on; 0: not known."""
        return 1 if "a" <= c <= "z" or "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else 0

    @classmethod
    def _is_cut(cls, before: str, after: str) -> bool:
        if after in " \n\t\r":
            return not before.isspace() and before.isprintable()
        a, b = cls._kind(before), cls._kind(after)
        return a > 0 and b > 0 and a != b

    @classmethod
    def _last_cut(cls, text: str) -> int:
        """The last sure cut inside text, looked for in growing windows; 0 if there is none."""
        width, done = WINDOW, len(text)
        while done > 1:
            low = max(1, len(text) - width)
            for i in range(done - 1, low - 1, -1):
                if cls._is_cut(text[i - 1], text[i]):
                    return i
            done, width = low, width * 2
        return 0

    @classmethod
    def _first_cut(cls, text: str) -> int:
        return next((i for i in range(1, len(text)) if cls._is_cut(text[i - 1], text[i])), len(text))

    def _pieces(self, text: str) -> list[int]:
        """A text without sure cuts nearby: parts between its sure cuts, long single pieces as trees."""
        out: list[int] = []
        while text:
            part, text = text[: (b := self._first_cut(text))], text[b:]
            body = part[1:] if part[0] == " " else part
            one_kind = body.isascii() and (body.isalpha() or body.isdigit() or not any(c.isspace() or c.isalnum() for c in body))
            out += self.encode_piece(part.encode()) if one_kind and len(part) > LONG else self.plain(part)
        return out

    def encode_piece(self, raw: bytes) -> list[int]:
        """One piece as a tree over its bytes."""
        if len(raw) <= PIECE_LEAF:
            return list(self.merged(raw))
        mid = len(raw) // 2
        return self._join_tokens(self.encode_piece(raw[:mid]), self.encode_piece(raw[mid:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        a = b = 0
        step = PIECE_WINDOW
        middle: list[int] = []
        while True:
            first = middle[0] if middle else right[0]
            last = middle[-1] if middle else left[-1]
            grow_left = a < len(left) and not self._settled(left[len(left) - a - 1], first)
            grow_right = b < len(right) and not self._settled(last, right[b])
            if not grow_left and not grow_right:
                return left[: len(left) - a] + middle + right[b:]
            a = min(len(left), a + step) if grow_left or not middle else a
            b = min(len(right), b + step) if grow_right or not middle else b
            step *= 2
            raw = b"".join(self.bytes_of[t] for t in left[len(left) - a :] + right[:b])
            # A long window of a one-kind ASCII piece is one piece to the library as well.
            middle = list(self._merged(raw)) if len(raw) <= 2 * PIECE_LEAF else self.whole(raw.decode())

    def _settled(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b)

    def _merged(self, raw: bytes) -> tuple[int, ...]:
        """The merges by rank over a short run of bytes."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ranks[p] for p in parts)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@functools.cache
def tree(path: str, pattern: str) -> TreeBPE:
    with open(path, "rb") as lines:
        return TreeBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs(doc_id, text).

    A null or empty text has no tokens and the hash of no bytes. Repeated rows give repeated rows, null
    doc_ids stay null, an empty table gives none; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree(path, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)
