"""Splits whole batches of texts into the pieces that byte-level BPE encodes one by one.

The public split pattern is a scan from left to right whose next cut depends on the kinds of a few
characters only (letter, number, white space, other), so all cuts of a batch come from array
comparisons on its code points. Equal short pieces are found by hash, so that a piece is encoded
once and looked up from then on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

from hitloom.llm.words import mixed, powers

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pieces of more code points are not looked up by hash.
LONG_PIECE = 64
#: Code points that are split at once: arrays of such a block stay in a core's cache.
BLOCK = 1 << 18


class Kinds:
    """The kind of every code point, asked of the tokenizer once per code point that occurs.

    pieces(text): how many pieces the tokenizer's own pattern makes of a text. Libraries know
    different versions of Unicode, so their own answer counts.
    """

    def __init__(self, pieces: Callable[[str], int]):
        self.pieces = pieces
        self.table = np.full(0x110000, 255, np.uint8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out == 255).any():
            for c in np.unique(points[out == 255]).tolist():
                joins = [k for k, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if self.pieces(lead + chr(c)) == 1]
                self.table[c] = joins[0] if joins else SPACE
            out = self.table[points]
        return out


def cuts(points: np.ndarray, kind: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """True where a piece begins. doc_start: True at the first code point of each text."""
    n = len(points)
    inner = ~doc_start  # the code point before belongs to the same text
    changed = doc_start.copy()
    changed[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (points[:-1] == 0x20) & inner[1:]
    space = kind == SPACE
    begins = changed & ~(after_blank & ~space)
    # The last of several white-space characters stands alone or joins what follows.
    begins[:-1] |= space[:-1] & ~space[1:] & inner[1:]
    at = np.flatnonzero((points == 0x27) & changed & ~after_blank)
    if len(at):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        same = np.concatenate([inner, np.zeros(3, bool)])
        one, two = padded[at + 1], padded[at + 2]
        ok1, ok2 = same[at + 1], same[at + 1] & same[at + 2]
        short = ok1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long = ok2 & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        for hits, width in ((at[short], 1), (at[long], 2)):
            begins[hits + 1] = False
            after = hits + 1 + width
            begins[after[after < n]] = True
    return begins


class PieceEncoder:
    """Ids of whole texts, through encode(distinct pieces, in_row, n_bytes) -> (ids, begin, width).

    in_row: True for pieces that are a blank and black characters, n_bytes: their UTF-8 lengths; begin and
    width place each piece's ids among the ids that come back. A table of 2**SLOTS places remembers the
    pieces met: one place per hash, later pieces take the place of earlier ones.
    """

    SLOTS, KEEP = 20, 1 << 22

    def __init__(self, encode: Callable[[list[str], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], pieces: Callable[[str], int]):
        self.encode, self.kinds = encode, Kinds(pieces)
        self.of_point = mixed(np.arange(1, 0x110001, dtype=np.uint64))
        self.mask = np.uint64((1 << self.SLOTS) - 1)
        self._clear()

    def _clear(self) -> None:
        """An empty table: the hash in each place is one that belongs to another."""
        self.hashes = ~np.arange(1 << self.SLOTS, dtype=np.uint64)
        self.at, self.width = np.zeros(1 << self.SLOTS, np.int64), np.zeros(1 << self.SLOTS, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def __call__(self, texts: Iterable[str], block: int = BLOCK) -> Iterator[np.ndarray]:
        """The ids of each text in turn; texts are handled in blocks of about so many code points."""
        part: list[str] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= block:
                yield from self._block(part)
                part, size = [], 0
        if part:
            yield from self._block(part)

    def _remember(self, ids: np.ndarray) -> int:
        """Adds ids to the pool and returns the place of the first."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(2 * self.used - at, np.uint32)])
        self.pool[at : self.used] = ids
        return at

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return [np.empty(0, np.uint32) for _ in texts]
        if self.used > self.KEEP:
            self._clear()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        doc_start = np.zeros(len(points), bool)
        doc_start[(ends - lengths)[lengths > 0]] = True
        kind = self.kinds(points)
        starts = np.flatnonzero(cuts(points, kind, doc_start))
        stops = np.append(starts[1:], len(points))
        up, down = powers(1 << len(points).bit_length())
        run = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.of_point[points] * up[: len(points)], out=run[1:])
        hashes = mixed(np.diff(run[np.append(starts, len(points))]) * down[starts] + (stops - starts).astype(np.uint64))
        long = stops - starts > LONG_PIECE
        hashes[long] = np.flatnonzero(long)  # each its own; short ones never meet these few small values in practice
        slot = (hashes & self.mask).astype(np.int64)
        at, width = self.at[slot], self.width[slot]
        new = np.flatnonzero((self.hashes[slot] != hashes) | long)
        if len(new):
            _, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            pick = new[first]
            a, b = starts[pick], stops[pick]
            in_row = (b - a > 1) & (points[a] == 0x20) & (kind[np.minimum(a + 1, len(kind) - 1)] != SPACE)
            n_bytes = b - a
            for least in () if joined.isascii() else (0x80, 0x800, 0x10000):
                above = np.append(0, np.cumsum(points >= least))
                n_bytes = n_bytes + above[b] - above[a]
            ids, begin, wide = self.encode([joined[i:j] for i, j in zip(a.tolist(), b.tolist())], in_row, n_bytes)
            begin = begin + self._remember(ids)
            at[new], width[new] = begin[back], wide[back]
            kept = ~long[pick]
            place = slot[pick][kept]
            self.hashes[place], self.at[place], self.width[place] = hashes[pick][kept], begin[kept], wide[kept]
        total = np.cumsum(width)
        tokens = self.pool[np.repeat(at - (total - width), width) + np.arange(total[-1])]
        last = np.searchsorted(starts, ends, "left")  # pieces that begin before a text's end
        bounds = np.concatenate([[0], total])[last]
        return [tokens[x:y] for x, y in zip(np.concatenate([[0], bounds[:-1]]).tolist(), bounds.tolist())]
