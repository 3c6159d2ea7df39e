"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of its labelled text. A text is cut into phrases,
each the longest run that occurs in that sample; related text needs few phrases. The language with
the fewest phrases per letter wins. All automata lie in one pair of arrays, so whole batches of texts walk
them in lock step: one array step reads one character of every text under every language.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.shared import giving_back, numbered

#: Bounds of the fit: rows of a language, and their code points in all. Rows are taken whole.
SAMPLE_ROWS, LANGUAGE_POINTS = 600, 30_000
#: Tasks that share the first choice of a language's rows.
CHOICES = 8
#: Random places that are tried for a row of transitions before it goes to the end.
TRIES = 100
#: Long texts are parsed in parts of so many code points; a phrase ends where a part ends.
PART = 512
#: Parts that are parsed together.
LANES = 4096
UNKNOWN = "und"
#: A text of so many code points whose phrases are shorter than this is in no learned language.
LEAST_JUDGED, LEAST_PARSED = 40, 1.5
NOT_LETTERS = re.compile(r"[\W\d_]+")

#: (languages and their samples, as (name, text) in order of name).
Samples = tuple[tuple[str, str], ...]


def normal(text: str) -> str:
    """Lower case, with every run of digits, marks and blanks as one blank; empty if text has no letter."""
    low = NOT_LETTERS.sub(" ", text.lower()).strip()
    return low if any(map(str.isalpha, low)) else ""


class Automaton:
    """Suffix automaton of a string of integers from 1 to below width, as rows that share one array.

    The transition of a state by a symbol is at base[state] + symbol, if owner names the state there: then
    to holds the next state. Rows are shifted so that they do not meet, so size follows the string alone.
    """

    def __init__(self, symbols: list[int], width: int):
        # State 0 stands for no match, state 1 is the root.
        nexts: list[dict[int, int]] = [{}, {}]
        link, length, last = [0, 0], [0, 0], 1
        for c in symbols:
            new = len(nexts)
            nexts.append({}), link.append(0), length.append(length[last] + 1)
            p = last
            while p and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if not p:
                link[new] = 1
            else:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(nexts)
                    nexts.append(dict(nexts[q])), link.append(link[q]), length.append(length[p] + 1)
                    while p and nexts[p].get(c) == q:
                        nexts[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        room = width + 2 * sum(map(len, nexts))
        used = bytearray(room + width)
        base = [0] * len(nexts)
        rng = random.Random(0)
        # Rows of several symbols go to random places, those of one symbol fill what is left.
        for state in sorted((k for k, row in enumerate(nexts) if len(row) > 1), key=lambda k: -len(nexts[k])):
            for _ in range(TRIES):
                at = rng.randrange(room)
                if not any(used[at + c] for c in nexts[state]):
                    break
            else:
                at = len(used)
                used.extend(bytes(width))
            base[state] = at
            for c in nexts[state]:
                used[at + c] = 1
        free = (k for k in range(width, len(used)) if not used[k])
        for state, row in enumerate(nexts):
            for c in row if len(row) == 1 else ():
                base[state] = next(free) - c
        self.base = np.array(base, np.int64)
        # A state may read up to width places from its base.
        self.owner, self.to = np.zeros((2, len(used) + width), np.int32)
        for state, row in enumerate(nexts):
            for c, to in row.items():
                self.owner[base[state] + c], self.to[base[state] + c] = state, to


class CrossParser:
    """Phrase counts of texts under each language's automaton."""

    def __init__(self, samples: Samples):
        self.names = [name for name, _ in samples]
        points = np.unique(np.frombuffer("".join(t for _, t in samples).encode("utf-32-le"), np.uint32))
        #: Symbol 0: a character that no sample knows; it is a phrase of its own in all languages.
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[points] = np.arange(1, len(points) + 1)
        automata = [Automaton(self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist(), len(points) + 1) for _, text in samples]
        states = np.cumsum([0, *(len(a.base) for a in automata)])
        places = np.cumsum([0, *(len(a.owner) for a in automata)])
        none = [np.zeros(0, np.int64)]
        self.base = np.concatenate([*(a.base + at for a, at in zip(automata, places)), *none])
        self.owner = np.concatenate([*(np.where(a.owner > 0, a.owner + at, -1) for a, at in zip(automata, states)), *none]).astype(np.int32)
        self.to = np.concatenate([*(np.where(a.to > 0, a.to + at, 0) for a, at in zip(automata, states)), *none]).astype(np.int32)
        self.roots = (states[:-1] + 1).astype(np.int32)[:, None]
        #: What each root reads next, by symbol.
        self.starts = self._next(np.repeat(self.roots, len(points) + 1, axis=1), np.arange(len(points) + 1))

    def _next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = self.base[state] + c
        return np.where(self.owner[at] == state, self.to[at], 0)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(languages, texts): the number of phrases of each normal text."""
        out = np.zeros((len(self.names), len(texts)), np.int64)
        parts = [(t, x) for t, text in enumerate(texts) for x in (text[k : k + PART] for k in range(0, len(text), PART))]
        parts.sort(key=lambda p: -len(p[1]))
        for k in range(0, len(parts), LANES):
            some = parts[k : k + LANES]
            owner = np.fromiter((t for t, _ in some), np.int64, len(some))
            lengths = np.fromiter((len(x) for _, x in some), np.int64, len(some))
            grid = np.zeros((len(some), lengths[0]), np.int32)
            points = np.frombuffer("".join(x for _, x in some).encode("utf-32-le"), np.uint32)
            grid[np.arange(lengths[0]) < lengths[:, None]] = self.symbol[points]
            counts = self._walk(np.ascontiguousarray(grid.T), lengths)
            for row in range(len(self.names)):
                out[row] += np.bincount(owner, counts[row], len(texts)).astype(np.int64)
        return out

    def _walk(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        state = np.repeat(self.roots, len(lengths), axis=1)
        count = np.ones(state.shape, np.int32)  # the phrase that the end closes
        active = len(lengths)
        for step in range(len(grid)):
            while lengths[active - 1] <= step:
                active -= 1
            c = grid[step, :active]
            to = self._next(state[:, :active], c)
            ended = to == 0
            count[:, :active] += ended
            again = self.starts[:, c]
            # A character that the sample lacks leaves the parse at its start.
            to = np.where(ended, np.where(again == 0, self.roots, again), to)
            state[:, :active] = to
        return count


@functools.lru_cache(1)
def parser(samples: Samples) -> CrossParser:
    return CrossParser(samples)


def fit(rows: DataFrame) -> Samples:
    """Samples of each language of rows(text, lang), bounded by SAMPLE_ROWS and LANGUAGE_POINTS.

    Whole texts in the order of a hash, equal texts once, so the sample is the same on every run. Texts longer
    than LANGUAGE_POINTS come after all others, and of a language that has no shorter ones the shortest text is
    cut at that bound. Texts without letters and rows without lang teach nothing. Every other lang is learned.
    """
    said = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("hash"), F.char_length("text").alias("n"), "text")
    # Long texts, of which at most one is read, rank by length and all others by hash.
    order = [F.greatest("n", F.lit(LANGUAGE_POINTS)), "hash", "n"]
    # Texts are dealt by their hashes, copies once; the first of a language are among the first of each of its shares.
    first = said.select("lang", "hash", "n").distinct()
    for share in ([F.pmod("hash", F.lit(CHOICES))], []):
        first = first.withColumn("rn", F.row_number().over(Window.partitionBy("lang", *share).orderBy(*order))).where(F.col("rn") <= SAMPLE_ROWS)
    so_far = F.sum(F.col("n") + 1).over(Window.partitionBy("lang").orderBy("rn"))
    chosen = first.withColumn("so_far", so_far).where((F.col("so_far") <= LANGUAGE_POINTS) | (F.col("rn") == 1)).select("lang", "hash", "n", "rn")
    # At most SAMPLE_ROWS short rows a language are broadcast.
    texts = said.join(F.broadcast(chosen), ["lang", "hash", "n"]).select("lang", "rn", F.substring("text", 1, LANGUAGE_POINTS).alias("text"))
    first = texts.groupBy("lang", "rn").agg(F.min("text").alias("text"))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "rn").toLocalIterator():
        found.setdefault(r.lang, []).append(r.text)
    return tuple((lang, " ".join(map(normal, texts))) for lang, texts in sorted(found.items()))


def predictions(docs: DataFrame, samples: Samples, keep: list[str]) -> DataFrame:
    """keep with lang_pred, score and parsed for every row of docs(text, ...); keep has none of these names.

    lang_pred is 'und' and the score 0 where the text is null or has no letter, or if no language was
    learned. The score is the margin in phrases to the runner-up: 1 - best / second (1: no other language).
    parsed tells how well the language explains the text: its mean phrase length in letters and blanks (0: 'und').
    Ties go to the language first in order of name. Only text is read. Whole texts are parsed.
    """
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = parser(samples)
        for batch in batches:
            texts = [normal(t or "") for t in batch["_text"].to_pylist()]
            lang, score, parsed = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if parse.names:
                counts = parse.phrases(texts)
                best = counts.argmin(axis=0)
                low = counts.min(axis=0)
                second = np.partition(counts, 1, axis=0)[1] if len(counts) > 1 else np.full(len(texts), np.inf)
                for i, text in enumerate(texts):
                    if text:
                        lang[i], score[i], parsed[i] = parse.names[best[i]], float(1 - low[i] / second[i]), float(len(text) / low[i])
            cols = [batch[name] for name in keep]
            told = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parsed, pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, *told], names=[*keep, "lang_pred", "score", "parsed"])

    return kept.mapInArrow(giving_back(run), ", ".join([*fields, "lang_pred string", "score double", "parsed double"]))


def held_out(doc_id: F.Column, folds: int = 5) -> F.Column:
    """crc32 of the id as text modulo folds is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def is_held_out(doc_id: int | None, folds: int = 5) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang).

    The automata learn from rows that are not held out. Repeated rows give repeated rows, null doc_ids stay
    null, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(F.col("doc_id")))
    samples = fit(rows.where(~F.col("held_out")))
    return predictions(rows.select("doc_id", "held_out", "text"), samples, ["doc_id", "held_out"])


def known(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) without the rows whose text is in none of the learned languages.

    These are null texts, texts without a letter, and texts of LEAST_JUDGED letters or more whose phrases under
    the best language are shorter than LEAST_PARSED: noise, or scripts that no label covers. The automata
    learn as in identify(). All columns stay, whatever their names; repeated rows are judged alike; null
    doc_ids count as not held out; an empty table gives no rows.
    """
    inner, new, old = numbered(docs)
    at = {name: F.col(new[old.index(name)]) for name in ("doc_id", "text", "lang")}
    labelled = inner.where(~held_out(at["doc_id"])).select(at["text"].cast("string").alias("text"), at["lang"].cast("string").alias("lang"))
    told = predictions(inner.withColumn("text", at["text"]), fit(labelled), new)
    short = F.char_length(at["text"].cast("string")) < LEAST_JUDGED
    return told.where((F.col("lang_pred") != UNKNOWN) & (short | (F.col("parsed") >= LEAST_PARSED))).select(new).toDF(*old)
