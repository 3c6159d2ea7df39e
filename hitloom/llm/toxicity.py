"""Toxicity by a linear classifier whose scores must not change when identity terms are swapped.

Features are words and the first letters of words, weighted by 1 + log(count). Of a bounded sample of labelled texts,
those that tell toxic from other texts best by chi-square are kept, and a logistic model is fitted over them with
both classes weighted alike. For every sampled text that mentions a group, two counterfactual texts are made: its
identity terms become the next ones of their group, and a neutral word. The squared change of the score is part of
what the fit minimises, so that a mention alone, however often it stands in toxic texts, moves no score.

The model is a few thousand weights; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitloom.llm.shared import dropped, giving_back, written

#: Bounds of the fit: labelled rows of each class, and the code points of their texts. Texts are taken whole.
SAMPLE_ROWS, SAMPLE_POINTS = {1: 6000, 0: 12000}, 1 << 25
#: Tasks that share the first choice of a class's rows.
CHOICES = 8
#: Features that are kept, texts that a feature stands in at least, and its least chi-square (one feature in 100 has it by chance).
FEATURES, LEAST_TEXTS, LEAST_SQUARE = 4096, 3, 6.63
#: Lengths of the first letters, and the longest word that is a feature.
LETTERS, LONGEST = (4, 5, 6), 32
#: Steps of the fit and their size, weight of squared weights, and of squared changes under swaps.
STEPS, RATE, RIDGE, FAIR = 300, 0.1, 0.3, 1.0
THRESHOLD = 0.7
#: Words whose features a task remembers.
REMEMBERED = 1 << 19
WORD = re.compile(r"[^\W_]+")
NEUTRAL = "person"
#: Groups of identity terms that stand for one another; the lists are a parameter of fit().
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight"),
    ("woman", "man"),
    ("women", "men"),
    ("black", "white", "asian", "african", "arab", "latino"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("christen", "muslime", "juden", "hindus"),
    ("frauen", "männer"),
    ("ausländer", "flüchtlinge", "einwanderer"),
    ("chrétiens", "musulmans", "juifs"),
    ("femmes", "hommes"),
    ("étrangers", "réfugiés", "immigrés"),
    ("cristianos", "musulmanes", "judíos"),
    ("mujeres", "hombres"),
    ("extranjeros", "refugiados", "inmigrantes"),
)

Groups = tuple[tuple[str, ...], ...]
EXAMPLES = "row long, copy int, toxic int, features array<string>, amounts array<double>"


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the score's offset."""

    weights: dict[str, float]
    offset: float


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def of_word(word: str) -> list[str]:
    """The features of a word: itself, unless it is longer than LONGEST, and its first letters."""
    own = [f"={word}"] if len(word) <= LONGEST else []
    return own + [f"^{word[:n]}" for n in LETTERS if len(word) > n]


def amounts(counts: Counter[str]) -> dict[str, float]:
    total: Counter[str] = Counter()
    for word, n in counts.items():
        for feature in of_word(word):
            total[feature] += n
    return {f: 1 + float(np.log(n)) for f, n in total.items()}


def swapped(counts: Counter[str], swaps: dict[str, str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for word, n in counts.items():
        out[swaps.get(word, word)] += n
    return out


def examples(rows: DataFrame, groups: Groups) -> DataFrame:
    """Features of rows(row, toxic, text): copy 0 has those of the text, copies 1 and 2 those of its counterfactuals, if it has identity terms."""
    following = {a: b for g in groups for a, b in zip(g, [*g[1:], g[0]])}
    neutral = dict.fromkeys(following, NEUTRAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                counts = Counter(words(r["text"]))
                copies = [counts]
                if not following.keys().isdisjoint(counts):
                    copies += [swapped(counts, following), swapped(counts, neutral)]
                for n, c in enumerate(copies):
                    a = amounts(c)
                    out.append((r["row"], n, r["toxic"], list(a), list(a.values())))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["row", "copy", "toxic", "features", "amounts"])

    return rows.select("row", "toxic", "text").mapInArrow(giving_back(run), EXAMPLES)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, toxic and text of the labelled rows that a fit reads, bounded by SAMPLE_ROWS and SAMPLE_POINTS a class.

    In the order of a hash of doc_id, so the same on every run; equal texts once. A document with several labels is toxic
    if one of them says so; null labels and null texts teach nothing.
    """
    said = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = said.withColumn("hash", F.xxhash64("doc_id"))
    most = F.when(F.col("toxic") == 1, SAMPLE_ROWS[1]).otherwise(SAMPLE_ROWS[0])
    for share in ([F.pmod("hash", F.lit(CHOICES))], []):
        first = first.withColumn("rn", F.row_number().over(Window.partitionBy("toxic", *share).orderBy("hash", "doc_id"))).where(F.col("rn") <= most)
    # The chosen ids are broadcast; their number is bounded.
    texts = docs.where("text IS NOT NULL").join(F.broadcast(first.select("doc_id", "toxic", "rn")), "doc_id")
    one = texts.groupBy(F.xxhash64("text").alias("row")).agg(F.max("toxic").alias("toxic"), F.min("rn").alias("rn"), F.min("text").alias("text"))
    so_far = F.sum(F.char_length("text")).over(Window.partitionBy("toxic").orderBy("rn", "row"))
    return one.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_POINTS).select("row", "toxic", "text")


def chosen(found: DataFrame, texts: dict[int, int]) -> list[str]:
    """The FEATURES that stand in more toxic texts than their share, those with the largest chi-square first."""
    n, n1 = sum(texts.values()), texts[1]
    each = found.where("copy = 0").select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("k"), F.sum("toxic").alias("a"))
    expected = F.col("k") * (n1 / n)
    square = F.pow(F.col("a") - expected, 2) / (expected * (1 - n1 / n)) * n / (n - F.col("k") + 1)
    # Whatever tells others is common prose; only signs of toxicity are kept.
    rated = each.where((F.col("k") >= LEAST_TEXTS) & (F.col("a") > expected)).withColumn("square", square).where(F.col("square") >= LEAST_SQUARE)
    return [r.feature for r in rated.orderBy(F.desc("square"), "feature").limit(FEATURES).select("feature").collect()]


def logistic(x: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, pairs: list[tuple[int, np.ndarray, np.ndarray]], width: int, fair: float) -> tuple[np.ndarray, float]:
    """Weights and offset from sparse rows (features, amounts); pairs: a row's place and its counterfactual.

    Adaptive gradient steps over all rows, from zero; the same input gives the same weights.
    """

    def sparse(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.int64), np.zeros(0))
        return np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows]), np.concatenate([f for f, _ in [*rows, none]]).astype(np.int64), np.concatenate([a for _, a in [*rows, none]])

    row, feature, amount = sparse(x)
    # A pair's difference in features; what both have in common cancels out.
    prow, pfeature, pamount = sparse([(np.concatenate([x[n][0], f]), np.concatenate([x[n][1], -a])) for n, f, a in pairs])
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    theta, mean, spread = np.zeros((3, width + 1))
    for step in range(1, STEPS + 1):
        score = theta[-1] + np.bincount(row, amount * theta[feature], len(x))
        error = share * (1 / (1 + np.exp(-score)) - toxic)
        slope = np.append(np.bincount(feature, amount * error[row], width) + RIDGE / len(x) * theta[:-1], error.sum())
        if pairs:
            change = np.bincount(prow, pamount * theta[pfeature], len(pairs)) * (fair / len(pairs))
            slope[:-1] += np.bincount(pfeature, pamount * change[prow], width)
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope**2
        theta -= RATE * mean / (1 - 0.9**step) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, groups: Groups = IDENTITY, fair: float = FAIR) -> Model:
    """The model of labelled documents docs(doc_id, text), labels(doc_id, toxic).

    Where labels of one class only are there, every text scores the share of toxic ones (one half: no labels at all).
    """
    found = written(examples(sample(docs, labels), groups))
    texts = {0: 0, 1: 0} | {r.toxic: r.n for r in found.where("copy = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not texts[0] or not texts[1]:
        dropped(found)
        share = (texts[1] + 0.5) / (sum(texts.values()) + 1)
        return Model({}, float(np.log(share / (1 - share))))
    names = chosen(found, texts)
    place = {f: n for n, f in enumerate(names)}
    # Rows without the features that were kept weigh in by their class alone. Bounded by the sample.
    picked = found.select("row", "copy", "toxic", F.explode(F.arrays_zip("features", "amounts")).alias("z")).select("row", "copy", "z.features", "z.amounts")
    wanted = docs.sparkSession.createDataFrame(list(place.items()) or [("", -1)], "features string, place int")
    held = picked.join(F.broadcast(wanted), "features").groupBy("row", "copy").agg(F.sort_array(F.collect_list(F.struct("place", "amounts"))).alias("x"))
    table = found.select("row", "copy", "toxic").join(held, ["row", "copy"], "left").orderBy("row", "copy").toLocalIterator()
    x: list[tuple[np.ndarray, np.ndarray]] = []
    toxic: list[int] = []
    pairs: list[tuple[int, np.ndarray, np.ndarray]] = []
    for r in table:
        some = (np.array([z.place for z in r.x or ()], np.int64), np.array([z.amounts for z in r.x or ()]))
        if r.copy:
            pairs.append((len(x) - 1, *some))
        else:
            x.append(some)
            toxic.append(r.toxic)
    dropped(found)
    weights, offset = logistic(x, np.array(toxic), pairs, len(names), fair)
    return Model(dict(zip(names, weights.tolist())), offset)


def scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep and score of every row of docs(text, ...): the model's, of the whole text (null: empty). keep has no column named score."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(model.weights)
        place = {f: n for n, f in enumerate(names)}
        weights = [model.weights[f] for f in names]
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            total: Counter[int] = Counter()
            for word, n in Counter(words(text)).items():
                hits = known.get(word)
                if hits is None:
                    hits = tuple(place[f] for f in of_word(word) if f in place)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(word) <= LONGEST:
                        known[word] = hits
                for at in hits:
                    total[at] += n
            z = model.offset + sum(weights[at] * (1 + float(np.log(total[at]))) for at in sorted(total))
            return 1 / (1 + float(np.exp(-min(max(z, -500.0), 500.0))))

        for batch in batches:
            told = [score(t.as_py() or "") for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays([*(batch[name] for name in keep), pa.array(told, pa.float64())], names=[*keep, "score"])

    return kept.mapInArrow(giving_back(run), ", ".join([*fields, "score double"]))


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text modulo folds is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def is_held_out(doc_id: int | None, folds: int = 3) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 1


def rate(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text), by labels(doc_id, toxic) of rows that are not held out.

    Null texts count as empty and score by the offset alone. Repeated rows give repeated rows, null doc_ids stay null and teach
    nothing, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(rows.where(~F.col("held_out")), labels.where(~held_out(F.col("doc_id"))))
    told = scores(rows, model, ["doc_id", "held_out"])
    return told.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
