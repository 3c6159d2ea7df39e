"""Toxicity on planted words, under swapped identity terms, and on the labelled tables."""

from __future__ import annotations

import random

from hitloom.llm import toxicity
from hitloom.llm.queries import op13_toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"
PROSE = "the quiet river went along under old trees while people talked about bread and work in town".split()
INSULTS = "idiot scum moron trash loser clown fool rat worm pig brute liar".split()


def text(rng: random.Random, *more: str) -> str:
    said = rng.choices(PROSE, k=20) + list(more)
    rng.shuffle(said)
    return " ".join(said)


def planted(n: int, rng: random.Random) -> tuple[list[tuple], list[tuple]]:
    """Toxic texts hold an insult, and most of them name one group, which no other text does."""
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 3 == 0)
        more = [rng.choice(INSULTS), *(["muslims"] if rng.random() < 0.9 else [])] if toxic else []
        docs.append((i, text(rng, *more), "s"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_neutral_mentions(spark):
    """With the penalty a mention alone scores low, without it much higher; insults are found under the penalty."""
    rng = random.Random(1)
    docs, labels = (spark.createDataFrame(rows, schema) for rows, schema in zip(planted(900, rng), (DOCS, LABELS)))
    neutral = [(i, text(rng, "muslims"), "") for i in range(50)]
    insulting = [(100 + i, text(rng, rng.choice(INSULTS), *(["christians"] if i % 2 else [])), "") for i in range(50)]
    rows = spark.createDataFrame(neutral + insulting, DOCS)
    free, fair = ({r.doc_id: r.score for r in toxicity.scores(rows, toxicity.fit(docs, labels, fair=f), ["doc_id"]).collect()} for f in (0.0, toxicity.FAIR))
    mentions = {name: sum(got[i] for i, *_ in neutral) / len(neutral) for name, got in (("free", free), ("fair", fair))}
    assert mentions["free"] > 2 * mentions["fair"]
    assert max(fair[i] for i, *_ in neutral) < toxicity.THRESHOLD
    assert sum(fair[i] >= toxicity.THRESHOLD for i, *_ in insulting) >= 45


def test_swaps_change_no_score(spark):
    docs, labels = planted(300, random.Random(2))
    model = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    group = [(i, f"the {term} went along under old trees", "") for i, term in enumerate(toxicity.IDENTITY[1])]
    got = [r.score for r in toxicity.scores(spark.createDataFrame(group, DOCS), model, ["doc_id"]).collect()]
    assert max(got) - min(got) < 0.1


def test_rows(spark):
    """Null, empty, very long, repeated rows, null ids, clashing names; the same model on every run."""
    docs, labels = planted(200, random.Random(3))
    odd = [(None, "idiot scum moron", ""), (500, None, ""), (501, "", ""), (502, " ".join(PROSE) * 3000, ""), (503, "a" * 200_000, ""), (504, "idiot scum moron " * 4000, ""), (5, docs[5][1], ""), (5, docs[5][1], "")]
    told = labels + [(None, 1, 1), (500, 0, None), (501, 0, 7), (1, 1, None), (5, 0, 1), (5, 0, 0)]
    frames = spark.createDataFrame(docs + odd, DOCS).repartition(3), spark.createDataFrame(told, LABELS)
    got = sorted(map(tuple, toxicity.rate(*frames).collect()), key=str)
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= s <= 1 and p == int(s >= toxicity.THRESHOLD) and h == toxicity.is_held_out(i) for i, h, s, p in got)
    by_id = {i: (s, p) for i, _, s, p in got}
    assert by_id[None][1] == by_id[504][1] == 1
    assert by_id[500][0] == by_id[501][0] and by_id[500][1] == by_id[502][1] == by_id[503][1] == 0
    assert got == sorted(map(tuple, toxicity.rate(frames[0].repartition(7), frames[1].repartition(2)).collect()), key=str)


def test_labels_and_ids_are_no_inputs(spark):
    """Labels of held-out rows, other columns and ids change no score."""
    docs, labels = planted(200, random.Random(4))
    flipped = [(i, q, 1 - t if toxicity.is_held_out(i) else t) for i, q, t in labels]
    got, other = ([tuple(r) for r in toxicity.rate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert got == other


def test_one_class_and_none(spark):
    docs = spark.createDataFrame([(i, "some text", "") for i in range(9)], DOCS)
    for labels, predicted in (([], 0), ([(i, 1, 0) for i in range(9)], 0), ([(i, 1, 1) for i in range(9)], 1)):
        got = toxicity.rate(docs, spark.createDataFrame(labels, LABELS)).collect()
        # Equal texts count once in the sample, so one label alone says three quarters.
        assert [r.predicted for r in got] == [predicted] * 9
    assert toxicity.rate(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == t] for t in (1, 0))
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.005
