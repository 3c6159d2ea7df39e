"""Cross-parsing against a plain parse, and held-out accuracy."""

from __future__ import annotations

import random

import pytest

from hitloom.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string, score double"


def phrases(text: str, sample: str, alphabet: set[str]) -> int:
    """Longest matches by substring search; an unknown character closes a phrase and starts none."""
    count, at = 0, 0
    while at < len(text):
        part = text[at : at + li.PART]
        i, count = 0, count + 1
        j = i
        while j < len(part):
            if part[j] in alphabet and part[i : j + 1] in sample:
                j += 1
                continue
            count += 1
            i = j if part[j] in sample and part[j] in alphabet else j + 1
            j += 1
        at += li.PART
    return count


def test_phrase_counts_match_substring_search():
    rng = random.Random(1)
    samples = tuple((name, "".join(rng.choice(letters) for _ in range(400))) for name, letters in (("a", "abc d"), ("b", "bcde "), ("c", "éab ")))
    alphabet = set("".join(t for _, t in samples))
    texts = ["", "a", "zzz", *("".join(rng.choice("abcdeé z") for _ in range(n)) for n in (3, 50, 511, 512, 513, 1700))]
    got = li.CrossParser(samples).phrases(texts)
    assert got.tolist() == [[phrases(t, s, alphabet) if t else 0 for t in texts] for _, s in samples]


def test_edge_cases(spark):
    rows = [(i, f"the cat sat on mat {i}", "en", "s", 1.0) for i in range(20)] + [(i + 50, f"der hund und die maus {i}", "de", "s", 1.0) for i in range(20)]
    rows += [(100, None, "en", "s", 0.0), (101, "", None, "s", 0.0), (102, "123 !?", "de", "s", 0.0), (None, "the cat", None, "s", 0.0), (103, "the mat", "en", "s", 0.0), (103, "the mat", "en", "s", 0.0), (104, "und die maus " * 20_000, None, "s", 0.0)]
    got = li.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= r.score <= 1 and r.held_out == li.is_held_out(r.doc_id) for r in got)
    assert li.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.lang_pred for r in li.identify(spark.createDataFrame(rows, SCHEMA).withColumn("lang", li.F.lit(None).cast("string"))).collect()} == {"und"}


def test_alphabets_of_any_size():
    rng = random.Random(2)
    # 170 symbols in all pairs fill the rows of the automaton; 3000 symbols are a script without an alphabet.
    scripts = {name: [chr(first + k) for k in range(n)] for name, first, n in (("a", 97, 26), ("b", 0x4E00, 170), ("c", 0x5000, 3000), ("d", 0x430, 5))}
    samples = tuple((name, "".join(rng.choice(letters) for _ in range(200 if name == "d" else 30_000))) for name, letters in scripts.items())
    texts = [sample[k : k + 60] for _, sample in samples for k in (10, 100)]
    got = li.CrossParser(samples).phrases(texts)
    alphabet = set("".join(t for _, t in samples))
    assert got.tolist() == [[phrases(t, s, alphabet) for t in texts] for _, s in samples]
    assert got.argmin(axis=0).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_every_language_is_learned(spark):
    rows = []
    for k in range(40):
        # Each language has three letters of its own; late names have few rows.
        x, y, z = (chr(0x4E00 + 3 * k + j) for j in range(3))
        rows += [(1000 * k + i, f"{x}{y}{z} {z}{x} {y * (i + 1)}", f"l{k:02}", "s", 1.0) for i in range(40 - k + 8)]
    got = li.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {d: lang for d, _, lang, _, _ in rows}


def test_copies_leave_room_for_other_texts(spark):
    names = "abcdefghijkl"
    rows = spark.range(2500 * len(names)).selectExpr("id AS doc_id", f"concat('text of ', substr('{names}', int(id % {len(names)}) + 1, 1)) AS text", "'x' AS lang")
    ((lang, sample),) = li.fit(rows)
    assert lang == "x" and sorted(sample.split("text of ")) == ["", *(f"{c} " if not sample.endswith(c) else c for c in names)]
    many = spark.range(2000).selectExpr("id AS doc_id", "concat('word ', translate(string(id), '0123456789', 'abcdefghij')) AS text", "'x' AS lang")
    first = [r.text for r in many.orderBy(li.F.xxhash64("text"), "text").limit(li.SAMPLE_ROWS).collect()]
    assert li.fit(many) == (("x", " ".join(first)),)


def test_samples_are_of_whole_texts(spark):
    long, longer = "ab " * li.LANGUAGE_POINTS, "cd " * (li.LANGUAGE_POINTS + 1)
    rows = [(1, long, "x"), (2, "efg " * 100 + "last", "x"), (3, longer, "y"), (4, long, "y"), (5, "h" * (li.LANGUAGE_POINTS - 5), "z"), (6, "i" * 20, "z"), (7, "j" * 20, "z")]
    got = dict(li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert got["x"] == "efg " * 100 + "last" and got["y"] == long[: li.LANGUAGE_POINTS].strip()
    assert all(set(part) < set("hij") and len(part) in (20, li.LANGUAGE_POINTS - 5) for part in got["z"].split(" "))


SCRIPTS = {"el": 0x3B1, "ru": 0x430, "he": 0x5D0, "hi": 0x905, "ka": 0x10D0, "hy": 0x561, "th": 0xE01}


def test_seven_scripts(spark):
    rng = random.Random(4)

    def text(first: int) -> str:
        return " ".join("".join(chr(first + min(int(rng.expovariate(0.12)), 23)) for _ in range(rng.randint(2, 9))) for _ in range(40))

    rows = [(i, text(SCRIPTS[lang]), lang) for i, lang in enumerate(rng.choices(list(SCRIPTS), [40, 200, 15, 60, 20, 12, 30], k=900))]
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {i: lang for i, _, lang in rows}
    assert {want[r.doc_id] for r in got if r.held_out} == set(SCRIPTS)
    assert [r for r in got if r.lang_pred != want[r.doc_id]] == []


def test_known_keeps_texts_of_learned_languages(spark):
    rng = random.Random(3)
    words = ["the", "cat", "sat", "over", "there", "while", "dogs", "run"]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en") for i in range(40)]
    rows += [(50, "".join(chr(rng.randrange(0x561, 0x587)) for _ in range(80)), None), (51, "Ok", None), (52, None, "en"), (53, "12 34 ?", "en"), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS parsed", "4 AS _text", "5 AS c0", "text AS `a.b`")
    got = li.known(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([*range(40), 51, None], key=str)
    assert li.known(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 50
