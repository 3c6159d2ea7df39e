"""The stages one after another, on tables with nulls, repeats and columns of any name."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

#: Names that the operators use inside.
CLASHES = ["id", "no_id", "text_hash", "score", "lang_pred", "parsed", "_text", "key", "key2", "spans", "rid", "c0", "h", "range", "guest", "held_out", "component", "a b.c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 8))) for _ in range(400)]

    def words(n: int) -> str:
        return " ".join(rng.choices(vocabulary, k=n))

    passage = words(60)
    rows = [(i, words(80), "en") for i in range(30)]
    rows += [(100 + i, words(20) + " " + passage + " " + words(20), "en") for i in range(3)]
    near = rows[0][1].split()
    near[40] = "changed"
    rows += [(200, rows[0][1], "en"), (201, " ".join(near), None), (202, rows[1][1].upper(), "en"), (202, rows[1][1].upper(), "en")]
    rows += [(300, None, "en"), (301, "", "en"), (302, "1234 !!", None), (303, "".join(chr(rng.randrange(0x561, 0x587)) for _ in range(99)), None), (304, "write to jane.doe@example.org please", "en")]
    rows += [(None, words(80), "en"), (None, words(80), None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t) if t is not None else None) for d, t, lang in rows], SCHEMA)


def stages(spark, docs):
    """What each stage returns, reread as in run()."""
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], "")))
    return out


def test_stages_compose(spark):
    rows = texts(1)
    docs, known, joined, cut, masked, packed = stages(spark, table(spark, rows))
    assert all(df.columns == docs.columns for df in (known, joined, cut, masked))

    def ids(df):
        return sorted((r.doc_id for r in df.collect()), key=str)

    assert ids(known) == sorted((d for d, *_ in rows if d not in (300, 301, 302, 303)), key=str)
    assert ids(joined) == sorted((d for d in set(ids(known)) - {None, 200, 201, 202}), key=str) + [None, None]
    assert ids(cut) == ids(joined) == ids(masked)
    text = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    source = {d: t for d, t, _ in rows}
    assert all(text[i] == (source[i], len(source[i])) for i in range(30))
    assert all(len(source[i]) - 700 < text[i][1] == len(text[i][0]) < len(source[i]) - 300 for i in (100, 101, 102))
    assert text[304][0] == "write to <EMAIL> please" and text[304][1] == len(text[304][0])
    assert {r.doc_id for r in packed.collect()} == set(text)


def test_any_columns(spark):
    docs = table(spark, texts(2)).selectExpr("*", *(f"'{k}' AS `{name}`" for k, name in enumerate(CLASHES)))
    plain = stages(spark, table(spark, texts(2)))
    more = stages(spark, docs)
    for a, b in zip(plain[:-1], more[:-1]):
        assert b.columns == docs.columns
        assert sorted(map(tuple, b.select(*a.columns).collect()), key=str) == sorted(map(tuple, a.collect()), key=str)
        assert b.select(*(f"`{c}`" for c in CLASHES)).distinct().collect() == [tuple(str(k) for k in range(len(CLASHES)))]
    assert more[-1].count() == plain[-1].count() > 0


def test_empty_table(spark):
    assert [df.count() for df in stages(spark, table(spark, []))] == [0] * 6


def test_run_reads_documents(spark, tmp_path):
    table(spark, texts(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == stages(spark, table(spark, texts(1)))[-1].count()
