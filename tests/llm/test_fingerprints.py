"""Fingerprints against a plain version and against true resemblance."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from hitloom.llm import fingerprints as fp
from tests.llm.test_jaccard_join import shingles

SCHEMA = "doc_id long, text string, lang string, fingerprint string, range int"


def edited(rows: list[tuple]) -> list[tuple]:
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        out.append((d, t, len(t), e, after))
    return out


def run(spark, rows: list[tuple]):
    return fp.compare(spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)).collect()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "Über straße 𝒳𝒳 ok"), (4, "Über straße 𝒳𝒳 ok"), (None, "null id text"), (5, "a b c d e f g"), (6, "A b  c d e\tf g"), (7, "word " * 30_000), (None, None)]
    got = run(spark, rows)
    want = edited(rows)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(((d, n, hashlib.sha256(e.encode()).hexdigest()) for d, _, n, e, _ in want), key=key)
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[5].fingerprint == by[6].fingerprint != by[7].fingerprint
    assert by[1].fingerprint == by[2].fingerprint == "" and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert run(spark, []) == []
    (single,) = run(spark, [(9, "abcdef")])
    assert single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_estimates_resemblance(spark):
    rng = random.Random(4)
    rows, truth = [], []
    for i in range(60):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([30, 200, 600]))]
        cut = rng.randrange(len(base))
        other = base[:cut] + [f"v{rng.randrange(2000)}" for _ in range(len(base) - cut)]
        a, b = " ".join(base), " ".join(other)
        rows.append((i, a, b))
        truth.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    got = [r.l for r in df.select("i", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("l")).orderBy("i").collect()]
    errors = [x - y for x, y in zip(got, truth)]
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.25


def test_bins_hold_the_least_hashes(spark):
    text = " ".join(f"w{i}" for i in range(400))
    (hashes, minima), *_ = spark.range(1).select(fp.shingle_hashes(F.lit(text)), fp._minima(fp.shingle_hashes(F.lit(text)))).collect()
    least: dict[int, int] = {}
    for h in hashes:
        b = (h % (1 << 64)) >> 57
        least[b] = min(h, least.get(b, h))
    assert len(hashes) == 396 and sorted(least.values()) == sorted(minima)


def test_bins_probes_and_bits_against_a_plain_version(spark):
    import random
    import re

    import xxhash

    from hitloom.llm import fingerprints as fp

    def plain(text: str) -> str:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [xxhash.xxh64(w.encode(), seed=42).digest()[::-1] for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        shingles = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words + [len(words).to_bytes(4, "little")]] if words else []
        least: dict[int, int] = {}
        for parts in shingles:
            h = 42
            for part in parts:
                h = xxhash.xxh64(part, seed=h).intdigest()
            b = h * fp.BINS >> 64
            least[b] = min(least.get(b, h), h)
        if not least:
            return ""
        out = []
        for b in range(fp.BINS):
            at = b if b in least else next(p for k in range(fp.BINS) if (p := (fp.START[b] + fp.STEP[b] * k) % fp.BINS) in least)
            out.append(f"{least[at] % (1 << fp.BITS):0{fp.BITS // 4}x}")
        return "".join(out)

    rng = random.Random(2)
    texts = ["", " \n", "One", "one two THREE", *(" ".join(rng.choices(["Ab", "c", "déf", "g1", "𝒳", "hh"], k=n)) for n in (5, 6, 9, 40, 300))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", fp.fingerprint(fp.F.col("text")).alias("f")).collect()
    prints = [r.f for r in sorted(got)]
    assert prints == [plain(t) for t in texts]

    def likeness(a: str, b: str) -> float:
        if a == b or not a or not b:
            return float(a == b)
        same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, len(a), 2)) / fp.BINS
        return max(0.0, (same - 1 / 256) / (1 - 1 / 256))

    pairs = [(a, b) for a in prints for b in prints]
    told = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fp.likeness(fp.F.col("a"), fp.F.col("b")).alias("n")).collect()
    assert all(abs(r.n - likeness(r.a, r.b)) < 1e-12 for r in told)
