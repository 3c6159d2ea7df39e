"""Tree encoding against the library, and decoding back."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from hitloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, n_tokens long"


def test_round_trip(spark, monkeypatch):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = ["the ", "don't", "'", "I've ", "é", "𝒳", "  ", "\n\n", "12", "345 ", "!?", "<|endoftext|>", " ", "aaaa", "\t", "ß", "0"]
    texts = [None, "", " ", "a" * 9_000, "ab" * 5_000, "7" * 5_000, "!" * 9_000, " " * 9_000, "é" * 9_000, "'" * 5_000, *("".join(rng.choice(alphabet) for _ in range(rng.choice([5, 300, 9_000]))) for _ in range(60))]
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA), PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).collect() == []


def test_small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 16)
    tree = bpe.tree(PATH, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", " ", "  ", "'s", "1", "é", "\n", ".", "the", "ing "]) for _ in range(rng.randint(1, 120)))
        ids = tree.encode(text)
        assert ids == tree.plain(text) and tree.decode(ids) == text.encode()
