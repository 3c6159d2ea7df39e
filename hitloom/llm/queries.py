"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hitloom.llm import bpe, clustering, fingerprints, jaccard_join, language_id, packing, pii, ranking, sharding, suffix_dedup, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """Vocabulary files are installed beside Python on every machine and are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings")).drop("measured")


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_topk": op3_topk,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_clustering": op11_clustering,
    "op12_ranking": op12_ranking,
    "op13_toxicity": op13_toxicity,
}


def _moved(n: int) -> str:
    """Assignment n of all vectors, and the centroids after it."""
    return f"""
    d{n} AS (SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM kept, c{n}),
    a{n} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{n} GROUP BY r),
    s{n} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY j, i),
    m{n} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::bigint ORDER BY i) AS c FROM s{n} GROUP BY j),
    c{n + 1} AS (SELECT j, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (j))"""


_FINITE = "list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0"

ORACLE_SQL: dict[str, str] = {
    "op11_clustering": f"""
    WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS v
        FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept QUALIFY j < 16),
    {",".join(_moved(n) for n in range(4))}
    SELECT vec_id, j::int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia,
        sha256(array_to_string(c3.c, ',')) AS centroid_sha256
    FROM a3 JOIN c3 USING (j)""".replace("AS (SELECT", "AS MATERIALIZED (SELECT"),
    "op12_ranking": r"""
    WITH said AS MATERIALIZED (SELECT rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
    tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM said GROUP BY r, term),
    doc AS MATERIALIZED (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM said GROUP BY r),
    total AS MATERIALIZED (SELECT count(*)::bigint AS n, sum(n)::bigint AS l FROM doc),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    gain AS (SELECT item_id, term, count(*) * floor(1000 * ln((2.0::double * total.n + 2) / (2 * df + 1)))::bigint AS gain FROM asked JOIN df USING (term), total GROUP BY item_id, term, df, total.n),
    scored AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(gain * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * doc.n * total.n) // total.l))))::bigint AS score
        FROM gain JOIN tf USING (term) JOIN doc USING (r), total GROUP BY item_id, r),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20""",
}
