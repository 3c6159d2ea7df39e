"""From raw documents to packed training sequences, as stages that each read what the one before kept.

Language ID drops what is in no learned language, the Jaccard join keeps one document of each group of near
copies, suffix-array dedup cuts long repeated passages, personal data is masked, and what is left is
packed. All but the last stage keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import jaccard_join, language_id, packing, pii, suffix_dedup
from hitloom.llm.shared import dropped, written

#: SQL has neither the automata nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without a letter, and long noise go.

    The automata learn from labelled rows outside the held-out fold, as in the query of its own.
    Repeated rows, null ids and other columns stay as they are; an empty table gives an empty one.
    """
    return language_id.known(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (null ids last).

    Rows without words belong to no group and stay, also repeated ones; other columns stay as they are.
    """
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; those with nothing left stay as empty texts.

    Null texts stay null, and repeated rows of WIDTH bytes or more lose their text in full; n_chars follows the text.
    """
    return _sized(suffix_dedup.remove(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts masked; null texts stay null and n_chars follows the text.

    Repeated rows are masked alike, null ids and other columns of any name stay, an empty table gives an empty one.
    Of spans that overlap the first one is masked, of equal starts the shorter one.
    """
    return _sized(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null and empty texts are one end token.

    Repeated rows and null ids are packed each for itself, other columns are ignored, an empty table gives no rows.
    Of bins that serve the rule alike the tightest takes a piece.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is deleted once the next one has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
