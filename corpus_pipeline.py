"""A corpus pipeline of five stages over documents, each written as a table and read again by the next.

Defined results: null and empty texts are scored like any other by the classifier, are near-copies of nothing (rows that
repeat both id and text leave one), hold no secret, have size 0 and are kept once by the mix, and have no tokens; null ids are an id of
their own, a null source a source of its own; repeated rows and copies leave one row after the second stage; very long texts
pass whole; further columns pass through all stages but the last, whatever their names; empty tables pass all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import bpe, mixing, ngram_join, quality, secrets
from chunkloom.llm._common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts; it is fitted to the labelled ones among docs, without the held-out fold."""
    return quality.accepted(docs, quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id stays."""
    return ngram_join.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces owner-specific secrets in the texts; the documents stay."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the token ids, a row for each copy in the mix."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("ids",))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]
#: SQL can express neither the classifier nor the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
