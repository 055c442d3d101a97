"""A corpus pipeline of five stages, each of which reads what the one before it kept."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import decontamination, pieces, pseudonyms, quality, simhash
from veldt.llm.common import fresh, held, materialize, release, table

#: The setting that holds the key of the pseudonyms. Without it each run has a key of its own, which is not kept.
KEY = "spark.veldt.pseudonyms.key"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Documents link at a similarity of 0.8 or more of their five-word shingles, or if their 64-bit
    fingerprints of three-word shingles differ in two bits or fewer.
    """
    return simhash.keep_one(docs, similarity=0.8, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much benchmark text go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms; the number of characters follows."""
    (kinds,) = fresh(docs, "pii")
    found = pseudonyms.pseudonymise(docs, spark.conf.get(KEY, None) or secrets.token_hex(16), found=kinds).drop(kinds)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and the text decoded from them."""
    return pieces.encode_decode(docs).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", pseudonymise),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier, the tokenizer and the fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again.

    What a stage needed beside that is deleted as soon as its rows are written.
    """
    docs, before = table(spark, sf_dir, "documents"), held()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}", "snappy")
            release(spark, [*before, docs.written_to])
    return docs
