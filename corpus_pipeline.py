"""From documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import bpe, jaccard, mixing, secrets, toxicity
from tesserine.llm.common import settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go. Null and empty texts stay; repeated rows share
    one verdict, rows of equal or null doc_id have their own; without documents there are no rows."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: five-word shingles, similarity 0.8 or more.
    Texts without words, and rows without an id that nothing with an id resembles, stay."""
    return jaccard.keep_one(docs, size=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials of few owners are replaced in the text; widely copied examples stay, and so do
    all rows, null texts included. A null source is an owner of its own."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned out to their target weights, null a source of its own. Texts without words
    have size 0; an empty table gives no rows."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to; a row a row, null text as empty."""
    return bpe.encode_docs(docs, bpe.vocabulary(), decode=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: The classifier and the tokenizer can't be stated in SQL; each stage's operator is tested against brute force
#: (mixing against SQL), and the stages in a row on planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
