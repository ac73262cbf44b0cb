"""The corpus pipeline: toxic documents go, exact and near copies go, personal data is masked, what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import pii, toxicity
from lodestone.llm.common import documents, drop_written, written, written_so_far
from lodestone.llm.exact_dedup import keep_rows
from lodestone.llm.packing import pack_documents
from lodestone.llm.queries import VOCABULARY, vocabulary
from lodestone.llm.simhash import keep_representatives


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels that aren't held out, scores below one half.

    A null text is an empty one, which stays; equal texts fare alike; rows that repeat an id each count. Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for the case of A-Z: the one with the largest doc_id.

    Null and empty texts are one group. A null id loses against any other; of rows that repeat id and text one stays.
    """
    return keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of SimHash fingerprints connect: the one with the smallest doc_id.

    Texts without words, null ones too, are one group. Rows that share the id that stays all stay; null ids stay only where a
    group has no other.
    """
    return keep_representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it masked; n_chars follows the text.

    A null text stays null, with a null n_chars; repeated rows are masked alike.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is one token; rows that repeat an id each get their pieces.
    """
    return pack_documents(docs, vocabulary(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: The fingerprints, spans and packings of the stages are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each but the last written and read again; what a stage wrote on its way is deleted then."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        begun = written_so_far()
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, set(written_so_far()) - set(begun), keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
