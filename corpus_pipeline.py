"""Corpus pipeline: documents to token ids in five stages, each a Parquet table in the shared folder.

toxicity -> near-duplicates -> personal data -> mixture -> token ids. Every stage works on all rows
of the one before it. All but the last return the columns of documents, and more if documents has
more; columns of names that a stage adds for itself are not among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import mixing, pii, sentence_pieces, simhash, toxicity
from creditloom.llm.catalog import PIECES
from creditloom.llm.common import kept_in_store, table
from creditloom.session import pin_settings


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold.

    The network learns from the labels in ``sf_dir``. Empty and null texts are scored as no words;
    a document without a label or a doc_id is scored like any other.
    """
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, net, "_toxicity_score")
    return scored.where(F.col("_toxicity_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every group of near-duplicates."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact_personal_data(docs, pii.fit_spans(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time perhaps in part.

    A row stands for one repeat. Where a source's time ends within a document, the row holds the
    words it got: the text up to the end of the last of them.
    """
    return mixing.mixed_documents(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts."""
    return sentence_pieces.encode_documents(docs, sentence_pieces.load_encoder(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("personal_data", redact),
    ("source_mix", mix_sources),
    ("sentence_pieces", encode),
]

#: Networks, hashes and piece tables are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    pin_settings(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_in_store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
