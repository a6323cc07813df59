"""A training corpus from raw documents: reject junk, drop exact and near copies, remove secrets, pack.

Every stage reads all that the stage before it kept. Results between stages are written as Parquet to the shared
folder and read again, so a lost executor costs one stage's work at most.

Null texts count as empty in every stage: their quality is judged as of an empty text, they equal empty texts, and what
stays of them keeps its null until packing, where an empty text is its end mark alone. Rows without id are judged by the
classifier and by exact dedup like others (of equal texts a row with an id stays before one without); near-dedup keeps
all that are left, as they have no id to stand for a group. Of equal texts the row of the largest id stays, of near copies
the rows of the smallest id; of rows that repeat an id with unlike texts all stay that are no copies. Secrets are replaced,
nothing is dropped for them. Texts of any length are read whole. An empty table gives an empty table; columns besides
doc_id and text pass through all stages but the last unchanged (n_chars follows the text where secrets went).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import exact, packing, quality, secret_scan, simhash
from tidelog.llm.common import Scratch, cut, remove, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, quality.fit(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact.keep_one(docs, keep="largest")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one document stays."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by marks."""
    return secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: A learned score, fingerprints of whole texts and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as files:  # what a stage writes on its way goes when its result is written
            after = files.keep(cut(stage(spark, docs, sf_dir), name))
        remove(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
