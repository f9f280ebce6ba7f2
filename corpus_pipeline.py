"""The corpus pipeline over documents: quality rules, quality classifier, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_crf, minhash, ngram_lm, packing, pii
from tessera.llm.common import materialize, table
from tessera.llm.registry import BPE_JSON, PII_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the counts nor the line labels reject."""
    chain = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.apply_rules(docs, chain).where("kept").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return ngram_lm.keep_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of five-word shingle sets of Jaccard similarity 0.8 or more."""
    return minhash.keep_first(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for entities; n_chars follows the text."""
    return pii.replace_pii(docs, PII_KEY, length_col="n_chars").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs, public_tokenizers.path(BPE_JSON), public_tokenizers.PATTERN, end_id=1, max_length=2048, added=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL can express neither the line labels nor the byte-pair ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
