"""A corpus pipeline of five stages, each of which calls one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causaltape.llm import bpe, decontamination, pii, queries, similar_documents, simhash, toxicity
from causaltape.llm.shared import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores under 0.3, learnt from the labels of those that are not held out."""
    model = queries.toxicity_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_harmless(docs, model, threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by fingerprints within two bits (three-word shingles) or by a five-word-shingle
    similarity of 0.8 or more, the smallest id. Fingerprints find copies; the similarity adds edits that move more bits."""
    near = simhash.near_duplicates(docs, shingle=3, radius=2).select("doc_id", "component_id")
    return similar_documents.keep_one(docs, shingle=5, least=0.8, also=near)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at a five-word-shingle similarity of 0.8 or more."""
    return decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"), shingle=5, least=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs, path, keep=("lang", "source", "n_chars", "text"), decoded=True)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: No SQL can express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
