"""From raw documents to tokens: quality, near duplicates, benchmark passages, personal data, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
to the shared folder and reads it back for the next.  All but the last return the columns of
documents.  Nulls, empty texts, repeated rows and extra columns fare as in each operator's
docstring; an empty table passes through empty.  A stage bounds the bytes of the batches that
go to Python, if the session leaves that open.  Helper columns take names that documents do
not have; the last stage's results replace columns of their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import bpe, decontaminate, jaccard, pii, quality
from cohortkit.llm.common import free_names, staged, table
from cohortkit.llm.queries import KEEP
from cohortkit.session import TEXTS, tune


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    tune(spark, TEXTS)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs, 1)
    return docs.withColumn(score, quality.score(docs, model)).where(F.col(score) >= KEEP).drop(score)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    tune(spark, TEXTS)
    return jaccard.one_of_each(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    tune(spark, TEXTS)
    found = decontaminate.matches(F.col("text"), table(spark, sf_dir, "benchmark"))
    (name,) = free_names(docs, 1)
    return docs.withColumn(name, found).where(F.size(name) == 0).drop(name)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    tune(spark, TEXTS)
    hidden = docs.withColumn("text", pii.redact(F.col("text"), pii.fit_selector(docs)))
    if "n_chars" not in docs.columns:
        return hidden
    kind = docs.schema["n_chars"].dataType
    return hidden.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of what they decode to."""
    tune(spark, TEXTS)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", without_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("pii redaction", redacted),
    ("byte-level bpe", encoded),
]

#: Trained models and a tokenizer's merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
