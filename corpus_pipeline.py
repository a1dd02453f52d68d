"""From raw documents to packed training sequences.

Each stage takes all that the one before kept: documents of poor quality go, of
exact copies one stays, of near copies one stays, personal data is taken out of the
texts, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blastradius.llm import exact_dedup, jaccard, packing, pii, quality
from blastradius.llm.common import table, workspace

#: Near copies have 80 of 100 shingles of five words in common.
NEAR_WORDS, NEAR_SHARE = 5, (80, 100)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=NEAR_WORDS, share=NEAR_SHARE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("best-fit packing", sequences),
]

#: No stage but the second can be said in SQL. Tests hold the copies, near copies and base spans against brute force, and
#: the packing against its rules; of the whole only that what the stages keep is packed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    ws, docs = workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
