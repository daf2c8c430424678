"""The corpus pipeline: cleaning, language, near-duplicates, repeated passages, packing.

``STAGES`` are functions of ``(spark, docs, sf_dir)``; each gets what the one before wrote.
All but the last return the columns of ``documents``:

* quality drops failing lines and rejected documents,
* language drops documents whose language is unclear and fills in missing languages,
* near_duplicates keeps the document with the smallest id of each group of texts whose
  five-word shingles have a Jaccard similarity of 0.8 or more,
* repeated_passages removes words in passages of 50 that an earlier document has,
* packing returns the pieces of all documents in sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from buildlens.llm import alike, language, packing, quality, substring
from buildlens.llm.common import ready, store, table
from buildlens.llm.tokens import vocabulary_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned(docs)


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return language.recognised(docs, language.fit(language.learnable(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return alike.one_of_each(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_text(VOCABULARY))


STAGES = [
    ("quality", clean),
    ("language", recognise),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_passages),
    ("packing", pack),
]

# Hashes of shingles, compression and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
