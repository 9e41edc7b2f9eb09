"""A training corpus in five stages: clean of toxic texts, in known languages, without near-duplicates, mixed
to target weights, and encoded.

Every stage works on all rows that the one before it kept, is written as Parquet into the shared folder, and is read
back by the next, and goes once the next is written. Null and empty texts have no language, so the second stage rejects them;
repeated rows fall to the third. Texts of any length are taken whole, columns with other names are carried along up to the last stage, which
returns its own. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parallaxis.llm import bpe, language, mixing, neardup, toxicity
from parallaxis.llm.common import discard, table, written
from parallaxis.llm.queries import tokenizer_path

#: A document goes if its language can't be told with this much confidence.
LEAST_LANGUAGE_SCORE = 0.5
#: Near-duplicates share this percentage of their shingles of so many words. op9_minhash_near_dup has its own, 3 and 85.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def in_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.in_languages(docs, language.fit(language.learnable(docs)), LEAST_LANGUAGE_SCORE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded, and their digests."""
    return bpe.digests(bpe.round_trip(docs, tokenizer_path()), "ids", "decoded")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("language", in_known_languages),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The trained stages can't be put in SQL; tests hold run() against a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
