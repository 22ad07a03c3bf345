"""From documents to packed training sequences, in stages that are each written and read again.

All stages take whole texts of any length, keep columns that they do not know, give no rows for an
empty table, and run jobs while they are called, as operators write what they read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, language, packing, simhash, suffixes
from tessera.llm.common import materialize, read_table, release
from tessera.llm.tokenizing import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with a score of 0.5 or more; null texts and those without letters go, ids are not looked at."""
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the one with the largest id; null ids are the smallest, of repeated rows one stays."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each SimHash component; rows without an id stay, of rows that share the id one stays."""
    return simhash.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of suffixes.PASSAGE_BYTES that repeat anywhere; texts may become empty, null ones do."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; an empty text is one end token, repeated rows are packed one by one."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("best-fit packing", pack),
]

#: Learned labels, SimHash components and packing are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes once the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        done, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            release(done)
    return docs
