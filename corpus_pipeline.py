"""From raw documents to token ids: the operators of ``arborweb.llm`` in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The runner writes it as
Parquet and rereads it as the next stage's documents; ``run`` does that in the shared
folder. All stages but the last return the columns of documents.

Defined results, in every stage: an empty table gives an empty one; a null id is an id like
others where rows are kept, and names no group of copies; columns beside those a stage reads
are handed on as they are, whatever their names; texts of any length are read whole. The
stages say below what becomes of null texts, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborweb.llm import bpe, langid, mixing, quality, simhash
from arborweb.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known; ``und`` (a null text, or one without a letter) and scores
    that no language leads clearly go. Of languages of equal score the first by name counts;
    repeated rows are judged each by itself, and alike."""
    return langid.keep(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the likelihood ratio; null and empty texts fail the
    base rule. A score equal to the threshold stays; repeated rows are judged alike."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; of repeated rows one.
    Null and empty texts are copies of each other. A group without any id keeps the row whose
    text has the smallest hash."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to shares that grow with the square root of a source's size, shuffled.
    A null source is a source of its own; rows of equal id, null included, are drawn equally
    often. Null texts are copied like others."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row, repeated ones each. A null or empty
    text has no ids and decodes to no bytes."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL has no recurrent network, merge table and no connected components; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
