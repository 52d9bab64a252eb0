"""A training-data pipeline over ``documents``.

Language identification, toxicity, SimHash near-dedup and best-fit packing, each on
all rows that the stage before it kept.

Cases: null and empty texts have no language and go in the first stage, as do all rows if
none is labelled; null labels teach nothing; rows that repeat an id count one by one until
near-dedup keeps one of them; without labels nothing is toxic; empty tables pass through;
extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markovine.llm import langid, packing, registry, simhash, toxicity
from markovine.llm._common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows' own ``lang``; rows without a letter or without a clear
    language go."""
    return langid.keep_identified(docs, langid.train(docs, "lang"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from ``labels.toxic``; rows that score 0.3 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact or near copies stays, that of the smallest id; copies
    share 0.8 or more of their five-word shingles."""
    return simhash.keep_dissimilar(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token ids in packed sequences, no two documents of one source or of one
    group of alike fingerprints in a sequence; returns where each document's pieces lie."""
    path = packing.write_sequences(docs, clusters=simhash.text_components(docs), tokenizer=registry.tokenizer_path("byte_bpe_50k.json"))
    return packing.read_pieces(spark, path, width=4)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
