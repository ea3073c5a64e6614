"""A corpus through five stages: toxicity, exact dedup, near dedup, mixing to target weights, packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerloom.llm import common, exact, mixing, packing, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go.

    Null and empty texts are scored by the intercept alone; rows with a null id, repeated rows and columns of any name stay
    or go by their text. Without labels of both kinds every score is 0.5, which counts as toxic, and nothing stays.
    """
    model = toxicity.learn(docs, common.labels(spark, sf_dir))
    return docs.filter(toxicity.score_column(spark, model) < 0.5)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty ones are equal), the document with the smallest id stays; one of several rows under it."""
    return exact.without_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints (all without words are), the one with the smallest id stays; one row of it."""
    return simhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its schedule: documents as often as it takes them, cut at the edges of its blocks.

    A null source is a source; texts without words take no place in a mix.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: the token ids of each piece of each document, and where in which sequence they lie."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
