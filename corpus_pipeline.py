"""A corpus in five stages: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes the session, the documents that its predecessor kept, and the folder of the other tables. Null and
empty texts pass all stages but the third, where they are one group; rows with a null id are judged by their text alone
and never dropped as copies; repeated rows share every verdict and give one row behind the third stage. Columns beyond
those of `documents`, of any name, pass the first four stages. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import materialize, table
from tessella.llm.decontam import decontaminate
from tessella.llm.jaccard import keep_one_per_group
from tessella.llm.linededup import line_dedup
from tessella.llm.mixing import mix
from tessella.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; every document stays, with its new length."""
    return line_dedup(docs, n_chars="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: candidates by SimHash anchors, linked by a Jaccard similarity of five-word shingles of 0.8 or more."""
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes from each: size, source_size, target and taken are added."""
    return mix(docs, keep=("text", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: The fingerprints, the learned lexicon and the latent space have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
