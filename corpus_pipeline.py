"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

toxicity and quality rules drop the documents that they reject, near-dedup keeps one document of each class, substring
dedup cuts repeated units out of the texts, and packing returns the pieces with bucket, batch and slot.

Defined cases, for every stage: NULL, empty and blank texts pass toxicity (they get the base score), fail the quality rules
(no words) and otherwise stay as they are; of rows that are equal in id and text near-dedup keeps one, as of all near
copies, and a NULL id ranks last; very long texts are read whole; a table without the column source has no hosts; an empty
table gives an empty result. Further columns of any name are passed on unchanged up to packing, which returns them beside
its own unless they have the name of one of these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import host_rules, near_duplicates, packing, substrings, toxicity
from fieldspark.llm.text import spooled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _judged(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows with the columns of ``docs``, whatever these are called: the stage sees further ones under other names."""
    others = {c: f"carried_{k}" for k, c in enumerate(docs.columns) if c not in COLUMNS}
    plain = docs.withColumnsRenamed(others)
    kept = stage(plain).select(*plain.columns)
    return kept.withColumnsRenamed({name: c for c, name in others.items()})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return _judged(docs, lambda d: toxicity.score(d, model).filter("predicted = 0"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not refused."""

    def stage(plain: DataFrame) -> DataFrame:
        hosted = plain if "source" in plain.columns else plain.withColumn("source", F.lit(None).cast("string"))
        return host_rules.judge(hosted).filter("kept")

    return _judged(docs, stage)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines and sentences that an earlier one has."""
    return _judged(docs, substrings.drop_repeats)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their length bucket, batch and slot."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_lengths),
]

# The first stage learns a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = spooled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
