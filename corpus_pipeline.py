"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and packing, one after the other.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet
and read again before the next. All but the last return the columns of documents, by COLUMNS; further columns
that a caller's documents may have, whatever their names, end there.

Defined results, beyond those of the operators: an empty table stays empty through all stages; null and empty texts
are kept by the first two stages, are one class of near-duplicates, are mixed as documents of size 0 and are packed as
their end id alone; rows without a doc_id, source or label take part like others; rows that repeat are one
class of near-duplicates, so one is left; very long texts are whole in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import line_dedup, mixing, packing, simhash, toxicity
from ledgerspark.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Null and empty texts get the model's intercept; repeated rows are judged alike."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score_toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier run; n_chars is the new length (null for a null text).

    A document all of whose lines repeat earlier ones stays with an empty text; ties go by doc_id, null first.
    """
    return line_dedup.line_dedup(docs).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the least doc_id's, null last; unlike texts under one doc_id all stay."""
    return simhash.near_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most; a null source is a source of its own."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences; rows that the mix repeats are packed each."""
    return packing.packed_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, rolling line ends and tokenization have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
