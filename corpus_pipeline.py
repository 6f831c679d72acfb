"""The training corpus: documents of known languages, not toxic, one of each group
of near copies, mixed to target weights and packed into sequences.

Each stage takes the documents that the one before has kept, and is written before
the next reads it, so a lost executor costs a stage at most.  All but the last return the
columns of documents.  A stage learns from the documents it gets: languages from
their column lang, toxicity from the table labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import jaccard, langid, mixing, packing, toxicity
from hearthline.llm.tables import table, written


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return langid.known(docs, langid.labelled_sample(docs.filter(~langid.is_held_out())))


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, folder, "labels")))


def join_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    return mixing.emitted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Python workers come here with what the stages before have left; the tokenizer
    remembers fewer words than on its own."""
    return packing.pack(docs, remember=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", join_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and tokenizers are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
