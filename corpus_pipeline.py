"""From raw documents to packed training sequences: five stages, each over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from cartolith.llm.common import cut, table
from cartolith.llm.queries import tokenizer_path

#: No SQL: the toxicity model, the sketches and the tokenizer have no SQL form. Tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, all columns as they are.

    The model learns from the labelled ones among docs. Null and empty texts, which have no passage, stay; equal texts
    score alike, so repeated rows stay or go together; without labels of both kinds, or of an empty table, nothing goes.
    """
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-1])["score"] < 0.5).select(*[scored[c] for c in scored.columns[:-1]])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: of the most code points, then the smallest id; null texts are empty, null ids last."""
    return exact_dedup.keep_one_of_equals(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate class; null ids come last, and rows are told apart by id and text."""
    return near_dedup.keep_one_of_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and topic margins are raked to their damped targets.

    A null source or language is a value of its own; documents without words carry no weight and stay; rows of one id
    are decided alike; an empty table stays empty.
    """
    mixed = mixing.mix_documents(docs)
    return mixed.where(F.col(mixed.columns[-1])["kept"]).select(*[mixed[c] for c in mixed.columns[:-1]])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a null or empty text is one piece of the end id; repeated rows are packed each by itself."""
    return packing.pack(docs, tokenizer_path(), remember=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
