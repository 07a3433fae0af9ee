"""A training corpus from raw documents: classify, deduplicate, mask, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import dedup, mixing, pieces, pii, quality
from wattline.llm.store import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that importance resampling rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word runs, 80 per cent): the smallest id."""
    return dedup.drop_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data masked in the text, ``n_chars`` set anew."""
    return pii.mask(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight; a document taken twice is two rows."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    coded = pieces.encode(docs)
    return coded.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("sentencepiece", token_ids),
]

#: Hash models, learned classifiers and piece merges have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, the rows of each stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
